import collections
import hashlib
import random
import re

import numpy as np

from scriptorium.llm import near_dedup as nd
from scriptorium.llm import shingles as sh
from scriptorium.llm import suffix_dedup as sd
from scriptorium.llm.components import connected_components
from scriptorium.llm.suffix_array import repeated_starts, suffix_array

from .conftest import prose, write_tables

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_copies(seed):
    """Documents with exact and near copies, chains, shared passages and short texts."""
    r = random.Random(seed)
    texts = {}
    for g in range(12):
        words = prose(seed * 100 + g, r.randrange(6, 300)).split()
        for _ in range(r.randrange(1, 9)):
            texts[len(texts)] = (" " if r.random() < 0.5 else "\n").join(words)
            if r.random() < 0.7:
                for _ in range(max(1, len(words) // 60)):
                    words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    shared = prose(seed, 80)
    for _ in range(10):
        texts[len(texts)] = shared + " " + prose(r.randrange(10**6), r.randrange(10, 60))
    texts |= {500: None, 501: "", 502: " ", 503: "one two", 504: "ONE  two", 505: "one two three"}
    return texts


def test_components_equal_brute_force(spark, tmp_path):
    for seed in (1, 2):
        texts = near_copies(seed)
        docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
        sets = {i: shingle_set(t) for i, t in texts.items()}
        want = brute_components(sets)
        rows = nd.op5_near_dedup(spark, write_tables(tmp_path / str(seed), documents=docs)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
            i: (len(sets[i]), want[i], want[i] == i) for i in texts}


def test_links_between_classes_that_the_leader_misses(spark, monkeypatch):
    """A chain whose ends share buckets with an unrelated leader is only found by the blocks."""
    monkeypatch.setattr(nd, "BLOCK", 2)
    texts = near_copies(3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_components({i: shingle_set(t) for i, t in texts.items()})
    assert {r.doc_id: r.component_id for r in nd.near_duplicates(docs).collect()} == want


def test_families_around_the_threshold(spark, monkeypatch):
    """Many candidates of one bucket, some of them alike: links must not be lost to pairs that fail."""
    for seed, block in ((1, 8192), (2, 8192), (3, 5)):
        monkeypatch.setattr(nd, "BLOCK", block)
        r, texts = random.Random(seed), {}
        for g in range(4):
            base = prose(seed * 10 + g, 70).split()
            for _ in range(70):
                words = list(base)
                for _ in range(r.randrange(0, 4)):
                    words[r.randrange(len(words))] = f"new{r.randrange(30)}"
                texts[len(texts)] = " ".join(words)
        want = brute_components({i: shingle_set(t) for i, t in texts.items()})
        docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
        assert {x.doc_id: x.component_id for x in nd.near_duplicates(docs).collect()} == want
        assert len(set(want.values())) > 20


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    rows = nd.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: r.component_id for r in rows}
    assert got[6] == 5 and got[12] == 11 and got[2] == 2 and got[4] == 4 and got[None] is None
    assert all(r.kept for r in rows if r.doc_id is None)
    assert nd.near_duplicates(no_docs).count() == 0


def test_pigeonhole_buckets_hold_every_close_pair():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = rng.integers(0, 2**32, nd.SLOTS, dtype=np.uint32)
        b = a.copy()
        wrong = rng.choice(nd.SLOTS, rng.integers(0, nd.MAX_ERRORS + 1), replace=False)
        b[wrong] ^= 1
        keys = nd.bucket_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def test_shingle_sets_of_a_batch_equal_those_of_its_texts():
    texts = [t or "" for t in near_copies(5).values()]
    raw = [t.encode() for t in texts]
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
    _, sizes = sh.shingle_sets(data, ends)
    assert sizes.tolist() == [len(shingle_set(t)) for t in texts]


def test_connected_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(edges.where("a < 0")).count() == 0


def test_suffix_array_and_repeats_equal_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(300):
        n = int(rng.integers(3, 200))
        a = rng.integers(1, int(rng.integers(2, 6)) + 1, n)
        if trial % 3 == 0:
            a = np.tile(a[: max(2, n // 4)], 5)
        if trial % 7 == 0:
            a = np.full(n, 2)
        t = np.concatenate([a, [0]]).astype(np.int16)
        order = suffix_array(t)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        size = int(rng.integers(1, 8))
        seen = collections.Counter(tuple(t[i : i + size]) for i in range(len(t) - size + 1))
        want = [i + size <= len(t) and seen[tuple(t[i : i + size])] > 1 for i in range(len(t))]
        assert repeated_starts(t, order, size).tolist() == want


def brute_removal(texts, length):
    seen = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def repeating_texts(seed):
    r = random.Random(seed)
    passages = [prose(seed + k, r.randrange(60, 200)) for k in range(5)]
    texts = {}
    for i in range(50):
        parts = [prose(1000 * seed + i, r.randrange(5, 100))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            parts += [p[r.randrange(50) :], prose(r.randrange(10**6), r.randrange(1, 30))]
        texts[i] = " ".join(parts)
    p = passages[0]
    return texts | {100: texts[3], 101: texts[3], 102: None, 103: "", 104: p + p + p, 105: "é" * 900, 106: "ab" * 700, 107: "x" * 399, 108: "x" * 400, 109: "short"}


def test_removal_equals_brute_force(spark, tmp_path):
    for seed in (1, 2):
        texts = repeating_texts(seed)
        docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
        want = brute_removal([(t or "").encode() for t in texts.values()], 400)
        rows = sd.op10_suffix_dedup(spark, write_tables(tmp_path / str(seed), documents=docs)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(zip(texts, want))


def test_hot_anchors_dealt_anew_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sd, "MAX_SHARD", 1)
    texts = repeating_texts(3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_removal([(t or "").encode() for t in texts.values()], 400)
    rows = sd.op10_suffix_dedup(spark, write_tables(tmp_path, documents=docs)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(zip(texts, want))


def test_removal_from_odd_rows(spark, odd_docs, no_docs):
    rows = {r.text: r for r in sd.remove_repeats(odd_docs).collect()}
    assert len(rows) == odd_docs.selectExpr("coalesce(text, '') t").distinct().count()
    assert max(r.n_removed for r in rows.values()) == len(prose(1, 3000))
    assert sd.remove_repeats(no_docs).count() == 0


def test_candidates_of_a_family_are_stars(spark):
    """Buckets that hold different members of one family link them to its smallest class, each once."""
    rows = [(k, 0, 0, 0, i, i, b"\1" * 4 * nd.SLOTS, b"\1" * nd.WIDE) for k in range(10) for i in range(40) if i == 0 or i % 10 != k]
    rows += [(99, 0, 0, 0, i, i, bytes([i]) * 4 * nd.SLOTS, bytes([i]) * nd.WIDE) for i in (50, 51)]  # far apart
    df = spark.createDataFrame(rows, "key bigint, i bigint, j bigint, block bigint, id bigint, component bigint, sig binary, wide binary").repartition(1)
    got = sorted(tuple(r) for r in nd._links(df, ("key", "i", "j"), None).collect())
    assert got == [(i, 0) for i in range(1, 40)]
