import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import decontamination as dec
from scriptorium.llm import merkle, oracles, resampling
from scriptorium.llm.words import word_lists, word_places

from .conftest import prose, write_tables

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words_of(t):
    return WORD.findall(lower(t))


def features(t):
    w = words_of(t)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 20))
def test_words_do_not_depend_on_the_slices(t, limit):
    t = t.encode("utf-8", "ignore").decode()
    got = [w.decode() for ws in word_lists(t.encode(), limit) for w in ws]
    assert got == words_of(t)
    assert [lower(t[a:b]) for a, b in word_places(t)] == got


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bb", "é", "7", "zz-"]), max_size=30))
def test_features_cross_slices(ws):
    import scriptorium.llm.words as words

    t, before = " ".join(ws), resampling.word_lists
    resampling.word_lists = lambda data: words.word_lists(data, 4)
    try:
        parts = list(resampling._features(t.encode()))
    finally:
        resampling.word_lists = before
    assert sum(n for n, _ in parts) == len(words_of(t))
    assert Counter(h % 10000 for _, hs in parts for h in hs) == Counter(features(t))


def brute_resampling(docs, target):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in range(10000)]
    out = []
    for i, x in docs:
        f = features(x)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * 5 // 100]):
        r[4] = k + 1
    return sorted((r[:5] for r in out), key=str)


def test_resampling_equals_brute_force(spark, odd_docs):
    target = spark.createDataFrame([(0, prose(500, 80)), (1, None), (2, "Plain text")], "item_id bigint, text string")
    more = spark.createDataFrame([(i, prose(i, 30 + i % 50) + (" plain TEXT with words" * (i % 3)), "x") for i in range(100, 300)],
                                 "doc_id bigint, text string, score string")
    docs = odd_docs.unionByName(more).withColumn("rank", F.lit("clash")).withColumn("weight", F.lit(1))
    got = sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in resampling.resample(docs, target).collect()), key=str)
    want = brute_resampling([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got == want and sum(r[4] is not None for r in got) > 5


def test_resampling_of_empty_tables(spark, no_docs, odd_docs):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, nothing).count() == 0
    assert resampling.resample(odd_docs, nothing).count() == odd_docs.count()


def test_radix_ranks_sort_by_all_keys_and_are_stable(spark):
    big = (1 << 62) + 5
    rows = [(i, [None, -big, -3, -3, 0, 7, big][i % 7], (i * 37) % 11 - 5) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a bigint, b bigint").repartition(5, "i")
    for descending in (False, True):
        got = {r.i: r.place for r in resampling.radix_ranks(df, [("a", descending), ("b", False)], "place", digit_bits=5, block_bits=4).collect()}
        assert sorted(got.values()) == list(range(1, 401))
        order = sorted(got, key=got.get)
        keys = [(rows[i][1] is None, 0 if rows[i][1] is None else -rows[i][1] if descending else rows[i][1], rows[i][2]) for i in order]
        assert keys == sorted(keys)
    # With one value for all keys the order of the input stays.
    same = spark.range(50, numPartitions=1).select("id", F.lit(3).cast("long").alias("k"))
    assert all(r.id + 1 == r["rank"] for r in resampling.radix_ranks(same, [("k", True)], block_bits=3).collect())
    assert resampling.radix_ranks(same.limit(0), [("k", True)]).count() == 0


def brute_merkle(rows, arity=8):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(part, (*r[:4], text))))

    def tree(leaves):
        """(root, siblings and slot of every leaf, level by level)."""
        ways, nodes, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
        while len(nodes) > 1:
            runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
            for k in range(len(leaves)):
                run, slot = runs[at[k] // arity], at[k] % arity
                ways[k].append((run[:slot], run[slot + 1 :]))
                at[k] //= arity
            nodes = [sha("".join(r)) for r in runs]
        return nodes[0], ways

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[g] = tree([leaf(r, r[4]) for r in groups[g]])
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for r, way in zip(groups[g], trees[g][1]):
            way = way + top
            changed = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 0
            node = leaf(r, lower(r[4]) if changed and r[4] is not None else r[4])
            for a, b in way:
                node = sha("".join(a) + node + "".join(b))
            out.append((r[0], leaf(r, r[4]), trees[g][0], root, sha("".join("".join(a + b) for a, b in way)), node, node == root))
    return sorted(out, key=str)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")


def test_merkle_equals_brute_force(spark, tmp_path):
    # Languages of 1, 8, 9, 64 and 65 rows and of null, empty and non-ASCII name; nulls, ties and repeated rows.
    rows = [(None, None, None, None, None), (1, "s", "solo", 5, "Alone"), (2, "s", "", 0, ""), (4, None, "é", 9, "É Ünï TEXT")]
    rows += [(100 + i, "src", "a8", i, prose(i, 5).title()) for i in range(8)] + [(200 + i, "src", "b9", None, None if i == 3 else prose(i, 9).upper()) for i in range(9)]
    rows += [(300 + i % 50, "src", "c64", 1, f"Text {i}") for i in range(64)] + [(400 + i, "src", "d65", 1, f"TEXT {i}" * 300) for i in range(65)]
    rows += [(7, "src", "rep", 1, "Same")] * 20 + [(None, "src", "rep", 1, "Same")] * 3 + [(8, "x", "rep", 1, t) for t in ("A", "b", None)]
    docs = documents(spark, rows).withColumn("idx", F.lit("clash")).withColumn("leaf", F.lit(0)).withColumn("grp", F.lit("g"))
    got = sorted((tuple(r) for r in merkle.verify_documents(docs.repartition(5)).collect()), key=str)
    want = brute_merkle(rows)
    assert got == want and {r[6] for r in got} == {True, False}
    base = write_tables(tmp_path, documents=documents(spark, rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{base}/documents.parquet/*.parquet')")
    assert sorted(con.execute(oracles.OP12).fetchall(), key=str) == want


def test_merkle_of_few_rows_and_other_arities(spark):
    assert merkle.verify_documents(documents(spark, [])).collect() == []
    one = [(5, "s", "en", 1, "Only One")]
    assert [tuple(r) for r in merkle.verify_documents(documents(spark, one)).collect()] == brute_merkle(one)
    rows = [(i, "s", ["en", "de", None][i % 3], 1, f"Text {i}") for i in range(40)]
    for arity in (2, 3):
        assert sorted((tuple(r) for r in merkle.verify_documents(documents(spark, rows), arity).collect()), key=str) == brute_merkle(rows, arity)


def brute_passages(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for item, x in items:
            p = words_of(x)
            n = min(window, len(p))
            grams = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if p else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, prose(900, 40)), (2, "Short, ITEM"), (10, prose(900, 40)), (3, None), (4, ""), (5, "--"), (None, prose(901, 12)), (2, "Short, ITEM"),
         (6, "a a a a a a a a a a a a"), (7, prose(902, 10)), (8, "é Ünï")]


def leaky(spark, odd_docs):
    a, b = prose(900, 40).split(), prose(902, 10).split()
    rows = [(20, prose(3, 50) + " " + "; ".join(a[5:25]).upper() + "! " + prose(4, 20)), (21, " ".join(a[:9])), (22, " ".join(a[:10])),
            (23, "x short... item y SHORT\nitem"), (24, "a " * 30), (25, " ".join(b) + " " + " ".join(b)), (26, prose(901, 12)), (27, "ünï é Ünï é ünï"),
            (28, (" ".join(a[3:17]) + " gap ") * 400)]
    more = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, score string")
    return odd_docs.unionByName(more).withColumn("n_words", F.lit("clash")).withColumn("items", F.lit(0))


def digest(found):
    hit = F.aggregate(F.zip_with("f.ends", "f.starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = found.select("doc_id", "f.n_words", hit, F.size("f.items"), F.sha2(F.array_join("f.items", ","), 256), F.size("f.starts") > 0).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_passages_equal_brute_force_in_one_block_and_in_many(spark, odd_docs, no_docs, monkeypatch):
    docs = leaky(spark, odd_docs)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = brute_passages([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert sum(r[5] for r in want) >= 8
    assert digest(dec.find_passages(docs, items, out="f")) == want
    many = dec.find_passages(docs, items, out="f", block_words=30)
    assert digest(many) == want and many.columns == [*docs.columns, "f"]
    assert dec.find_passages(no_docs, items).count() == 0
    none = dec.find_passages(docs, items.limit(0), out="f")
    assert [r[2] for r in digest(none)] == [0] * docs.count()


def test_segments_hold_every_window(spark):
    long = prose(950, 300)
    items = spark.createDataFrame([(1, long, "an answer")], "item_id bigint, text string, answer string")
    parts = dec.segments(items, "item_id", ["text", "answer"], size=32).collect()
    w = words_of(long)
    held = {tuple(x[k : k + 10]) for x in (r.words.split() for r in parts) for k in range(len(x) - 9)}
    assert held == {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    assert [r.words for r in parts if r.n < 10] == ["an answer"] and max(r.n for r in parts) <= 32 + 9


def test_spans_of_passages_point_into_the_original(spark, odd_docs):
    docs = leaky(spark, odd_docs)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = dec.find_passages(docs, items, out="f").withColumn("spans", dec.passage_spans(F.col("text"), F.col("f")))
    for r in found.collect():
        w = words_of(r.text)
        assert [words_of(r.text[s.start : s.end]) for s in r.spans] == [w[a:b] for a, b in zip(r.f.starts, r.f.ends)]
        assert all(WORD.match(lower(r.text[s.start])) and WORD.match(lower(r.text[s.end - 1])) for s in r.spans)


def test_long_texts_are_read_whole(spark):
    passage = prose(903, 10)
    far = " ".join([prose(3, 120_000), passage, prose(5, 60_000)])
    docs = spark.createDataFrame([(1, far)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    r = dec.find_passages(docs, items, out="f").first()
    assert (r.f.n_words, r.f.starts, r.f.ends) == (180_010, [120_000], [120_010])
    s = resampling.resample(docs, items).first()
    assert s.n_features == len(features(far))
