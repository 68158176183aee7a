import collections
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import packing as pk
from scriptorium.llm import piece_sampling as ps

from .conftest import prose, write_tables


@pytest.fixture(scope="module")
def lattice():
    return ps.PieceLattice(ps.default_model(), 0.5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=60), min_size=1, max_size=5), st.integers(0, 9))
def test_every_sample_decodes_to_its_text(lattice, texts, seed):
    ids, n = lattice.sample(texts, np.arange(len(texts)), seed)
    data, sizes = lattice.spell(ids, n)
    at = np.concatenate([[0], np.cumsum(sizes)])
    assert [data.tobytes()[a:b].decode() for a, b in zip(at, at[1:])] == texts


def test_samples_follow_the_lattice_distribution(lattice):
    def paths(u):
        if not u:
            yield ()
        for j in range(1, len(u) + 1):
            if u[:j] in lattice.weights:
                for p in paths(u[j:]):
                    yield (lattice.weights[u[:j]], *p)

    weight = {tuple(i for i, _ in p): math.exp(sum(w for _, w in p)) for p in paths(" hello")}
    total = sum(weight.values())
    n = 20_000
    ids, made = lattice.sample(["hello"] * n, np.arange(n), 3)
    ends = np.cumsum(made)
    seen = collections.Counter(tuple(ids[b - m : b].tolist()) for b, m in zip(ends, made))
    for path, w in weight.items():
        p = w / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_encoding_is_lossless_and_depends_on_the_key_alone(spark, odd_docs, no_docs, tmp_path):
    rows = ps.op2_piece_sampling(spark, write_tables(tmp_path, documents=odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(r.lossless for r in rows)
    again = ps.op2_piece_sampling(spark, write_tables(tmp_path / "b", documents=odd_docs.repartition(5))).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_chars)
    assert [r.piece_ids for r in sorted(rows, key=key)] == [r.piece_ids for r in sorted(again, key=key)]
    assert [r.n_pieces for r in rows if r.doc_id in (2, 3)] == [0, 0]
    assert ps.decode_pieces(ps.encode_sampled(no_docs, "doc_id")).count() == 0


def brute_cost(places, costs, size):
    """Least cost by trying every window."""
    p, cut = [0, *places], [0, *costs]
    f = [0] + [None] * len(places)
    for i in range(1, len(p)):
        best = None
        for j in range(i):
            n = p[i] - p[j]
            if n <= size and f[j] is not None:
                pad = 0 if n in pk.SHORT_POWERS and n < size else size - n
                c = f[j] + pad + pk.WINDOW + cut[i]
                best = c if best is None or c < best else best
        f[i] = best
    return f[-1]


def test_cuts_cost_as_little_as_possible(monkeypatch):
    monkeypatch.setattr(pk, "SHORT_POWERS", (16, 8))
    monkeypatch.setattr(pk, "_split_tail", lambda ends, size: ends)
    r = random.Random(4)
    for _ in range(200):
        steps = [r.randrange(1, 20) for _ in range(r.randrange(1, 30))]
        places = np.cumsum(steps)
        costs = np.array([r.choice([0, 2, 16]) for _ in steps])
        ends = pk.choose_cuts(places, costs, 32)
        at = dict(zip(places.tolist(), costs.tolist()))
        spent, start = 0, 0
        for e in ends:
            n = e - start
            assert 0 < n <= 32
            spent += (0 if n in (16, 8) else 32 - n) + pk.WINDOW + at[e]
            start = e
        assert start == places[-1] and spent == brute_cost(places.tolist(), costs.tolist(), 32)


def check_pieces(rows, texts):
    """Pieces lie gapless in documents and sequences; ids are those of the tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return by_seq


def test_packing_keeps_every_id_once(spark, tmp_path):
    texts = {i: prose(i, 50 + 37 * i) + ". " + prose(i + 100, 60) for i in range(60)}
    texts |= {100: None, 101: "", 102: "x <|endoftext|> y", 103: "é😀\n\n\t 中文" * 500, 104: "a" * 5000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    seqs = check_pieces(pk.op3_packing(spark, write_tables(tmp_path, documents=docs)).collect(), texts)
    used = [sum(r.length for r in s) for s in seqs.values()]
    pad = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used)
    assert pad < 0.03 * sum(used)


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    rows = pk.pack_documents(odd_docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1
    assert sum(r.length for r in rows if r.doc_id == 7) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 7)
    assert any(r.doc_id is None for r in rows)
    assert pk.pack_documents(no_docs).count() == 0


def test_the_two_vocabulary_files_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    bpe, tok = pk.ByteBpe(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["", " ", "it's  we'll", "中文 abc\n\n x", "١٢٣ ⅷ ²", " a b", "😀" * 20, "a" * 300, "🇩🇪 é"]:
        assert bpe.encode(t) == tok.encode(t, add_special_tokens=False).ids
