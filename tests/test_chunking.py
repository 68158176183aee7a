"""Packing, trimming and the chunk job (FIXTURES.md cases + brute force)."""

import re
import string

from pyspark.sql import functions as F

from scriptorium.functions.text import split_sentences
from scriptorium.operators import chunking as ch
from scriptorium.operators.filters import trim_sentences


def pack(spark, sentences, mx):
    df = spark.createDataFrame([(sentences,)], "s array<string>")
    return ch.with_packed_chunks(df, "s", mx).first().chunks


def test_packing_cases(spark):
    assert pack(spark, ["a b c.", "d e.", "f g h i."], 5) == ["a b c. d e.", "f g h i."]
    assert pack(spark, ["a b c d e f.", "g."], 5) == ["", "a b c d e f.", "g."]
    assert pack(spark, ["a.", "b c d e f g."], 5) == ["a.", "b c d e f g."]
    assert pack(spark, [], 5) == []


def test_trim_cases(spark):
    def trim(n, a, b):
        df = spark.createDataFrame([([str(i) for i in range(1, n + 1)],)], "s array<string>")
        return df.select(trim_sentences(F.col("s"), a, b).alias("t")).first().t

    assert trim(10, 2, 3) == ["3", "4", "5", "6", "7"]
    assert trim(6, 2, 3) is None
    assert trim(60, 50, 25) == []
    assert trim(50, 50, 25) is None
    assert trim(10, 10, None) is None
    assert trim(10, None, 4) == ["1", "2", "3", "4", "5", "6"]


PAT = r"(?<!\d)(?<!\w\.\w)(?<![A-Z][a-z]\.)(?<=\.|\?)(?<!\d\.)\s"


def brute_chunks(text, mx, a, b):
    s = re.split(PAT, text)
    if a and not b:
        assert a < len(s)
        s = s[a:]
    elif b and not a:
        assert b < len(s)
        s = s[:-b]
    elif a and b:
        assert b + b < len(s)
        s = s[a:-b]
    out, cur, cnt = [], [], 0
    for x in s:
        w = len(x.split())
        if cnt + w > mx:
            out.append(" ".join(cur))
            cur, cnt = [], 0
        cur.append(x)
        cnt += w
    if cur:
        out.append(" ".join(cur))
    return out


def test_pack_chunks_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.chunk_id): r.sequence for r in ch.pack_chunks(docs, 40, 1, 2).collect()}
    exp = {}
    for r in docs.collect():
        try:
            for i, c in enumerate(brute_chunks(r.text, 40, 1, 2)):
                exp[(r.doc_id, i)] = c
        except AssertionError:
            pass
    assert got == exp


def test_chunk_job_quirks(spark):
    long_first = "a b c d e f. g."
    rows = [(1, "annual", None, long_first), (2, "current", "EX-99", long_first), (3, "news", None, None),
            (4, "current", "EX-99.5", "kept? no."), (5, "news", None, "a b c d. e f g h.")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, doc_type string, text string")
    prof = {"annual": ch.ChunkProfile(), "current": ch.ChunkProfile(None, None, 0.0), "news": ch.ChunkProfile()}
    out = {(r.doc_id, r.chunk_id): r.sequence for r in ch.chunk_corpus(docs, prof, chunk_words=5).collect()}
    # annual: empty first chunk -> whole document excluded (Q2); current: '' is emitted (Q3)
    assert (1, 0) not in out and (1, 1) not in out
    assert out[(2, 0)] == "" and out[(2, 1)] == "a b c d e f."
    assert (4, 0) not in out  # exhibit type not kept
    assert out[(5, 0)] == "a b c d." and out[(5, 1)] == "e f g h."
    rep = {r.source: r for r in ch.chunk_report(docs, prof, chunk_words=5).collect()}
    assert rep["annual"].n_excluded == 1 and rep["annual"].n_raw_chunks == 3 and rep["annual"].n_kept_chunks == 0
    assert rep["news"].n_documents == 2 and rep["news"].n_excluded == 1  # the NULL text
    assert rep["current"].n_documents == 2


def test_results_independent_of_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", F.lit("news").alias("source"), F.lit(None).cast("string").alias("doc_type"), "text")
    prof = {"news": ch.ChunkProfile(1, 1, None)}
    a = sorted(ch.chunk_corpus(docs, prof, 50).collect())
    b = sorted(ch.chunk_corpus(docs.repartition(7), prof, 50).collect())
    assert a == b and len(a) > 0


def test_streaming_packer_equals_the_native_one(spark):
    import random

    r = random.Random(2)
    pieces = ["Mr. Smith went.", "1. 5 is it?", "U.S. economy rose.", "a  b\tc", "Is it?", "x" * 30, "é b.", "\x1cq\x1d.", "no end", "9.", "Yes. No.", "　w."]
    texts = [None, "", " ", ".", "? ", "A. ", "\n"] + ["".join(r.choice(pieces) + r.choice([" ", "\n", "  ", " ", "\x85"]) for _ in range(r.randint(1, 40))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for first, last in ((None, None), (2, None), (None, 2), (2, 3), (0, 0), (50, 1)):
        native = ch.pack_chunks(df, 7, first, last).collect()
        assert sorted(native) == sorted(ch.pack_long_documents(df, 7, first, last).collect())
        assert sorted(native) == sorted(ch.pack_chunks(df, 7, first, last, long_text=40).collect())


def test_a_document_of_100_megabytes(spark):
    sentence = "The quick brown fox jumps over the lazy dog again today."
    n = 100 * 1024 * 1024 // (len(sentence) + 1) + 1
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit(sentence), n), " ").alias("text"))
    got = ch.pack_chunks(df, 200, 50, 25).agg(F.count("*").alias("n"), F.max("chunk_id").alias("last"), F.sum(F.length("sequence")).alias("c")).first()
    kept, per = n - 75, 200 // 11
    chunks = -(-kept // per)
    assert (got.n, got.last) == (chunks, chunks - 1) and got.c == kept * len(sentence) + kept - chunks
