"""replaced-token scores hold few numbers at once and need few Python workers."""

import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
from scriptorium.functions import random as rnd
from scriptorium.operators import masking, scores

from test_digest_tables import some_documents, workers_of_a_task


def test_a_task_has_two_python_workers(spark, tmp_path):
    assert workers_of_a_task(entry.q_replaced_token_scores(spark, some_documents(spark, tmp_path))) == 2
    ids = spark.createDataFrame([("a", [5, 6])], "row_key string, input_ids array<int>")
    assert workers_of_a_task(masking.replace_random(ids)) == 1


def test_uniforms_are_drawn_in_stretches(monkeypatch):
    monkeypatch.setattr(rnd, "_UNIFORMS_AT_ONCE", 100)
    monkeypatch.setattr(rnd.F, "arrow_udf", lambda kind: lambda f: lambda *_: f)
    sizes, run = [], rnd.md5_numbered
    monkeypatch.setattr(rnd, "md5_numbered", lambda heads, rows, numbers: sizes.append(len(rows)) or run(heads, rows, numbers))
    draw = rnd.hash_uniforms(29, type("K", (), {"cast": lambda self, kind: self})(), None)
    n = [0, 70, None, 60, 50, 0, 30, 0]
    keys = [f"k{i}" for i in range(7)] + [None]
    got = draw(rnd.pa.array(keys), rnd.pa.array(n)).to_pylist()
    want = [None if m is None else [int(hashlib.md5(":".join(["29", *([k] if k else []), str(i)]).encode()).hexdigest()[:13], 16) / 2**52 for i in range(m)]
            for k, m in zip(keys, n)]
    assert got == want and max(sizes) < 100 + 70 and len(sizes) > 2


def test_scores_of_lists_of_other_lengths_and_nulls(spark):
    rows = [("s", [1, 0, 1, 0], [1.0, -2.0, 0.0, 3.0], [1, 1, 1, 1]), ("s", [1, 1], [2.0], [1, 1, 1]), ("s", [1], [2.0, 1.0], [0]),
            ("s", None, [1.0], [1]), ("s", [1], None, [1]), ("s", [1], [1.0], None), ("s", [], [], []), ("s", [1, None], [None, 1.0], [1, 1]),
            (None, [1, 0], [1.0, 1.0], [1, None]), ("t", [1], [1.0], [0])]
    df = spark.createDataFrame(rows, "source string, replaced array<int>, logits array<double>, attention_mask array<int>")
    got = {r.source: tuple(r)[1:] for r in scores.replaced_token_scores(df, by=["source"]).collect()}
    assert got.keys() == {"s", None}
    assert got[None] == (1.0, 1.0, 1.0)
    z = F.arrays_zip(F.col("replaced").alias("y"), F.col("logits").alias("g"), F.col("attention_mask").alias("m"))
    pos = df.select("source", F.explode(F.filter(z, lambda e: e["m"] == 1)).alias("e")).select("source", "e.*").where("source = 's'").collect()
    sure = [(r.y, (1 + (r.g > 0) - (r.g < 0)) / 2) for r in pos if r.y is not None and r.g is not None]
    hits = sum(int(p) == 1 and y == 1 for y, p in sure)
    said = sum(r.g is not None and r.g > 0 for r in pos)
    assert got["s"] == (sum(p == y for y, p in sure) / len(sure), hits / said, hits / sum(r.y == 1 for r in pos))
