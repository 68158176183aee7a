"""The normalisation of texts, their null rows and its memory."""

import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

TEXTS = ["", "  ", "Plain ASCII \x1c", " \u00c9t\u00c9 caf\u00e9\u0301 ", "\u039f\u0394\u039f\u03a3 A\u03a3b", "\u0130I\u0307\u0307 x", " \u0301 a", None,
         "\u3000wide\u3000", "a" + "".join(chr(c) for c in range(0x300, 0x36F)) + "B", "\u1e69\u0323\u0307 \U0001d400 \uac00", "\u0302"]


def plain(s, strip):
    if s is None:
        return None
    s = unicodedata.normalize("NFD", s).lower()
    return "".join(c for c in (s.strip() if strip else s) if unicodedata.category(c) != "Mn")


def test_as_by_the_rule(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", tx.normalize_text(F.col("text")).alias("a"),
                                                                          tx.normalize_inner(F.col("text")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(plain(t, True), plain(t, False)) for t in TEXTS]


def test_no_batch_is_held_as_strings():
    big = pa.array([("some plain words \u00e9 \u4e2d " * 2000) for _ in range(400)])
    tracemalloc.start()
    out = tx.normalize_array(big)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < big.nbytes / 2 and len(out) == 400
    assert len(tx.normalize_array(pa.array([], pa.string()))) == 0
