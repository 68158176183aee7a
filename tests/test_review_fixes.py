"""NaN losses, unlisted sources, surviving rows, macro F1: cases found in review."""

import math

from pyspark.sql import functions as F

from scriptorium.functions.arrays import never_masked
from scriptorium.operators import chunking as ch
from scriptorium.operators import models
from scriptorium.operators import runs
from scriptorium.sources import documents as docs
from scriptorium.streaming.early_stop_stream import _fold


def test_early_stopping_with_a_nan_loss_is_the_same_everywhere(spark):
    import pandas as pd

    for values in ([1, math.nan, 2, 3, 4], [3, 2, math.nan, math.nan, 5, 6, 7, 8], [math.nan, 1, 2, 3, 4]):
        df = spark.createDataFrame([("r", i + 1, float(v)) for i, v in enumerate(values)], "run_id string, step long, loss double")
        for delta in (0.0, 0.1):
            got = runs.early_stopping(df, patience=2, delta=delta).first()
            st = dict(best=None, best_step=None, best_value=None, counter=0, stop_step=None, last_step=None)
            st = _fold(pd.DataFrame({"step": range(1, len(values) + 1), "loss": [float(v) for v in values]}), st, "loss", 2, delta, "min")
            assert (got.best_step, got.stop_step) == (st["best_step"], st["stop_step"]), (values, delta)


def test_documents_of_unlisted_sources_are_chunked_and_counted(spark):
    text = "One two three four. Five six seven eight."
    df = spark.createDataFrame([(1, "blogs", None, text), (2, "news", None, text), (3, None, None, text)], "doc_id long, source string, doc_type string, text string")
    chunks = ch.chunk_corpus(df, chunk_words=50)
    assert {r.doc_id for r in chunks.collect()} >= {1, 3}
    report = {r.source: r.n_documents for r in ch.chunk_report(df, chunk_words=50).collect()}
    assert report["blogs"] == 1


def test_the_surviving_row_keeps_its_own_columns(spark):
    df = spark.createDataFrame([(2, "calls", "A", "t"), (1, "calls", "B", "t"), (3, "calls", "C", None)], "doc_id long, source string, doc_type string, text string")
    assert sorted((r.doc_id, r.doc_type, r.text) for r in docs.scan_distinct(df).collect()) == [(1, "B", "t"), (3, "C", None)]


def test_macro_f1_of_skewed_classes(spark):
    rows = [(0.0, 0.0)] * 90 + [(1.0, 1.0)] * 2 + [(1.0, 0.0)] * 3 + [(2.0, 2.0)] * 2 + [(2.0, 0.0)] * 3
    df = spark.createDataFrame(rows, "label_d double, prediction double")
    f = lambda p, r: 2 * p * r / (p + r)
    assert abs(models.MacroF1().evaluate(df) - (f(90 / 96, 1) + 2 * f(1, 0.4)) / 3) < 1e-9


def test_cross_validation_of_three_classes_on_separable_text(spark):
    words = ["red apple", "blue sky", "green leaf"]
    df = spark.createDataFrame([(i, words[i % 3] + f" n{i}", i % 3) for i in range(90)], "row_no long, text string, label int")
    trials = spark.createDataFrame([(0, 0.0, 20), (1, 0.01, 20)], "trial_id long, regParam double, maxIter int")
    got = models.cv_search(df, trials, k=3, num_classes=3, num_features=1 << 12).collect()
    assert len(got) == 2 and all(r.cv_score > 0.9 for r in got)
    scored = models.final_evaluation(df.where("row_no < 60"), df.where("row_no >= 60"), {"regParam": 0.0, "maxIter": 20}, num_classes=3, num_features=1 << 12)
    assert all(r.macro_f1 > 0.9 for r in scored.collect())


def test_ids_that_are_never_masked(spark):
    assert spark.range(1).select(never_masked().alias("x")).first().x == [0, 1, 2, 3]
