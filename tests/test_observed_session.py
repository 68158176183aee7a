"""Spark ML on a session that has observed metrics before, which cannot be serialized (M1, M2, M4)."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from scriptorium.operators import models


@pytest.fixture
def observed(spark):
    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    return spark


def _texts(spark, n=40):
    rows = [(i, f"good fine nice w{i}" if i % 2 else f"bad poor weak w{i}", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "row_no long, text string, label int")


def test_svm_separability(observed):
    rows = [([float(i % 3 == c) + i / 1000 for c in range(3)], i % 3) for i in range(30)]
    out = models.svm_separability(observed.createDataFrame(rows, "embedding array<float>, label int"), max_iter=5).first()
    assert (out["n"], out["accuracy"]) == (30, 1.0)


def test_cv_search(observed):
    trials = models.trial_table(observed, n_trials=2, seed=3)
    out = models.cv_search(_texts(observed), trials, k=3, num_features=64, index="row_no").collect()
    assert sorted(r["trial_id"] for r in out) == [0, 1]
    assert max(r["cv_score"] for r in out) == 1.0


def test_final_evaluation(observed):
    best = {"trial_id": 0, "regParam": 0.01, "elasticNetParam": 0.0, "maxIter": 10, "fitIntercept": True}
    out = models.final_evaluation(_texts(observed), _texts(observed, 10), best, num_features=64).collect()
    assert sorted((r["split"], r["f1"]) for r in out) == [("test", 1.0), ("train", 1.0)]
