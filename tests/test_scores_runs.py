"""A5-A13, W7, W8, R5 on the FIXTURES.md examples."""

from pyspark.sql import functions as F

from scriptorium.operators import runs, scores


def test_binary(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0], [1, 0, 0, 1])), "label int, prediction int")
    r = scores.binary_scores(df).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5, 0.5)


def test_multiclass(spark):
    df = spark.createDataFrame(list(zip([0, 1, 2, 2], [0, 1, 1, 2])), "label int, prediction int")
    r = scores.multiclass_scores(df).first()
    assert r.accuracy == 0.75 and abs(r.macro_f1 - (1 + 2 / 3 + 2 / 3) / 3) < 1e-9
    per = {c.label: (c.precision, c.recall) for c in scores.class_scores(df).collect()}
    assert per == {0: (1.0, 1.0), 1: (0.5, 1.0), 2: (1.0, 0.5)}


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "label double, prediction double")
    r = scores.regression_scores(df).first()
    assert abs(r.mae - 1 / 3) < 1e-12 and abs(r.mse - 1 / 3) < 1e-12 and abs(r.r2 - 0.5) < 1e-12


def test_run_summary(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 0.1), ("a", 2, 1.5, 0.2), ("a", 3, 1.2, 0.3)],
                               "run_id string, step long, loss double, accuracy double")
    r = runs.run_summary(df).first()
    assert r.final_loss == 1.2 and abs(r.mean_loss - 1.566667) < 1e-6 and abs(r.std_loss - 0.329983) < 1e-6
    assert abs(r.mean_loss_delta + 0.4) < 1e-12 and abs(r.std_loss_delta - 0.1) < 1e-12
    assert abs(r.loss_trend_slope + 0.4) < 1e-12


def test_early_stopping_table(spark):
    cases = [([1.0, 0.9, 0.95, 0.96, 0.97], "min", 3, 0.0, 2, 5),
             ([1.0, 1.0, 1.0], "min", 2, 0.0, 3, None),
             ([0.5, 0.45, 0.44, 0.43], "max", 2, 0.1, 4, None),
             ([0.5, 0.3, 0.2], "max", 2, 0.1, 1, 3),
             ([1.0, 0.95, 0.92], "min", 2, 0.1, 1, 3)]
    for vals, mode, pat, delta, best, stop in cases:
        df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(vals)], "run_id string, step long, m double")
        r = runs.early_stopping(df, "m", pat, delta, mode).first()
        assert (r.best_step, r.stop_step) == (best, stop), (vals, mode)


def test_selected_score_and_best_trial(spark):
    m = spark.createDataFrame([("r", 1, 1.0, 0.5), ("r", 2, 0.8, 0.7), ("r", 3, 0.9, 0.6)],
                              "run_id string, step long, loss double, score double")
    stops = runs.early_stopping(m, "loss", 5, 0.0, "min")
    assert runs.selected_epoch_score(m, stops).first().score == 0.7  # best loss was earlier
    t = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "trial_id long, value double")
    assert runs.best_trial(t, "value", "maximize").first().trial_id == 1
    assert runs.best_trial(t, "value", "minimize").first().trial_id == 0
