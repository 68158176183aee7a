"""Run analytics: S9, A11-A13, W5, W7, W8, R5, M5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _zfill2(c):
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def next_run_id(runs: DataFrame, model_types: DataFrame, name: str = "run_name") -> DataFrame:
    """Next run folder per model type: ``<type>_NN`` with NN = max existing
    index + 1 (zero-padded to two digits), ``<type>_00`` when none exists. A run
    belongs to the type named before its first '_' (an equi-join; the reference's
    prefix test agrees for type names without '_'); its index is the next field.
    Runs are pre-aggregated per type before the join, so the join side is one
    row per type."""
    per_type = runs.select(F.split_part(F.col(name), F.lit("_"), F.lit(1)).alias("model_type"),
                           F.expr(f"try_cast(split_part({name}, '_', 2) AS INT)").alias("_idx")) \
        .groupBy("model_type").agg(F.max("_idx").alias("_max"))
    best = model_types.select("model_type").join(per_type, "model_type", "left")
    nxt = F.when(F.col("_max").isNull(), F.lit(0)).otherwise(F.col("_max") + 1).cast("string")
    return best.select("model_type", F.concat(F.col("model_type"), F.lit("_"), _zfill2(nxt)).alias("next_run"))


# ---------------------------------------------------------------------------
# A12 / W5 / A13 / A11 / R5
# ---------------------------------------------------------------------------
def run_summary(metrics: DataFrame, run: str = "run_id", step: str = "step", loss: str = "loss",
                accuracy: str = "accuracy") -> DataFrame:
    """A12 + W5: per run -- final loss/accuracy (at the last step), mean and
    population std of loss and accuracy, mean and population std of the
    step-to-step loss deltas, and the least-squares slope of loss on the step
    index 0..n-1 (NULL for a single step).

    The windows are running frames (lag, row_number) that Spark evaluates
    streaming over the sorted run, so a long run is not buffered whole."""
    from pyspark.sql import Window

    w = Window.partitionBy(run).orderBy(step)
    d = metrics.select(run, step, loss, accuracy,
                       (F.col(loss) - F.lag(loss).over(w)).alias("_delta"),
                       (F.row_number().over(w) - 1).cast("double").alias("_x"))
    agg = d.groupBy(run).agg(
        F.max_by(loss, step).alias("final_loss"),
        F.max_by(accuracy, step).alias("final_accuracy"),
        F.avg(loss).alias("mean_loss"), F.stddev_pop(loss).alias("std_loss"),
        F.avg(accuracy).alias("mean_accuracy"), F.stddev_pop(accuracy).alias("std_accuracy"),
        F.avg("_delta").alias("mean_loss_delta"), F.stddev_pop("_delta").alias("std_loss_delta"),
        F.regr_slope(F.col(loss), F.col("_x")).alias("loss_trend_slope"),
        F.count(F.lit(1)).alias("n_steps"),
    )
    return agg


# Default objective weights of the pretraining search.
OBJECTIVE_WEIGHTS = dict(final_loss=1.0, final_accuracy=0.0, std_loss=0.5, std_accuracy=0.0,
                         mean_loss_delta=10.0, std_loss_delta=10.0, eval_loss=1.0, eval_accuracy=10.0)


def run_objective(summary: DataFrame, evals: DataFrame, run: str = "run_id", **weights) -> DataFrame:
    """Weighted objective per run (minimised). The eval-accuracy weight is
    +10 by default although accuracy should be maximised (quirk Q6, reproduced)."""
    w = {**OBJECTIVE_WEIGHTS, **weights}
    j = summary.join(evals.select(run, "eval_loss", "eval_accuracy"), run)
    expr = sum((F.lit(v) * F.coalesce(F.col(k), F.lit(0.0)) for k, v in w.items()), F.lit(0.0))
    return j.select(run, expr.alias("objective"))


def cv_mean(fold_scores: DataFrame, trial: str = "trial_id", score: str = "score") -> DataFrame:
    """Cross-validation score = unweighted mean of the fold scores."""
    return fold_scores.groupBy(trial).agg(F.avg(score).alias("cv_score"), F.count(F.lit(1)).alias("n_folds"))


def best_trial(trials: DataFrame, value: str = "value", direction: str = "maximize",
               trial: str = "trial_id") -> DataFrame:
    """The best trial (max or min of ``value``; ties -> smallest trial id) as
    one row: a global ``max_by`` with partial aggregation, no sort of all trials."""
    key = F.struct((F.col(value) if direction == "maximize" else -F.col(value)), -F.col(trial))
    return trials.agg(F.max_by(F.struct(*trials.columns), key).alias("_b")).select("_b.*")


# ---------------------------------------------------------------------------
# W7 / W8
# ---------------------------------------------------------------------------
def early_stopping(metrics: DataFrame, metric: str = "loss", patience: int = 5, delta: float = 0.0,
                   mode: str = "min", run: str = "run_id", step: str = "step") -> DataFrame:
    """Per run, in step order: the first value is best; ``min`` works on
    ``-metric`` and counts no improvement when ``score < best + delta``; ``max``
    when ``score < best - delta`` (asymmetric, quirk Q5). The counter resets on
    improvement; the run stops at the first step where ``counter >= patience``.
    Returns ``run_id, best_step, best_value, stop_step`` (NULL = never stopped).

    With ``delta = 0`` an improvement is exactly ``score >= running max`` of the
    earlier scores, so the result comes from running-frame windows (sorted per
    run, spill-capable, no arrays). With ``delta != 0`` the best value can move by
    less than the running max (and down, in ``max`` mode), so each run's
    evaluation series (one value per evaluation, bounded by the training
    schedule) is folded by one native ``aggregate`` over its step-ordered array."""
    sign = -1.0 if mode == "min" else 1.0
    if float(delta) == 0.0:
        return _early_stopping_windows(metrics, metric, patience, sign, run, step)
    d = float(delta) if mode == "min" else -float(delta)
    series = metrics.groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(metric).cast("double").alias("v"))))
        .alias("_series"))
    init = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("best_step"),
                    F.lit(None).cast("double").alias("best_value"), F.lit(0).alias("counter"),
                    F.lit(None).cast("long").alias("stop_step"))

    def step_fn(acc, e):
        score = F.lit(sign) * e["v"]
        stopped = acc["stop_step"].isNotNull()
        first = acc["best"].isNull()
        # a comparison with NaN is false, here as in Python (Spark orders NaN above all)
        worse = (score < acc["best"] + F.lit(d)) & ~F.isnan(score) & ~F.isnan(acc["best"])
        improve = F.struct(score.alias("best"), e["s"].cast("long").alias("best_step"), e["v"].alias("best_value"),
                           F.lit(0).alias("counter"), acc["stop_step"].alias("stop_step"))
        cnt = acc["counter"] + 1
        no_imp = F.struct(acc["best"].alias("best"), acc["best_step"].alias("best_step"),
                          acc["best_value"].alias("best_value"), cnt.alias("counter"),
                          F.when(cnt >= patience, e["s"].cast("long")).alias("stop_step"))
        return F.when(stopped, acc).when(first, improve).when(worse, no_imp).otherwise(improve)

    res = series.select(run, F.aggregate("_series", init, step_fn).alias("r"))
    return res.select(run, F.col("r.best_step").alias("best_step"), F.col("r.best_value").alias("best_value"),
                      F.col("r.stop_step").alias("stop_step"))


def _early_stopping_windows(metrics: DataFrame, metric: str, patience: int, sign: float, run: str,
                            step: str) -> DataFrame:
    """W7 for ``delta = 0``: improvement iff the score reaches the running max of
    the earlier scores; counter = evaluations since the last improvement; the
    stop is the first step with ``counter >= patience``; the best step is the
    last improvement before it."""
    from pyspark.sql import Window

    w = Window.partitionBy(run).orderBy(step)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    score = F.lit(sign) * F.col(metric).cast("double")
    d = metrics.select(run, step, F.col(metric).cast("double").alias("_v"), score.alias("_s"),
                       F.row_number().over(w).alias("_i"))
    # A NaN score counts as an improvement and so does whatever follows it: the running
    # maximum starts anew after each NaN.
    nans = F.sum(F.isnan("_s").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_part", F.coalesce(nans, F.lit(0)))
    before = Window.partitionBy(run, "_part").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_imp", F.max("_s").over(before).isNull() | (F.col("_s") >= F.max("_s").over(before)))
    d = d.withColumn("_cnt", F.col("_i") - F.max(F.when(F.col("_imp"), F.col("_i"))).over(upto))
    d = d.withColumn("_stop", F.min(F.when(F.col("_cnt") >= patience, F.col(step))).over(upto))
    cand = F.col("_imp") & F.col("_stop").isNull()
    return d.groupBy(run).agg(
        F.max(F.when(cand, F.col(step))).cast("long").alias("best_step"),
        F.max_by(F.when(cand, F.col("_v")), F.when(cand, F.col(step))).alias("best_value"),
        F.min(F.when(F.col("_cnt") >= patience, F.col(step))).cast("long").alias("stop_step"),
    )


def selected_epoch_score(metrics: DataFrame, stops: DataFrame, run: str = "run_id", step: str = "step",
                         loss: str = "loss", score: str = "score") -> DataFrame:
    """The score reported after training (early stopping on the validation
    loss): when the run stopped early, or the best loss seen is strictly lower than
    the last epoch's loss, the best epoch's score (the reloaded checkpoint);
    otherwise the last epoch's score."""
    last = metrics.groupBy(run).agg(F.max(step).alias("_last"), F.max_by(loss, step).alias("_last_loss"))
    j = stops.join(last, run)
    pick = F.when(F.col("stop_step").isNotNull() | (F.col("best_value") < F.col("_last_loss")), F.col("best_step")) \
        .otherwise(F.col("_last"))
    chosen = j.select(run, pick.alias(step))
    return chosen.join(metrics.select(run, step, score), [run, step]).withColumnRenamed(step, "selected_step")
