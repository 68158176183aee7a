"""Scoring: A5-A10 (classification, regression, token-level metrics, eval summary).

Every metric is a grouped aggregation with map-side partial aggregation, so a
huge group (one split, one run, one batch) never materialises in one task;
token-level metrics explode positions and aggregate conditional counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masking import MASK_ID


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def binary_scores(df: DataFrame, label: str = "label", pred: str = "prediction", by=()) -> DataFrame:
    """A5: accuracy, precision, recall, F1 with positive class 1 (0 on a zero
    denominator)."""
    y, p = F.col(label), F.col(pred)
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y == p).cast("long")).alias("_ok"),
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("_tp"),
        F.sum((p == 1).cast("long")).alias("_pp"),
        F.sum((y == 1).cast("long")).alias("_ap"),
    )
    prec = _safe_div(F.col("_tp"), F.col("_pp"))
    rec = _safe_div(F.col("_tp"), F.col("_ap"))
    return (agg.withColumn("accuracy", F.col("_ok") / F.col("n"))
            .withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
            .drop("_ok", "_tp", "_pp", "_ap"))


def class_scores(df: DataFrame, label: str = "label", pred: str = "prediction", by=()) -> DataFrame:
    """A6 per class: precision, recall, F1 (0 on a zero denominator) for every
    label occurring in the truth or the predictions. Built from the confusion
    counts (at most classes^2 rows per group)."""
    conf = df.groupBy(*by, F.col(label).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    contrib = conf.select(*by, F.explode(F.array(
        F.struct(F.col("_t").alias("cls"), F.col("_n").alias("actual"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("_p").alias("cls"), F.lit(0).cast("long").alias("actual"), F.col("_n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")),
    )).alias("c")).select(*by, "c.*")
    per = contrib.groupBy(*by, "cls").agg(F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"),
                                           F.sum("tp").alias("tp"))
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("actual"))
    return (per.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
            .select(*by, F.col("cls").alias("label"), "precision", "recall", "f1", "tp", "actual"))


def multiclass_scores(df: DataFrame, label: str = "label", pred: str = "prediction", by=()) -> DataFrame:
    """Accuracy and macro F1 (mean of per-class F1 over labels in truth or
    prediction)."""
    per = class_scores(df, label, pred, by)
    return per.groupBy(*by).agg((F.sum("tp") / F.sum("actual")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def regression_scores(df: DataFrame, label: str = "label", pred: str = "prediction", by=()) -> DataFrame:
    """MAE, MSE, R^2 = 1 - MSE / var_pop(label); a constant label gives 1.0 for
    a perfect fit and 0.0 otherwise. Scores the given prediction column (Q8 fixed)."""
    err = F.col(pred) - F.col(label)
    agg = df.groupBy(*by).agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
                              F.var_pop(F.col(label)).alias("_var"))
    r2 = F.when(F.col("_var") > 0, 1 - F.col("mse") / F.col("_var")) \
        .otherwise(F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.withColumn("r2", r2).drop("_var")


def mlm_accuracy(df: DataFrame, inputs: str = "masked_ids", labels: str = "labels", preds: str = "predictions",
                 by=("batch_id",), mask_id: int = MASK_ID) -> DataFrame:
    """Accuracy of predictions at positions whose *input* id is the mask id
    (random-replaced and kept positions are not scored), per group."""
    z = F.arrays_zip(F.col(inputs).alias("i"), F.col(labels).alias("l"), F.col(preds).alias("p"))
    pos = df.select(*by, F.explode(F.filter(z, lambda e: e["i"] == mask_id)).alias("e"))
    return pos.groupBy(*by).agg(F.avg((F.col("e.p") == F.col("e.l")).cast("double")).alias("mlm_accuracy"),
                                F.count(F.lit(1)).alias("n_masked"))


def replaced_token_scores(df: DataFrame, labels: str = "replaced", logits: str = "logits",
                          mask: str = "attention_mask", by=("batch_id",)) -> DataFrame:
    """Over positions with attention mask 1, prediction = (sign(logit) + 1) / 2.
    Accuracy compares that value with the 0/1 label (a logit of 0 gives 0.5, never
    equal); precision/recall use the prediction truncated to an integer."""
    known = F.when(F.col(labels).isNotNull() & F.col(logits).isNotNull(), F.col(mask))
    pos = df.select(*by, F.col(labels).alias("_y"), F.col(logits).alias("_g"), F.posexplode(known).alias("_i", "_m")).where("_m = 1")
    pos = pos.select(*by, F.get("_y", "_i").alias("_y"), F.get("_g", "_i").alias("_g"))
    pr = (F.signum(F.col("_g")) + 1.0) * 0.5
    pl = pr.cast("int")
    y = F.col("_y")
    agg = pos.groupBy(*by).agg(
        F.avg((pr == y.cast("double")).cast("double")).alias("accuracy"),
        F.sum(((pl == 1) & (y == 1)).cast("long")).alias("_tp"),
        F.sum((pl == 1).cast("long")).alias("_pp"),
        F.sum((y == 1).cast("long")).alias("_ap"),
    )
    return (agg.withColumn("precision", _safe_div(F.col("_tp"), F.col("_pp")))
            .withColumn("recall", _safe_div(F.col("_tp"), F.col("_ap"))).drop("_tp", "_pp", "_ap"))


def eval_summary(batch_metrics: DataFrame, by=("run_id",), batch: str = "batch_id",
                 loss: str = "loss", accuracy: str = "accuracy") -> DataFrame:
    """A10: evaluation pass = unweighted mean over batches of each batch's mean
    loss and accuracy (two-level aggregation)."""
    per_batch = batch_metrics.groupBy(*by, batch).agg(F.avg(loss).alias("_l"), F.avg(accuracy).alias("_a"))
    return per_batch.groupBy(*by).agg(F.avg("_l").alias("eval_loss"), F.avg("_a").alias("eval_accuracy"),
                                      F.count(F.lit(1)).alias("n_batches"))
