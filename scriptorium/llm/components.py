"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import keep_table

SALTS = 32


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each node's component; nodes without an edge are absent.

    Every round gives a node the smallest label among its neighbours and then that label's own label
    (pointer jumping), so the number of rounds grows with the logarithm of a component's diameter.
    Rounds are written to tables in the checkpoint folder; only one count per round reaches the driver.
    """
    both = keep_table(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
                .union(edges.select(F.col(b).alias("u"), F.col(a).alias("v")).where("u <> v")).distinct())
    labels = keep_table(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("component")))
    while True:
        reached = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(reached, labels.node == reached.u).select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # A label that very many nodes bear is looked up SALTS times, and its nodes meet it in as many tasks.
        salted = step.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        known = salted.select("component", "salt").distinct().join(up, "component")
        jumped = salted.join(known, ["component", "salt"], "left").select(
            "node", "old", F.least("component", F.coalesce("upper", "component")).alias("component"))
        jumped = keep_table(jumped)
        changed = jumped.where("old <> component").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
