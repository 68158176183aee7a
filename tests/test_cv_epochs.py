"""M1 epoch by epoch: the metric table, and the selected epochs against SQL over it."""

import math

import duckdb
from pyspark.sql import functions as F

from scriptorium.operators import models
from scriptorium.operators import ordering as od


def labelled(spark, n=120):
    good = F.concat_ws(" ", F.lit("calm fine word"), F.concat(F.lit("w"), F.col("id") % 17))
    bad = F.concat_ws(" ", F.lit("angry bad word"), F.concat(F.lit("w"), F.col("id") % 13))
    y = (F.xxhash64("id") % 2 == 0).cast("int")
    return od.shuffle_labelled(spark.range(n).select(F.col("id").alias("doc_id"), F.when(y == 1, bad).otherwise(good).alias("text"), y.alias("label")), 1)


def test_selected_epochs_equal_sql_over_the_stored_table(spark, tmp_path):
    trials = spark.createDataFrame([(0, 0.5), (1, 0.01)], "trial_id long, step_size double")
    table = models.cv_epochs(labelled(spark), trials, k=2, n_epochs=4, patience=2, num_features=64, steps_per_epoch=2)
    table.coalesce(1).write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    rows = stored.orderBy("run_id", "step").collect()
    assert {r.run_id for r in rows} == {"0:0", "0:1", "1:0", "1:1"} and all(1 <= r.step <= 4 and r.loss > 0 and 0 <= r.score <= 1 for r in rows)
    by = {(r.run_id, r.step): r.loss for r in rows}
    # Warm start: training goes on from epoch to epoch.
    assert all(by[run, 2] < by[run, 1] for run in ("1:0", "1:1"))
    got = {(r.trial_id, r.fold): (r.stop_step, r.selected_step, r.score) for r in models.selected_cv_scores(stored, 2).collect()}
    con = duckdb.connect()
    want = con.execute(f"""WITH m AS (SELECT * FROM read_parquet('{tmp_path}/m/*.parquet')),
b AS (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM m),
i AS (SELECT *, max(CASE WHEN low IS NULL OR loss <= low THEN step END) OVER (PARTITION BY run_id ORDER BY step) AS imp FROM b),
s AS (SELECT run_id, min(CASE WHEN step - imp >= 2 THEN step END) AS stop, max(step) AS last FROM i GROUP BY run_id),
p AS (SELECT i.run_id, any_value(stop) AS stop, any_value(last) AS last, arg_min(loss, step) FILTER (WHERE step = last) AS l,
      max(imp) FILTER (WHERE stop IS NULL OR step <= stop) AS best FROM i JOIN s USING (run_id) GROUP BY i.run_id)
SELECT m.trial_id, m.fold, p.stop, m.step, m.score FROM p JOIN m ON m.run_id = p.run_id
WHERE m.step = CASE WHEN p.stop IS NOT NULL OR (SELECT loss FROM m x WHERE x.run_id = p.run_id AND x.step = p.best) < p.l THEN p.best ELSE p.last END""").fetchall()
    assert got == {(t, f): (stop, step, score) for t, f, stop, step, score in want}


def test_a_run_ends_where_the_rule_stops_it(spark):

    trials = spark.createDataFrame([(0, 5000.0)], "trial_id long, step_size double")
    table = models.cv_epochs(labelled(spark, 40), trials, k=2, n_epochs=6, patience=1, num_features=16, steps_per_epoch=2)
    for run in {r.run_id for r in table.collect()}:
        ls = [r.loss for r in table.where(F.col("run_id") == run).orderBy("step").collect()]
        worse = [i for i in range(1, len(ls)) if ls[i] > min(ls[:i])]
        assert worse in ([], [len(ls) - 1])


def test_epochs_are_those_of_the_perceptron_without_its_dense_rows(spark):
    """the perceptron stacks every row as a dense vector; the same steps on sparse features."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    sh = labelled(spark, 300)
    trials = spark.createDataFrame([(0, 0.5)], "trial_id long, step_size double")
    table = models.cv_epochs(sh, trials, k=2, n_epochs=2, patience=2, num_features=64, steps_per_epoch=3, seed=5)
    got = {(r.fold, r.step): (r.loss, r.score) for r in table.collect()}
    folded = od.kfold(sh, 2, ["row_no"]).withColumn("label_d", F.col("label").cast("double"))
    # Blocks are made in partitions, so both must read the same ones.
    folded = models._few_partitions(models.term_frequencies(folded, 64).select("fold", "label_d", "label", "_tf")).persist()
    for fold in (0, 1):
        weights = None
        for epoch in (1, 2):
            net = MultilayerPerceptronClassifier(layers=[64, 2], featuresCol="_tf", labelCol="label_d", solver="gd", maxIter=3, stepSize=0.5, tol=0.0, seed=5)
            model = (net if weights is None else net.setInitialWeights(weights)).fit(folded.where(F.col("fold") != fold))
            weights = model.weights
            rows = model.transform(folded.where(F.col("fold") == fold)).select("probability", "label").collect()
            loss = sum(-math.log(max(r.probability[r.label], 1e-15)) for r in rows) / len(rows)
            assert abs(loss - got[fold, epoch][0]) < 1e-9
