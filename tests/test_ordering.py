"""Shuffles, epoch windows, batches, splits, folds, sampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.functions.random import hash_uniform
from scriptorium.operators import ordering as od


def test_hash_uniform_golden(spark):
    u = spark.range(1).select(hash_uniform(7, F.lit(1), F.lit(3)).alias("u")).first().u
    assert abs(u - 0xf76d7db57a7ea / 4503599627370496.0) < 1e-15


def test_index_rows_matches_row_number(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id"), hash_uniform(1, F.col("id")).alias("u"))
    got = od.index_rows(df, ["u", "id"], by=["g"], num_blocks=7)
    w = Window.partitionBy("g").orderBy("u", "id")
    exp = df.withColumn("row_no", F.row_number().over(w) - 1)
    a = sorted((r.id, r.row_no) for r in got.select("id", "row_no").collect())
    b = sorted((r.id, r.row_no) for r in exp.select("id", "row_no").collect())
    assert a == b


def test_epoch_window_fixture(spark):
    seqs = spark.range(1000).select(F.lit("s").alias("source"), F.col("id").alias("row_no"))
    ret = spark.createDataFrame([("s", 300)], "source string, limit long")
    rows = {e: sorted(r.row_no for r in od.epoch_window(seqs, ret, e).collect()) for e in range(4)}
    assert rows[0] == list(range(0, 300)) and rows[1] == list(range(300, 600))
    assert rows[2] == list(range(0, 300)) and rows[3] == list(range(0, 300))  # wraps after half (Q4)
    assert sorted(r.row_no for r in od.epoch_window(seqs, ret, 2, wrap="full").collect()) == list(range(600, 900))


def test_epoch_window_goes_through_all_rows_before_it_starts_again(spark):
    seqs = spark.range(1000).select(F.lit("s").alias("source"), F.col("id").alias("row_no"))
    ret = spark.createDataFrame([("s", 300)], "source string, limit long")
    rows = sorted(r.row_no for r in od.epoch_window(seqs, ret, 3, wrap="full").collect())
    assert rows == list(range(0, 200)) + list(range(900, 1000))
    many = spark.createDataFrame([("s", 5000)], "source string, limit long")
    assert od.epoch_window(seqs, many, 2, wrap="full").count() == 1000


def test_epoch_window_reads_its_own_rows_only(spark, tmp_path):
    seqs = spark.range(1000).select(F.when(F.col("id") < 500, "a").otherwise("b").alias("source"), (F.col("id") % 500).alias("row_no"))
    seqs.write.partitionBy("source").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    ret = spark.createDataFrame([("a", 100)], "source string, limit long")
    win = od.epoch_window(stored, ret, 1, totals=od.source_totals(stored))
    plan = win._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_no,100)" in plan and "PartitionFilters: [" in plan and "source" in plan.split("PartitionFilters: [")[1][:60]
    assert sorted(r.row_no for r in win.collect()) == list(range(100, 200))


def test_index_rows_with_nulls_strings_outliers_and_descending_keys(spark):
    rows = [(None, 0), (5, 1), (10**15, 2)] + [(i, 10 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, id long").withColumn("s", F.concat(F.lit("x"), F.col("k").cast("string")))
    for order in (["k", "id"], ["s", "id"], [F.col("k").desc(), "id"], [F.col("s").desc(), F.col("id")]):
        cols = [F.col(c) if isinstance(c, str) else c for c in order]
        want = df.withColumn("n", F.row_number().over(Window.orderBy(*cols)) - 1)
        got = od.index_rows(df, order, out="n", num_blocks=8)
        assert sorted((r.id, r.n) for r in got.collect()) == sorted((r.id, r.n) for r in want.collect())
    blocks = od.with_sampled_block(df, [F.col("k")], 8, "b").groupBy("b").count().collect()
    assert max(r["count"] for r in blocks) < 120


def test_planned_steps(spark):
    ret = spark.createDataFrame([(f"s{i}", 512) for i in range(4)], "source string, limit long")
    r = od.planned_steps(ret, 128, 3).first()
    assert (r.steps_per_epoch, r.total_steps) == (16, 48)
    # the learning-rate check from the reference logs: linear decay from 1e-4 over 48 steps
    lr = [1e-4 * (1 - s / 48) for s in (1, 17, 33)]
    assert [round(x, 12) for x in lr] == [round(9.791666666666667e-05, 12), round(6.458333333333334e-05, 12),
                                          round(3.125e-05, 12)]


def test_split_and_folds(spark):
    df7 = spark.range(7).withColumnRenamed("id", "k")
    sp = {r.k: r.split for r in od.train_test_split(df7, 0.8, ["k"]).collect()}
    assert [sp[i] for i in range(7)] == ["train"] * 5 + ["test"] * 2
    df10 = spark.range(10).withColumnRenamed("id", "k")
    folds = [r.fold for r in od.kfold(df10, 3, ["k"]).orderBy("k").collect()]
    assert folds == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_batches_and_sampling(spark):
    win = spark.range(300).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_id"))
    b = od.batch_plan(win, 128, seed=1, epoch=0, steps_per_epoch=3)
    sizes = sorted((r.batch_id, r["count"]) for r in b.groupBy("batch_id").count().collect())
    assert sizes == [(0, 128), (1, 128), (2, 44)]
    assert sorted(r.position for r in b.collect()) == list(range(300))
    df = spark.range(20).withColumnRenamed("id", "k")
    s = od.sample_with_replacement(df, 50, 3, ["k"])
    assert s.count() == 50 and s.select("draw").distinct().count() == 50
    sel = od.select_rows(df.withColumnRenamed("k", "row_no"), spark.createDataFrame([(1,), (1,), (5,)], "row_no long"))
    assert sorted(r.row_no for r in sel.collect()) == [1, 5]


def test_blocks_are_balanced_when_the_leading_column_is_constant_or_hot(spark):
    df = spark.range(4000).select(F.lit("same").alias("a"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("b"),
                                  F.xxhash64("id").alias("c"), "id").repartition(3)
    for order in (["a", "id"], ["a", F.col("b").desc(), "c"], [F.col("b").asc_nulls_last(), F.col("c").desc_nulls_first()], [F.col("b").desc_nulls_first(), "id"]):
        cols = [F.col(c) if isinstance(c, str) else c for c in order]
        sizes = [r["count"] for r in od.with_sampled_block(df, cols, 16, "b").groupBy("b").count().collect()]
        assert len(sizes) >= 14 and max(sizes) < 2 * 4000 / 16
        want = df.withColumn("n", F.row_number().over(Window.orderBy(*cols)) - 1)
        got = od.index_rows(df, order, out="n", num_blocks=16)
        assert sorted((r.id, r.n) for r in got.collect()) == sorted((r.id, r.n) for r in want.collect())


def _jobs_while(spark, build):
    """Jobs that run while ``build`` makes its plan."""
    sc = spark.sparkContext
    sc.setJobGroup("plan", "plan")
    out = build()
    n = len(sc.statusTracker().getJobIdsForGroup("plan"))
    sc.setJobGroup("other", "other")
    return n, out


def test_nothing_runs_while_a_split_is_planned(spark):
    df = spark.range(1000).withColumn("row_no", F.col("id"))
    for build in (lambda: od.train_test_split(df, 0.8, ["id"]), lambda: od.kfold(df, 3, ["id"]), lambda: od.sample_with_replacement(df, 9, 1, ["id"]),
                  lambda: od.train_test_split(df, 0.8, ["id"], index="row_no")):
        jobs, out = _jobs_while(spark, build)
        assert jobs == 0 and out.count() in (1000, 9)
    dense = [od.train_test_split(df, 0.33, ["id"], index="row_no"), od.kfold(df, 7, ["id"], index="row_no")]
    sorted_ = [od.train_test_split(df, 0.33, ["id"]), od.kfold(df, 7, ["id"])]
    for a, b in zip(dense, sorted_):
        assert sorted(a.collect()) == sorted(b.collect())
        assert "Window" not in a._jdf.queryExecution().executedPlan().toString()


def test_draws_number_only_the_blocks_that_they_hit(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id"), hash_uniform(3, F.col("id")).alias("x")).repartition(3)
    want = {(r.draw, r.id) for r in df.sparkSession.range(40).withColumnRenamed("id", "draw").withColumn(
        "id", F.floor(hash_uniform(5, F.col("draw")) * 5000).cast("long")).collect()}
    for blocks in (1, 4, 600):
        assert {(r.draw, r.id) for r in od.sample_with_replacement(df, 40, 5, ["k", "id"], num_blocks=blocks).collect()} == want
    assert {(r.draw, r.id) for r in od.sample_with_replacement(df, 40, 5, ["id"], index="id").collect()} == want
    plan = od.sample_with_replacement(df, 40, 5, ["k", "id"])._jdf.queryExecution().optimizedPlan().toString()
    above = plan[plan.index("Window [row_number"):]
    assert "LeftSemi" in above.split("Aggregate")[0]
    assert od.sample_with_replacement(df.limit(0), 5, 1, ["id"]).count() == 0
