"""A1 from the writing pass, paging, and the versions of the shuffled table."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunking as ch
from scriptorium.operators import ordering as od
from scriptorium.sources import documents as sd
from scriptorium.sources import sinks

PROFILES = {"annual": ch.ChunkProfile(1, 1, None), "calls": ch.ChunkProfile(1, 1, None), "news": ch.ChunkProfile(None, None, 0.0)}


def documents(spark):
    rows = []
    for i in range(90):
        source = ["annual", "calls", "news", "other", None][i % 5]
        text = None if i % 17 == 0 else " ".join(f"Word{j} goes on with 12 more." for j in range(i % 13)) + (" 1234567890 99 88." * (i % 4))
        text = text if source != "calls" or text is None else "\n".join(f"speaker: line {j} of call {i % 15} is here." for j in range(8))
        rows.append((i, source, None, text))
    return spark.createDataFrame(rows, "doc_id bigint, source string, doc_type string, text string")


@pytest.mark.parametrize("limit,offset", [(None, None), (5, None), (5, 3), (None, 4), (0, 0), (1000, 2)])
def test_the_write_and_its_report_equal_two_passes(spark, tmp_path, limit, offset):
    docs = documents(spark)
    path = str(tmp_path / "chunks")
    report = ch.write_corpus(docs, path, PROFILES, 10, limit=limit, offset=offset)
    want = ch.chunk_report(docs, PROFILES, 10, limit=limit, offset=offset)
    key = lambda r: str(r.source)
    assert sorted(report.collect(), key=key) == sorted(want.collect(), key=key)
    assert {r.source: r.n_documents for r in report.collect()} == {s: 18 for s in ("annual", "calls", "news", "other", None)}
    chunks = ch.chunk_corpus(docs, PROFILES, 10, limit=limit, offset=offset)
    assert sorted(map(str, spark.read.parquet(path).select(*chunks.columns).collect())) == sorted(map(str, chunks.collect()))


def test_pages_are_taken_per_source_after_the_distinct_scan(spark):
    docs = documents(spark)
    page = ch.clean_documents(docs, PROFILES, limit=4, offset=2)
    by = {s: sorted(r.doc_id for r in page.where(F.col("source").eqNullSafe(s)).collect()) for s in ("annual", "calls", None)}
    assert by["annual"] == [10, 15, 20, 25] and by[None] == [14, 19, 24, 29]
    distinct = sorted(r.doc_id for r in sd.scan_distinct(docs.where("source = 'calls'")).collect())
    kept = [i for i in distinct[2:6]]
    assert set(by["calls"]) <= set(kept) and len(distinct) < 18


def test_deep_pages_equal_a_sorted_slice(spark, monkeypatch):
    monkeypatch.setattr(sd, "TOP_PAGE_ROWS", 10)
    docs = documents(spark).repartition(5)
    for limit, offset in ((None, 30), (20, 30), (5, 2), (None, 500), (3, None), (None, None)):
        got = sorted(r.doc_id for r in sd.scan_page(docs, limit, offset).collect())
        lo = offset or 0
        assert got == list(range(90))[lo : lo + limit if limit else None]


def test_empty_table_writes_and_reports_nothing(spark, tmp_path):
    report = ch.write_corpus(documents(spark).limit(0), str(tmp_path / "c"), PROFILES, 10)
    assert report.count() == 0


def chunks(spark, n):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"), F.col("id").alias("doc_id"),
                                 F.lit(0).alias("chunk_id"), F.concat(F.lit("text "), F.col("id")).alias("sequence"))


def test_a_published_table_has_the_shuffle_and_its_totals(spark, tmp_path):
    out = str(tmp_path / "seqs")
    assert sinks.publish_shuffled(od.shuffle_into_stripes(chunks(spark, 900), seed=4, stripes=3), out) == 1
    rows, totals = sinks.open_shuffled(spark, out)
    want = od.shuffle_sequences(chunks(spark, 900), seed=4)
    assert sorted(rows.select(*want.columns).collect()) == sorted(want.collect())
    assert {r.source: r.n_total for r in totals.collect()} == {"a": 600, "b": 300}
    ret = spark.createDataFrame([("a", 100), ("b", 50)], "source string, limit long")
    win = od.epoch_window(rows, ret, 2, totals=totals)
    assert sorted((r.source, r.row_no) for r in win.collect()) == [("a", i) for i in range(200, 300)] + [("b", i) for i in range(100, 150)]
    assert sorted(win.collect()) == sorted(od.epoch_window(rows, ret, 2).collect())


def test_rows_of_a_file_are_consecutive_and_texts_are_exchanged_once(spark, tmp_path):
    shuffled = od.shuffle_into_stripes(chunks(spark, 900), seed=4, stripes=6)
    sinks.publish_shuffled(shuffled, str(tmp_path / "s"))
    rows, _ = sinks.open_shuffled(spark, str(tmp_path / "s"))
    for f in rows.groupBy("source", F.input_file_name().alias("file")).agg(F.min("row_no").alias("a"), F.max("row_no").alias("z"), F.count("*").alias("n")).collect():
        assert f.z - f.a + 1 == f.n and f.n < 300
    plan = shuffled.sortWithinPartitions("source", "stripe", "row_no")._jdf.queryExecution().optimizedPlan().toString()
    physical = shuffled._jdf.queryExecution().sparkPlan().toString()
    assert "RepartitionByExpression" in plan and physical.count("Exchange hashpartitioning(_grp") <= 1


def test_a_crash_before_the_swap_leaves_the_old_version(spark, tmp_path):
    out = str(tmp_path / "seqs")
    with pytest.raises(FileNotFoundError):
        sinks.open_shuffled(spark, out)
    sinks.publish_shuffled(od.shuffle_into_stripes(chunks(spark, 30), seed=1), out)
    name = sinks.write_version(od.shuffle_into_stripes(chunks(spark, 60), seed=2), out)  # and then the job dies
    assert sinks.open_shuffled(spark, out)[0].count() == 30
    assert sinks.commit_version(spark, out, name) == 2
    rows, totals = sinks.open_shuffled(spark, out)
    assert rows.count() == 60 and totals.agg(F.sum("n_total")).first()[0] == 60
    assert sinks.open_shuffled(spark, out, version=1)[0].count() == 30
    with pytest.raises(FileNotFoundError):
        sinks.open_shuffled(spark, out, version=9)
