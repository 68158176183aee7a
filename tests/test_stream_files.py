"""The files that the streaming queries read: few and large, whatever number of tasks read the table."""

import os

import __spark_entry__ as entry


def test_ranges_are_one_file_each_and_hold_every_numbered_row(spark, tmp_path):
    docs = [(k, f"text {k}" if k % 7 else None, "en", "s", 6) for k in range(100)] + [(3, "again", "en", "s", 5), (None, "no id", "en", "s", 5)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(6).write.parquet(
        str(tmp_path / "documents.parquet"))
    inbox, schema = entry._document_files(spark, str(tmp_path))
    rows = spark.read.schema(schema).parquet(inbox).select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((d[0], d[1] or "") for d in docs if d[0] is not None)
    files = [f for _, _, names in os.walk(inbox.removeprefix("file:")) for f in names if f.endswith(".parquet")]
    assert len(files) == 4
