"""Queries that read the sequences twice chunk them once (K4)."""

import __spark_entry__ as entry


def test_replace_sampled_chunks_once(spark, tmp_path):
    text = " ".join(f"Sentence number {'abcdefghij'[i % 10]} has some plain words in it." for i in range(200))
    rows = [(i, text if i % 2 else text[5:], f"src{i}", "en", len(text)) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    out = entry.q_replace_sampled_gumbel(spark, str(tmp_path))
    got = {(r["source"], r["doc_id"], r["chunk_id"]): r["disc"] for r in out.collect()}
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("Scan parquet") == 2  # transcripts and the rest, once each
    masked = {(r["source"], r["doc_id"], r["chunk_id"]): r["masked"] for r in entry.q_mask_tokens(spark, str(tmp_path)).collect()}
    assert got.keys() == masked.keys() and len(got) > 5
    for k, disc in got.items():
        before, after = masked[k].split(","), disc.split(",")
        assert len(before) == len(after)
        assert all(b == "4" or b == a for b, a in zip(before, after))


def test_epoch_windows_chunk_once(spark, tmp_path):
    """Limits, totals and window read a stored shuffle, and that chunks the texts once."""
    text = " ".join(f"Sentence number {'abcdefghij'[i % 10]} has some plain words in it." for i in range(200))
    rows = [(i, text[i:], f"src{i % 5}", "en", len(text) - i) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    shuffled = entry._shuffled(spark, str(tmp_path))
    want = {(r.source, r.doc_id, r.chunk_id, r.row_no) for r in shuffled.collect()}
    final = shuffled._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("Scan parquet") == 2  # transcripts and the rest, once each
    for query in (entry.q_epoch_window, entry.q_epoch_window_wrap, entry.q_batch_plan):
        out = query(spark, str(tmp_path))
        assert "Scan parquet" not in out._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r) for r in entry.q_epoch_window(spark, str(tmp_path)).collect()}
    assert got and got <= want and all(r[3] < entry.EPOCH_LIMIT for r in got)  # few rows: the epoch falls back to the start
