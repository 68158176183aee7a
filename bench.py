"""

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default sf0.1) and prints
ONE JSON line. Each timed step materialises its result with the ``noop`` sink
(full computation, nothing collected); fast steps are the median of
``$BENCH_REPEATS`` runs after one warm-up, vocabulary learning runs once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    os.environ.setdefault("SPARK_DRIVER_MEMORY", os.environ.get("BENCH_MEMORY", "7g"))

    from pyspark.sql import functions as F

    from scriptorium.operators import chunking as ch
    from scriptorium.operators import masking, ordering, vocab
    from scriptorium.session import build_session, ensure_checkpoint_dir
    from scriptorium.sources import standins as si
    from scriptorium.sources.sinks import open_shuffled, publish_shuffled, write_chunks

    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2)
    scratch = ensure_checkpoint_dir(spark).rstrip("/") + f"/bench-{uuid.uuid4().hex}"

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    def timed(fn, n=repeats, warm=True):
        if warm:
            fn()
        ts = []
        for _ in range(n):
            t0 = time.perf_counter()
            fn()
            ts.append(time.perf_counter() - t0)
        return statistics.median(ts)

    small = {
        "annual": ch.ChunkProfile(1, 1, None), "current": ch.ChunkProfile(None, None, 0.0),
        "calls": ch.ChunkProfile(1, 1, None), "news": ch.ChunkProfile(2, 3, None),
        "reports": ch.ChunkProfile(1, None, None),
    }
    docs = si.documents_in(spark, sf_dir)
    n_docs = docs.count()
    q, extra = {}, {}

    # 1. corpus chunk job, reference settings (200 words, reference trims)
    # (the input is one small file: dealt out by hand, as a user would)
    parts = 2 * cpus
    q["chunk_corpus"] = timed(lambda: run(ch.chunk_corpus(docs, partitions=parts)))
    n_chunks = ch.chunk_corpus(docs, partitions=parts).count()
    extra["chunk_corpus_docs_per_sec"] = n_docs / q["chunk_corpus"]
    extra["chunk_corpus_chunks_per_sec"] = n_chunks / q["chunk_corpus"]

    # 2. corpus with small trims (more chunks, feeds the training-set steps): chunk table
    #    written once (S7), then shuffled from the written table into a new one
    chunk_path, seq_path = f"{scratch}/chunks", f"{scratch}/sequences"
    t0 = time.perf_counter()
    write_chunks(ch.chunk_corpus(docs, small, chunk_words=60, partitions=parts), chunk_path)
    q["chunk_write"] = time.perf_counter() - t0
    t0 = time.perf_counter()
    publish_shuffled(ordering.shuffle_into_stripes(spark.read.parquet(chunk_path), seed=7), seq_path)
    q["shuffle_write"] = time.perf_counter() - t0
    seqs, totals = open_shuffled(spark, seq_path)
    n_seqs = seqs.count()
    extra["sequences"] = n_seqs
    q["count_sequences"] = timed(lambda: run(ordering.source_totals(seqs)))

    # 3. epoch windows: first and last epoch before the wrap (cost must not grow with the offset)
    limit = 512
    sizes = {r["source"]: r["n_total"] for r in totals.collect()}
    retrieval = spark.createDataFrame([(name, limit) for name in sizes], "source string, limit long")
    last_epoch = max(0, (min(sizes.values()) // 2) // limit)
    q["epoch_window_first"] = timed(lambda: run(ordering.epoch_window(seqs, retrieval, 0, totals=totals)))
    q["epoch_window_last"] = timed(lambda: run(ordering.epoch_window(seqs, retrieval, last_epoch, totals=totals)))
    extra["epoch_window_last_epoch"] = last_epoch

    # 4. vocabulary learning
    vocab_size = int(os.environ.get("BENCH_VOCAB", "50000"))
    freqs = vocab.word_frequencies(docs)
    t0 = time.perf_counter()
    voc = vocab.learn_vocabulary(freqs, vocab_size, min_frequency=5)
    voc = voc.cache()
    extra["vocab_tokens"] = voc.count()
    q["learn_vocabulary"] = time.perf_counter() - t0
    extra["vocab_size_requested"] = vocab_size

    # 5. encode sequences (length 256)
    enc = vocab.encode_sequences(seqs, voc, 256)
    q["encode_sequences"] = timed(lambda: run(enc))
    extra["encode_rows_per_sec"] = n_seqs / q["encode_sequences"]
    enc_path = f"{scratch}/encoded"
    enc.write.parquet(enc_path)
    encoded = spark.read.parquet(enc_path).withColumn("row_key", si.row_key("source", "doc_id", "chunk_id"))

    # 6. MLM masking of the encoded rows
    n_tokens = extra["vocab_tokens"]
    q["mask_tokens"] = timed(lambda: run(masking.mask_tokens_arrow(encoded, seed=1, n_tokens=n_tokens)))
    extra["mask_rows_per_sec"] = n_seqs / q["mask_tokens"]

    total = sum(q.values())
    print(json.dumps({"metric": "headline_total_sec", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in q.items()},
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                      "cpus": cpus, "documents": n_docs,
                      **{k: (round(v, 2) if isinstance(v, float) else v) for k, v in extra.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
