"""ST1: incremental chunking as a Structured Streaming job.

New document files arriving in a folder are chunked by exactly the same
per-document plan as the batch job (``chunk_corpus``) and appended to a
partitioned parquet table. The file source and file sink plus the checkpoint
location give exactly-once output across restarts and executor loss.

The distinct scan of transcripts (S2) has a bounded form (``Distinct``): a text that comes again within ``keep``
of its first event time is dropped. Its state is one entry per digest, which a timer removes, so state grows with the
texts of that span only. Of copies in one trigger the smallest ``doc_id`` stays, as in the batch job; without
``distinct`` the scan is left to the batch job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunking import DEFAULT_CHUNK_WORDS, DEFAULT_MAX_CHUNK_SHARE, ChunkProfile, chunk_corpus


@dataclass(frozen=True)
class Distinct:
    """S2 on a stream: the event-time column, the watermark's delay and how long a text is remembered."""

    event_time: str
    delay: str = "1 hour"
    keep_seconds: int = 24 * 3600


def first_texts(stream: DataFrame, distinct: Distinct) -> DataFrame:
    """The first of equal texts of a source within ``keep_seconds`` (null texts are equal): ``doc_id, source, doc_type, text``."""
    schema = stream.select("doc_id", "source", "doc_type", "text").schema
    timed = stream.withColumn(distinct.event_time, F.col(distinct.event_time).cast("timestamp")).withWatermark(distinct.event_time, distinct.delay)
    timed = timed.withColumn("_at", F.unix_millis(distinct.event_time))
    keyed = timed.withColumn("_digest", F.sha2(F.col("text").cast("binary"), 256))

    def first(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Batches of a hot text are looked at one by one, so the copies are never held together.
        best, seen = None, None
        for part in parts:
            row = part.loc[[part["doc_id"].idxmin()]]
            seen = int(part["_at"].min()) if seen is None else min(seen, int(part["_at"].min()))
            if best is None or row["doc_id"].iloc[0] < best["doc_id"].iloc[0]:
                best = row
        if best is None or state.exists:
            return
        until = max(seen + 1000 * distinct.keep_seconds, state.getCurrentWatermarkMs() + 1)
        state.update((until,))
        state.setTimeoutTimestamp(until)
        yield best[[f.name for f in schema.fields]]

    return keyed.groupBy("source", "_digest").applyInPandasWithState(first, schema, "until long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_chunk(stream: DataFrame, profiles: dict[str, ChunkProfile] | None = None,
                 chunk_words: int = DEFAULT_CHUNK_WORDS, max_share: float = DEFAULT_MAX_CHUNK_SHARE,
                 distinct: Distinct | None = None) -> DataFrame:
    """The chunk job on a streaming frame of ``doc_id, source, doc_type, text`` (and the event time of ``distinct``)."""
    scan = (lambda calls: first_texts(calls, distinct)) if distinct is not None else False
    return chunk_corpus(stream, profiles, chunk_words, max_share, distinct_calls=scan)


def start_chunk_stream(spark: SparkSession, input_dir: str, schema, output_dir: str, checkpoint_dir: str,
                       prepare: Callable[[DataFrame], DataFrame] | None = None,
                       profiles: dict[str, ChunkProfile] | None = None, chunk_words: int = DEFAULT_CHUNK_WORDS,
                       available_now: bool = True, max_files_per_trigger: int | None = None,
                       distinct: Distinct | None = None) -> StreamingQuery:
    """Start ST1: parquet files in ``input_dir`` -> chunks appended to ``output_dir``
    (partitioned by source). ``prepare`` maps the raw file schema to
    ``doc_id, source, doc_type, text`` (and the event time of ``distinct``)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(input_dir)
    docs = prepare(raw) if prepare else raw
    chunks = stream_chunk(docs, profiles, chunk_words, distinct=distinct)
    writer = (chunks.writeStream.format("parquet").outputMode("append")
              .option("path", output_dir).option("checkpointLocation", checkpoint_dir).partitionBy("source"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
