"""How the driver's test tables stand in for the reference's inputs.

These functions only reshape rows into the schemas the operators expect; they
do none of an operator's work. Every operator in this package runs unchanged
on any table of the same schema.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import keys_as_bytes, md5_counted, uniform_of_digest

# The five document sources, in the order of their profile number.
SOURCE_NAMES = ("annual", "current", "calls", "news", "reports")
# Exhibit types cycled over current filings (two are kept by F1, two are not).
STANDIN_EXHIBITS = ("EX-99.1", "EX-99.5", "EX-10.1", "EX-99")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_of(raw_source: str = "source") -> F.Column:
    """``srcN`` -> one of the five source names by ``N % 5``."""
    idx = F.substring(F.col(raw_source), 4, 10).cast("int") % 5
    return F.element_at(F.array(*[F.lit(s) for s in SOURCE_NAMES]), idx + 1)


def exhibit_of() -> F.Column:
    """Exhibit types cycled by ``doc_id``."""
    types = F.array(*[F.lit(e) for e in STANDIN_EXHIBITS])
    return F.element_at(types, (F.col("doc_id") % len(STANDIN_EXHIBITS)).cast("int") + 1)


def documents_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` -> ``doc_id, source, doc_type, text``."""
    return documents_in_from(table(spark, sf_dir, "documents"))


def documents_in_from(docs: DataFrame) -> DataFrame:
    """The same mapping on any (batch or streaming) frame of the ``documents`` schema."""
    src = source_of()
    return docs.select(
        "doc_id",
        src.alias("source"),
        F.when(src == "current", exhibit_of()).alias("doc_type"),
        "text",
    )


def transcripts_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` -> transcripts: one document per ``conv_id``, lines
    ``role: text`` in turn order, joined by newlines. A conversation has a handful
    of turns, so the per-conversation list is small."""
    conv = table(spark, sf_dir, "conversations")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return (conv.groupBy("conv_id")
            .agg(lines.alias("lines"))
            .select(F.col("conv_id").alias("doc_id"), F.lit("calls").alias("source"),
                    F.lit(None).cast("string").alias("doc_type"),
                    F.array_join(F.col("lines.line"), "\n").alias("text")))


def labelled_in(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """``documents`` joined with ``labels`` -> ``doc_id, text, label``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("label"))
    return docs.join(labels, "doc_id")


def run_metrics_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` -> run metrics: ``run_id = user_id``, step = 1-based position by
    ``(ts, event_id)`` within the run, ``loss = value``; accuracy/grad_norm/lr are
    derived from the same row so every column is data-driven."""
    from pyspark.sql import Window

    ev = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return ev.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.row_number().over(w).cast("long").alias("step"),
        F.col("value").alias("loss"),
        (F.lit(1.0) / (F.lit(1.0) + F.col("value"))).alias("accuracy"),
        F.col("event_type").alias("tag"),
        F.col("ts"),
    )


def standin_parts(labelled: "DataFrame", seed: int = 3, train_share: float = 0.8) -> dict:
    """A labelled set's given ``train``/``test`` parts (as a published dataset ships
    them), assigned by a seeded hash of ``doc_id``."""
    from ..functions.random import hash_uniform

    u = hash_uniform(seed, F.col("doc_id"))
    return {"train": labelled.where(u < train_share), "test": labelled.where(u >= train_share)}


# The character-level stand-in vocabulary used to give the masking
# and token-metric operators oracle-checkable id arrays (27 buckets after the 5 specials).
CHAR_BUCKETS = 27
CHAR_VOCAB = CHAR_BUCKETS + 5


def char_ids(text, max_length: int | None = None):
    """Stand-in encoder: code point of each character -> ``code % 27 + 5``, wrapped as
    ``[seq] ids [/seq]``; whole, or truncated and padded to ``max_length``."""
    from ..functions.arrays import pad_truncate

    return _code_points(wrapped=True)(text) if max_length is None else pad_truncate(_code_points(wrapped=False)(text), max_length)


# Characters whose ids are made at once, whatever the batch.
CHARS_AT_ONCE = 1 << 20


def _code_points(wrapped: bool):
    """UDF text -> ``code % 27 + 5`` of every character, a stretch of texts at a time; ``wrapped``: between 1 and 2, the ids of [seq] and [/seq]."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        counts = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(counts) // CHARS_AT_ONCE)) + 1
        cuts = [0, *cuts.tolist(), len(texts)]
        return pa.concat_arrays([some(texts.slice(a, z - a), counts[a:z]) for a, z in zip(cuts, cuts[1:])])

    def some(texts: pa.Array, counts: np.ndarray) -> pa.Array:
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        codes = np.frombuffer("".join(t for t in texts.to_pylist() if t is not None).encode("utf-32-le"), "<u4")
        codes = (codes % CHAR_BUCKETS + 5).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if wrapped:
            starts, ends = offsets[:-1][known], offsets[1:][known]
            codes = np.insert(codes, np.stack([starts, ends], 1).ravel(), np.tile(np.array([1, 2], np.int32), len(starts)))
            offsets = offsets + 2 * np.concatenate([[0], np.cumsum(known)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes), mask=texts.is_null() if texts.null_count else None)

    return ids


def generator_logits(seed, key, pos, n_tokens: int):
    """Stand-in logits of a position: ``hash_uniform(seed, key, pos, token) * 4 - 2`` for every token."""

    @F.arrow_udf("array<double>")
    def logits(keys: pa.Array, positions: pa.Array) -> pa.Array:
        n = len(keys)
        heads = [h + b"%d:" % p for h, p in zip(keys_as_bytes(keys, seed), positions.to_pylist())]
        u = uniform_of_digest(md5_counted(heads, np.full(n, n_tokens), 2))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n_tokens, pa.int32()), pa.array(u * 4.0 - 2.0))

    return logits(key, pos)


def row_key(*cols):
    return F.concat_ws(":", *[F.col(c).cast("string") for c in cols])
