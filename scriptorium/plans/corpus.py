"""Corpus build plan (reference flow: chunk every source -> append to chunk
tables -> shuffle each table into a new one).

1. ``write_corpus``: all sources chunked and written once, partitioned by source (S7), with the
   report (A1) observed on the way.
2. The written table is shuffled (R1) into a new version of the sequence table: one exchange of
   the texts, then a manifest entry with the totals swaps it in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.chunking import DEFAULT_CHUNK_WORDS, DEFAULT_MAX_CHUNK_SHARE, ChunkProfile, write_corpus
from ..operators.ordering import shuffle_into_stripes
from ..sources.sinks import publish_shuffled


@dataclass
class CorpusPaths:
    chunks: str
    shuffled: str
    report: DataFrame


def build_corpus(spark: SparkSession, docs: DataFrame, out_dir: str, profiles: dict[str, ChunkProfile] | None = None,
                 chunk_words: int = DEFAULT_CHUNK_WORDS, max_share: float = DEFAULT_MAX_CHUNK_SHARE,
                 seed: int = 0, limit: int | None = None, offset: int | None = None) -> CorpusPaths:
    """Run steps 1-2 and return the two table locations (under ``out_dir``, which
    must be shared storage on a cluster) and the chunking report. ``open_shuffled`` reads the second."""
    chunks, shuffled = f"{out_dir.rstrip('/')}/chunks", f"{out_dir.rstrip('/')}/sequences"
    report = write_corpus(docs, chunks, profiles, chunk_words, max_share, limit, offset)
    publish_shuffled(shuffle_into_stripes(spark.read.parquet(chunks), seed), shuffled)
    return CorpusPaths(chunks, shuffled, report)
