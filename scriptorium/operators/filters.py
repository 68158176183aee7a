"""F1-F8: document, line, sentence and chunk filters (all native Column predicates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    CURRENT_FILING_EXHIBITS,
    digit_punct_fraction,
    flatten_newlines,
    keep_report_sentences,
    split_sentences,
    strip_speaker_prefixes,
)


def filter_doc_type(df: DataFrame, allowed=CURRENT_FILING_EXHIBITS) -> DataFrame:
    """keep documents whose exhibit type is in ``allowed`` (pushed to the scan)."""
    return df.where(F.col("doc_type").isin(list(allowed)))


def filter_noisy_docs(df: DataFrame, max_share: float = 0.30) -> DataFrame:
    """drop documents whose digit+punctuation share exceeds ``max_share``
    (equal is kept; empty text scores 0.0)."""
    return df.where(digit_punct_fraction(F.col("text"), empty=0.0) <= max_share)


def filter_short_transcripts(df: DataFrame, min_lines: int = 5) -> DataFrame:
    """drop transcripts with fewer than ``min_lines`` newline-separated lines."""
    return df.where(F.size(F.split(F.col("text"), "\n", -1)) >= min_lines)


def clean_transcripts(df: DataFrame, min_lines: int = 5, min_line_length: int = 11,
                      prefix_window: int = 20) -> DataFrame:
    """F3 + F4 + X8: line-count filter, short-line removal, speaker-prefix removal,
    lines joined with a space."""
    lines = F.split(F.col("text"), "\n", -1)
    return (filter_short_transcripts(df, min_lines)
            .withColumn("text", F.array_join(strip_speaker_prefixes(lines, min_line_length, prefix_window), " ")))


def clean_reports_text(text: Column, max_numeric_pct: float = 15.0, max_percent_symbols: int = 5) -> Column:
    """Newline->space, sentence split, strip, F5 sentence filter, join with a space."""
    sents = split_sentences(flatten_newlines(text))
    return F.array_join(keep_report_sentences(sents, max_numeric_pct, max_percent_symbols), " ")


def clean_reports(df: DataFrame, max_numeric_pct: float = 15.0, max_percent_symbols: int = 5) -> DataFrame:
    return df.withColumn("text", clean_reports_text(F.col("text"), max_numeric_pct, max_percent_symbols))


def filter_numeric_sentences(df: DataFrame, col: str = "sentences", max_pct: float = 15.0,
                             max_percent_symbols: int = 5) -> DataFrame:
    """F5 on an array-of-sentences column."""
    return df.withColumn(col, keep_report_sentences(F.col(col), max_pct, max_percent_symbols))


def filter_noisy_chunks(df: DataFrame, max_share: float = 0.15, col: str = "sequence",
                        empty: float | None = None) -> DataFrame:
    """keep chunks whose digit+punctuation share is at most ``max_share``."""
    return df.where(digit_punct_fraction(F.col(col), empty=empty) <= max_share)


def trim_sentences(sentences: Column, first: int | Column | None = None,
                   last: int | Column | None = None) -> Column:
    """drop the first ``first`` and last ``last`` sentences (0/None = unset).

    Returns NULL when the document has too few sentences, which the chunk job
    counts as an excluded document. With both set the check is ``2*last < n``
    (quirk Q1) and the kept slice may be empty."""
    a = F.coalesce(F.lit(first) if not isinstance(first, Column) else first, F.lit(0))
    b = F.coalesce(F.lit(last) if not isinstance(last, Column) else last, F.lit(0))
    n = F.size(sentences)
    ok = (F.when((a > 0) & (b > 0), 2 * b < n)
          .when(a > 0, a < n)
          .when(b > 0, b < n)
          .otherwise(F.lit(True)))
    kept = F.slice(sentences, a + 1, F.greatest(n - a - b, F.lit(0)))
    return F.when(ok, kept)


def exclude_nulls(df: DataFrame, col: str = "text") -> DataFrame:
    """F8: NULL texts are excluded (and counted by ``chunk_report``), never fatal."""
    return df.where(F.col(col).isNotNull())
