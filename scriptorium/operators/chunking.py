"""Sentence packing, the per-source chunk job and its report.

Design
------
Everything is a per-row projection over the document row, so the chunk job is
a single narrow stage (scan -> clean -> split -> trim -> pack -> score ->
explode -> filter) with no shuffle, except the distinct scan of transcripts.

The greedy packer (T1) is sequential inside a document. It runs as one native
``aggregate`` over the array of sentence word counts whose state holds only the
chunk start positions and the running count, so the cost is linear in the
number of sentences (the start list is copied only on a flush). Texts are cut
with ``slice`` + ``array_join`` afterwards, so no string is copied per step.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import (
    CURRENT_FILING_EXHIBITS,
    digit_punct_fraction,
    flatten_newlines,
    split_sentences,
    split_sentences_simple,
    word_count,
)
from ..functions.arrays import posexplode_rows
from .filters import clean_reports_text, strip_speaker_prefixes, trim_sentences
from ..sources.documents import count_documents, page_by_source, scan_distinct
from ..sources.sinks import write_chunks


@dataclass(frozen=True)
class ChunkProfile:
    """Per-source chunk settings. ``empty_share`` = score of an empty chunk:
    None means "no score" and the document is excluded (quirk Q2); 0.0 keeps it
    (current filings, quirk Q3)."""

    trim_first: int | None = None
    trim_last: int | None = None
    empty_share: float | None = None


# Per-source trims and chunk settings of the reference's corpus build.
DEFAULT_PROFILES: dict[str, ChunkProfile] = {
    "annual": ChunkProfile(50, 25, None),
    "current": ChunkProfile(None, None, 0.0),
    "calls": ChunkProfile(10, 10, None),
    "news": ChunkProfile(2, 3, None),
    "reports": ChunkProfile(5, 5, None),
}
DEFAULT_CHUNK_WORDS = 200
DEFAULT_MAX_CHUNK_SHARE = 0.15
DEFAULT_MAX_DOC_SHARE = 0.30
# Characters from which a document is packed sentence by sentence instead of in arrays.
LONG_TEXT = 8_000_000


# ---------------------------------------------------------------------------
# Greedy word-bounded packing
# ---------------------------------------------------------------------------
def chunk_starts(word_counts: Column, max_words: int | Column) -> Column:
    """Positions where a new chunk starts after a flush (greedy rule: flush when
    ``current + words > max_words``, even if the current chunk is empty)."""
    mx = max_words if isinstance(max_words, Column) else F.lit(int(max_words))
    init = F.struct(F.array().cast("array<int>").alias("starts"),
                    F.lit(0).cast("long").alias("cnt"), F.lit(0).alias("pos"))

    def step(acc, w):
        flush = acc["cnt"] + w > mx
        return F.when(flush, F.struct(F.array_append(acc["starts"], acc["pos"]).alias("starts"),
                                      w.cast("long").alias("cnt"), (acc["pos"] + 1).alias("pos"))) \
            .otherwise(F.struct(acc["starts"].alias("starts"), (acc["cnt"] + w).alias("cnt"),
                                (acc["pos"] + 1).alias("pos")))

    return F.aggregate(word_counts, init, step, lambda acc: acc["starts"])


def with_packed_chunks(df: DataFrame, sentences: str, max_words: int | Column, out: str = "chunks") -> DataFrame:
    """T1 on a DataFrame: array-of-sentences column -> array-of-chunks column.

    Runs as staged projections so the sentence array and the chunk bounds are
    computed once per document (a column referenced inside a lambda would be
    re-evaluated per element otherwise). NULL in -> NULL out; zero sentences ->
    zero chunks; a chunk may exceed ``max_words`` (sentences are never cut);
    chunk 0 is '' when the first sentence alone exceeds the limit (quirk Q2)."""
    s = F.col(sentences)
    staged = df.withColumn("_bounds", F.concat(F.array(F.lit(0)),
                                               chunk_starts(F.transform(s, word_count), max_words),
                                               F.array(F.size(s))))
    b = F.col("_bounds")
    chunks = F.transform(
        F.sequence(F.lit(0), F.size(b) - 2),
        lambda j: F.array_join(F.slice(s, b[j] + 1, b[j + 1] - b[j]), " "),
    )
    packed = F.when(F.size(s) > 0, chunks).when(F.size(s) == 0, F.array().cast("array<string>"))
    return staged.withColumn(out, packed).drop("_bounds")


def spread(df: DataFrame, partitions: int | None, key: str = "doc_id") -> DataFrame:
    """Deal the rows into ``partitions`` by ``key`` when the caller asks for it.

    With None the scan's own partitions stay (``spark.sql.files.maxPartitionBytes``
    and friends set their size) and no text is shuffled."""
    return df if partitions is None else df.repartition(partitions, key)


# ---------------------------------------------------------------------------
# The per-source chunk job
# ---------------------------------------------------------------------------
def _profile_col(profiles: dict[str, ChunkProfile], attr: str, cast: str) -> Column:
    expr = None
    for name, p in profiles.items():
        v = getattr(p, attr)
        lit = F.lit(v).cast(cast)
        expr = F.when(F.col("source") == name, lit) if expr is None else expr.when(F.col("source") == name, lit)
    return expr.otherwise(F.lit(getattr(OTHER_SOURCE, attr)).cast(cast))


# Sources without a profile of their own: whole documents, no trimming.
OTHER_SOURCE = ChunkProfile(None, None, None)


def clean_documents(docs: DataFrame, profiles: dict[str, ChunkProfile] | None = None,
                    max_doc_share: float = DEFAULT_MAX_DOC_SHARE,
                    exhibits=CURRENT_FILING_EXHIBITS, distinct_calls: bool | Callable[[DataFrame], DataFrame] = True,
                    partitions: int | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Per-source fetch + clean (S1-S2, F1-F4, X7-X9) -> ``source, doc_id, text``.

    ``limit`` and ``offset`` page every source's scan by ``doc_id`` before its filters (transcripts: after
    the distinct scan, as ``SELECT DISTINCT .. LIMIT`` does).
    ``distinct_calls`` may be a function: the distinct scan to use (a stream's has state).
    Documents of a source without a profile are kept as they are (``OTHER_SOURCE``).

    Rows removed by a source filter (F1, F2, F3, distinct) are not documents of the
    job; NULL texts stay and are counted as excluded later (F8)."""
    profiles = profiles or DEFAULT_PROFILES
    wanted = ["doc_id", "source", "doc_type", "text"]
    src, text = F.col("source"), F.col("text")

    # Every source but transcripts: one projection (transcripts are redistributed by
    # their distinct aggregation).
    rest = spread(page_by_source(docs.select(*wanted).where(~src.eqNullSafe("calls")), limit, offset), partitions).where(
        ~src.eqNullSafe("current")
        | (F.col("doc_type").isin(list(exhibits))
           & (text.isNull() | (digit_punct_fraction(text, empty=0.0) <= max_doc_share)))
    )
    cleaned = (F.when(src == "news", flatten_newlines(text))
               .when(src == "reports", clean_reports_text(text))
               .otherwise(text))
    rest = rest.select("source", "doc_id", cleaned.alias("text"))
    calls = docs.where(src == "calls")
    if callable(distinct_calls):
        calls = distinct_calls(calls)
    elif distinct_calls:
        calls = scan_distinct(calls.select(*wanted))
    calls = page_by_source(calls.select(*wanted), limit, offset)
    lines = F.split(text, "\n", -1)
    calls = calls.where(text.isNull() | (F.size(lines) >= 5)).select(
        "source", "doc_id", F.array_join(strip_speaker_prefixes(lines), " ").alias("text"))
    return rest.unionByName(calls)


def chunk_documents(docs: DataFrame, profiles: dict[str, ChunkProfile] | None = None,
                    chunk_words: int = DEFAULT_CHUNK_WORDS, clean: bool = True, distinct_calls: bool = True,
                    partitions: int | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Document-level chunk result: ``source, doc_id, chunks, shares, excluded``.

    ``chunks`` is NULL when the document failed (NULL text, too few sentences);
    ``excluded`` is also true when an empty chunk has no score (Q2)."""
    profiles = profiles or DEFAULT_PROFILES
    base = clean_documents(docs, profiles, distinct_calls=distinct_calls, partitions=partitions, limit=limit, offset=offset) if clean \
        else spread(page_by_source(docs, limit, offset), partitions).select("source", "doc_id", "text")
    first = _profile_col(profiles, "trim_first", "int")
    last = _profile_col(profiles, "trim_last", "int")
    empty_share = _profile_col(profiles, "empty_share", "double")
    staged = base.select("source", "doc_id", empty_share.alias("_empty"),
                         trim_sentences(split_sentences(F.col("text")), first, last).alias("_sentences"))
    staged = with_packed_chunks(staged, "_sentences", chunk_words, "chunks")
    shares = F.transform(F.col("chunks"),
                         lambda c: F.when(F.length(c) > 0, digit_punct_fraction(c)).otherwise(F.col("_empty")))
    out = staged.select("source", "doc_id", "chunks", shares.alias("shares"))
    excluded = F.col("chunks").isNull() | F.exists(F.col("shares"), lambda x: x.isNull())
    return out.withColumn("excluded", excluded)


def pack_chunks(docs: DataFrame, chunk_words: int = DEFAULT_CHUNK_WORDS, first: int | None = None,
                last: int | None = None, text: str = "text", partitions: int | None = None,
                long_text: int = LONG_TEXT) -> DataFrame:
    """T1 as a table function: ``doc_id, chunk_id, sequence`` for every raw chunk
    (split -> trim -> pack); documents failing the trim check give no rows.

    Texts of more than ``long_text`` characters, whose arrays of sentences and chunks would have to fit one row
    several times, go through ``pack_long_documents``."""
    long = F.length(F.col(text)) > long_text
    staged = spread(docs.where(~F.coalesce(long, F.lit(False))), partitions).select("doc_id", trim_sentences(split_sentences(F.col(text)), first, last).alias("_s"))
    staged = with_packed_chunks(staged, "_s", chunk_words, "chunks")
    short = staged.select("doc_id", posexplode_rows("chunks").alias("chunk_id", "sequence")) \
        .withColumn("chunk_id", F.col("chunk_id").cast("int"))
    return short.unionByName(pack_long_documents(docs.where(long), chunk_words, first, last, text))


# White space as Java's (?U)\s has it, and the two patterns of functions.text over it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BOUNDARY = re.compile(rf"(?<=[.?])(?<![A-Z][a-z]\.)(?<!\d\.)[{_SPACE}]")
_WORD = re.compile(rf"[^{_SPACE}]+")
OUT_CHARS = 4 << 20


def _sentences(text: str) -> Iterator[str]:
    """X1, one sentence at a time."""
    start = 0
    for m in _BOUNDARY.finditer(text):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def _trimmed(text: str, first: int | None, last: int | None) -> Iterator[str] | None:
    """F7 on the stream of sentences; None where the document is excluded."""
    a, b = first or 0, last or 0
    if not a and not b:
        return _sentences(text)
    n = 1 + sum(1 for _ in _BOUNDARY.finditer(text))
    if not (2 * b < n if a and b else a + b < n):
        return None
    return islice(_sentences(text), a, max(a, n - b))


def _packed(sentences: Iterator[str], max_words: int) -> Iterator[str]:
    """T1 with one open chunk as its state."""
    held: list[str] = []
    words, any_chunk = 0, False
    for s in sentences:
        any_chunk, n = True, sum(1 for _ in _WORD.finditer(s))
        if words + n > max_words:
            yield " ".join(held)
            held, words = [], 0
        held.append(s)
        words += n
    if any_chunk:
        yield " ".join(held)


def pack_long_documents(docs: DataFrame, chunk_words: int = DEFAULT_CHUNK_WORDS, first: int | None = None,
                        last: int | None = None, text: str = "text") -> DataFrame:
    """T1 for documents of any size: the text is walked sentence by sentence and chunks leave
    the task in batches of about ``OUT_CHARS`` characters, so beside the text a task holds one open chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", id_type), ("chunk_id", pa.int32()), ("sequence", pa.string())])
        for batch in batches:
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                sentences = _trimmed(value.as_py(), first, last) if value.is_valid else None
                rows, size = [], 0
                for i, chunk in enumerate(_packed(sentences, chunk_words) if sentences is not None else ()):
                    rows.append((i, chunk))
                    size += len(chunk)
                    if size >= OUT_CHARS:
                        yield made(doc_id, rows, kind)
                        rows, size = [], 0
                if rows:
                    yield made(doc_id, rows, kind)

    def made(doc_id: pa.Scalar, rows: list, kind: pa.Schema) -> pa.RecordBatch:
        ids = pa.array([doc_id.as_py()] * len(rows), id_type)
        return pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], schema=kind)

    id_kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(id_kind)
    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(run, f"doc_id {id_kind.simpleString()}, chunk_id int, sequence string")


def chunk_corpus(docs: DataFrame, profiles: dict[str, ChunkProfile] | None = None,
                 chunk_words: int = DEFAULT_CHUNK_WORDS, max_share: float = DEFAULT_MAX_CHUNK_SHARE,
                 clean: bool = True, distinct_calls: bool = True, partitions: int | None = None,
                 limit: int | None = None, offset: int | None = None) -> DataFrame:
    """T2 (flagship): ``source, doc_id, chunk_id, sequence`` for every kept chunk.

    ``chunk_id`` is the chunk's position in its document before the quality
    filter, so the keys are stable lineage (deviation D1)."""
    return _kept_chunks(chunk_documents(docs, profiles, chunk_words, clean, distinct_calls, partitions, limit, offset), max_share)


def _kept_chunks(doc: DataFrame, max_share: float) -> DataFrame:
    # Exclusion is folded into the generator input instead of a Filter: a Filter on
    # a derived column would be pushed below the projections and re-run the whole
    # text pipeline inside its predicate.
    zipped = F.when(~F.col("excluded"), F.arrays_zip("chunks", "shares"))
    exploded = doc.select("source", "doc_id", F.posexplode(zipped).alias("chunk_id", "c"))
    return (exploded.where(F.col("c.shares") <= max_share)
            .select("source", "doc_id", F.col("chunk_id").cast("int").alias("chunk_id"),
                    F.col("c.chunks").alias("sequence")))


def _document_counts(doc: DataFrame, max_share: float) -> dict[str, Column]:
    """Per document: what the report adds up."""
    ok = ~F.col("excluded")
    return {
        "n_excluded": F.col("excluded").cast("long"),
        "n_raw_chunks": F.coalesce(F.size("chunks"), F.lit(0)).cast("long"),
        "share_sum": F.when(ok, F.aggregate("shares", F.lit(0.0), lambda a, s: a + s)).otherwise(F.lit(0.0)),
        "n_kept_chunks": F.when(ok, F.size(F.filter("shares", lambda s: s <= max_share))).otherwise(F.lit(0)).cast("long"),
    }


def _report(totals: DataFrame, sums: DataFrame) -> DataFrame:
    named = sums.withColumnRenamed("source", "_source")
    return (totals.join(named, F.col("source").eqNullSafe(F.col("_source")), "left")
            .select("source", "n_documents",
                    F.coalesce("n_excluded", F.lit(0)).alias("n_excluded"),
                    (F.coalesce("n_excluded", F.lit(0)) / F.col("n_documents")).alias("excluded_fraction"),
                    F.coalesce("n_raw_chunks", F.lit(0)).alias("n_raw_chunks"),
                    F.when(F.col("n_raw_chunks") > 0, F.col("share_sum") / F.col("n_raw_chunks")).alias("mean_share"),
                    F.coalesce("n_kept_chunks", F.lit(0)).alias("n_kept_chunks")))


def chunk_report(docs: DataFrame, profiles: dict[str, ChunkProfile] | None = None,
                 chunk_words: int = DEFAULT_CHUNK_WORDS, max_share: float = DEFAULT_MAX_CHUNK_SHARE,
                 limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A1: per source -- documents in the table, excluded documents and fraction,
    raw chunks (including those of documents later excluded), mean share over raw
    chunks (sum without excluded documents, as the reference does), kept chunks. With
    ``limit``/``offset`` the document count, and so the fraction's denominator, is still the whole table's.

    Two partial aggregations on ``source`` (a handful of keys): map-side combine
    keeps the shuffle at one row per source per task. ``write_corpus`` gives the same report from the
    pass that writes the chunks."""
    doc = chunk_documents(docs, profiles or DEFAULT_PROFILES, chunk_words, limit=limit, offset=offset)
    counts = _document_counts(doc, max_share)
    sums = doc.select("source", *[c.alias(n) for n, c in counts.items()]).groupBy("source").agg(*[F.sum(n).alias(n) for n in counts])
    return _report(count_documents(docs), sums)


def write_corpus(docs: DataFrame, path: str, profiles: dict[str, ChunkProfile] | None = None,
                 chunk_words: int = DEFAULT_CHUNK_WORDS, max_share: float = DEFAULT_MAX_CHUNK_SHARE,
                 limit: int | None = None, offset: int | None = None, partitions: int | None = None) -> DataFrame:
    """T2 + S7 + A1 in one pass: write the chunk table (partitioned by source) and return its report.

    The report's sums are observed on the documents as they stream into the write; only a count of the ``source``
    column (for the whole table's totals) is read beside it. One row per source reaches the driver."""
    spark = docs.sparkSession
    totals = [(r["source"], r["n_documents"]) for r in count_documents(docs).collect()]
    doc = chunk_documents(docs, profiles or DEFAULT_PROFILES, chunk_words, partitions=partitions, limit=limit, offset=offset)
    counts, seen = _document_counts(doc, max_share), Observation()
    sums = [F.coalesce(F.sum(F.when(F.col("source").eqNullSafe(F.lit(source)), c)), F.lit(0)).alias(f"{n}_{i}")
            for i, (source, _) in enumerate(totals) for n, c in counts.items()]
    if not sums:
        sums = [F.count(F.lit(1)).alias("n")]
    write_chunks(_kept_chunks(doc.observe(seen, *sums), max_share), path)
    got = seen.get
    rows = [(source, *[got[f"{n}_{i}"] for n in counts]) for i, (source, _) in enumerate(totals)]
    observed = spark.createDataFrame(rows, "source string, n_excluded long, n_raw_chunks long, share_sum double, n_kept_chunks long")
    return _report(spark.createDataFrame(totals, "source string, n_documents long"), observed)


# ---------------------------------------------------------------------------
# Document -> ordered sentences (document-level tasks)
# ---------------------------------------------------------------------------
def document_sequences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per sentence (simple split), ``seq_idx`` from 0."""
    return docs.select(key, F.posexplode(split_sentences_simple(F.col("text"))).alias("seq_idx", "sentence"))
