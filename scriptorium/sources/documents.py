"""Document scans, paging, distinct scan, union, counts, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import flatten_newlines
from ..operators.ordering import index_rows


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read a document table (``doc_id, source, doc_type, text``) from any Spark source."""
    return spark.read.format(fmt).options(**options).load(path)


def scan_source(docs: DataFrame, source: str | None = None) -> DataFrame:
    """Keep only what a source's chunk job uses (id, source, exhibit type, text).

    The source predicate and the column pruning reach the Parquet scan."""
    out = docs.select("doc_id", "source", "doc_type", "text")
    if source is not None:
        out = out.where(F.col("source") == source)
    return out


def scan_distinct(docs: DataFrame) -> DataFrame:
    """Distinct texts; the survivor of a duplicate group is its smallest ``doc_id``.

    Grouped by a 256-bit digest, so no sort or shuffle key is a whole text; every
    column is the survivor's own. Duplicates collapse in the map-side partial
    aggregate: a hot text is one row per partition before the shuffle."""
    row = F.struct("doc_id", "doc_type", "text")
    return (docs.groupBy("source", F.sha2(F.col("text").cast("binary"), 256).alias("_digest"))
            .agg(F.min_by(row, "doc_id").alias("_row"))
            .select("_row.doc_id", "source", "_row.doc_type", "_row.text"))


# Pages that end within so many rows are a top-k; later ones are found by numbering the order's keys.
TOP_PAGE_ROWS = 10_000


def scan_page(docs: DataFrame, limit: int | None = None, offset: int | None = None,
              order_by: str | list[str] = "doc_id") -> DataFrame:
    """S3: LIMIT/OFFSET paging over an explicit order that tells all rows apart (0/None = unset).

    A page near the start is ``orderBy + offset + limit``, a distributed top-k. A deep page, or an offset alone,
    would sort its whole prefix in one task; there the keys are numbered in blocks and the page's keys
    fetch their rows. The rows themselves come in no order."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    lo, size = int(offset or 0), int(limit or 0)
    if not lo and not size:
        return docs
    if size and lo + size <= TOP_PAGE_ROWS:
        return docs.orderBy(*order).offset(lo).limit(size)
    return _rows_between(docs, order, [], lo, size)


def page_by_source(docs: DataFrame, limit: int | None = None, offset: int | None = None,
                   order_by: str | list[str] = "doc_id") -> DataFrame:
    """S3 for every source on its own: rows [offset, offset + limit) of each, in the order of unique keys."""
    if not limit and not offset:
        return docs
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return _rows_between(docs, order, ["source"], int(offset or 0), int(limit or 0))


def _rows_between(docs: DataFrame, order: list[str], by: list[str], lo: int, size: int) -> DataFrame:
    """Only keys are numbered; texts meet the page's keys by a semi-join (a broadcast one where the page is small)."""
    numbered = index_rows(docs.select(*by, *order), order, by=by, out="_at")
    page = numbered.where(F.col("_at") >= lo)
    page = page.where(F.col("_at") < lo + size) if size else page
    keys = [*by, *order]
    named = page.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)])
    return docs.join(named, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)], "left_semi")


def corpus_union(sources: dict[str, DataFrame]) -> DataFrame:
    """One text corpus over several sources. News and reports get newline->space,
    NULL texts are skipped (not a stop, deviation D5)."""
    parts = []
    for name, df in sources.items():
        text = flatten_newlines(F.col("text")) if name in ("news", "reports") else F.col("text")
        parts.append(df.where(F.col("text").isNotNull())
                     .select("doc_id", F.lit(name).alias("source"), text.alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def corpus_union_by_source(docs: DataFrame) -> DataFrame:
    """S4 on a single table that carries a ``source`` column."""
    text = F.when(F.col("source").isin("news", "reports"), flatten_newlines(F.col("text"))).otherwise(F.col("text"))
    return docs.where(F.col("text").isNotNull()).select("doc_id", "source", text.alias("text"))


def count_documents(docs: DataFrame) -> DataFrame:
    """Documents per source (answered from Parquet metadata-light scans)."""
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"))


def count_sequences(seqs: DataFrame) -> DataFrame:
    """Sequences per chunk table."""
    return seqs.groupBy("source").agg(F.count(F.lit(1)).alias("n_sequences"))


def preview_sources(df: DataFrame, n: int = 5, order_by: str | list[str] = "doc_id") -> DataFrame:
    """First ``n`` rows per source.

    A per-group top-n: Spark 3.5+ plans ``row_number() <= n`` with a
    WindowGroupLimit below the shuffle, so each map task forwards at most ``n``
    rows per source and a hot source never lands whole in one task."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    w = Window.partitionBy("source").orderBy(*order)
    return df.withColumn("row_no", F.row_number().over(w).cast("long")).where(F.col("row_no") <= n)
