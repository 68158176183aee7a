"""S7 and friends: writing chunk tables.

Output goes to a new location partitioned by source (``errorifexists``: the
reference refuses to write into an existing output). Writing sorted by
``(source, row_no)`` after R1 makes later epoch windows range scans that skip
row groups by their min/max statistics.

A shuffled table is published as a version: the rows are written into a folder of their own, and
only then a manifest entry (version number, folder, rows per source) makes it the current one. A crash
before the entry leaves the version before in place; readers of it are not disturbed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a chunk table partitioned by ``source`` (batch)."""
    chunks.write.mode(mode).partitionBy("source").parquet(path)


def write_shuffled(shuffled: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """R1 sink: one folder per source, rows clustered by ``row_no`` so the W1 range
    predicate prunes row groups. The range repartition keeps a hot source spread
    over many files."""
    (shuffled.repartitionByRange("source", "row_no").sortWithinPartitions("source", "row_no")
     .write.mode(mode).partitionBy("source").parquet(path))


def write_version(shuffled: DataFrame, out_dir: str, by: str = "source") -> str:
    """R1, first half: write the rows of ``shuffle_into_stripes`` into a new folder under ``out_dir``; its name."""
    name = f"rows-{uuid.uuid4().hex}"
    shuffled.sortWithinPartitions(by, "stripe", "row_no").write.partitionBy(by, "stripe").parquet(f"{out_dir.rstrip('/')}/{name}")
    return name


def commit_version(spark: SparkSession, out_dir: str, name: str, by: str = "source") -> int:
    """R1, second half: make a written folder the current version. The entry is one small file, so it is there or not."""
    base = out_dir.rstrip("/")
    totals = spark.read.parquet(f"{base}/{name}").groupBy(by).agg(F.count(F.lit(1)).alias("n_total"))
    seen = _entries(spark, base)
    version = 1 + (seen.agg(F.max("version")).first()[0] or 0 if seen is not None else 0)
    entry = totals.withColumn("folder", F.lit(name)).withColumn("version", F.lit(version))
    entry.coalesce(1).write.mode("append").parquet(f"{base}/manifest")  # one row per source
    return version


def publish_shuffled(shuffled: DataFrame, out_dir: str, by: str = "source") -> int:
    """Write a new version, then swap it in; the version's number."""
    return commit_version(shuffled.sparkSession, out_dir, write_version(shuffled, out_dir, by), by)


def _entries(spark: SparkSession, base: str) -> DataFrame | None:
    """The manifest's rows, or None where nothing has been published."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifest")
    there = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
    return spark.read.parquet(folder.toString()) if there else None


def open_shuffled(spark: SparkSession, out_dir: str, version: int | None = None, by: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, totals) of the current version, or of an earlier one; totals (``by``, n_total) need no count."""
    base = out_dir.rstrip("/")
    seen = _entries(spark, base)
    if seen is None:
        raise FileNotFoundError(f"no version has been published under {out_dir}")
    mine = seen.where(F.col("version") == (version or seen.agg(F.max("version")).first()[0]))
    folders = [r["folder"] for r in mine.select("folder").distinct().collect()]
    if not folders:
        raise FileNotFoundError(f"version {version} has not been published under {out_dir}")
    return spark.read.parquet(f"{base}/{folders[0]}").drop("stripe"), mine.select(by, "n_total")
