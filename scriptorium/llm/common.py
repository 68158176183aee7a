"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table (all of them when none are named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def whole_text(name: str = "text") -> Column:
    """The text as it is; null reads as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_fold(name: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty string)."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    The copy outlives any executor, is computed once and cuts the lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in that folder, for steps that are repeated.

    A checkpoint keeps the size estimate of its plan. Each join multiplies the estimates of its sides, so after some rounds
    of joins with themselves the planner works on numbers of millions of digits; a table has the size of its files.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, read when a job is built."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
