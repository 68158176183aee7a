"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import table
from scriptorium.llm.near_dedup import near_duplicates
from scriptorium.llm.packing import pack_documents
from scriptorium.llm.secret_scan import redact_secrets
from scriptorium.llm.suffix_dedup import remove_repeats, text_key
from scriptorium.llm.toxicity import labelled_rows, score_toxicity, train_toxicity
from scriptorium.session import ensure_checkpoint_dir


# Passages of over 50 words that documents share go, short words included: 51 words and their spaces have 238 bytes or
# more in 99 of 100 places of the test texts. Operator 10's own length, 400 bytes, is that of its contract.
PASSAGE_BYTES, GRAM_BYTES = 200, 32


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the changed text where there is such a column."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 4 scores below one half."""
    model = train_toxicity(labelled_rows(spark, docs, sf_dir))
    return score_toxicity(docs, model, score="__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def _one_row(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """One row per value of ``keys`` (the smallest); every task brings one of its rows, so a hot value stays small."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("__row")).select("__row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component that operator 5 finds the document with the smallest id, once.

    Rows with equal id and text count as one. Rows without an id are linked with nothing: one row of each of
    their texts stays, unless a document with an id has the same text (a text without words stays in any case).
    """
    columns, text = docs.columns, ["__a", "__b"]
    keyed = docs.withColumn("__a", F.xxhash64("text")).withColumn("__b", F.xxhash64(F.lit(1), "text"))
    named, unnamed = keyed.where("doc_id is not null"), keyed.where("doc_id is null")
    others = near_duplicates(docs).where("not kept").select("doc_id", F.lit(True).alias("__gone"))
    repeated = named.groupBy("doc_id", *text).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(False).alias("__gone"))
    # Both lists have the id as key, so the texts are dealt for one join only.
    marks = others.union(repeated).groupBy("doc_id").agg(F.max("__gone").alias("__gone"))
    rows = named.join(marks, "doc_id", "left")
    once = rows.where("__gone is null").select(*columns)
    again = _one_row(rows.where("not __gone"), columns, "doc_id", *text)
    worded = named.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).select(*text).distinct()
    free = _one_row(unnamed.join(worded, text, "left_anti"), columns, *text)
    return once.unionByName(again).unionByName(free)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the bytes that operator 10 removes for strings of PASSAGE_BYTES (null texts stay null)."""
    kept = remove_repeats(docs, length=PASSAGE_BYTES, gram=GRAM_BYTES).select(F.col("text").alias("__key"), "kept_text")
    # The rows travel without their text: what is kept of it comes back whole.
    rows = docs.withColumn("__key", text_key()).withColumn("__null", F.col("text").isNull()).drop("text")
    joined = rows.join(kept, "__key").withColumn("text", F.when(~F.col("__null"), F.col("kept_text")))
    return _sized(joined, docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document; the spans that operator 8 finds are replaced by a mark."""
    return _sized(redact_secrets(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of operator 3 with their token ids, one row per piece."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written to the shared checkpoint folder and read again."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Compressed lengths (toxicity) and tokenizer ids (packing) cannot be written in SQL, so the stages
# are tested against brute force instead.
ORACLE_SQL = None
