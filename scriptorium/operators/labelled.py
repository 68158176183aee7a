"""Labelled-set preparation: J4, S8, A4, X15 (document padding) and T3 helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import _num_blocks, index_rows, uniform_block
from ..functions.random import hash_uniform


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str = "label",
                       key: str = "doc_id") -> DataFrame:
    """Pair documents with their labels (inner equi-join on the document key;
    both sides are shuffled on the key, or the label side is broadcast by AQE when
    its measured size is small)."""
    lab = labels.select(key, F.col(label).cast("int").alias("label"))
    return docs.select(key, "text").join(lab, key)


def labelled_union(parts: dict[str, DataFrame], seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Shuffle each part with its own seeded order and concatenate them with a
    ``part`` column; ``row_no`` is the position inside the part (train before test
    is the order of ``parts``)."""
    out = None
    for name, df in parts.items():
        d = df.withColumn("part", F.lit(name))
        out = d if out is None else out.unionByName(d)
    nb = _num_blocks(out, None)
    return index_rows(out.withColumn("_u", hash_uniform(seed, F.col(key))), ["_u", key], by=["part"],
                      block=uniform_block(F.col("_u"), nb), num_blocks=nb).drop("_u")


def label_counts(df: DataFrame, by: list[str] | tuple = (), label: str = "label") -> DataFrame:
    """A4: sorted distinct labels with counts, per ``by`` group (split, fold ...)."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n")).orderBy(*by, label)


def pad_documents(seqs: DataFrame, max_sequences: int, length: int, doc: str = "doc_id", idx: str = "seq_idx",
                  keep: tuple = ()) -> DataFrame:
    """Per document, the first ``max_sequences`` encoded sequences (in
    ``seq_idx`` order) as ``ARRAY<ARRAY<INT>>`` ids and masks, padded with zero rows
    to exactly ``max_sequences``; ``sequence_mask`` is 1 for real rows.

    Rows past ``max_sequences`` are dropped before the group-by, so each group
    holds at most ``max_sequences`` rows however long the document is."""
    kept = seqs.where(F.col(idx) < max_sequences)
    g = kept.groupBy(doc, *keep).agg(F.array_sort(F.collect_list(
        F.struct(F.col(idx).alias("i"), F.col("input_ids").alias("ids"), F.col("attention_mask").alias("m"))))
        .alias("_s"))
    n = F.size("_s")
    pad_rows = F.array_repeat(F.array_repeat(F.lit(0), length), F.lit(max_sequences) - n)
    return g.select(
        doc, *keep,
        F.concat(F.transform("_s", lambda e: e["ids"]), pad_rows).alias("input_ids"),
        F.concat(F.transform("_s", lambda e: e["m"]), pad_rows).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_sequences) - n)).alias("sequence_mask"),
    )
