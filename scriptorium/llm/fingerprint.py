"""Operator 7: document fingerprints by consistent weighted sampling (DataFrame functions only).

A document is the weighted set of its words, weighted by how often they occur.
For sample k every word draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a hash of
(word, k) alone; with t = floor(ln w / r + b) the word's key is
ln a = ln c - r (t - b + 1), and the document's k-th sample is the word (and t)
with the smallest key. Two documents have the same sample with probability
sum min(w, w') / sum max(w, w'), the generalised Jaccard similarity. As a key is
a continuous draw of (word, t), the smallest key itself stands for the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import keep, table, whole_text

SPACE = r"[\x20\x09-\x0D]+"
SAMPLES = 32
# Stands for a missing id inside the joins; no document may bear it.
NO_ID = -(2**63)


def _uniform(bits: Column, low: int, width: int) -> Column:
    """A number in (0, 1) from ``width`` bits of a long, from bit ``low`` on."""
    part = F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -width)


def weighted_samples(terms: DataFrame, keys: list[str], term: str, counts: list[str], samples: int = SAMPLES,
                     at_once: int = 4) -> DataFrame:
    """One row per ``keys``: for the i-th of ``counts`` an array ``sig_<i>`` of ``samples`` ints.

    ``terms`` has one row per key and term with the term's counts. The array is null where a key has
    no term of that count above 0; the chance that two different samples agree is 2^-32. ``at_once``
    samples are drawn per exploded row: enough to share its cost, few enough to stay compiled.
    """
    n = len(counts)
    logs = terms.select(
        *keys, term,
        *[F.when(F.col(c) > 0, F.log(F.col(c).cast("double"))).alias(f"ln_{i}") for i, c in enumerate(counts)],
        F.explode(F.array(*[F.lit(k) for k in range(samples // at_once)])).alias("block"))
    draws = []
    for j in range(at_once):
        h, g = F.xxhash64(term, "block", F.lit(2 * j)), F.xxhash64(term, "block", F.lit(2 * j + 1))
        draws += [(-F.log(_uniform(h, 0, 21) * _uniform(h, 21, 21))).alias(f"r_{j}"), _uniform(h, 42, 21).alias(f"b_{j}"),
                  F.log(-F.log(_uniform(g, 0, 31) * _uniform(g, 31, 31))).alias(f"c_{j}")]
    drawn = logs.select(*keys, "block", *[f"ln_{i}" for i in range(n)], *draws)

    def key(i: int, j: int) -> Column:
        r, b = F.col(f"r_{j}"), F.col(f"b_{j}")
        return F.col(f"c_{j}") - r * (F.floor(F.col(f"ln_{i}") / r + b) - b + 1)

    least = drawn.groupBy(*keys, "block").agg(*[F.min(key(i, j)).alias(f"s_{i}_{j}") for i in range(n) for j in range(at_once)])
    blocks = least.select(*keys, F.struct("block", *[
        F.when(F.col(f"s_{i}_0").isNotNull(), F.array(*[F.hash(f"s_{i}_{j}") for j in range(at_once)])).alias(f"sig_{i}")
        for i in range(n)]).alias("part"))
    # samples / at_once parts for each key, no more
    grouped = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return grouped.select(*keys, *[F.flatten(F.col(f"parts.sig_{i}")).alias(f"sig_{i}") for i in range(n)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; 1 for two documents without words, 0 if only one has none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return (F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0))
            .otherwise(same / F.lit(float(samples))))


def fingerprint_text(sig: Column) -> Column:
    """The samples as hexadecimal text, eight digits each; empty for a document without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit(""))


def next_ids(ids: DataFrame, column: str) -> DataFrame:
    """(id, next_id) of the distinct non-null ids in ascending order, the first one after the last.

    Neighbours are found inside blocks of 2^12 ids, blocks inside blocks of 2^24; only the list of
    the latter is ordered in one task (one row per 16.8 million ids of range).
    """
    one = ids.select(F.col(column).cast("long").alias("id")).where("id is not null").distinct()
    one = one.select("id", F.shiftright("id", 12).alias("b1"), F.shiftright("id", 24).alias("b2"))
    near = one.withColumn("n1", F.lead("id").over(Window.partitionBy("b1").orderBy("id")))
    blocks = one.groupBy("b1", "b2").agg(F.min("id").alias("low"))
    blocks = blocks.withColumn("n2", F.lead("low").over(Window.partitionBy("b2").orderBy("b1")))
    far = blocks.groupBy("b2").agg(F.min("low").alias("low"))
    everything = Window.partitionBy(F.lit(0))
    far = far.select("b2", F.lead("low").over(everything.orderBy("b2")).alias("n3"), F.min("low").over(everything).alias("first"))
    return (near.join(blocks.select("b1", "n2"), "b1").join(far, "b2")
            .select("id", F.coalesce("n1", "n2", "n3", "first").alias("next_id")))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited form, in which the last floor(n/4) code points are
    replaced by the first as many of the next document (ascending id; after the last one the first).

    Returns per distinct row: doc_id, h (hash of the text), copies, n_chars, edited_sha256, sig,
    edited_sig. A null text reads as empty. Repeated rows are one row with their number; of different texts under one id the smallest one is the "next document"
    of the row before. A row without an id has no next document: nothing replaces what is taken off.
    """
    # ``key`` is never null, so the joins below add no filter and share one shuffle of the texts; every
    # step on (key, h) stays inside its partitions.
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("key"), whole_text(text).alias("t"))
    rows = rows.repartition(F.col("key")).groupBy("key", F.xxhash64("t").alias("h")).agg(
        F.max("t").alias("t"), F.count(F.lit(1)).alias("copies"))
    sized = docs.select(F.col(doc_id).cast("long").alias("id"), F.floor(F.char_length(whole_text(text)) / 4).cast("int").alias("q"))
    need = sized.groupBy("id").agg(F.max("q").alias("q")).where("q > 0")
    order = next_ids(docs, doc_id)
    wanted = order.join(need, "id").select(F.col("id").alias("before"), F.coalesce("next_id", F.lit(NO_ID)).alias("key"), "q")
    heads = (rows.join(wanted, "key").select(F.coalesce("before", F.lit(NO_ID)).alias("before"), F.expr("left(t, q)").alias("head"))
             .groupBy(F.col("before").alias("key")).agg(F.min("head").alias("head")))

    joined = rows.join(heads, "key", "left").withColumn("n_chars", F.char_length("t").cast("long"))
    cut = joined.select(
        "key", "h", "copies", "n_chars", "t",
        F.expr("left(t, cast(n_chars - floor(n_chars / 4) as int))").alias("kept"),
        F.expr("coalesce(left(head, cast(floor(n_chars / 4) as int)), '')").alias("tail"))
    whole = cut.select(
        "key", "h", "copies", "n_chars", "t", F.concat("kept", "tail").alias("e"),
        # Words up to the last space before the cut are the same on both sides and counted once.
        F.char_length(F.regexp_extract("kept", r"(?s)^(.*[\x20\x09-\x0D])", 1)).alias("both"))
    parts = whole.select(
        "key", "h", "copies", "n_chars", F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"),
        F.split(F.expr("left(t, both)"), SPACE).alias("w2"),
        F.split(F.expr("substring(t, both + 1)"), SPACE).alias("w0"),
        F.split(F.expr("substring(e, both + 1)"), SPACE).alias("w1"))
    words = parts.select(
        "key", "h", F.size("w2").alias("a"), (F.size("w2") + F.size("w0")).alias("b"),
        F.posexplode(F.concat("w2", "w0", "w1")).alias("pos", "word")).where("word <> ''")
    terms = words.groupBy("key", "h", F.xxhash64("word").alias("term")).agg(
        F.sum(F.when(F.col("pos") < F.col("b"), 1).otherwise(0)).alias("c0"),
        F.sum(F.when((F.col("pos") < F.col("a")) | (F.col("pos") >= F.col("b")), 1).otherwise(0)).alias("c1"))
    sigs = weighted_samples(terms, ["key", "h"], "term", ["c0", "c1"], samples)

    info = parts.select("key", "h", "copies", "n_chars", "edited_sha256")
    return info.join(sigs, ["key", "h"], "left").select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "h", "copies", "n_chars", "edited_sha256",
        F.col("sig_0").alias("sig"), F.col("sig_1").alias("edited_sig"))


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``fingerprint_edits`` plus ``next_sig``, the samples of the next document's text, one row per input row."""
    sigs = keep(fingerprint_edits(docs, doc_id, text, samples))
    following = sigs.groupBy(F.col("doc_id").alias("next_id")).agg(F.min_by("sig", "h").alias("next_sig"))
    after = next_ids(docs, doc_id).join(following, "next_id").select(F.col("id").alias("doc_id"), "next_sig")
    return (sigs.join(after, "doc_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .drop("copy", "copies", "h"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents``, of its edited text, and their likeness."""
    out = fingerprint_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("sig")).alias("fingerprint"),
        fingerprint_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
