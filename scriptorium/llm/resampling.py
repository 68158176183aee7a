"""Operator 11: importance resampling towards a target distribution.

Words, their runs of one to three and the hashed buckets of these are counted over all documents and
over all target texts; a bucket's gain is the logarithm of how much more the target favours it. The
gains (one array of BUCKETS numbers) travel with the tasks, which score each document by a look-up per
feature. Gumbel noise from a hash of the id turns scores into a draw without replacement, and the draw
takes the first ranks of a distributed radix sort.

The sort (``radix_ranks``) is least significant digit first. A pass counts the rows of every (block,
digit), adds the counts up over digits, then blocks (the global prefix offsets), and a row goes to the offset
of its (block, digit) plus its place there: a stable counting sort whose blocks are BLOCK consecutive
positions. Rows travel as positions and keys, never with their texts, and no task holds more than a block of one digit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import keep, keep_table, table, whole_text
from scriptorium.llm.words import word_lists

BUCKETS = 10_000
MIN_WORDS, PERCENT, SEED = 20, 5, 42
DIGIT_BITS, BLOCK_BITS = 11, 14
# Features are turned into counts whenever so many have come together.
RUN_FEATURES = 1 << 19


def _features(data: bytes) -> Iterator[tuple[int, list[int]]]:
    """(number of words, crc32 of every run of one to three words) of the slices of a text; runs cross slices."""
    last: list[bytes] = []
    for new in word_lists(data):
        old, words = len(last), last + new
        spaced = [b" " + w for w in words]
        # A checksum goes on from that of the run before its last word.
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        # Of each length, the runs that end in the new words.
        yield len(new), one[old:] + two[max(0, old - 1):] + three[max(0, old - 2):]
        last = words[-2:]


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all rows; every task sends each bucket once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting = np.zeros(buckets, np.int64), []

        def add() -> None:
            total[:] += np.bincount(np.fromiter(waiting, np.int64, len(waiting)) % buckets, minlength=buckets)
            waiting.clear()

        for batch in batches:
            for data in batch.column(0):
                for _, hashes in _features(data.as_py()):
                    waiting.extend(hashes)
                    if len(waiting) >= RUN_FEATURES:
                        add()
        add()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return (docs.select(whole_text(text).cast("binary").alias("data")).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def _dense(counts: DataFrame, buckets: int) -> list[int]:
    """The counts as a list of ``buckets`` numbers (its length bounds what comes to the driver)."""
    out = [0] * buckets
    for row in counts.collect():
        out[row.bucket] = row.n
    return out


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """One whole number per bucket: floor of 1000 times the log ratio of its smoothed shares in target and documents."""
    s = _dense(bucket_counts(docs, text, buckets), buckets)
    t = _dense(bucket_counts(target, target_text, buckets), buckets)
    all_s, all_t = float(sum(s)), float(sum(t))
    return np.array([math.floor(1000 * math.log((tb + 1.0) * (all_s + buckets) / ((sb + 1.0) * (all_t + buckets))))
                     for sb, tb in zip(s, t)], np.int64)


def feature_weights(table_of_gains: np.ndarray, data: Column) -> Column:
    """struct(n_words, n_features, weight) of a binary column; the array of gains travels with the tasks."""
    buckets = len(table_of_gains)
    kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    @F.arrow_udf("struct<n_words: long, n_features: long, weight: long>")
    def weigh(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for data in batch:
                n_words = n_features = weight = 0
                for n, hashes in _features(data.as_py()):
                    n_words, n_features = n_words + n, n_features + len(hashes)
                    weight += int(table_of_gains[np.fromiter(hashes, np.int64, len(hashes)) % buckets].sum())
                rows.append((n_words, n_features, weight))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(kind))

    return weigh(data)


def gumbel(seed: int, key: Column) -> Column:
    """floor of 1000 times the Gumbel noise of a key, from the first 32 bits of a hash (a null key counts as empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def _digits(bits: int, low: int, high: int) -> list[int]:
    """Shifts of the digits in which unsigned 64-bit numbers between ``low`` and ``high`` can differ."""
    return [s for s in range(0, 64, bits) if low >> s != high >> s]


def radix_ranks(rows: DataFrame, keys: list[tuple[str, bool]], out: str = "rank", digit_bits: int = DIGIT_BITS,
                block_bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``out``: the 1-based place of every row in the order of the whole-number columns ``keys`` (name, descending).

    Least significant digit first, the last key first; nulls come last. Digits that no two rows can differ in are
    skipped, which takes the smallest and the largest value of each key. Rows that are equal in all keys have
    their places in the order of the input. Sends only the columns of ``rows``, so give it ids and keys.
    An empty table gives an empty one.
    """
    names = rows.columns
    internal = [f"__k{i}" for i in range(len(keys))]
    turned = rows.withColumn("__pos", F.monotonically_increasing_id())
    for name, (key, descending) in zip(internal, keys):
        # Signed order as that of unsigned numbers; descending keys with all bits turned.
        number = F.coalesce(F.col(key).cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))
        turned = turned.withColumn(name, F.bitwise_not(number) if descending else number)
        turned = turned.withColumn(f"{name}_null", F.col(key).isNull().cast("int"))
    turned = keep(turned)
    sign = F.lit(-(1 << 63))
    ends = turned.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(k).bitwiseXOR(sign)).alias(f"{f.__name__}_{k}")
                                                      for k in internal for f in (F.min, F.max)],
                      *[F.max(f"{k}_null").alias(f"null_{k}") for k in internal]).first()
    if not ends.n:
        return rows.withColumn(out, F.lit(None).cast("long"))
    digits = []
    for k in reversed(internal):
        low, high = (ends[f"{f}_{k}"] + (1 << 63) for f in ("min", "max"))
        mask = F.lit((1 << digit_bits) - 1)
        digits += [F.shiftrightunsigned(k, s).bitwiseAND(mask) for s in _digits(digit_bits, low, high)]
        digits += [F.col(f"{k}_null").cast("long")] if ends[f"null_{k}"] else []
    # Without a digit to sort by, one pass over a constant gives dense places.
    for digit in digits or [F.lit(0).cast("long")]:
        turned = keep_table(_counting_pass(turned, digit, block_bits))
    return turned.select(*names, (F.col("__pos") + 1).alias(out))


def _counting_pass(rows: DataFrame, digit: Column, block_bits: int) -> DataFrame:
    """One stable counting sort: ``__pos`` becomes the place of a row after ordering by ``digit``, then ``__pos``."""
    tagged = rows.withColumn("__block", F.shiftright("__pos", block_bits)).withColumn("__digit", digit)
    counts = tagged.groupBy("__block", "__digit").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One row per value of a digit, so this window is bounded by the digit's width.
    totals = counts.groupBy("__digit").agg(F.sum("__n").alias("__all"))
    bases = totals.select("__digit", F.coalesce(F.sum("__all").over(earlier.orderBy("__digit")), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum("__n").over(earlier.partitionBy("__digit").orderBy("__block")), F.lit(0))
    offsets = (counts.select("__block", "__digit", inside.alias("__inside")).join(bases, "__digit")
               .select("__block", "__digit", (F.col("__base") + F.col("__inside")).alias("__offset")))
    place = F.row_number().over(Window.partitionBy("__block", "__digit").orderBy("__pos"))
    return (tagged.join(offsets, ["__block", "__digit"])
            .withColumn("__pos", (F.col("__offset") + place - 1).cast("long")).select(*rows.columns))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every document's (``doc_id``, n_features, weight, score, rank); rank is null where it is not drawn.

    Of the N documents with at least ``min_words`` words the ``percent`` per cent of highest score are drawn, ties to
    the smaller id (null ids last; repeated ids, which tie, by their number of features). Null texts have no
    words; a null id counts as empty for the noise. Empty tables give no rows; an empty target gives gains all
    the same. Columns other than these two are not read, so names cannot clash.
    """
    table_of_gains = gains(docs, target, text, target_text, buckets)
    scored = docs.select(F.col(doc_id).alias("doc_id"), feature_weights(table_of_gains, whole_text(text).cast("binary")).alias("f"))
    scored = scored.select("doc_id", "f.n_words", "f.n_features", "f.weight", (F.col("f.weight") + gumbel(seed, F.col("doc_id"))).alias("score"))
    scored = keep(scored.withColumn("__row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= min_words).select("__row", "score", "doc_id", "n_features")
    drawn = able.count() * percent // 100
    ranks = radix_ranks(able, [("score", True), ("doc_id", False), ("n_features", False)])
    ranks = ranks.where(F.col("rank") <= drawn).select("__row", "rank")
    return scored.join(ranks, "__row", "left").select(F.col("doc_id").alias(doc_id), "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling of ``documents`` towards ``benchmark`` (5 per cent of documents with 20 words or more)."""
    return resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
