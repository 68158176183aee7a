"""Operator 6: a hashed maximum-entropy language model with classes.

P(word | history) = P(class(word) | history) * P(word | class(word)).

The class distribution is a softmax over hashed features of the history: the word before, the two
words before, the word two and three places back (skips), and the classes of the last three and
of the last and the fourth last word. The word distribution inside a class is (count + 0.5) over
the class's mass, with one unknown word in every class. Classes are the end token, the most frequent
words one by one, and groups of words that occur in the same documents.

Every task makes gradient updates (AdaGrad on batches of BATCH tokens) over its part of the training
texts; the weights are then averaged, each feature by how often a task met it; without weights the classes have their
shares of all training tokens. Counts, seed words,
classes and updates cover all training texts.

As classes need no counts, the text's log probability falls into a part that depends on order, summed
where the text is, and the sum of log(count + 0.5) over its tokens. Counts of the TOP_WORDS most
frequent words travel with the task; the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import crc_fold, keep, table, whole_text
from scriptorium.llm.near_dedup import _bytes_of
from scriptorium.llm.shingles import mix, runs, word_hashes

SEED_WORDS = 256
SINGLE, GROUPS = 31, 16
CLASSES = 1 + SINGLE + GROUPS
FEATURE_BITS, BUCKET_BITS, BUCKETS_A_BLOCK = 15, 22, 1 << 12
N_FEATURES = 6
BATCH, RATE = 16_384, 0.15
# Rows that are worked on at once inside a batch, and the longest groups that ``sum_groups`` adds together (numpy
# adds up to eight numbers one after the other, more of them in eight lanes). Neither changes a result.
STRETCH, SHORT = 4096, 8
TOP_WORDS = 1 << 18
END = 0x1F3D5B79A2C4E688
ROWS_A_BLOCK = 256


def token_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the tokens of each text: its words, then the end."""
    words, doc = word_hashes(data, ends)
    n = len(ends)
    per = np.bincount(doc, minlength=n) + 1
    last = np.cumsum(per) - 1
    out = np.full(int(per.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = words
    return out, np.repeat(np.arange(n), per)


@dataclass(frozen=True)
class WordClasses:
    """Class of every word: single words by hash, all others by the group of their bucket."""

    single: np.ndarray  # hashes, ascending
    single_class: np.ndarray
    group: np.ndarray  # class of each bucket

    def of(self, h: np.ndarray) -> np.ndarray:
        out = self.group[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.int64)
        if len(self.single):
            at = np.minimum(np.searchsorted(self.single, h), len(self.single) - 1)
            hit = self.single[at] == h
            out[hit] = self.single_class[at[hit]]
        out[h == np.uint64(END)] = 0
        return out


def features(h: np.ndarray, doc: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """(tokens, N_FEATURES) rows of the weights that the history of each token switches on."""
    def back(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        if len(x) > k:
            out[k:] = np.where(doc[k:] == doc[:-k], x[:-k], 0)
        return out

    c = (cls + 1).astype(np.uint64)
    w1, w2, w3 = back(h, 1), back(h, 2), back(h, 3)
    c1, c2, c3, c4 = (back(c, k) for k in (1, 2, 3, 4))
    # the class of the word before tells apart what shares a row by chance
    parts = (w1, w1 * np.uint64(3) + w2, w2, w3, c1 + c2 * np.uint64(64) + c3 * np.uint64(4096), c1 * np.uint64(64) + c4)
    out = np.empty((len(h), N_FEATURES), np.int64)
    for i, p in enumerate(parts):
        out[:, i] = (mix(p, 101 + i) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    return out


def log_softmax(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log probabilities of the classes; without any weight they are those of ``prior``."""
    z = np.empty((len(rows), weights.shape[1]), np.result_type(weights, prior))
    more = np.empty((min(len(rows), STRETCH), weights.shape[1]), weights.dtype)
    for at in range(0, len(rows), STRETCH):  # in stretches that stay in the processor's cache
        part, r = z[at : at + STRETCH], rows[at : at + STRETCH]
        one = more[: len(part)]
        np.add(np.take(weights, r[:, 0], axis=0, out=one, mode="clip"), prior, out=part)
        for i in range(1, rows.shape[1]):
            part += np.take(weights, r[:, i], axis=0, out=one, mode="clip")
        part -= part.max(1, keepdims=True)
        part -= np.log(np.exp(part).sum(1, keepdims=True))
    return z


def sum_groups(x: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the rows ``order[first[g] : first[g] + count[g]]`` of ``x``, added in the order of ``np.add.reduceat``.

    Most groups are short: the second, third... rows of all of them are added at once, and only the long ones are reduced singly.
    """
    out = x[order[first]]
    short = np.flatnonzero((count > 1) & (count <= SHORT))
    if len(short):
        short = short[np.argsort(-count[short], kind="stable")]
        f, c = first[short], count[short]
        rest = x[order[f + 1]]
        for k in range(2, int(c[0])):
            n = int(np.searchsorted(-c, -k))  # groups of more than k rows
            rest[:n] += x[order[f[:n] + k]]
        out[short] += rest
    long = np.flatnonzero(count > SHORT)
    if len(long):
        sizes = count[long]
        starts = np.cumsum(sizes) - sizes
        out[long] = np.add.reduceat(x[order[np.arange(int(sizes.sum())) + np.repeat(first[long] - starts, sizes)]], starts, axis=0)
    return out


def update(weights: np.ndarray, squares: np.ndarray, met: np.ndarray, rows: np.ndarray, cls: np.ndarray, prior: np.ndarray) -> None:
    """One gradient step on a batch."""
    grad = log_softmax(weights, rows, prior)
    np.exp(grad, out=grad)
    grad[np.arange(len(cls)), cls] -= 1
    for i in range(rows.shape[1]):
        row = rows[:, i].astype(np.uint16)  # FEATURE_BITS fit; numbers this small are sorted by radix
        order = np.argsort(row, kind="stable")
        r = row[order]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        r = r[first].astype(np.int64)
        count = np.diff(np.append(first, len(order)))
        met[r] += count
        for at in range(0, len(r), STRETCH):
            part = slice(at, at + STRETCH)
            g = sum_groups(grad, order, first[part], count[part])
            s = squares[r[part]]
            s += g * g
            squares[r[part]] = s
            s += 1.0
            np.sqrt(s, out=s)
            g *= RATE
            g /= s
            w = weights[r[part]]
            w -= g
            weights[r[part]] = w


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    """(batch, first, last, token hashes, text of each token) in runs of bounded size."""
    for batch in batches:
        data, ends = _bytes_of(batch.column(column))
        lengths = np.diff(ends, prepend=0)
        for lo, hi in runs(lengths):
            base = ends[lo] - lengths[lo]
            yield batch, lo, hi, *token_hashes(data[base : ends[hi - 1]], ends[lo:hi] - base)


def _group_seeds(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the seed words, ascending; their groups): words that share documents share a group."""
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, h, _ in _texts(batches, 0):
            u, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["h", "n"])

    counted = train.mapInArrow(top, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("h") != END).orderBy(F.desc("n"), "h").limit(SEED_WORDS).collect()
    seeds = np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))
    if not len(seeds):
        return seeds, np.empty(0, np.int64)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(seeds), len(seeds)))
        for _, lo, hi, h, doc in _texts(batches, 0):
            at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
            hit = seeds[at] == h
            has = np.zeros((hi - lo, len(seeds)), np.float32)
            has[doc[hit], at[hit]] = 1
            total += has.T @ has
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])

    cells = train.mapInArrow(pairs, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together = np.zeros((len(seeds), len(seeds)))
    for c in cells:
        together[c["i"], c["j"]] = c["n"]
    alone = np.maximum(np.diag(together), 1)
    profile = together / np.sqrt(np.outer(alone, alone))
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-12)
    centres = profile[[int(np.argmax(alone))]]
    while len(centres) < min(GROUPS, len(seeds)):  # farthest first
        centres = np.vstack([centres, profile[int(np.argmin((profile @ centres.T).max(1)))]])
    for _ in range(30):
        group = np.argmax(profile @ centres.T, axis=1)
        for k in range(len(centres)):
            if (group == k).any():
                centres[k] = profile[group == k].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return seeds, group


def _count_words(train: DataFrame, seeds: np.ndarray, group: np.ndarray) -> DataFrame:
    """(h, c, k): every training token's count, and the group of the documents that hold it most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lo, hi, h, doc in _texts(batches, 0):
            votes = np.zeros((hi - lo, GROUPS), np.int32)
            if len(seeds):
                at = np.minimum(np.searchsorted(seeds, h), len(seeds) - 1)
                hit = seeds[at] == h
                np.add.at(votes, (doc[hit], group[at[hit]]), 1)
            u, where = np.unique(h, return_inverse=True)
            cells = np.bincount(where * GROUPS + votes.argmax(1)[doc], minlength=len(u) * GROUPS)
            held = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)[held // GROUPS]), pa.array((held % GROUPS).astype(np.int32)), pa.array(cells[held])], names=["h", "k", "c"])

    cells = train.mapInArrow(run, "h bigint, k int, c bigint").groupBy("h", "k").agg(F.sum("c").alias("c"))
    return cells.groupBy("h").agg(F.sum("c").alias("c"), F.max_by("k", F.struct("c", "k")).alias("k"))


def _learn_classes(counts: DataFrame) -> WordClasses:
    common = counts.where(F.col("h") != END).orderBy(F.desc("c"), "h").limit(SINGLE).collect()
    single = np.array([r["h"] for r in common], np.int64).view(np.uint64)
    order = np.argsort(single)
    bucket = F.shiftrightunsigned("h", 64 - BUCKET_BITS).alias("bucket")
    votes = counts.groupBy(bucket, "k").agg(F.sum("c").alias("c")).groupBy("bucket").agg(F.max_by("k", F.struct("c", "k")).alias("k"))
    blocks = votes.withColumn("block", F.floor(F.col("bucket") / BUCKETS_A_BLOCK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bucket, k = (batch.column(i).to_numpy() for i in range(3))
            for b in np.unique(block).tolist():
                part = held.setdefault(b, np.full(BUCKETS_A_BLOCK, 1 + SINGLE, np.uint8))
                own = block == b
                part[bucket[own] - b * BUCKETS_A_BLOCK] = 1 + SINGLE + k[own]
        for b, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([part.tobytes()], pa.binary())], names=["block", "groups"])

    # One byte for each of the 2^BUCKET_BITS buckets reaches the driver.
    packed = blocks.select("block", "bucket", "k").repartition("block").mapInArrow(pack, "block bigint, groups binary").collect()
    group = np.full(1 << BUCKET_BITS, 1 + SINGLE, np.uint8)
    for r in packed:
        group[r["block"] * BUCKETS_A_BLOCK : (r["block"] + 1) * BUCKETS_A_BLOCK] = np.frombuffer(r["groups"], np.uint8)
    return WordClasses(single[order], 1 + np.arange(len(single))[order], group)


def _train(train: DataFrame, arrays: Broadcast, prior: np.ndarray) -> np.ndarray:
    """Weights (2^FEATURE_BITS, CLASSES) after one pass of gradient updates in every task, averaged."""
    n_rows = 1 << FEATURE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((n_rows, CLASSES), np.float32)
        squares, met = np.zeros_like(weights), np.zeros(n_rows, np.int64)
        word_classes = WordClasses(*arrays.value)
        for _, _, _, h, doc in _texts(batches, 0):
            cls = word_classes.of(h)
            rows = features(h, doc, cls)
            for at in range(0, len(h), BATCH):
                update(weights, squares, met, rows[at : at + BATCH], cls[at : at + BATCH], prior)
        for b in range(0, n_rows, ROWS_A_BLOCK):
            part = slice(b, b + ROWS_A_BLOCK)
            if met[part].any():
                yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([met[part].tobytes()], pa.binary()),
                                                  pa.array([(weights[part] * met[part][:, None]).astype(np.float32).tobytes()], pa.binary())],
                                                 names=["block", "met", "w"])

    def average(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in parts:
            for b, m, w in zip(*(c.to_pylist() for c in batch.columns)):
                have = sums.setdefault(b, [np.zeros(ROWS_A_BLOCK), np.zeros((ROWS_A_BLOCK, CLASSES))])
                have[0] += np.frombuffer(m, np.int64)
                have[1] += np.frombuffer(w, np.float32).reshape(ROWS_A_BLOCK, CLASSES)
        for b, (m, w) in sorted(sums.items()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([b]), pa.array([(w / np.maximum(m, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())], names=["block", "w"])

    parts = train.mapInArrow(run, "block bigint, met binary, w binary")
    done = parts.repartition("block").sortWithinPartitions("block", "met", "w").mapInArrow(average, "block bigint, w binary").collect()
    weights = np.zeros((n_rows, CLASSES), np.float32)
    for r in done:
        weights[r["block"] : r["block"] + ROWS_A_BLOCK] = np.frombuffer(r["w"], np.float32).reshape(ROWS_A_BLOCK, CLASSES)
    return weights


def score_texts(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    The model and the counts come from ``training``'s column ``text``. Null texts are the end token alone.
    ``base_score`` uses (c + 0.5) / (N + 0.5 (V + 1)) for each token; ``score`` the model. Repeated rows get
    equal scores. Without training text every class and every word of it is equally likely.
    """
    train = training.select(whole_text(text).alias("t"))
    seeds, group = _group_seeds(train)
    counts = keep(_count_words(train, seeds, group))
    classes = _learn_classes(counts)
    spark = docs.sparkSession

    def mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        word_classes = WordClasses(*arrays.value)
        for batch in batches:
            h, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cls = word_classes.of(h.view(np.uint64))
            n += np.bincount(cls, weights=c, minlength=CLASSES).astype(np.int64)
            v += np.bincount(cls, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    arrays = spark.sparkContext.broadcast((classes.single, classes.single_class, classes.group))  # about four megabytes, whatever the input
    sums = counts.select("h", "c").mapInArrow(mass, "k bigint, n bigint, v bigint").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    total, distinct = int(class_n.sum()), int(class_v.sum())
    log_mass = np.log10(class_n + 0.5 * (class_v + 1))
    prior = np.log(class_n + 0.5 * (class_v + 1)).astype(np.float32)
    weights = _train(train, arrays, prior)
    # Words by ranges of their count, the largest first, as long as they fit: what reaches the driver is a
    # few hundred ranges and TOP_WORDS words.
    steps = counts.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 8).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).collect()
    held, least = 0, total + 1
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["n"]
        if held > TOP_WORDS:
            break
        least = r["low"]
    top = counts.where(F.col("c") >= least).select("h", "c").toPandas()
    top_h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(top_h)
    top_h, top_c = top_h[order], top["c"].to_numpy(np.int64)[order]
    # All of a size that the parameters fix: weights and TOP_WORDS counts.
    shared = spark.sparkContext.broadcast((weights, top_h, top_c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, top_h, top_c = shared.value
        word_classes = WordClasses(*arrays.value)
        for batch, lo, hi, h, doc in _texts(batches, 1):
            n = hi - lo
            cls = word_classes.of(h)
            rows = features(h, doc, cls)
            ordered = np.empty(len(h))
            for at in range(0, len(h), BATCH):
                part = slice(at, at + BATCH)
                z = log_softmax(weights, rows[part], prior)
                ordered[part] = z[np.arange(len(z)), cls[part]]
            ordered = ordered / np.log(10) - log_mass[cls]
            if len(top_h):
                at = np.minimum(np.searchsorted(top_h, h), len(top_h) - 1)
                known = top_h[at] == h
            else:
                at, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            logs = np.where(known, np.log10(np.where(known, top_c[at] if len(top_h) else 0, 0) + 0.5), 0.0)
            tokens = np.bincount(doc, minlength=n)
            rare_of = doc[~known]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.bincount(rare_of, minlength=n))]), pa.int32()), pa.array(h[~known].view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(tokens), pa.array(np.bincount(doc, weights=known, minlength=n).astype(np.int64)),
                pa.array(np.bincount(doc, weights=logs, minlength=n)), pa.array(np.bincount(doc, weights=ordered, minlength=n)), lists],
                names=["doc_id", "key", "n_tokens", "n_top", "log_top", "ordered", "rare"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t")).select(
        "doc_id", "t", F.xxhash64("doc_id", "t").alias("key"))
    main = keep(rows.mapInArrow(run, "doc_id bigint, key bigint, n_tokens bigint, n_top bigint, log_top double, ordered double, rare array<bigint>"))
    rare = main.select("key", F.explode("rare").alias("h")).groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"))
    seen = rare.join(counts.where(F.col("c") < least).select("h", "c"), "h", "left")
    c = F.coalesce("c", F.lit(0))
    per_key = seen.groupBy("key").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("log_rare"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_rare"))
    # equal rows share a key, and what was summed over them is divided again
    copies = main.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    out = main.drop("rare").join(copies, "key").join(per_key, "key", "left")
    logs = F.col("log_top") + F.coalesce(F.col("log_rare") / F.col("copies"), F.lit(0.0))
    base_mass = float(np.log10(total + 0.5 * (distinct + 1)))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_top") + F.coalesce(F.col("n_rare") / F.col("copies"), F.lit(0.0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * F.lit(base_mass)).alias("base_score"),
        (logs + F.col("ordered")).alias("score"))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the unigram base and the model (learned outside fold 1 of 5)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = score_texts(docs, docs.where(crc_fold("doc_id", 5) != 1))
    return out.select("doc_id", (crc_fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
