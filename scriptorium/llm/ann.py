"""Operator 1: nearest neighbours by multi-index hashing.

Vectors become BITS-bit codes: the signs of their principal components after a rotation that is
learned so that the signs lose least (iterative quantisation). A code is split into substrings of
SUB bits, each with an index of its own. If two codes differ in at most r bits, then with
r = m a + e (m substrings, 0 <= e < m) one of the first e + 1 substrings differs in at most a
bits or one of the rest in at most a - 1; so probing all substring values that near
retrieves every code within r (pigeonhole). What it retrieves is checked on the whole
code and ranked by the original floats.

The radius is learned too: the exact neighbours of a few sample rows among all rows tell how many
bits a true neighbour differs in. Rows are dealt into index blocks and queries into query blocks;
every two meet in one task, so no bucket, however hot, outgrows a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import keep, table

BITS, SUB = 64, 16
# Bounds: rows that the codes are learned from, rows that the radius is measured on.
FIT_ROWS, RADIUS_ROWS = 20_000, 64
COVER = 0.97
INDEX_BLOCK, QUERY_BLOCK = 1 << 13, 1 << 12


@dataclass(frozen=True)
class BinaryCode:
    """Signs of (x - mean) @ project."""

    mean: np.ndarray
    project: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        bits = ((x - self.mean) @ self.project) > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fit_code(x: np.ndarray, rounds: int = 30, seed: int = 7) -> BinaryCode:
    """Principal components and a learned rotation of the sample ``x``."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(d)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred / max(1, len(x)) + 1e-12 * np.eye(d))
    axes = axes[:, ::-1][:, : min(d, BITS)]
    blocks = []
    while sum(b.shape[1] for b in blocks) < BITS:  # fewer dimensions than bits: several rotations side by side
        v = centred @ axes
        rotation, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
        for _ in range(rounds if len(x) > axes.shape[1] else 0):
            u, _, w = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        blocks.append(axes @ rotation)
    return BinaryCode(mean, np.concatenate(blocks, axis=1)[:, :BITS])


def flips(radius: int) -> np.ndarray:
    """All SUB-bit masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(SUB), r)], np.int64)


class MultiIndex:
    """One index per substring over a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view("<u2").reshape(len(codes), BITS // SUB).astype(np.int64)
        self.order, self.starts, self.masks = [], [], {}
        for j in range(self.parts.shape[1]):
            self.order.append(np.argsort(self.parts[:, j], kind="stable"))
            self.starts.append(np.searchsorted(self.parts[self.order[j], j], np.arange((1 << SUB) + 1)))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits."""
        found = np.zeros(len(self.codes), bool)
        m = BITS // SUB
        a, e = divmod(radius, m)
        sub = np.array([code], "<u8").view("<u2").astype(np.int64)
        for j in range(m):
            near = a if j <= e else a - 1
            if near < 0:
                continue
            near = min(near, SUB)
            if near not in self.masks:
                self.masks[near] = flips(near)
            probes = sub[j] ^ self.masks[near]
            low, high = self.starts[j][probes], self.starts[j][probes + 1]
            full = high > low
            low, n = low[full], (high - low)[full]
            if len(low):
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                found[self.order[j][at]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), width)


def usable_vectors(df: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, vec) with the vectors as float64 bytes, and their length.

    Left out: null vectors, all-zero ones, ones with a null or non-finite component or of another length than
    the most frequent one (the larger, on a tie), and rows without an id.
    """
    arrays = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    good = arrays.where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = common[0]["n"] if common else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "vec": [np.asarray(v, "<f8").tobytes() for v in b["v"]]})

    return good.where(F.size("v") == width).mapInPandas(run, "vec_id bigint, vec binary"), width


def _blocked(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows with a block number, by a hash of their id, of about ``size`` rows a block."""
    blocks = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), blocks


def _every(blocks: int):
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _meet(index: DataFrame, queries: DataFrame, index_blocks: int, query_blocks: int, fn, schema: str) -> DataFrame:
    """``fn`` on every pair of an index block and a query block."""
    left = index.withColumnRenamed("block", "i").withColumn("q", _every(query_blocks))
    right = queries.withColumnRenamed("block", "q").withColumn("i", _every(index_blocks))
    return left.groupBy("i", "q").cogroup(right.groupBy("i", "q")).applyInPandas(fn, schema)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
                       cover: float = COVER, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each query, nearest first.

    Candidates are all rows of ``vectors`` but those with the query's id; the score is the Euclidean distance of
    the original vectors in double precision, ties go to the smaller id. Where the radius holds fewer than
    ``k`` rows of a block it is widened there, so every query has ``k`` rows if there are so many. Repeated
    query ids are searched once (the smallest vector by bytes). See ``usable_vectors`` for what takes no part.
    """
    rows, width = usable_vectors(vectors, vec_id, embedding)
    asked, other = usable_vectors(queries, vec_id, embedding)
    result = "query_id bigint, vec_id bigint, score double"
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not width or other != width:
        return empty
    rows = keep(rows)
    spread = F.xxhash64("vec_id")
    share = min(1.0, 1.2 * fit_rows / rows.count())  # few rows more than wanted reach the sort
    picked = rows.where(F.pmod(spread, F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.orderBy(spread, "vec").limit(fit_rows).toPandas()
    code = fit_code(_matrix(sample["vec"], width))
    index, index_blocks = _blocked(rows, INDEX_BLOCK)
    asked = keep(asked.groupBy("vec_id").agg(F.min("vec").alias("vec")))
    asked, query_blocks = _blocked(asked, QUERY_BLOCK)

    def exact(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of the rows ``x``: (positions, distances)."""
        far = np.sqrt(((x - q) ** 2).sum(1))
        far[ids == own] = np.inf
        if len(far) > k:
            limit = np.partition(far, k - 1)[k - 1]
            near = np.flatnonzero(far <= limit)
        else:
            near = np.arange(len(far))
        near = near[np.isfinite(far[near])]
        near = near[np.lexsort((ids[near], far[near]))][:k]
        return near, far[near]

    def measure(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a):
            x, ids = _matrix(a["vec"], width), a["vec_id"].to_numpy()
            codes = code.of(x)
            for own, q in zip(b["vec_id"], _matrix(b["vec"], width)):
                near, far = exact(x, ids, q, own)
                bits = np.bitwise_count(codes[near] ^ code.of(q[None])[0])
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[near], "score": far, "bits": bits.astype("int32")}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "vec_id", "score", "bits"])

    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    probe = asked.drop("block").orderBy(F.xxhash64("vec_id", F.lit(5))).limit(RADIUS_ROWS).withColumn("block", F.lit(0))
    true = _meet(index, probe, index_blocks, 1, measure, result + ", bits int")
    true = true.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    bits = np.sort(np.array([r["bits"] for r in true.select("bits").collect()]))
    radius = int(bits[min(len(bits) - 1, int(cover * len(bits)))]) if len(bits) else BITS

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a):
            x, ids = _matrix(a["vec"], width), a["vec_id"].to_numpy()
            hashed = MultiIndex(code.of(x))
            least = min(len(ids), k + 1)
            for own, q in zip(b["vec_id"], _matrix(b["vec"], width)):
                c, r = code.of(q[None])[0], radius
                found = hashed.within(c, r)
                while len(found) < least and r < BITS:
                    r = min(BITS, r + 4)
                    found = hashed.within(c, r)
                near, far = exact(x[found], ids[found], q, own)
                out.append(pd.DataFrame({"query_id": own, "vec_id": ids[found][near], "score": far}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "vec_id", "score"])

    near = _meet(index, asked, index_blocks, query_blocks, search, result)
    ranked = near.withColumn("rank", F.row_number().over(top).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of ``embeddings`` for every row whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
