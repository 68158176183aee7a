"""Operator 5: near-duplicates by a multi-index Hamming join of MinHash signatures.

A signature has SLOTS symbols of 32 bits; two texts differ in a slot with probability
1 - J. Texts with at most MAX_ERRORS differing slots form the candidate pairs. The
signature is split into chunks of three slots; as MAX_ERRORS is below twice the number of
chunks, at least one chunk of any such pair has at most one error, so enumerating the
three ways to leave out one slot of every chunk (its allowed errors) puts the pair into a
common bucket. At J = 0.75 a pair exceeds MAX_ERRORS with probability 1.5e-6.

Texts with equal shingle sets are one class from the start. Only components are wanted,
so a bucket of m classes is not expanded into m^2 pairs: every class is confirmed
against the bucket's smallest one first, and only classes of a bucket that still lie in
different components are compared with each other, in blocks. A word line that very many
documents share puts them into one bucket without making them alike; a second, wider
signature (WIDE symbols of 8 bits, at most WIDE_ERRORS of them different, which a pair at
J = 0.75 exceeds with probability 1e-7) keeps such pairs from reaching the full sets.
Classes with close signatures form candidate groups, and the task that holds two blocks
of a group compares them with the full sets in hand and gives a spanning forest of
what it confirms, so the rows that travel grow with the classes, not with their pairs.
Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import keep, table, whole_text
from scriptorium.llm.components import connected_components
from scriptorium.llm.shingles import digests, minhash, runs, shingle_sets

SHINGLE = 5
SLOTS, CHUNK = 30, 3
MAX_ERRORS = 2 * (SLOTS // CHUNK) - 1
WIDE, WIDE_ERRORS = 192, 81
# Classes in a block, bytes of full sets in a block, and rows or bytes of small groups that a task takes together.
BLOCK, BLOCK_BYTES = 8192, 8 << 20
CHUNK_ROWS, CHUNK_BYTES = 1 << 15, 32 << 20


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text column and the end of each text in them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """(texts, SLOTS) bucket keys: for each chunk, each two of its three slots."""
    wide = signatures.astype(np.uint64)
    keys = np.empty((len(wide), SLOTS), np.uint64)
    for k in range(SLOTS):
        chunk, out = divmod(k, CHUNK)
        i, j = (chunk * CHUNK + x for x in range(CHUNK) if x != out)
        mixed = (wide[:, i] << np.uint64(32) | wide[:, j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
        mixed ^= mixed >> np.uint64(31)
        keys[:, k] = mixed * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
    return keys


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), sig (binary, SLOTS uint32), keys (array<bigint>).

    A text without words has 0 shingles and nulls in the other columns.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _bytes_of(batch.column(1))
            lengths = np.diff(ends, prepend=0)
            for lo, hi in runs(lengths):
                base = ends[lo] - lengths[lo]
                sets, sizes = shingle_sets(data[base : ends[hi - 1]], ends[lo:hi] - base, shingle)
                some = sizes > 0
                sig, dig = minhash(sets, sizes, SLOTS), digests(sets, sizes)
                keys = bucket_keys(sig).view(np.int64)
                row = np.where(some, np.cumsum(some) - 1, -1)
                pick = pa.array(np.where(some, row, 0), mask=~some)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * SLOTS), len(sig), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, SLOTS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(dig[:, 0]).take(pick),
                    pa.array(dig[:, 1]).take(pick), raw.take(pick), lists.take(pick)],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig", "keys"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary, keys array<bigint>")


def _sets_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(id, shingle_set, wide): the full set of each wanted document as ascending uint64, and its wide signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _bytes_of(batch.column(1))
            lengths = np.diff(ends, prepend=0)
            for lo, hi in runs(lengths):
                base = ends[lo] - lengths[lo]
                sets, sizes = shingle_sets(data[base : ends[hi - 1]], ends[lo:hi] - base, shingle)
                parts = np.split(sets, np.cumsum(sizes)[:-1])
                some = np.flatnonzero(sizes > 0)
                wide = (minhash(sets, sizes, WIDE, seed=2) & np.uint32(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array([parts[i].tobytes() for i in some], pa.binary()),
                     pa.array([w.tobytes() for w in wide], pa.binary())], names=["id", "shingle_set", "wide"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), whole_text(text).alias("t"))
    return rows.join(wanted, "id", "left_semi").mapInArrow(run, "id bigint, shingle_set binary, wide binary")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose wide signatures differ in at most WIDE_ERRORS symbols."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("wide").alias("wide_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("wide").alias("wide_b")), "b").select("a", "b", "wide_a", "wide_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, WIDE) for i in (2, 3))
            near = pa.array((x != y).sum(1) <= WIDE_ERRORS)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _similar(x, y, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two ascending sets of 64-bit numbers, given as bytes."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingle_set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingle_set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([_similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of about CHUNK_ROWS rows or CHUNK_BYTES bytes (a larger group is alone) that end where a group of equal ``keys`` ends."""
    held, rows, size = [], 0, 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
            t = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(len(t), bool)
            for k in keys:
                c = t[k].to_numpy()
                last &= c == c[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield t.slice(0, cut)
                t = t.slice(cut).combine_chunks()
            held, rows, size = t.to_batches(), len(t), t.nbytes
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _forest(group: np.ndarray, label: np.ndarray, apart: tuple[np.ndarray, ...], sig: np.ndarray, wide: np.ndarray,
            test) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of one group that have close signatures and pass ``test``: (links, 2) row numbers,
    and the smallest label of every row's tree.

    Rows of a group stand together. Rows of equal ``label`` need no link; a link makes two labels one. Only rows that
    differ in all of ``apart`` are compared. Shifts of the rows against themselves give all pairs.
    """
    labels, root = np.unique(label, return_inverse=True)
    out = []
    sizes = np.bincount(np.unique(group, return_inverse=True)[1])
    number = np.arange(int(root.max()) + 1) if len(root) else root

    def find(x: int) -> int:
        while number[x] != x:
            number[x] = number[number[x]]
            x = number[x]
        return x

    # One byte of every slot settles most pairs; the slots as rows, so a shift is a stretch of memory.
    low = np.ascontiguousarray((sig & np.uint32(0xFF)).astype(np.uint8).T)
    now, least = root, SLOTS - MAX_ERRORS
    for d in range(1, int(sizes.max())):
        near = (group[:-d] == group[d:]) & (now[:-d] != now[d:])
        for c in apart:
            near &= c[:-d] != c[d:]
        if not near.any():
            continue
        same = np.zeros(len(near), np.uint8)
        for k in range(SLOTS):
            same += low[k, :-d] == low[k, d:]
        a = np.flatnonzero(near & (same >= least))
        a = a[(sig[a] == sig[a + d]).sum(1) >= least]
        a = a[(wide[a] != wide[a + d]).sum(1) <= WIDE_ERRORS]
        merged = False
        for x in a.tolist():
            p, q = find(root[x]), find(root[x + d])
            if p != q and (test is None or test(x, x + d)):
                number[max(p, q)] = min(p, q)
                out.append((x, x + d))
                merged = True
        if merged:
            while (number[number] != number).any():
                number = number[number]
            now = number[root]
    return np.array(out, np.int64).reshape(-1, 2), labels[now]


def _small_and_large(group: np.ndarray, small: int = 64) -> list[np.ndarray]:
    """Row numbers of all small groups together, and of each larger one alone."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    several = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    return ([several] if len(several) else []) + [np.arange(s, s + n) for s, n in zip(starts.tolist(), sizes.tolist()) if n > small]


def _links(rows: DataFrame, keys: tuple[str, ...], percent: int | None) -> DataFrame:
    """(a, b) links inside the groups of ``rows`` (keys, block, id, component, sig, wide[, shingle_set]).

    The last two keys are the blocks that meet. With ``percent`` a link is confirmed on the full sets, without it is a
    candidate by its signatures. A task holds a chunk of small groups or one group of two blocks, and gives no more links
    than it has classes. Of candidates only what hangs together counts: their links go to the smallest class of a tree,
    so the buckets that a family shares give mostly the same ones, and few rounds find its component.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, keys):
            columns = [t[k].to_numpy() for k in keys]
            new = np.zeros(len(t), bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            group = np.cumsum(new)
            ids, comp, block = (t[c].to_numpy() for c in ("id", "component", "block"))
            # A block that meets itself compares all its rows, two blocks only rows of different ones.
            side = np.where(columns[-2] == columns[-1], np.arange(len(t)), block)
            a, b = [], []
            for at in _small_and_large(group):
                part = t.take(pa.array(at))
                sets = part["shingle_set"] if percent is not None else None

                def test(x: int, y: int) -> bool:
                    return _similar(sets[x].as_buffer(), sets[y].as_buffer(), percent)

                # Candidates of one component may be alike to different classes, so each is a label of its own.
                label = ids if percent is None else comp
                found, tree = _forest(group[at], label[at], (side[at], comp[at]), _matrix(part["sig"], np.uint32, SLOTS),
                                      _matrix(part["wide"], np.uint8, WIDE), test if percent is not None else None)
                if percent is None:
                    linked = ids[at] != tree
                    a.append(ids[at][linked])
                    b.append(tree[linked])
                else:
                    a.append(ids[at][found[:, 0]])
                    b.append(ids[at][found[:, 1]])
            x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y), pa.int64()), pa.array(np.minimum(x, y), pa.int64())], names=["a", "b"])

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def _met(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Deal the rows of a key into its ``blocks`` and let each two blocks (i <= j) meet."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col(blocks)))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))).drop(blocks)
    return met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def _across(labelled: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of one bucket that lie in different components.

    Classes whose signatures are close in some bucket make a candidate group, by a spanning forest of such pairs out
    of every bucket. Inside a group the pairs are compared again, now with the full sets at hand: these travel once per
    block of a group, and a pair is never a row. Blocks bound what a task holds, whatever the size of a bucket or group.
    """
    buckets = labelled.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    sizes = buckets.select("key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    signed = labelled.join(sizes, "key").join(heads.select("id", "sig"), "id").join(sets.select("id", "wide"), "id")
    groups = keep(connected_components(_links(_met(signed, "key", "blocks"), ("key", "i", "j"), None)).select(
        F.col("node").alias("id"), F.col("component").alias("grp")))
    now = labelled.select("id", "component").distinct()
    members = groups.join(now, "id").join(heads.select("id", "sig"), "id").join(sets, "id")
    weights = groups.join(sets.select("id", F.octet_length("shingle_set").alias("size")), "id").groupBy("grp").agg(
        F.greatest(F.ceil(F.sum("size") / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("long").alias("blocks"))
    return _links(_met(members.join(weights, "grp"), "grp", "blocks"), ("grp", "i", "j"), percent)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct word shingles
    (A-Z lower-cased). ``component_id`` is the smallest id that links reach, ``kept`` marks the row that bears
    it. Null and empty texts have no shingles and no links. Repeated rows share a class and an answer. A row
    without an id is linked with nothing: its component is null and it is kept.
    """
    rows = keep(signatures(docs, doc_id, text, shingle))
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    heads = keep(usable.join(classes.select("id", "d1", "d2"), ["d1", "d2"]).where("doc_id = id")
                 .dropDuplicates(["d1", "d2"]).select("id", "d1", "d2", "sig", "keys"))
    entries = heads.select("id", F.explode("keys").alias("key"))
    leaders = entries.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keep(entries.join(leaders, "key").select("key", "id", "lead"))
    wanted = shared.select("id").distinct()
    sets = keep(_sets_of(docs, wanted, doc_id, text, shingle).dropDuplicates(["id"]))

    stars = shared.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    links = keep(_confirm(_alike(stars, sets), sets, percent))
    found = connected_components(links)

    labelled = shared.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    # Classes that a bucket's smallest one did not reach.
    links = links.union(keep(_across(keep(labelled), heads, sets, percent)))
    found = connected_components(links)

    named = heads.select("id", "d1", "d2").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "d1", "d2", F.coalesce("component", "id").alias("component"))
    plain = rows.select("doc_id", "n_shingles", "d1", "d2")
    out = plain.join(named, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
