"""Operator 10: exact removal of long repeated byte strings with suffix arrays.

Two equal strings of LENGTH bytes have the same anchor: the leftmost smallest hash among
their GRAM-byte grams. So the strings of a document are cut into segments, one per anchor
(the strings that start one after the other and share it), and equal strings can only be found
in segments of the same anchor. Segments of anchors that occur once are done with. Of the
others one copy of each different segment, and a second one where it occurs again, goes to
the shard of its anchor; a shard builds the suffix array of its segments by induced sorting and
finds the starts of repeated strings from the permuted common prefixes. What it finds goes back
to all occurrences of the segment, and the union of the strings is cut out of each document.

Equal texts are one text from the start, and a segment that very many documents share is one
row per run of texts before it is shuffled. An anchor whose different segments exceed MAX_SHARD
bytes is dealt anew by the strings themselves (equal strings still meet), and anchors share a
shard only up to SHARD_BYTES, so no shard outgrows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import table, whole_text
from scriptorium.llm.shingles import mix, runs
from scriptorium.llm.suffix_array import prefix_sums, repeated_starts, suffix_array

LENGTH, GRAM = 400, 64
# The arrays of a run of texts and of a shard take about 90 bytes for each of their bytes.
LIST_BYTES = SHARD_BYTES = 1 << 18
MAX_SHARD = 2 << 20
# Rows, bytes and strings that a task holds at once beside its input batch.
SLICE_ROWS, OUT_BYTES, OUT_STRINGS = 512, 2 << 20, 1 << 16


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts that end at ``ends``: (anchor, hash of the bytes, text, start, number of strings)."""
    n = len(data)
    nothing = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < length:
        return nothing
    sums, back = prefix_sums(data)
    grams = n - gram + 1
    h = mix((sums[gram:] - sums[:-gram]) * back[:grams])
    low = np.uint64((1 << max(1, n.bit_length())) - 1)
    key = (h & ~low) | np.arange(grams, dtype=np.uint64)  # ties go to the left
    width = length - gram + 1
    boxed = np.concatenate([key, np.full(-grams % width, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    left = np.minimum.accumulate(boxed, axis=1).ravel()
    right = np.minimum.accumulate(boxed[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - length + 1
    anchor = (np.minimum(right[:last], left[width - 1 : width - 1 + last]) & low).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(n), side="right")
    s = np.flatnonzero(doc[:last] == doc[length - 1 :])
    if not len(s):
        return nothing
    p = anchor[s]
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    s0, p0 = s[first], p[first]
    size = count + (length - 1)
    value = mix((sums[s0 + size] - sums[s0]) * back[s0] + size.astype(np.uint64))
    d = doc[s0]
    return h[p0], value, d, s0 - (ends[d] - np.diff(ends, prepend=0)[d]), count


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _list_segments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, seg, texts, pos), one row for each different segment of a run of texts: pos holds the start and, in the
    lowest 16 bits, the number of strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _bytes_of(batch.column(1))
            lengths = np.diff(ends, prepend=0)
            ids = batch.column(0).to_numpy()
            for lo, hi in runs(lengths, LIST_BYTES):
                base = ends[lo] - lengths[lo]
                anchor, seg, d, start, count = segments(data[base : ends[hi - 1]], ends[lo:hi] - base, length, gram)
                order = np.lexsort((seg, anchor))
                anchor, seg = anchor[order], seg[order]
                new = np.ones(len(order), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])
                first = np.flatnonzero(new)
                at = pa.array(np.append(first, len(order)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[first].view(np.int64)), pa.array(seg[first].view(np.int64)),
                     pa.ListArray.from_arrays(at, pa.array(ids[lo:hi][d[order]])), pa.ListArray.from_arrays(at, pa.array((start << 16 | count)[order]))],
                    names=["anchor", "seg", "texts", "pos"])

    return texts.select("text", "t", "copies").mapInArrow(run, "anchor bigint, seg bigint, texts array<bigint>, pos array<bigint>")


def _cut_segments(rows: DataFrame, length: int) -> DataFrame:
    """(shard, anchor, seg, again, bytes) from (t, wanted) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()))],
                names=["anchor", "seg", "again", "split", "bytes"])

        for batch in batches:
            out, size = [], 0
            for t, wanted in zip(batch.column(0), batch.column(1)):
                raw = memoryview(t.as_buffer())
                for w in wanted.as_py():
                    start, count = w["pos"] >> 16, w["pos"] & 0xFFFF
                    out.append((w["anchor"], w["seg"], w["again"], w["split"], bytes(raw[start : start + count + length - 1])))
                    size += count + length
                if size >= OUT_BYTES:
                    yield made()
                    out, size = [], 0
            if out:
                yield made()

    return rows.select("t", "wanted", "copies").mapInArrow(run, "anchor bigint, seg bigint, again boolean, split boolean, bytes binary")


def _shards(rows: Iterable[tuple], limit: int) -> Iterator[list[tuple]]:
    """Rows (anchor, seg, again, bytes), ascending by anchor, in lists of whole anchors: at most ``limit`` bytes, or one anchor."""
    held, size, own, own_size = [], 0, [], 0
    for row in rows:
        if own and row[0] != own[0][0]:
            if held and size + own_size > limit:
                yield held
                held, size = [], 0
            held, size, own, own_size = held + own if held else own, size + own_size, [], 0
        own.append(row)
        own_size += len(row[3]) * (2 if row[2] else 1)
    if held and own and size + own_size > limit:
        yield held
        held = []
    if held or own:
        yield held + own


def _shard_repeats(segs: DataFrame, length: int, parts: int) -> DataFrame:
    """(anchor, seg, first, last): ranges of starts of repeated strings in each segment."""
    def found(held: list[tuple]) -> pa.RecordBatch:
        texts, owner = [], []
        for i, (_, _, again, raw) in enumerate(held):
            for _ in range(2 if again else 1):
                texts.append(raw)
                owner.append(i)
        sizes = np.array([len(x) for x in texts], np.int64)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.ones(int(sizes.sum()) + len(sizes) + 1, np.int16)  # 1 parts the segments
        text[-1] = 0
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 2
        text[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
        hit = repeated_starts(text, suffix_array(text, length), length)
        once = np.ones(len(owner), bool)
        once[1:] = np.diff(owner) > 0
        rows = []
        for k in np.flatnonzero(once).tolist():
            inside = hit[starts[k] : starts[k] + sizes[k] - length + 1].view(np.int8)  # strings that end in the segment
            at = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
            rows += [(held[owner[k]][0], held[owner[k]][1], int(a), int(b) - 1) for a, b in zip(at[::2], at[1::2])]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["anchor", "seg", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for held in _shards(rows, SHARD_BYTES):
            yield found(held)

    ranges = "anchor bigint, seg bigint, first bigint, last bigint"
    usual = segs.where("not split").select("anchor", "seg", "again", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "seg")
    return usual.mapInArrow(run, ranges).union(_split_repeats(segs.where("split"), length))


def _split_repeats(segs: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many different segments for one shard: every string is counted by its value."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["anchor", "seg", "times", "first", "value"])

        for batch in batches:
            out = []
            for anchor, seg, again, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                raw = memoryview(raw.as_buffer())
                out += [(anchor, seg, 2 if again else 1, i, hashlib.sha256(raw[i : i + length]).digest()) for i in range(len(raw) - length + 1)]
                if len(out) >= OUT_STRINGS:
                    yield made()
                    out = []
            if out:
                yield made()

    one = segs.select("anchor", "seg", "again", "bytes").mapInArrow(strings, "anchor bigint, seg bigint, times bigint, first bigint, value binary")
    counted = one.withColumn("n", F.sum("times").over(Window.partitionBy("value")))
    return counted.where("n > 1").select("anchor", "seg", "first", F.col("first").alias("last"))


def _remove(texts: DataFrame, length: int) -> DataFrame:
    """text, n_bytes, n_removed, n_spans, kept (binary), kept_text from (text, t, copies, starts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, len(b), SLICE_ROWS)):
            out = []
            for text, t, copies, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                raw = t.as_buffer().to_pybytes()
                n = len(raw)
                if n >= length and copies > 1:  # the text as a whole occurs again
                    out.append((text, n, n, 1, b""))
                    continue
                flat = starts.values.to_numpy() if starts.is_valid and len(starts) else np.empty(0, np.int64)
                if not len(flat):
                    out.append((text, n, 0, 0, raw))
                    continue
                a, b = flat[0::2], flat[1::2] + length
                change = np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1)
                covered = np.cumsum(change)[:n] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8)])) == 1)
                out.append((text, n, int(covered.sum()), len(edges), np.frombuffer(raw, np.uint8)[~covered].tobytes()))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            columns.append(pa.array([o[4].decode("utf-8", "ignore") for o in out], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["text", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])

    return texts.select("text", "t", "copies", "starts").mapInArrow(
        run, "text bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_text string")


def text_key(column: str = "text"):
    """64-bit key of a whole text (null: empty)."""
    return F.xxhash64(whole_text(column))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per distinct text of ``docs``: text (its ``text_key``), n_bytes, n_removed, n_spans, kept (bytes),
    kept_text (the kept bytes as text, without the parts of characters that a cut leaves).

    Texts are UTF-8 bytes (null: empty). Removed is every byte that a string of ``length`` bytes covers which
    starts anywhere else too, in the same or another row, overlaps included; all strings are judged on the
    input. A text that two rows hold is removed whole when it has ``length`` bytes; shorter texts stay.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    # The only shuffle of whole texts. The three uses below share it because all of them take all its columns: one
    # without ``copies`` would be another aggregate with a shuffle of its own.
    texts = docs.select(text_key(text).alias("text"), whole_text(text).cast("binary").alias("t")).groupBy("text").agg(
        F.max("t").alias("t"), F.count(F.lit(1)).alias("copies"))
    listed = _list_segments(texts, length, gram)
    # Dealt once by anchor, a row for each different segment of a run: anchors that occur once leave, and both sums and the
    # grouping between them need no other shuffle.
    by_anchor = Window.partitionBy("anchor")
    lists = listed.select("anchor", "seg", F.size("pos").alias("n"), F.struct(F.col("texts")[0].alias("text"), F.col("pos")[0].alias("pos")).alias("one"))
    repeated = lists.withColumn("all", F.sum("n").over(by_anchor)).where("all > 1")
    distinct = repeated.groupBy("anchor", "seg").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    size = (F.col("one.pos").bitwiseAND(0xFFFF) + (length - 1)) * F.when(F.col("n") > 1, 2).otherwise(1)
    sized = distinct.withColumn("size", size).withColumn("split", F.sum("size").over(by_anchor) > MAX_SHARD)
    chosen = sized.select(F.col("one.text").alias("text"), F.struct(
        "anchor", "seg", F.col("one.pos").alias("pos"), (F.col("n") > 1).alias("again"), "split").alias("w"))
    wanted = chosen.groupBy("text").agg(F.collect_list("w").alias("wanted"))  # at most the segments of one text
    cut = _cut_segments(texts.join(wanted, "text"), length)
    ranges = _shard_repeats(cut, length, parts)
    by_seg = ranges.groupBy("anchor", "seg").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))  # at most those of one segment
    places = listed.join(by_seg, ["anchor", "seg"]).select("ranges", F.explode(F.arrays_zip("texts", "pos")).alias("at"))
    start = F.shiftright("at.pos", 16)
    spans = places.select(F.col("at.texts").alias("text"), F.flatten(F.transform(
        "ranges", lambda r: F.array(r["first"] + start, r["last"] + start))).alias("starts"))
    per_text = spans.groupBy("text").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return _remove(texts.join(per_text, "text", "left"), length)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that no repeated 400-byte string covers, as counts and a digest."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    done = remove_repeats(docs).select("text", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", text_key().alias("text")).join(done, "text").drop("text")
