"""Operator 3: order-preserving packing by dynamic programming.

Documents in ascending id order form one stream of tokens. Places where a window may
end are document ends, sentence ends and, so that a window always can, every
``STRIDE``-th token of a document. A cut costs nothing at a document's end, ``SENTENCE``
after a sentence and ``MIDDLE`` elsewhere; a window costs its padding and ``WINDOW``.
With f(i) the least cost up to place p_i,

    f(i) = min over p_j >= p_i - size of  f(j) + p_j  + size - p_i + WINDOW + cut(i),

so a queue kept in ascending order of f(j) + p_j gives each minimum in constant time.
Windows whose length is a power of two need no padding and are tried beside it.
"""

from __future__ import annotations

import base64
import zlib  # noqa: F401  (crc32 of pieces is checked against it in the tests)
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import shuffle_parts, table, whole_text

SIZE = 1024
STRIDE, SENTENCE, MIDDLE, WINDOW = 32, 2, 16, 1
SHORT_POWERS = (512, 256, 128)
# Tokens after which a run of whole documents is packed on its own, which bounds a task's memory.
SEGMENT_TOKENS = 1 << 18
END_ID = 0
SPECIAL = "<|endoftext|>"
PIECES = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


class ByteBpe:
    """Ids of the public 50k byte-level vocabulary.

    tiktoken and tokenizers give the same ids for its two files; the former is four times as fast.
    A text that spells the special token goes through tokenizers, which turns it into one id.
    """

    def __init__(self, path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        self.path = path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None
        self.ends_sentence = np.zeros(max(ranks.values()) + 2, dtype=bool)
        for token, i in ranks.items():
            self.ends_sentence[i] = token[-1:] in (b".", b"!", b"?", b"\n")

    def encode(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


def choose_cuts(places: np.ndarray, costs: np.ndarray, size: int = SIZE) -> list[int]:
    """Ends of the windows that cost least. ``places`` ascend, the last one is the stream's end; no gap
    between neighbours (or before the first) exceeds ``size``."""
    p = [0, *places.tolist()]
    cut = [0, *costs.tolist()]
    at = np.asarray(p)
    back = []
    for power in (k for k in SHORT_POWERS if k < size):
        j = np.searchsorted(at, at - power)
        back.append(np.where(at[np.minimum(j, len(at) - 1)] == at - power, j, -1).tolist())
    f, came = [0] * len(p), [0] * len(p)
    queue, keys = deque([0]), deque([0])
    for i in range(1, len(p)):
        here = p[i]
        low = here - size
        while p[queue[0]] < low:
            queue.popleft()
            keys.popleft()
        j = queue[0]
        best = keys[0] + size - here
        for b in back:
            k = b[i]
            if k >= 0 and f[k] < best:
                best, j = f[k], k
        f[i] = best = best + WINDOW + cut[i]
        came[i] = j
        key = best + here
        while keys and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(i)
        keys.append(key)
    ends, i = [], len(p) - 1
    while i > 0:
        ends.append(p[i])
        i = came[i]
    ends.reverse()
    return _split_tail(ends, size)


def _split_tail(ends: list[int], size: int) -> list[int]:
    """The last window as powers of two where their cuts cost less than its padding."""
    if not ends:
        return ends
    start = ends[-2] if len(ends) > 1 else 0
    rest = ends[-1] - start
    bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    if (len(bits) - 1) * (MIDDLE + WINDOW) >= size - rest:
        return ends
    return ends[:-1] + (start + np.cumsum(bits)).tolist()


def _pack(ids: list[np.ndarray], ends_sentence: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Pieces of consecutive documents: (document, start, length, window, offset, place in the stream)."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    doc_ends = np.cumsum(lengths)
    stream = np.concatenate(ids)
    total = int(doc_ends[-1])
    cost = np.full(total + 1, -1, dtype=np.int64)
    cost[STRIDE::STRIDE] = MIDDLE
    cost[np.flatnonzero(ends_sentence[stream]) + 1] = SENTENCE
    cost[doc_ends] = 0
    places = np.flatnonzero(cost >= 0)
    places = places[places > 0]
    cuts = np.array(choose_cuts(places, cost[places], size), dtype=np.int64)
    bounds = np.union1d(cuts, doc_ends)
    begins = np.concatenate([[0], bounds[:-1]])
    doc = np.searchsorted(doc_ends, begins, side="right")
    window = np.searchsorted(cuts, begins, side="right")
    return (doc, begins - (doc_ends - lengths)[doc], bounds - begins, window,
            begins - np.concatenate([[0], cuts])[window], begins, stream, lengths)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
                   vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and END_ID; a null or empty text is END_ID alone. Every id lies in exactly one piece,
    sequences hold at most ``size`` ids without gaps. Documents keep the order of their ids (null ids first, ties by
    the text's hash). Repeated rows are packed as often as they occur. A sequence never crosses two of the range
    partitions, which costs the padding of one sequence each at most.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(shuffle_parts(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(vocabulary, ranks)
        first = TaskContext.get().partitionId() << 40
        names, held, tokens = [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal first, tokens
            doc, start, length, window, offset, begins, stream, lengths = _pack(held, bpe.ends_sentence, size)
            raw = stream.astype("<u4").tobytes()
            at = np.concatenate([4 * begins, [len(raw)]]).astype(np.int32)
            pieces = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw)])
            out = pa.RecordBatch.from_arrays([
                pa.array([names[d] for d in doc.tolist()], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pieces, pa.array(lengths[doc], pa.int64()), pa.array(first + window, pa.int64()), pa.array(offset, pa.int64()),
            ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            first += int(window[-1]) + 1
            names.clear()
            held.clear()
            tokens = 0
            return out

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(t.as_py())
                ids.append(END_ID)
                names.append(name)
                held.append(np.array(ids, dtype=np.int64))
                tokens += len(ids)
                if tokens >= SEGMENT_TOKENS:
                    yield emit()
        if held:
            yield emit()

    return ordered.mapInArrow(run, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 tokens; one row per piece."""
    packed = pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
