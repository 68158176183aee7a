"""Operator 2: sampled segmentations of a SentencePiece vocabulary, and their decoding.

A segmentation is a path through the lattice of pieces that spell a text; its probability is
proportional to the product of its pieces' probabilities to the power ``alpha``. Forward filtering sums
the weights of all paths to each place, backward sampling draws a piece that ends at the last place, then
one that ends where that begins, and so on. Draws depend on the row's key, the place in the text and the
seed alone, so a row has the same segmentation wherever and whenever it is computed.

The vocabulary's merge order gives its pieces' probabilities by Zipf's law (1 / (rank + 2.7)). No piece
holds a space after another character, and none a line break, so a text falls into units (a word with
the spaces before it) whose lattices are independent: forward filtering is done once for each different
unit of a run of texts, for all units place by place, and all units of the run are sampled together, one
backward step at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import table, whole_text
from scriptorium.llm.shingles import mix, runs
from scriptorium.llm.suffix_array import prefix_sums

ALPHA, SEED = 0.5, 17
ZIPF_SHIFT = 2.7
# Log probability of one byte of a character that no piece spells.
BYTE_LOG = -12.0
UNIT = re.compile(r" *[^ \n]+|\n| +")
RUN_BYTES = 3 << 19


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceLattice:
    """The pieces of a vocabulary, and the filtered lattices of a run of texts."""

    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        self.weights, self.byte_ids, self.texts = {}, [0] * 256, []
        for i in range(p.get_piece_size()):
            if p.is_control(i) or p.is_unknown(i):
                self.texts.append(b"")
            elif p.is_byte(i):
                value = int(p.id_to_piece(i)[3:5], 16)
                self.byte_ids[value] = i
                self.texts.append(bytes([value]))
            else:
                piece = p.id_to_piece(i).replace("▁", " ")
                if "\n" in piece or " " in piece.lstrip(" "):
                    raise ValueError(f"piece {i} crosses a unit")
                self.weights[piece] = (i, -alpha * math.log(max(0.0, -p.get_score(i)) + ZIPF_SHIFT))
                self.texts.append(piece.encode())
        self.byte_weight = alpha * BYTE_LOG
        self.by_length = self._tables()
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.text_bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.text_starts, self.text_lengths = np.cumsum(lengths) - lengths, lengths

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per length: hashes of all pieces' beginnings, ascending; their ids (-1: no piece) and weights."""
        by_length: dict[int, dict[str, tuple[int, float]]] = {}
        for piece in self.weights:
            for k in range(1, len(piece) + 1):
                by_length.setdefault(k, {}).setdefault(piece[:k], (-1, 0.0))
        for piece, hit in self.weights.items():
            by_length[len(piece)][piece] = hit
        out = []
        for k in range(1, max(by_length, default=0) + 1):
            begins = by_length[k]
            flat = np.frombuffer("".join(begins).encode("utf-32-le"), np.uint32)
            sums, back = prefix_sums(flat)
            at = np.arange(0, len(flat), k)
            h = (sums[at + k] - sums[at]) * back[at]
            order = np.argsort(h)
            hits = list(begins.values())
            out.append((h[order], np.array([hits[i][0] for i in order], np.int64), np.array([hits[i][1] for i in order])))
        return out

    def _edges(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """All pieces in the units: (begin and end node, first place in ids, number of ids, weight), by end node; ids, first and last node."""
        sizes = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        sums, back = prefix_sums(codes)
        ends = np.cumsum(sizes)
        unit = np.repeat(np.arange(len(units)), sizes)
        stop = ends[unit]
        place = np.arange(len(codes))
        single = np.zeros(len(codes), bool)
        begin, end, piece, weight = [], [], [], []
        for k, (hashes, ids, weights) in enumerate(self.by_length, 1):
            place = place[place + k <= stop[place]]
            if not len(place):
                break
            h = (sums[place + k] - sums[place]) * back[place]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            on = hashes[at] == h
            place, at = place[on], at[on]
            whole = ids[at] >= 0
            begin.append(place[whole])
            end.append(place[whole] + k)
            piece.append(ids[at[whole]])
            weight.append(weights[at[whole]])
            if k == 1:
                single[place[whole]] = True
        begin, end, piece, weight = (np.concatenate(x) for x in (begin, end, piece, weight))
        other = np.flatnonzero(~single)  # characters that no piece spells
        spelled, first, count = [], [], []
        for c in codes[other].tolist():
            raw = chr(c).encode("utf-8", "surrogatepass")
            first.append(len(spelled))
            count.append(len(raw))
            spelled += [self.byte_ids[b] for b in raw]
        n = len(begin)
        ids = np.concatenate([piece, np.array(spelled, np.int64)]).astype(np.int32)
        begin, end = np.concatenate([begin, other]), np.concatenate([end, other + 1])
        first = np.concatenate([np.arange(n), n + np.array(first, np.int64)])
        count = np.concatenate([np.ones(n, np.int64), np.array(count, np.int64)])
        weight = np.concatenate([weight, self.byte_weight * count[n:]])
        # a unit has a node before each character and one behind the last
        node = unit[begin]
        order = np.argsort(end + node, kind="stable")
        begin, end = (begin + node)[order], (end + node)[order]
        last = ends + np.arange(len(units))
        return begin, end, first[order], count[order], weight[order], ids, last - sizes, last

    def sample(self, texts: list[str], row_keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        units: dict[str, int] = {}
        numbers, per_text = [], []
        for t in texts:
            found = UNIT.findall(" " + t) if t else []
            per_text.append(len(found))
            numbers += [units.setdefault(u, len(units)) for u in found]
        per_text, unit = np.array(per_text, np.int64), np.array(numbers, np.int64)
        if not len(unit):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        source, target, first, count, weight, ids, bases, last = self._edges(list(units))
        # Forward filtering: nodes at the same distance from their unit's begin at a time.
        total = np.zeros(int(last[-1]) + 1)
        offset = target - np.repeat(bases, np.diff(np.searchsorted(target, np.append(bases, len(total)))))
        share = np.empty(len(target))
        # Small numbers of 16 bits are sorted by counting.
        by_offset = np.argsort(offset.astype(np.uint16) if offset.max(initial=0) < 1 << 16 else offset, kind="stable")
        cuts = np.flatnonzero(np.diff(offset[by_offset])) + 1
        for level in np.split(by_offset, cuts):
            logs = total[source[level]] + weight[level]
            head = np.flatnonzero(np.concatenate([[True], np.diff(target[level]) > 0]))
            n = np.diff(np.append(head, len(level)))
            top = np.maximum.reduceat(logs, head)
            part = np.exp(logs - np.repeat(top, n))
            whole = np.add.reduceat(part, head)
            total[target[level[head]]] = top + np.log(whole)
            share[level] = part / np.repeat(whole, n)
        # node + share of the paths into it up to this edge: ascending, a whole number behind each node's last
        tail = np.flatnonzero(np.concatenate([np.diff(target) > 0, [True]]))
        run = np.cumsum(share)
        run -= np.repeat(np.concatenate([[0.0], run[tail[:-1]]]), np.diff(np.concatenate([[-1], tail])))
        run[tail] = 1.0
        keys = target + np.minimum(run, 1.0)
        opens = np.bincount(target, minlength=len(total))
        opens = np.cumsum(opens) - opens
        del run, share, offset, by_offset, total

        text_of = np.repeat(np.arange(len(texts)), per_text)
        nth = np.arange(len(unit)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        salt = np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        noise = mix(row_keys.view(np.uint64)[text_of] + salt + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 3)
        active, node, stop = np.arange(len(unit)), last[unit], bases[unit]
        steps = []
        while len(active):
            noise = mix(noise, 5)
            u = (noise >> np.uint64(12)).astype(np.float64) * 2.0**-52
            # the share of an edge ends at its key: the first key of the node's own above node + u
            edge, aim = opens[node], node + u
            below = np.flatnonzero(keys[edge] <= aim)
            while len(below):
                edge[below] += 1
                below = below[keys[edge[below]] <= aim[below]]
            steps.append((active, edge))
            node = source[edge]
            on = node != stop
            active, node, stop, noise = active[on], node[on], stop[on], noise[on]
        made = np.zeros(len(unit), np.int64)
        for at, edge in steps:
            made[at] += count[edge]
        end = np.cumsum(made)
        out = np.empty(int(end[-1]), np.int32)
        for at, edge in steps:  # from the back of each unit to its front
            n = count[edge]
            end[at] -= n
            if n.max() == 1:
                out[end[at]] = ids[first[edge]]
            else:
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                out[np.repeat(end[at], n) + inner] = ids[np.repeat(first[edge], n) + inner]
        return out, np.bincount(text_of, weights=made, minlength=len(texts)).astype(np.int64)

    def spell(self, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, bytes of each text): pieces joined, without the space put before a text."""
        n = self.text_lengths[ids]
        ends = np.cumsum(n)
        inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
        data = self.text_bytes[np.repeat(self.text_starts[ids], n) + inner]
        total = np.concatenate([[0], ends])
        stops = total[np.cumsum(per_text)]
        sizes = np.diff(stops, prepend=0)
        keep = np.ones(len(data), bool)
        keep[(stops - sizes)[sizes > 0]] = False
        return data[keep], sizes - (sizes > 0)


def encode_sampled(df: DataFrame, key: str, text: str = "text", to: str = "piece_ids", model: str | None = None,
                   alpha: float = ALPHA, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """``df`` with the array<int> column ``to`` (replaced if there): ids of one sampled segmentation of the text.

    Without ``keep_text`` the text column is left out, so that it goes to the Python workers once and does not come back.

    ``key`` seeds the draws: equal keys and texts get equal ids. A null or empty text has no ids. Characters
    that no piece spells, and the vocabulary's own space mark, become bytes. No shuffle.
    """
    path = model or default_model()
    rest = [c for c in df.columns if c.lower() != to.lower() and (keep_text or c.lower() != text.lower())]
    rows = df.select(*rest, whole_text(text).alias("__text"), F.xxhash64(F.col(key)).alias("__key"))
    schema = rows.drop("__text", "__key").schema.add(to, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(path, alpha)
        for batch in batches:
            texts = batch.column(len(rest))
            lengths = pc.binary_length(texts).to_numpy().astype(np.int64)
            for lo, hi in runs(lengths, RUN_BYTES):
                keys = batch.column(len(rest) + 1).slice(lo, hi - lo).to_numpy()
                ids, made = lattice.sample(texts.slice(lo, hi - lo).to_pylist(), keys, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(made)]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(len(rest))] + [lists], names=[*rest, to])

    return rows.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, ids: str = "piece_ids", to: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with the text that ``ids`` spell in column ``to`` (replaced if there); null or no ids: empty. No shuffle."""
    path = model or default_model()
    rest = [c for c in df.columns if c.lower() != to.lower()]
    rows = df.select(*rest, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"))
    schema = rows.drop("__ids").schema.add(to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(path)
        for batch in batches:
            lists = batch.column(len(rest)).cast(pa.list_(pa.int32()))
            offsets = lists.offsets.to_numpy()
            for lo, hi in runs(4 * np.diff(offsets).astype(np.int64), RUN_BYTES):
                own = np.diff(offsets[lo : hi + 1]).astype(np.int64)
                flat = lists.values.to_numpy()[offsets[lo] : offsets[hi]]
                data, sizes = lattice.spell(flat, own)
                at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                texts = pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(len(rest))] + [texts], names=[*rest, to])

    return rows.mapInArrow(run, schema)


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every whole text of ``documents``, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", whole_text())
    # What the decoded text is held against travels as a digest instead of the text.
    docs = docs.withColumns({"n_chars": F.char_length("text").cast("long"), "text_sha256": F.sha2(F.col("text").cast("binary"), 256)})
    back = decode_pieces(encode_sampled(docs, "doc_id", keep_text=False))
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return back.select(
        "doc_id", "n_chars", F.size("piece_ids").cast("long").alias("n_pieces"),
        "piece_ids", decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("lossless"))
