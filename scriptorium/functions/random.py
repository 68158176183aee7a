"""Deterministic per-row uniforms.

``rand(seed)`` depends on partitioning, so shuffles, splits and masking here use
a hash of (seed, keys...) instead. The md5 form is reproducible in DuckDB
(``('0x' || substr(md5(..), 1, 13))::UBIGINT / 2^52``), which makes every random
operator oracle-checkable. ``hash_uniform`` has 52 bits, enough to number every row of
a table of 10^12; masking draws four 32-bit uniforms per position from one hash.

One hash per position of a text is too much for a lambda over an array, which Spark interprets
element by element; ``md5_numbered`` makes the same digests in numpy, thousands at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
TWO_52 = 4503599627370496.0


def _key(seed, *parts) -> Column:
    cols = [F.lit(str(seed))] + [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *cols)


def hex_uniform(hexdigest: Column, word: int = 0) -> Column:
    """Uniform in [0, 1) from 8 hex digits of ``hexdigest`` starting at word ``word``."""
    return F.conv(F.substring(hexdigest, 1 + 8 * word, 8), 16, 10).cast("double") / TWO_32


def hash_uniform(seed, *parts) -> Column:
    """u = first 13 hex digits of md5('seed:part1:part2...') / 2^52, in [0, 1)."""
    return F.conv(F.substring(F.md5(_key(seed, *parts)), 1, 13), 16, 10).cast("double") / TWO_52


# ---------------------------------------------------------------------------
# The same digests for numbered messages, in numpy
# ---------------------------------------------------------------------------
# Fixed values of md5 (RFC 1321); arrays without dimensions meet others faster than numpy's scalars do.
_SINES = [np.array(x) for x in np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * TWO_32).astype(np.uint32)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_LEFT = [np.array(_TURNS[i // 16][i % 4], np.uint32) for i in range(64)]
_RIGHT = [np.array(32 - _TURNS[i // 16][i % 4], np.uint32) for i in range(64)]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
# Messages hashed at once; their words then stay in a core's cache.
_AT_ONCE = 8192
# The same where heads are followed by all numbers: nearly all words are one for a head, and numpy's cost per call counts for more.
_TABLE_AT_ONCE = 65536


def _md5_block(state: list[np.ndarray], words: list[np.ndarray | None], shape: tuple[int, ...]) -> list[np.ndarray]:
    """One round of md5 for many messages. ``words`` are the block's 16 words, None where all are zero; words and ``state``
    either have ``shape`` or are one-dimensional and hold for all its rows, and until a word of full shape comes the steps are made once for all rows."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
        elif i < 32:
            g = (5 * i + 1) % 16
        elif i < 48:
            g = (3 * i + 5) % 16
        else:
            g = 7 * i % 16
        w = words[g]
        if w is not None and w.ndim > a.ndim:
            a, b, c, d = (np.array(np.broadcast_to(x, shape)) for x in (a, b, c, d))
            f, t = np.empty_like(a), np.empty_like(a)
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if w is None:
            np.add(f, _SINES[i], out=f)
        elif w.ndim < f.ndim:
            np.add(f, w + _SINES[i], out=f)
        else:
            np.add(f, _SINES[i], out=f)
            np.add(f, w, out=f)
        np.right_shift(f, _RIGHT[i], out=t)
        np.left_shift(f, _LEFT[i], out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(state, (a, b, c, d))]


def _md5_of_some(heads: list[bytes], rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    digits = np.ones(len(numbers), np.int64)
    for power in range(1, len(str(int(numbers.max())))):
        digits += numbers >= 10**power
    sizes = np.array([len(h) for h in heads], np.int64)
    length = sizes[rows] + digits
    n_blocks = (length + 8) // 64 + 1
    width = 64 * int(n_blocks.max())
    first = np.frombuffer(b"".join(h.ljust(width, b"\0") for h in heads), np.uint8).reshape(len(heads), width)
    text, every = first[rows], np.arange(len(numbers))
    for place in range(int(digits.max())):  # from the last digit
        has = every if place == 0 else np.flatnonzero(digits > place)
        text[has, length[has] - 1 - place] = 48 + numbers[has] // 10**place % 10
    text[every, length] = 0x80
    words = text.view("<u4")
    words[every, 16 * n_blocks - 2] = 8 * length
    words = np.ascontiguousarray(words.T)
    state = [np.full(len(numbers), x, np.uint32) for x in _START]
    for k in range(width // 64):
        after = _md5_block(state, list(words[16 * k : 16 * k + 16]), (len(numbers),))
        more = n_blocks > k
        state = after if more.all() else [np.where(more, x, y) for x, y in zip(after, state)]
    # The hex digits of a digest show its words' bytes in memory order.
    return np.array([x.byteswap() for x in state])


def md5_numbered(heads: list[bytes], rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """md5 of ``heads[rows[i]]`` followed by the decimal digits of ``numbers[i]`` (0 or more), as a 4 x n array of
    the digests' 8-digit words. Neighbouring messages should share heads."""
    out = np.empty((4, len(rows)), np.uint32)
    for a in range(0, len(rows), _AT_ONCE):
        part = rows[a : a + _AT_ONCE]
        used, at = np.unique(part, return_inverse=True)
        out[:, a : a + _AT_ONCE] = _md5_of_some([heads[i] for i in used.tolist()], at, numbers[a : a + _AT_ONCE].astype(np.int64))
    return out


def _md5_of_tails(heads: np.ndarray, sizes: np.ndarray, tails: np.ndarray, n_words: int) -> np.ndarray:
    """The first words of the digests of every head with every tail after it, as words x tails x heads. ``heads`` is a byte matrix
    as wide as the blocks of a message, with zeros after the heads' lengths, ``sizes``, which are in order; ``tails`` is a byte matrix too.

    Only the few words that hold a tail are made for every message; the others are those of its head."""
    n, digits = tails.shape
    shape = (n, len(heads))
    words: list[np.ndarray | None] = [*np.ascontiguousarray(heads.view("<u4").T)]
    low, high = int(sizes[0]) // 4, (int(sizes[-1]) + digits) // 4
    held = [np.array(np.broadcast_to(w, shape)) for w in words[low : high + 1]]
    for size in np.unique(sizes).tolist():
        a, z = np.searchsorted(sizes, [size, size + 1])
        put = np.zeros((n, 4 * (high + 1 - low)), np.uint8)
        put[:, size - 4 * low : size - 4 * low + digits] = tails
        put[:, size - 4 * low + digits] = 0x80
        for w, x in zip(held, put.view("<u4").T):
            if x.any():
                w[:, a:z] |= x[:, None]
    words[low:] = held + [None] * (len(words) - high - 1)
    bits = (8 * (sizes + digits)).astype(np.uint32)
    words[-2] = bits if words[-2] is None else words[-2] + bits
    state = [np.full(len(heads), x, np.uint32) for x in _START]
    for k in range(0, len(words), 16):
        state = _md5_block(state, words[k : k + 16], shape)
    return np.array([x.byteswap() for x in state[:n_words]])


def md5_counted(heads: list[bytes], counts: np.ndarray, n_words: int = 4) -> np.ndarray:
    """``md5_numbered`` of every head followed by each number below its count, head by head: the first ``n_words`` rows. Where all
    counts are equal, what the messages of a head share is made once."""
    counts = np.asarray(counts, np.int64)
    most = int(counts.max(initial=0))
    if (counts != most).any():
        rows = np.repeat(np.arange(len(counts)), counts)
        return md5_numbered(heads, rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts))[:n_words]
    out = np.empty((n_words, len(heads), most), np.uint32)
    sizes = np.array([len(h) for h in heads], np.int64)
    order, many = np.argsort(sizes, kind="stable"), max(1, _TABLE_AT_ONCE // max(most, 1))
    for at in range(0, len(heads) if most else 0, many):
        some = order[at : at + many]
        size = sizes[some]
        width = 64 * ((int(size[-1]) + len(str(most)) + 8) // 64 + 1)
        first = np.frombuffer(b"".join(heads[i].ljust(width, b"\0") for i in some.tolist()), np.uint8).reshape(len(some), width)
        low = 0
        while low < most:
            digits = len(str(low))
            high = min(10**digits, most, low + _TABLE_AT_ONCE)
            tails = (48 + np.arange(low, high)[:, None] // 10 ** np.arange(digits - 1, -1, -1) % 10).astype(np.uint8)
            n_blocks = (size + digits + 8) // 64 + 1
            for blocks in np.unique(n_blocks).tolist():
                a, z = np.searchsorted(n_blocks, [blocks, blocks + 1])
                got = _md5_of_tails(np.ascontiguousarray(first[a:z, : 64 * blocks]), size[a:z], tails, n_words)
                out[:, some[a:z], low:high] = got.transpose(0, 2, 1)
            low = high
    return out.reshape(n_words, -1)


def uniform_of_word(word: np.ndarray) -> np.ndarray:
    """``hex_uniform`` of a word of ``md5_numbered``."""
    return word / TWO_32


def uniform_of_digest(digest: np.ndarray) -> np.ndarray:
    """``hash_uniform`` of the digests of ``md5_numbered``: their first 13 hex digits."""
    return ((digest[0].astype(np.uint64) << np.uint64(20)) | (digest[1] >> np.uint32(12))).astype(np.float64) / TWO_52


def heads_of(keys: pa.Array, *before: object) -> tuple[list[bytes], np.ndarray]:
    """The heads 'before:key:' of numbered messages, each once, and which of them each key has; as with concat_ws a null key leaves no part."""
    lead = "".join(f"{b}:" for b in before).encode()
    coded = keys.dictionary_encode(null_encoding="encode")
    heads = [lead if k is None else lead + k.encode() + b":" for k in coded.dictionary.to_pylist()]
    return heads, coded.indices.to_numpy(zero_copy_only=False)


def keys_as_bytes(keys: pa.Array, *before: object) -> list[bytes]:
    """``heads_of`` with a head for each key."""
    heads, which = heads_of(keys, *before)
    return [heads[i] for i in which.tolist()]


def hash_uniforms(seed, key: Column, sizes: Column) -> Column:
    """``hash_uniform(seed, key, i)`` for every i below ``sizes``, as an array."""

    @F.arrow_udf("array<double>")
    def draw(keys: pa.Array, sizes: pa.Array) -> pa.Array:
        n = sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(n)])
        u = np.empty(offsets[-1])
        # Stretches of rows with about so many numbers each, whatever the batch.
        cuts = np.unique(np.searchsorted(offsets, np.arange(0, offsets[-1] + 1, _UNIFORMS_AT_ONCE))).tolist()
        cuts = [0, *[c for c in cuts if 0 < c < len(n)], len(n)]
        for a, z in zip(cuts, cuts[1:]):
            rows = np.repeat(np.arange(z - a), n[a:z])
            places = np.arange(offsets[a], offsets[z]) - offsets[a:z][rows]
            u[offsets[a] : offsets[z]] = uniform_of_digest(md5_numbered(keys_as_bytes(keys.slice(a, z - a), seed), rows, places))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(u), mask=sizes.is_null())

    return draw(key.cast("string"), sizes)


_UNIFORMS_AT_ONCE = 1 << 19
