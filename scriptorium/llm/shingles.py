"""Word shingles and MinHash signatures of many texts at once, on numpy arrays of their bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
# Inverse of the base modulo 2^64.
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# Texts are handled in runs of about so many bytes, which bounds the arrays.
RUN_BYTES = 1 << 20


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (every bit of the input reaches every bit of the output)."""
    x = (x + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def runs(lengths: np.ndarray, limit: int = RUN_BYTES):
    """(first, last) of consecutive texts that hold about ``limit`` bytes together; a longer text is alone."""
    first, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of every word of the texts that end at ``ends`` in ``data``.

    A-Z are lower-cased; words are runs of bytes other than space and 0x09-0x0D.
    """
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(n, bool)
    first[0] = True
    first[ends[ends < n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first | ~before))
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:] | first[1:]
    stops = np.flatnonzero(inside & last) + 1
    powers = np.full(n, _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    hashes = (sums[stops] - sums[starts]) * back[starts]
    return mix(hashes + (stops - starts).astype(np.uint64)), np.searchsorted(ends, starts, side="right")


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; and how many each has.

    A text of fewer than ``size`` words (and at least one) has its whole sequence as its only shingle.
    """
    words, doc = word_hashes(data, ends)
    n_docs = len(ends)
    per_doc = np.bincount(doc, minlength=n_docs)
    starts = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    odd = [np.uint64(0x9FB21C651E98DF25 + 2 * 0x632BE59BD9B4E019 * j & 0xFFFFFFFFFFFFFFFF | 1) for j in range(size)]
    full = max(0, len(words) - size + 1)
    h = np.zeros(full, np.uint64)
    for j in range(size):
        h += words[j : j + full] * odd[j]
    whole = doc[:full] == doc[size - 1 : size - 1 + full]
    h, d = mix(h[whole]), doc[:full][whole]
    for k in range(1, size):
        few = np.flatnonzero(per_doc == k)
        if len(few):
            s = np.zeros(len(few), np.uint64)
            for j in range(k):
                s += words[starts[few] + j] * odd[j]
            h, d = np.concatenate([h, mix(s, k)]), np.concatenate([d, few])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=n_docs)


def minhash(sets: np.ndarray, sizes: np.ndarray, slots: int, seed: int = 1) -> np.ndarray:
    """(texts with a shingle, slots) matrix of 32-bit minima."""
    some = sizes > 0
    at = (np.cumsum(sizes) - sizes)[some]
    out = np.empty((int(some.sum()), slots), np.uint32)
    if not len(out):
        return out
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, slots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, slots, dtype=np.uint64)
    for k in range(slots):
        out[:, k] = np.minimum.reduceat((sets * a[k] + b[k]) >> np.uint64(32), at)
    return out


def digests(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts with a shingle, 2) 64-bit digests of the sets, equal for equal sets."""
    some = sizes > 0
    at = (np.cumsum(sizes) - sizes)[some]
    if not len(at):
        return np.empty((0, 2), np.int64)
    return np.stack([np.add.reduceat(mix(sets, s), at) for s in (11, 12)], axis=1).view(np.int64)
