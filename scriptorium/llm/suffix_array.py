"""Suffix arrays by induced sorting, on numpy arrays, and the repeats that they show.

A suffix is of type S if it is smaller than the next one, else L; a leftmost S (LMS) follows
an L. Sorted LMS suffixes induce the order of the L suffixes in one pass over the buckets of
first symbols from the left, and those the order of the S suffixes in one from the right. The
passes go bucket by bucket, and a bucket's entries all at once: what a bucket puts into itself
(a run of one symbol) comes in rounds, one for each further symbol of the longest run.
"""

from __future__ import annotations

import numpy as np

from scriptorium.llm.shingles import _BASE, _INVERSE, mix


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last symbol must be the only smallest one."""
    n = len(text)
    step = np.diff(text.astype(np.int32))
    decided = np.where(step != 0, np.arange(n - 1), n)
    # an equal neighbour takes the type of the first place after it where the symbol changes
    nearest = np.minimum.accumulate(decided[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = step[np.minimum(nearest, n - 2)] > 0
    small[:-1][nearest == n] = True
    return small


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order of all suffixes that the order ``seeds`` of the LMS suffixes induces."""
    ends = np.cumsum(counts)
    starts = ends - counts
    order = np.full(len(text), -1, np.int32)
    # LMS suffixes at the ends of their buckets
    of = text[seeds]
    by_symbol = np.argsort(of, kind="stable")
    held = seeds[by_symbol]
    n_seeds = np.bincount(of, minlength=len(counts))
    seed_ends = np.cumsum(n_seeds)
    n_small = np.bincount(text[small], minlength=len(counts))
    free = starts.copy()

    def put(found: np.ndarray, at: np.ndarray, forward: bool) -> None:
        """Append the suffixes to their buckets, first come first, from the front or from the back."""
        if not len(found):
            return
        t = text[found]
        o = np.argsort(t, kind="stable")
        t, f = t[o], found[o]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(t)]]))
        nth = np.arange(len(t)) - np.repeat(first, sizes)
        if forward:
            order[at[t] + nth] = f
            at[t[first]] += sizes
        else:
            order[at[t] - 1 - nth] = f
            at[t[first]] -= sizes

    for c in symbols.tolist():
        later = []
        done = int(starts[c])
        while done < free[c]:
            wave = order[done : free[c]]
            done = int(free[c])
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            own = text[before] == c
            later.append(before[~own])
            new = before[own]
            order[free[c] : free[c] + len(new)] = new
            free[c] += len(new)
        wave = held[seed_ends[c] - n_seeds[c] : seed_ends[c]]
        before = wave[wave > 0] - 1
        later.append(before[~small[before]])
        put(np.concatenate(later), free, True)
    last = ends.copy()
    for c in symbols[::-1].tolist():
        later = []
        done = int(ends[c])
        if c == text[-1]:
            order[ends[c] - 1] = len(text) - 1
            last[c] -= 1
        while done > last[c]:
            wave = order[last[c] : done][::-1]
            done = int(last[c])
            before = wave[wave > 0] - 1
            before = before[small[before]]
            own = text[before] == c
            later.append(before[~own])
            new = before[own]
            order[last[c] - len(new) : last[c]] = new[::-1]
            last[c] -= len(new)
        wave = order[starts[c] : ends[c] - n_small[c]][::-1]
        before = wave[wave > 0] - 1
        later.append(before[small[before]])
        put(np.concatenate(later), last, False)
    return order


def order_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the reduced string, whose symbols are names of LMS substrings.

    The alphabet is nearly as large as the string here, so the recursion goes by doubling: after round r
    suffixes are in order by 2^r names. It ends when all differ or ``depth`` names are compared.
    """
    rank, width = names.astype(np.int64), 1
    n = len(rank)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= depth:
            return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of ``text`` in order. The last symbol must be the only smallest one.

    With ``depth`` suffixes that agree in as many symbols may stand in any order among themselves.
    """
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable").astype(np.int32)
    text = np.ascontiguousarray(text, np.int16 if text.max() < 1 << 15 else np.int32)
    counts = np.bincount(text)
    symbols = np.flatnonzero(counts)
    small = suffix_types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(lms) > 1:
        # one induction sorts the LMS substrings, whatever the order of the seeds
        order = induce(text, small, lms, symbols, counts)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ranked = order[is_lms[order]]
        length = np.zeros(n, np.int32)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        sums, back = prefix_sums(text)
        size = length[ranked]
        value = mix((sums[ranked + size] - sums[ranked]) * back[ranked]) ^ size.astype(np.uint64)
        fresh = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
        name = np.zeros(n, np.int64)
        name[ranked] = fresh
        if fresh[-1] == len(lms) - 1:
            seeds = ranked
        else:
            seeds = lms[order_names(name[lms], n if depth is None else depth)]
    else:
        seeds = lms
    return induce(text, small, seeds, symbols, counts)


def prefix_sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix sums and the inverse powers: (sums[j] - sums[i]) * back[i] is the hash of text[i:j]."""
    n = len(text)
    powers = np.full(n, _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return sums, back


def repeated_starts(text: np.ndarray, order: np.ndarray, length: int, step: int = 8) -> np.ndarray:
    """True where a string of ``length`` symbols starts that starts elsewhere too.

    Permuted common prefixes (the common prefix of a suffix and the one before it in the order, by position)
    fall by at most one from one position to the next. So they are computed at every ``step``-th position, by
    bisection, which decides most of the others; the rest are compared.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    sums, back = prefix_sums(text)

    def equal(i: np.ndarray, j: np.ndarray, size) -> np.ndarray:
        fits = (i + size <= n) & (j + size <= n) & (j >= 0)
        a, b = np.where(fits, i, 0), np.where(fits, j, 0)
        s = np.where(fits, size, 0)
        return fits & ((sums[a + s] - sums[a]) * back[a] == (sums[b + s] - sums[b]) * back[b])

    at = np.arange(0, n, step)
    phi = before[at]
    common = np.zeros(len(at), np.int64)
    bit = 1 << (length + step).bit_length()
    while bit:
        common = np.where(equal(at, phi, common + bit), common + bit, common)
        bit >>= 1
    place = np.arange(n)
    lower = common[place // step] - place % step
    ahead = np.minimum(place // step + 1, len(at) - 1)
    upper = np.where(place // step + 1 < len(at), common[ahead] + (step - place % step), n)
    long = lower >= length
    open_ = np.flatnonzero(~long & (upper >= length))
    long[open_] = equal(open_, before[open_], length)
    found = long.copy()
    partners = before[long]
    found[partners] = True
    return found
