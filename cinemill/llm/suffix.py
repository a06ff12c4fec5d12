"""Suffix arrays by induced sorting, and permuted common prefixes, over one shard of bytes.

Suffixes are classified as larger (L) or smaller (S) than their successor; the leftmost-smaller
substrings are sorted by induction and named; the string of names is sorted recursively; its order
induces the array in two linear scans. Where letters are few, a scan goes bucket by bucket, and within
a bucket in waves, each wave a few array operations; where they are many (the names of a recursion),
buckets hold few suffixes and the same scan goes suffix by suffix. Both give the same array.

Defined cases: an empty string has an empty array; equal letters, runs and periods need no separators.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Up to as many letters a scan goes bucket by bucket.
WAVES = 4096


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last is larger than the empty one."""
    n = len(t)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array from the leftmost-smaller suffixes in order (of their first letter at least)."""
    n, k = len(t), len(ends)
    if k > WAVES:
        return _induce_singly(t, small, seeds, ends)
    starts = np.concatenate([[0], ends[:-1]])
    sa = np.full(n, -1, dtype=np.int64)
    head = starts.copy()
    letters = t[seeds]
    cuts = np.searchsorted(letters, np.arange(k + 1))

    def put(j: np.ndarray, pointer: np.ndarray, sign: int):
        c = t[j]
        order = np.argsort(c, kind="stable")
        c, j = c[order], j[order]
        first = np.concatenate([[True], c[1:] != c[:-1]])
        begin = np.nonzero(first)[0]
        size = np.diff(np.append(begin, len(c)))
        rank = np.arange(len(c)) - np.repeat(begin, size)
        sa[pointer[c] + sign * rank] = j
        pointer[c[begin]] += sign * size

    put(np.array([n - 1]), head, 1)
    for c in range(k):
        done = starts[c]
        while done < head[c]:
            j, done = sa[done : head[c]] - 1, head[c]
            j = j[j >= 0]
            j = j[~small[j]]
            if len(j):
                put(j, head, 1)
        j = seeds[cuts[c] : cuts[c + 1]] - 1
        if len(j):
            put(j, head, 1)
    tail = ends - 1
    for c in range(k - 1, -1, -1):
        done = ends[c] - 1
        while done > tail[c]:  # smaller suffixes of this bucket, from its end
            j, done = sa[tail[c] + 1 : done + 1][::-1] - 1, tail[c]
            j = j[j >= 0]
            j = j[small[j]]
            if len(j):
                put(j, tail, -1)
        j = sa[starts[c] : head[c]][::-1] - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            put(j, tail, -1)
    return sa


def _induce_singly(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As _induce, one suffix at a time, over flat arrays of numbers (lists would hold an object a place)."""
    n = len(t)

    def flat(x: np.ndarray) -> array:
        return array("q", x.astype(np.int64).tobytes())

    def letter_before(kind: np.ndarray) -> array:
        """Letter before each place where that is of this kind, else -1, as at -1 (an empty place)."""
        out = np.full(n + 1, -1, dtype=np.int64)
        out[1:n] = np.where(kind[:-1], t[:-1].astype(np.int64), -1)
        return flat(out)

    sa, tail = flat(np.full(n, -1)), flat(ends)
    head = flat(np.concatenate([[0], ends[:-1]]))
    for j, c in zip(seeds[::-1].tolist(), t[seeds[::-1]].tolist()):
        tail[c] -= 1
        sa[tail[c]] = j
    c = int(t[n - 1])
    sa[head[c]] = n - 1
    head[c] += 1
    before = letter_before(~small)
    for j in sa:  # reads places filled meanwhile
        c = before[j]
        if c >= 0:
            at = head[c]
            sa[at] = j - 1
            head[c] = at + 1
    before, tail = letter_before(small), flat(ends)
    for i in range(n - 1, -1, -1):
        j = sa[i]
        c = before[j]
        if c >= 0:
            at = tail[c] - 1
            sa[at] = j - 1
            tail[c] = at
    return np.frombuffer(sa, dtype=np.int64)


def suffix_array(t: np.ndarray, k: int = 256) -> np.ndarray:
    """Suffix array of a string of numbers below k, ends comparing lowest."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int64)
    small = _types(t)
    lms = np.nonzero(small[1:] & ~small[:-1])[0] + 1
    ends = np.cumsum(np.bincount(t, minlength=k))
    if not len(lms):
        return _induce(t, small, lms, ends)
    rough = _induce(t, small, lms[np.argsort(t[lms], kind="stable")], ends)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    number = np.zeros(n, dtype=np.int64)
    number[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms) + 1, n - lms[-1] + 1)[number[order]]
    same = np.zeros(len(order), dtype=bool)
    pairs = np.nonzero((length[1:] == length[:-1]) & (order[1:] != lms[-1]) & (order[:-1] != lms[-1]))[0] + 1
    if len(pairs):
        size = length[pairs]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        differ = t[np.repeat(order[pairs], size) + step] != t[np.repeat(order[pairs - 1], size) + step]
        same[pairs] = ~np.logical_or.reduceat(differ, first)
    names = np.cumsum(~same) - 1
    if names[-1] + 1 == len(lms):
        seeds = order
    else:
        reduced = np.zeros(len(lms), dtype=np.int64)
        reduced[number[order]] = names
        seeds = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return _induce(t, small, seeds, ends)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix of its suffix and the one before it in the array.

    Values are computed by comparison only where the preceding letters differ; elsewhere each is one
    less than its left neighbour's.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    own = (at == 0) | (before <= 0)
    own[1:] |= t[at[1:] - 1] != t[before[1:] - 1]
    out = np.zeros(n, dtype=np.int64)
    i = at[own & (before >= 0)]
    j = before[i]
    padded = np.concatenate([t.astype(np.int64), np.full(32, -1)])
    width = np.arange(32)
    while len(i):
        done = []
        for lo in range(0, len(i), 1 << 14):
            a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            k = out[a]
            x, y = padded[np.minimum(a + k, n)[:, None] + width], padded[np.minimum(b + k, n)[:, None] + width]
            equal = (x == y) & (x >= 0)
            some = np.where(equal.all(1), 32, equal.argmin(1))
            out[a] = k + some
            done.append(some < 32)
        more = ~np.concatenate(done)
        i, j = i[more], j[more]
    last = np.maximum.accumulate(np.where(own, at, 0))
    return np.maximum(out[last] - (at - last), 0)
