"""Suffix arrays by induced sorting.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost-smaller (LMS) substrings are
sorted by inducing from bucket ends and named; where names repeat, the string of names is sorted the same way,
recursively; from the sorted LMS suffixes the whole array is induced. Inducing is linear. Over bytes it runs in numpy:
buckets are visited in order, and each visit moves all entries of a bucket at once; an entry that lands in the bucket
being visited forms the next wave of that visit, so a visit has as many waves as the bucket's longest run. The strings
of names below have alphabets about as large as themselves, where a bucket holds few entries, so those levels run the
same steps entry by entry.
"""

from __future__ import annotations

import numpy as np


def _classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour (the last one is larger than the empty suffix)."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    ends = np.r_[change, n - 1]
    up = np.zeros(len(ends), bool)
    up[:-1] = t[change] < t[change + 1]
    return np.repeat(up, np.diff(np.r_[-1, ends]))


def _within(groups: np.ndarray) -> np.ndarray:
    """Rank of each entry inside its run of equal values."""
    first = np.r_[0, np.flatnonzero(groups[1:] != groups[:-1]) + 1]
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


def _induce(t: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS positions in a given order (bucket by bucket)."""
    n, k = len(t), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    n_large = np.bincount(t[~small], minlength=k)
    head, split = starts[:-1].copy(), starts[:-1] + n_large
    chars = t[lms]
    lms_count = np.bincount(chars, minlength=k)
    order = np.argsort(chars, kind="stable")
    by_bucket = lms[order]
    lms_from = np.r_[0, np.cumsum(lms_count)]

    def put_large(entries: np.ndarray) -> None:
        j = entries[entries > 0] - 1
        j = j[~small[j]]
        if not len(j):
            return
        c = t[j]
        o = np.argsort(c, kind="stable")
        j, c = j[o], c[o]
        sa[head[c] + _within(c)] = j
        used, many = np.unique(c, return_counts=True)
        head[used] += many

    last = t[n - 1]
    sa[head[last]] = n - 1  # follows from the empty suffix
    head[last] += 1
    for c in range(k):
        at = starts[c]
        while at < head[c]:
            to = head[c]
            put_large(sa[at:to])
            at = to
        if lms_count[c]:
            put_large(by_bucket[lms_from[c] : lms_from[c + 1]])

    tail = starts[1:].copy()

    def put_small(entries: np.ndarray) -> None:
        """entries: from right to left."""
        j = entries[entries > 0] - 1
        j = j[small[j]]
        if not len(j):
            return
        c = t[j]
        o = np.argsort(c, kind="stable")
        j, c = j[o], c[o]
        sa[tail[c] - 1 - _within(c)] = j
        used, many = np.unique(c, return_counts=True)
        tail[used] -= many

    for c in range(k - 1, -1, -1):
        at = starts[c + 1]
        while at > tail[c]:
            to = tail[c]
            put_small(sa[to:at][::-1])
            at = to
        put_small(sa[starts[c] : split[c]][::-1])
    return sa


def _windows(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as big-endian numbers; ``t`` has eight spare bytes at its end."""
    return np.ndarray((len(t) - 7,), ">u8", t.tobytes(), 0, (1,))


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Are the ``length`` bytes from a and from b equal?"""
    ok = np.ones(len(a), bool)
    live, done = np.arange(len(a)), 0
    while len(live):
        left = length[live] - done
        shift = np.where(left >= 8, 0, 8 * (8 - left)).astype(np.uint64)
        x = words[a[live] + done].astype(np.uint64) ^ words[b[live] + done].astype(np.uint64)
        eq = (x >> shift) == 0
        ok[live[~eq]] = False
        live = live[eq & (left > 8)]
        done += 8
    return ok


def _induce_entries(s: list[int], small: list[bool], sizes: list[int], lms: list[int]) -> list[int]:
    """As :func:`_induce`, one entry at a time."""
    n = len(s)
    sa, heads, total = [-1] * n, [], 0
    for x in sizes:
        heads.append(total)
        total += x
    tails = [h + x for h, x in zip(heads, sizes, strict=True)]
    ends = tails.copy()
    for i in reversed(lms):
        ends[s[i]] -= 1
        sa[ends[s[i]]] = i
    sa_at = heads.copy()
    sa[sa_at[s[-1]]] = n - 1  # follows from the empty suffix; its bucket's LMS entries lie behind
    sa_at[s[-1]] += 1
    for at in range(n):
        i = sa[at]
        if i > 0 and not small[i - 1]:
            c = s[i - 1]
            sa[sa_at[c]] = i - 1
            sa_at[c] += 1
    ends = tails
    for at in range(n - 1, -1, -1):
        i = sa[at]
        if i > 0 and small[i - 1]:
            c = s[i - 1]
            ends[c] -= 1
            sa[ends[c]] = i - 1
    return sa


def name_order(s: list[int], names: int) -> list[int]:
    """Suffix array of a string over 0 .. names - 1, by the same induced sort, recursively."""
    n = len(s)
    if names == n:  # every name once
        out = [0] * n
        for i, x in enumerate(s):
            out[x] = i
        return out
    small = [False] * n
    for i in range(n - 2, -1, -1):
        small[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1])
    sizes = [0] * names
    for x in s:
        sizes[x] += 1
    lms = [i for i in range(1, n) if small[i] and not small[i - 1]]
    if len(lms) < 2:
        return _induce_entries(s, small, sizes, lms)
    number = {i: k for k, i in enumerate(lms)}
    rough = [i for i in _induce_entries(s, small, sizes, lms) if i in number]
    stop = [*lms[1:], n]
    reduced, name, before = [0] * len(lms), 0, None
    for i in rough:
        k = number[i]
        part = s[i : stop[k] + 1] if k + 1 < len(lms) else None  # the last one equals none
        if before is not None and (part is None or part != before[0]):
            name += 1
        reduced[k] = name
        before = (part,)
    return _induce_entries(s, small, sizes, [lms[k] for k in name_order(reduced, name + 1)])


def suffix_array(text: bytes | np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a byte string, in ascending order."""
    t = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text.astype(np.uint8, copy=False)
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = _classify(t)
    starts = np.r_[0, np.cumsum(np.bincount(t, minlength=256))]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _induce(t, small, starts, lms)
    rough = _induce(t, small, starts, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    in_order = rough[is_lms[rough]]
    length = np.zeros(n, np.int64)
    length[lms] = np.r_[np.diff(lms) + 1, n - lms[-1] + 1]  # the last one reaches past the end and equals none
    padded = np.r_[t, np.zeros(16, np.uint8)]
    a, b = in_order[:-1], in_order[1:]
    equal = length[a] == length[b]
    equal[(a == lms[-1]) | (b == lms[-1])] = False
    at = np.flatnonzero(equal)
    equal[at] = _same(_windows(padded), a[at], b[at], length[a[at]])
    names = np.zeros(n, np.int64)
    names[in_order] = np.r_[0, np.cumsum(~equal)]
    reduced = names[lms]
    order = in_order if reduced.max() == len(lms) - 1 else lms[name_order(reduced.tolist(), int(reduced.max()) + 1)]
    return _induce(t, small, starts, order)


def permuted_lcp(text: bytes | np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each text position, the common prefix with the suffix before it in the array, cut at ``most`` bytes."""
    t = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    words = _windows(np.r_[t, np.zeros(most + 16, np.uint8)])
    live = np.flatnonzero(before >= 0)
    done = 0
    while len(live) and done < most:
        x = words[live + done].astype(np.uint64) ^ words[before[live] + done].astype(np.uint64)
        full = x == 0
        bits = np.zeros(len(x), np.int64)
        part = x[~full]
        # bytes before the highest set bit of the difference
        lead = np.zeros(len(part), np.int64)
        for step in (32, 16, 8):
            low = (part >> np.uint64(64 - step)) == 0
            lead[low] += step // 8
            part = np.where(low, part << np.uint64(step), part)
        bits[~full] = lead
        bits[full] = 8
        out[live] += bits
        live = live[full]
        done += 8
    limit = n - np.maximum(np.arange(n), before)
    return np.minimum(np.minimum(out, most), limit)
