"""Suffix arrays by induced sorting, and permuted longest common prefixes.

The first level (bytes) induces bucket by bucket with array operations; the recursion on the names of the leftmost-smaller
substrings, whose alphabet is large, induces entry by entry. Both are linear.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last (the sentinel) is."""
    n = len(text)
    out = np.zeros(n, bool)
    out[-1] = True
    if n > 1:
        less = text[:-1] < text[1:]
        differ = np.flatnonzero(text[:-1] != text[1:])
        at = np.searchsorted(differ, np.arange(n - 1))
        has = at < len(differ)
        out[:-1][has] = less[differ[at[has]]]
    return out


def _leftmost(small: np.ndarray) -> np.ndarray:
    """Places where a smaller-type run starts, after a larger-type one."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _induce_buckets(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorts all suffixes from sorted leftmost-smaller ones, a bucket at a time."""
    n, k = len(text), len(bounds) - 1
    sa = np.full(n, -1, np.int64)
    head, tail = bounds[:-1].copy(), bounds[1:].copy()
    # seeds at their buckets' ends, in order
    letters = text[seeds]
    count = np.bincount(letters, minlength=k)
    begin = tail - count
    order = np.argsort(letters, kind="stable")
    ends = np.concatenate([[0], np.cumsum(count)])
    seed_of = seeds[order]

    def put_larger(queue: np.ndarray, c: int) -> np.ndarray:
        """Larger-type predecessors of the queue go to their buckets' heads; those of this bucket come back."""
        before = queue[queue > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return before
        ch = text[before]
        by = np.argsort(ch, kind="stable")
        sorted_ch = ch[by]
        cnt = np.bincount(sorted_ch, minlength=k)
        first = np.cumsum(cnt) - cnt
        sa[head[sorted_ch] + np.arange(len(by)) - first[sorted_ch]] = before[by]
        head[:] += cnt
        return before[ch == c]

    for c in range(k):
        if bounds[c] == bounds[c + 1]:
            continue
        queue = sa[bounds[c] : head[c]]
        while len(queue):
            queue = put_larger(queue.copy(), c)
        mine = seed_of[ends[c] : ends[c + 1]]
        if len(mine):
            put_larger(mine, c)

    def put_smaller(queue: np.ndarray, c: int) -> np.ndarray:
        """Smaller-type predecessors of the queue (from the right) go to their buckets' tails, from the right."""
        before = queue[queue > 0] - 1
        before = before[small[before]]
        if not len(before):
            return before
        ch = text[before]
        by = np.argsort(ch, kind="stable")
        sorted_ch = ch[by]
        cnt = np.bincount(sorted_ch, minlength=k)
        first = np.cumsum(cnt) - cnt
        sa[tail[sorted_ch] - 1 - (np.arange(len(by)) - first[sorted_ch])] = before[by]
        tail[:] -= cnt
        return before[ch == c]

    sa[0] = n - 1  # the sentinel
    tail[text[n - 1]] -= 1
    for c in range(k - 1, -1, -1):
        if bounds[c] == bounds[c + 1]:
            continue
        queue = sa[tail[c] : bounds[c + 1]][::-1]
        while len(queue):
            queue = put_smaller(queue.copy(), c)
        larger = sa[bounds[c] : head[c]][::-1]
        if len(larger):
            put_smaller(larger.copy(), c)
    return sa


def _induce_entries(larger: list[int], smaller: list[int], text: np.ndarray, seeds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """As _induce_buckets, entry by entry, for large alphabets.

    `larger` has, for a suffix, the letter before it if that starts a larger-type suffix, else -1; `smaller` likewise.
    Both end with a -1 for the entries that are still empty (-1).
    """
    letters = text[seeds]
    by = np.argsort(letters, kind="stable")
    ends = np.cumsum(np.bincount(letters, minlength=len(bounds) - 1))
    start = np.full(len(text), -1, np.int64)
    start[bounds[1:][letters[by]] - ends[letters[by]] + np.arange(len(by))] = seeds[by]
    sa = start.tolist()
    head = bounds[:-1].tolist()
    for i in sa:  # entries set on the way are met later
        c = larger[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    tail = bounds[1:].tolist()
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            at = tail[c] - 1
            sa[at] = i - 1
            tail[c] = at
    return np.array(sa, np.int64)


def suffix_array(text: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of integers below k that end with a 0 found nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=k))])
    small = _types(text)
    marks = _leftmost(small)
    if not len(marks):
        marks = np.array([n - 1])
    by_bucket = k <= 512
    if by_bucket:
        induce = lambda seeds: _induce_buckets(text, small, seeds, bounds)
    else:
        none = np.full(1, -1)
        larger = np.concatenate([none, np.where(small[:-1], -1, text[:-1]), none]).tolist()
        smaller = np.concatenate([none, np.where(small[:-1], text[:-1], -1), none]).tolist()
        induce = lambda seeds: _induce_entries(larger, smaller, text, seeds, bounds)
    rough = induce(marks)
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    order = rough[is_mark[rough]]
    # names of the substrings from one mark to the next, in sorted order
    size = np.zeros(n, np.int64)
    size[marks] = np.diff(marks, append=n - 1) + 1
    names = np.zeros(n, np.int64)
    names[order] = np.cumsum(_differ(text, order, size))
    reduced = names[marks]
    if reduced.max() + 1 < len(marks):
        deeper = suffix_array(reduced, int(reduced.max()) + 1)
    else:
        deeper = np.empty(len(marks), np.int64)
        deeper[reduced] = np.arange(len(marks))
    return induce(marks[deeper])


def _differ(text: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each substring but the first: whether it differs from the one before it."""
    out = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    out[1:] = size[a] != size[b]
    left = np.flatnonzero(out[1:] == 0)
    off = 0
    while len(left):
        x, y = a[left], b[left]
        unlike = text[x + off] != text[y + off]
        out[1:][left[unlike]] = 1
        off += 1
        left = left[~unlike & (size[x] > off)]
    return out


def permuted_lcp(data: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For each place of `data` (bytes) its common prefix with the suffix before it in the array, exact below `most`.

    Where the letter before a suffix is also the one before its predecessor, the value is that of the place before, less 1;
    only the other places, and `starts`, are compared, eight bytes at a time. Values from `most` on are cut, and so is what
    follows from them: with `most` at least the distance of `starts` plus a length L, all values up to L are exact.
    """
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    compared = np.ones(n, bool)
    both = np.flatnonzero(phi[1:] > 0) + 1
    compared[both] = data[both - 1] != data[phi[both] - 1]
    compared[starts] = True
    value = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded.tobytes(), strides=(1,))
    left = np.flatnonzero(compared & (phi >= 0))
    off = 0
    while len(left) and off < most:
        x, y = eight[left + off], eight[phi[left] + off]
        unlike = x != y
        low = (x ^ y)[unlike]
        low &= ~low + np.uint64(1)
        value[left[unlike]] = off + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        off += 8
        left = left[~unlike]
        value[left] = off
        left = left[(left + off < n) & (phi[left] + off < n)]
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(compared, place, 0))
    return np.where(compared, value, np.maximum(value[last] - (place - last), 0))
