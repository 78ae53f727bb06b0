"""A suffix array by induced sorting, with permuted common prefixes, in numpy.

Suffixes are classified as larger (L) or smaller (S) than their successor.  The
leftmost S suffixes of each run (LMS) are sorted by their substrings up to the
next one; where these do not tell all apart, their names form a text of at most
half the length, whose suffix array is made in the same way.  From the sorted
LMS suffixes all others follow by induction.

Bytes are induced in two scans over the buckets of the first byte.  A scan takes
the suffixes a bucket holds as one wave: their predecessors go to the ends of
their own buckets in the order found; those that fall into the same bucket are
its next wave.  Every suffix is moved once a scan.  Names of the recursion have
too many buckets for that, so there a chain of L (or S) suffixes is ranked from
the LMS (or L) suffix that ends it, by pointer jumping.
"""

from __future__ import annotations

import numpy as np


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is not (the end is smaller than anything)."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    out = np.zeros(n, bool)
    if len(change):
        rising = text[change] < text[change + 1]
        length = np.diff(np.concatenate([[-1], change]))
        out[: change[-1] + 1] = np.repeat(rising, length)
    return out


def _scan(text: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes, induced from LMS suffixes in the order given (the order within each first byte counts)."""
    n = len(text)
    sizes = np.bincount(text, minlength=256)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    large = np.bincount(text[~small], minlength=256)
    order = np.empty(n, np.int32)
    seed_byte = text[seeds]
    by_byte = seeds[np.argsort(seed_byte, kind="stable")].astype(np.int32)
    seed_stop = np.cumsum(np.bincount(seed_byte, minlength=256))
    # left to right: predecessors that are L, to the fronts
    head = starts.copy()

    def push_front(wave: np.ndarray) -> None:
        before = wave[wave > 0] - 1
        before = before[~small[before]]
        if len(before):
            byte = text[before]
            by = np.argsort(byte, kind="stable")
            count = np.bincount(byte, minlength=256)
            at = np.arange(len(before)) + np.repeat(head - (np.cumsum(count) - count), count)
            order[at] = before[by]
            head[:] += count

    if n and not small[n - 1]:  # what precedes the end
        order[head[text[n - 1]]] = n - 1
        head[text[n - 1]] += 1
    for c in np.flatnonzero(sizes):
        done = starts[c]
        while done < head[c]:
            wave = order[done: head[c]].copy()
            done = head[c]
            push_front(wave)
        if seed_stop[c] > (seed_stop[c - 1] if c else 0):
            push_front(by_byte[seed_stop[c - 1] if c else 0: seed_stop[c]])
    # right to left: predecessors that are S, to the backs
    tail = ends.copy()

    def push_back(wave: np.ndarray) -> None:
        """The wave is in descending order."""
        before = wave[wave > 0] - 1
        before = before[small[before]]
        if len(before):
            byte = text[before]
            by = np.argsort(byte, kind="stable")
            count = np.bincount(byte, minlength=256)
            within = np.arange(len(before)) - np.repeat(np.cumsum(count) - count, count)
            order[np.repeat(tail - 1, count) - within] = before[by]
            tail[:] -= count

    for c in np.flatnonzero(sizes)[::-1]:
        done = ends[c]
        while tail[c] < done:
            wave = order[tail[c]: done][::-1].copy()
            done = tail[c]
            push_back(wave)
        if large[c]:
            push_back(order[starts[c]: starts[c] + large[c]][::-1].copy())
    return order


def _dense(key: np.ndarray) -> np.ndarray:
    """Rank of each key, equal keys alike, from 0."""
    by = np.argsort(key)
    sorted_ = key[by]
    out = np.empty(len(key), np.int64)
    out[by] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    return out


def _rank_chains(rank: np.ndarray, open_: np.ndarray, ends: np.ndarray) -> None:
    """Rank positions by their own rank, then by what follows them, up to the next of ``ends``; in place.

    A rank is the place of the first suffix of its group, so a group is split without moving others.  Each round
    looks twice as far ahead, at the groups that are still tied.
    """
    n = len(rank)
    next_ = np.where(ends, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    while len(open_):
        size = np.bincount(rank[open_], minlength=n)
        tied = open_[size[rank[open_]] > 1]
        if not len(tied):
            return
        key = rank[tied] * n + rank[next_[tied]]
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        group = key // n
        index = np.arange(len(tied))
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), index, 0))
        equal = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), index, 0))
        rank[tied] = group + equal - begin
        ahead = next_[next_]
        open_ = tied[ahead[tied] != next_[tied]]  # a chain seen to its end is as ranked as it gets
        next_ = ahead


def _names_order(names: np.ndarray) -> np.ndarray:
    """Suffix array of a text of names."""
    n = len(names)
    if names.max() + 1 == n:
        return np.argsort(names)
    small = _smaller(names)
    is_lms = small & np.concatenate([[False], ~small[:-1]])
    lms = np.flatnonzero(is_lms)
    kind = names * 2 + small  # of one name, the L suffixes come first
    start = np.cumsum(np.bincount(kind)) - np.bincount(kind)
    end = np.zeros(n, bool)
    end[n - 1] = True

    def induced(order: np.ndarray | None) -> np.ndarray:
        """Ranks of all suffixes from the order of the LMS suffixes, or from their names alone; equal ones stay equal."""
        rank = start[kind]
        rank[kind == kind[n - 1]] += 1
        rank[n - 1] -= 1  # the last suffix is the first of its kind
        if order is not None and len(order):
            mine = lms[order]
            name = names[mine]
            index = np.arange(len(mine))
            rank[mine] += index - np.maximum.accumulate(np.where(np.concatenate([[True], name[1:] != name[:-1]]), index, 0))
        _rank_chains(rank, np.flatnonzero(~small & ~end), is_lms | end)
        rank[small] = start[kind[small]]
        _rank_chains(rank, np.flatnonzero(small), ~small)
        return rank

    order = None
    if len(lms):
        inner = _dense(induced(None)[lms])
        order = np.argsort(inner) if inner.max() + 1 == len(lms) else _names_order(inner)
    out = np.empty(n, np.int64)
    out[induced(order)] = np.arange(n)
    return out


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, the first byte lowest; zeros after the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text)].copy().view("<u8").ravel()


def suffix_array(text: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Start positions of the suffixes of a uint8 array in ascending order; shorter ones come before longer ones."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _smaller(text)
    lms = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))
    if not len(lms):
        return _scan(text, small, lms)
    order = _scan(text, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_ = order[is_lms[order]].astype(np.int64)
    # substrings up to and with the next LMS position; the last one runs to the end and is like no other
    where = np.empty(n, np.int32)
    where[lms] = np.arange(len(lms))
    length = np.concatenate([np.diff(lms) + 1, [n - lms[-1] + 1]])[where[sorted_]]
    words = words_of(text) if words is None else words
    a, b = sorted_[:-1], sorted_[1:]
    same = (length[:-1] == length[1:]) & (a != lms[-1]) & (b != lms[-1])
    pairs, depth = np.flatnonzero(same), 0
    while len(pairs):
        rest = length[pairs] - depth
        gap = words[a[pairs] + depth] ^ words[b[pairs] + depth]
        short = rest < 8
        gap[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        same[pairs[gap != 0]] = False
        pairs = pairs[(gap == 0) & (rest > 8)]
        depth += 8
    names = np.empty(len(lms), np.int64)
    names[where[sorted_]] = np.cumsum(np.concatenate([[0], ~same]))
    if names.max() + 1 == len(lms):
        return _scan(text, small, sorted_)  # all substrings differ: their order is that of the suffixes
    return _scan(text, small, lms[_names_order(names)])


def common_prefixes(text: np.ndarray, order: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """For each position, how many bytes its suffix shares with the one before it in the order (0 for the first).

    Permuted order: a position whose left neighbour byte equals that of its predecessor has the value of the position
    to its left less one, so only the others are compared, eight bytes at a time.
    """
    n = len(text)
    words = words_of(text) if words is None else words
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    if not n:
        return before
    before[order[0]] = -1
    at = np.arange(n)
    inherits = (at > 0) & (before > 0)
    inherits[inherits] = text[at[inherits] - 1] == text[before[inherits] - 1]
    # the left neighbour's own predecessor must be the one to the left as well, which holds where the bytes agree
    inherits[1:] &= before[:-1] >= 0
    leads = np.flatnonzero(~inherits)
    value = np.zeros(n, np.int64)
    open_ = leads[before[leads] >= 0]
    while len(open_):
        i, j = open_ + value[open_], before[open_] + value[open_]
        inside = np.maximum(i, j) < n
        open_, i, j = open_[inside], i[inside], j[inside]
        gap = words[i] ^ words[j]
        low = gap & (~gap + np.uint64(1))  # the lowest bit that differs; a power of two, so exact as a double
        equal = np.where(gap == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
        value[open_] += np.minimum(equal, n - np.maximum(i, j))
        open_ = open_[gap == 0]
    lead = np.maximum.accumulate(np.where(inherits, 0, at))
    return np.maximum(value[lead] - (at - lead), 0)
