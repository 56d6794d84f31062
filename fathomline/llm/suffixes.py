"""Suffix arrays by induced sorting, whole arrays at a time (numpy), and permuted common prefixes.

Names of leftmost-smaller substrings that aren't all different are put in order by ranks of doubled lengths: recursion would
meet thousands of names a level, and as many small steps, where texts repeat for hundreds of symbols.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last symbol is the only smallest one."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int32)))
    where = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(where[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(following, n - 2)] > 0
    return out


def _scatter(sa: np.ndarray, at: np.ndarray, t: np.ndarray, j: np.ndarray, forward: bool) -> None:
    """Puts suffixes j, in this order, at the open end of their buckets, and moves the ends."""
    if not len(j):
        return
    c = t[j]
    order = np.argsort(c, kind="stable")
    c, j = c[order], j[order]
    new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    count = np.diff(np.concatenate([new, [len(c)]]))
    rank = np.arange(len(c)) - np.repeat(new, count)
    if forward:
        sa[at[c] + rank] = j
        at[c[new]] += count
    else:
        sa[at[c] - 1 - rank] = j
        at[c[new]] -= count


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, ends: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The order that the given order of the leftmost-smaller suffixes induces on all suffixes."""
    n = len(t)
    starts = np.concatenate([[0], ends[:-1]])
    sa = np.full(n, -1, np.int32)
    tail = ends.copy()
    _scatter(sa, tail, t, lms[::-1], False)
    head = starts.copy()

    def before(block: np.ndarray, want: bool) -> np.ndarray:
        j = block[block > 0] - 1
        return j[smaller[j] == want]

    for c in symbols:  # larger suffixes, from the front
        cur = starts[c]
        while cur < head[c]:
            block = sa[cur : head[c]]
            cur = head[c]
            _scatter(sa, head, t, before(block, False), True)
        if tail[c] < ends[c]:
            _scatter(sa, head, t, before(sa[tail[c] : ends[c]], False), True)
    tail = ends.copy()
    for c in symbols[::-1]:  # smaller suffixes, from the back
        cur = ends[c]
        while tail[c] < cur:
            block = sa[tail[c] : cur][::-1]
            cur = tail[c]
            _scatter(sa, tail, t, before(block, True), False)
        if starts[c] < head[c]:
            _scatter(sa, tail, t, before(sa[starts[c] : head[c]][::-1], True), False)
    sa[0] = n - 1
    return sa


def _ranked(rank: np.ndarray) -> np.ndarray:
    """The order of the suffixes of some names, the last of which is the only smallest one."""
    n, k = len(rank), 1
    while True:
        key = rank * n
        key[: n - k] += rank[k:]  # suffixes that end sooner hold the last name, which parts them from all others
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of integers above 0 that end with a single 0."""
    n = len(t)
    if n < 2:
        return np.zeros(n, np.int32)
    smaller = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    ends = np.cumsum(np.bincount(t))
    symbols = np.flatnonzero(np.diff(np.concatenate([[0], ends])))
    if len(lms) > 1:
        sa = _induce(t, smaller, lms, ends, symbols)
        order = sa[is_lms[sa]]
        # Name the leftmost-smaller substrings: equal ones get equal names.
        length = np.ones(n, np.int32)
        length[lms[:-1]] = np.diff(lms) + 1
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        alive, k = np.flatnonzero(same), 0
        while len(alive):
            x, y = a[alive], b[alive]
            equal = t[x + k] == t[y + k]
            same[alive[~equal]] = False
            k += 1
            alive = alive[equal & (k < length[x])]
        name = np.zeros(n, np.int64)
        name[order[1:]] = np.cumsum(~same)
        names = name[lms]
        if int(names.max()) + 1 < len(lms):
            order = lms[_ranked(names)]
        lms = order
    return _induce(t, smaller, lms, ends, symbols)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, how long its suffix agrees with the one before it in order.

    Where the symbols before both agree, it is one less than at the place before; only the other places are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    start = (before < 0) | (place == 0) | (before == 0)
    start[1:] |= (t[place[1:] - 1] != t[before[1:] - 1]) | (before[:-1] < 0) | (before[1:] < 1)
    # A place also starts anew if the place before is not next to the same neighbour.
    start[1:] |= before[1:] != before[:-1] + 1
    own = np.flatnonzero(start & (before >= 0))
    padded = np.concatenate([t, np.zeros(4, t.dtype)]).astype(np.uint64)
    word = padded[:-3] | (padded[1:-2] << np.uint64(16)) | (padded[2:-1] << np.uint64(32)) | (padded[3:] << np.uint64(48))
    found = np.zeros(n, np.int64)
    alive, k = own, 0
    while len(alive):
        x, y = alive + k, before[alive] + k
        ok = (x < n) & (y < n)
        alive, x, y = alive[ok], x[ok], y[ok]
        differ = word[x] ^ word[y]
        equal = differ == 0
        part = differ[~equal]
        found[alive[~equal]] = k + ((part & np.uint64(0xFFFF)) == 0) * (1 + ((part & np.uint64(0xFFFF0000)) == 0) * (1 + ((part & np.uint64(0xFFFF00000000)) == 0)))
        alive, k = alive[equal], k + 4
    first = np.maximum.accumulate(np.where(start, place, 0))
    return np.maximum(found[first] - (place - first), 0)
