"""Suffix arrays with common-prefix values by induced sorting.

The suffixes at local minima (LMS) are sorted first: their substrings are put
in order by one induction, equal substrings get equal names, and the string of names,
a third as long, is sorted in turn. A second induction carries the order of the
LMS suffixes over to all others, and the common-prefix values with it.

Both inductions pop suffixes from queues in rank order and push their
predecessors. There is one queue a character, as the key of a pushed suffix is its
first character and ties keep their order. Whatever a queue holds is popped
as one wave, so an induction takes a few array operations a character instead of one
step a suffix. Common prefixes are cut at ``cap``.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor (S); the last one is."""
    n = len(t)
    rises = np.empty(n, bool)
    rises[-1] = True
    rises[:-1] = t[:-1] < t[1:]
    decided = np.ones(n, bool)
    decided[:-1] = t[:-1] != t[1:]
    at = np.where(decided, np.arange(n), n - 1)
    return rises[np.minimum.accumulate(at[::-1])[::-1]]


def _runs(t: np.ndarray) -> np.ndarray:
    """How often each character repeats from its place on."""
    n = len(t)
    ends = np.where(np.r_[t[1:] != t[:-1], True], np.arange(n), n - 1)
    return (np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n) + 1).astype(np.int32)


class _Least:
    """Least of any range of an array, by a table of powers of two."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        width = 1
        while width * 2 <= longest:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least of first..last, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            table = self.levels[k]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << int(k)) + 1])
        return out


class _Queues:
    """One queue a character for suffixes of one type, with the common prefix of neighbours."""

    def __init__(self, t: np.ndarray, wanted: np.ndarray, characters: int, cap: int | None):
        self.t, self.wanted, self.cap = t, wanted, cap
        counts = np.bincount(t[wanted], minlength=characters)
        self.begin = np.r_[0, np.cumsum(counts)]
        self.end = self.begin[:-1].copy()
        self.place = np.empty(self.begin[-1], np.int32)
        self.common = np.zeros(self.begin[-1], np.int32) if cap is not None else None
        self.pending = np.zeros(characters, np.int32)

    def open_bucket(self) -> None:
        """Suffixes popped from now on share no prefix with those before."""
        self.pending[:] = 0

    def push_before(self, popped: np.ndarray, common: np.ndarray | None) -> None:
        """Push the predecessors, of the wanted type, of suffixes popped in order; common: with the one popped before each."""
        at = np.flatnonzero((popped > 0) & self.wanted[popped - 1])
        if self.cap is not None:
            running = np.minimum.accumulate(common)
        if not len(at):
            if self.cap is not None:
                np.minimum(self.pending, running[-1], out=self.pending)
            return
        before = popped[at] - 1
        key = self.t[before]
        order = np.argsort(key, kind="stable")
        key, before, at = key[order], before[order], at[order]
        opens = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(opens)
        size = np.diff(np.r_[first, len(key)])
        into = np.repeat(self.end[key[first]] - first, size) + np.arange(len(key))
        self.place[into] = before
        if self.cap is not None:
            shared = np.empty(len(key), np.int32)
            inner = np.flatnonzero(~opens)
            if len(inner):
                span = at[inner] - at[inner - 1]
                shared[inner] = _Least(common, int(span.max())).of(at[inner - 1] + 1, at[inner]) + 1
            heads = key[first]
            fresh = self.end[heads] == self.begin[heads]
            shared[first] = np.where(fresh, 0, np.minimum(self.pending[heads], running[at[first]]) + 1)
            self.common[into] = np.minimum(shared, self.cap)
            np.minimum(self.pending, running[-1], out=self.pending)
            tail = np.minimum.accumulate(common[::-1])[::-1]
            last = at[first + size - 1] + 1
            self.pending[heads] = np.where(last < len(tail), tail[np.minimum(last, len(tail) - 1)], self.cap)
        self.end[key[first]] += size


def _induce(t: np.ndarray, is_s: np.ndarray, runs: np.ndarray, lms: np.ndarray, lms_common: np.ndarray | None, characters: int, cap: int | None) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in order (and their common prefixes), from the LMS suffixes in order."""
    large = _Queues(t, ~is_s, characters, cap)
    small = _Queues(t, is_s, characters, cap)
    bounds = np.searchsorted(t[lms], np.arange(characters + 1))
    meet = lambda a, b: np.int32(min(runs[a], runs[b], cap))  # noqa: E731  where larger suffixes of a bucket end and smaller ones begin

    for c in range(characters):
        large.open_bucket()
        done = large.begin[c]
        while done < large.end[c]:
            wave = slice(done, large.end[c])
            done = large.end[c]
            large.push_before(large.place[wave], large.common[wave] if cap is not None else None)
        star = lms[bounds[c] : bounds[c + 1]]
        if len(star):
            common = None
            if cap is not None:
                common = lms_common[bounds[c] : bounds[c + 1]].copy()
                common[0] = meet(large.place[done - 1], star[0]) if done > large.begin[c] else 0
            large.push_before(star, common)

    # From the largest down; a queue holds its bucket in falling order.
    small.place[small.begin[0]] = len(t) - 1
    small.end[0] += 1
    for c in range(characters - 1, -1, -1):
        small.open_bucket()
        done = small.begin[c]
        while done < small.end[c]:
            wave = slice(done, small.end[c])
            done = small.end[c]
            small.push_before(small.place[wave], small.common[wave] if cap is not None else None)
        own = slice(large.begin[c], large.end[c])
        falling = large.place[own][::-1]
        if len(falling):
            common = None
            if cap is not None:
                common = np.r_[0, large.common[own][:0:-1]].astype(np.int32)
                common[0] = meet(falling[0], small.place[done - 1]) if done > small.begin[c] else 0
            small.push_before(falling, common)

    order = np.empty(len(t), np.int32)
    shared = np.zeros(len(t), np.int32) if cap is not None else None
    at = 0
    for c in range(characters):
        l, s = slice(large.begin[c], large.end[c]), slice(small.begin[c], small.end[c])
        n_l, n_s = l.stop - l.start, s.stop - s.start
        order[at : at + n_l] = large.place[l]
        order[at + n_l : at + n_l + n_s] = small.place[s][::-1]
        if cap is not None:
            shared[at : at + n_l] = large.common[l]
            if n_s:
                # a queue's value is with the larger neighbour; in rising order it belongs to that one
                shared[at + n_l + 1 : at + n_l + n_s] = small.common[s][:0:-1]
                shared[at + n_l] = meet(order[at + n_l - 1], order[at + n_l]) if n_l else 0
        at += n_l + n_s
    return order, shared


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros behind the end."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    return np.ndarray(len(text) + 1, "<u8", padded, strides=(1,)).copy()


def _common_prefix(eights: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to most; bytes are compared eight at a time."""
    out = np.zeros(len(a), np.int64)
    going, k = np.flatnonzero(most > 0), 0
    while len(going):
        x = eights[a[going] + k] ^ eights[b[going] + k]
        differ = x != 0
        low = x[differ]
        out[going[differ]] = k + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        going, k = going[~differ], k + 8
        out[going] = k
        going = going[most[going] > k]
    return np.minimum(out, most)


def _names(lms: np.ndarray, ordered: np.ndarray, eights: np.ndarray) -> np.ndarray:
    """Rank of each LMS substring, by place: equal substrings get equal names."""
    n = len(eights) - 1
    number = np.full(n + 1, -1, np.int64)
    number[lms] = np.arange(len(lms))
    which = number[ordered]
    size = (np.r_[lms[1:] + 1, n + 1] - lms)[which]
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    most = np.minimum(np.minimum(n - a, n - b), size[1:])  # the end of the string is equal to nothing
    same = (size[1:] == size[:-1]) & (_common_prefix(eights, a, b, most) == size[1:])
    names = np.empty(len(lms), np.int64)
    names[which] = np.r_[0, np.cumsum(~same)]
    return names


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffixes of the string of names in order; only ties are sorted again, to twice the depth."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.full(n + 1, -1, np.int64)
    tied, key, depth = np.arange(n), names[order], 1
    while len(tied):
        opens = np.r_[True, key[1:] != key[:-1]]
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(opens, np.arange(len(tied)), 0))]
        single = opens & np.r_[opens[1:], True]
        tied = tied[~single]
        places = order[tied]
        key = rank[places] * (n + 1) + rank[np.minimum(places + depth, n)] + 1
        by = np.argsort(key, kind="stable")
        order[tied], key = places[by], key[by]
        depth *= 2
    return order


def suffix_array(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the suffixes of a byte string in order, common prefix of each with the one before, up to cap).

    The end of the string counts as smaller than any byte.
    """
    if not len(text):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    used = np.zeros(256, bool)
    used[text] = True
    t = np.r_[np.cumsum(used)[text], 0].astype(np.int16)  # the bytes in use as 1, 2, ...; 0 is the end
    characters = int(t.max()) + 1
    is_s, runs = _types(t), _runs(t)
    starts = is_s.copy()
    starts[0] = False
    starts[1:] &= ~is_s[:-1]
    lms = np.flatnonzero(starts).astype(np.int32)
    eights = _eights(text)
    if len(lms) > 1:
        rough = lms[np.argsort(t[lms], kind="stable")]
        order, _ = _induce(t, is_s, runs, rough, None, characters, None)
        names = _names(lms, order[starts[order]], eights)
        ordered = lms[_doubling(names)] if names.max() + 1 < len(names) else lms[np.argsort(names)]
    else:
        ordered = lms
    first, second = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    most = np.minimum(len(text) - np.maximum(first, second), cap)
    common = np.r_[0, _common_prefix(eights, first, second, most)].astype(np.int32)
    order, shared = _induce(t, is_s, runs, ordered, common, characters, cap)
    order, shared = order[1:], shared[1:]  # without the end
    shared[0] = 0
    return order, np.minimum(shared, cap)
