"""A run-compressed Burrows-Wheeler index of a set of strings.

Only what the runs need is kept: their first rows and characters, the number
of equal characters before each, and the text positions of both ends of each
run. All strings are then streamed backwards in step through the LF mapping;
each step yields the row of a suffix and the length it matches with the suffix
one row up (its matching statistic against the rest of the set): inside a run
that length grows by one with every step, at a run's first row it is read off
the text at the two sampled positions.
"""

from __future__ import annotations

import numpy as np

#: characters in the first sort key: nine bits each, 0 past the end of a string
FIRST = 7


def suffix_order(codes: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorted suffixes of strings that each end with a code 0; suffixes that are equal
    up to their end go by string. ``codes``: bytes + 1; ``owner``: string of
    each position; ``ends``: position of each string's 0."""
    n, strings = len(codes), len(ends)
    left = ends[owner] - np.arange(n)  # characters before the 0
    padded = np.concatenate((codes.astype(np.int64), np.zeros(FIRST, np.int64)))
    key = np.zeros(n, np.int64)
    for i in range(FIRST):
        key = (key << 9) | np.where(left > i, padded[i:i + n], 0)
    order = np.argsort(key, kind="stable")
    step, rank = FIRST, np.empty(n, np.int64)
    sorted_key = key[order]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # a tied group is named by its first row
    rank[order] = group
    while True:
        alone = head & np.append(head[1:], True)
        todo = np.flatnonzero(~alone)  # rows whose place isn't settled
        if not len(todo):
            return order
        at = order[todo]
        beyond = left[at] <= step
        after = np.where(beyond, owner[at], strings + rank[np.minimum(at + step, n - 1)])
        name = rank[at]
        again = np.lexsort((after, name))
        at, after, name = at[again], after[again], name[again]
        order[todo] = at
        new = np.concatenate(([True], (after[1:] != after[:-1]) | (name[1:] != name[:-1])))
        head[todo] = new
        rank[at] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        step *= 2


class RunIndex:
    """Run-compressed transform of ``strings`` with sampled run ends."""

    def __init__(self, strings: list[bytes], cap: int):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.cap, self.sizes = cap, sizes
        text = np.frombuffer(b"\0".join(strings) + b"\0" * (cap + 17), np.uint8)
        n = int(sizes.sum()) + len(sizes)
        self.text = text
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        codes = text[:n].astype(np.int16) + 1
        codes[self.ends] = 0
        order = suffix_order(codes, owner, self.ends)
        bwt = np.where(order == self.starts[owner[order]], 0, codes[order - 1])
        head = np.concatenate(([True], bwt[1:] != bwt[:-1]))
        self.first = np.flatnonzero(head)  # first row of each run
        self.code = bwt[self.first]
        size = np.diff(np.append(self.first, n))
        self.top = order[self.first]  # text positions at the run ends
        self.bottom = order[self.first + size - 1]
        self.rows, self.owner = n, owner
        # equal characters before each run, and the run of the same character before it
        by_code = np.argsort(self.code, kind="stable")
        total = np.cumsum(size[by_code]) - size[by_code]
        same = np.concatenate(([False], self.code[by_code][1:] == self.code[by_code][:-1]))
        begin = total[np.maximum.accumulate(np.where(same, 0, np.arange(len(by_code))))]
        less = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=257))))
        self.base = np.empty(len(size), np.int64)
        self.base[by_code] = less[self.code[by_code]] + total - begin  # row that LF gives a run's first row
        before = np.full(len(size), -1)
        before[by_code[same]] = by_code[np.flatnonzero(same) - 1]
        self.jump = self._matches(before)  # what a run's first row matches with the end of the run before of its code

    def _matches(self, before: np.ndarray) -> np.ndarray:
        out = np.full(len(before), -1)
        live = np.flatnonzero(before >= 0)
        p, q = self.top[live], self.bottom[before[live]]
        most = np.minimum(self.cap, np.minimum(self.ends[self.owner[p]] - p, self.ends[self.owner[q]] - q))
        words = np.ndarray((len(self.text) - 7,), "<u8", self.text.data, strides=(1,))
        out[live] = most
        for k in range(0, self.cap, 8):
            x = words[p + k] ^ words[q + k]
            differ = x != 0
            at = x[differ]
            low = at & (~at + np.uint64(1))
            out[live[differ]] = np.minimum(most[differ], k + (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64))
            keep = ~differ & (most > k + 8)
            live, p, q, most = live[keep], p[keep], q[keep], most[keep]
            if not len(live):
                break
        return out

    def stream(self):
        """Steps of all strings backwards in step: (string, offset of the
        suffix, row, matched length with the row above, capped)."""
        live = np.arange(len(self.sizes))
        row, match = live.copy(), np.zeros(len(live), np.int64)  # the empty suffixes are the first rows
        offset = self.sizes.copy()
        while True:
            some = offset > 0
            live, row, match, offset = live[some], row[some], match[some], offset[some]
            if not len(live):
                return
            run = np.searchsorted(self.first, row, "right") - 1
            inside = row - self.first[run]
            match = np.minimum(self.cap, np.where(inside > 0, match, self.jump[run]) + 1)
            row, offset = self.base[run] + inside, offset - 1
            yield live, offset, row, match


def earlier_windows(strings: list[bytes], places: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, the offsets of its windows of ``window`` bytes that
    also start at a smaller place; ``places``: place of each string's first byte."""
    index = RunIndex(strings, window)
    none = np.iinfo(np.int64).max
    match, place = np.zeros(index.rows, np.int64), np.full(index.rows, none)
    steps = []
    for string, offset, row, length in index.stream():
        match[row] = length
        full = index.sizes[string] - offset >= window
        place[row[full]] = places[string[full]] + offset[full]
        if full.any():
            steps.append((string[full], offset[full], row[full]))
    if not steps:
        return [np.zeros(0, np.int64)] * len(strings)
    string, offset, row = (np.concatenate(x) for x in zip(*steps))
    head = np.flatnonzero(match < window)  # rows that begin a class of equal windows
    least = np.minimum.reduceat(place, head)
    later = place[row] > least[np.searchsorted(head, row, "right") - 1]
    string, offset = string[later], offset[later]
    order = np.lexsort((offset, string))
    cut = np.searchsorted(string[order], np.arange(len(strings) + 1))
    return [offset[order[a:b]] for a, b in zip(cut, cut[1:])]
