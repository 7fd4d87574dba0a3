"""A run-compressed Burrows-Wheeler transform of many short strings, for match lengths.

Inside a run of the transform a position's longest match is one shorter than that of the
position before it, so lengths are kept for the ends of runs only, and the others follow
by streaming over the text. Copies lengthen runs, not their number: repetitive text has
few samples.
"""

from __future__ import annotations

import numpy as np

# Symbols that a sort key holds at first; every later round doubles that.
_FIRST = 7
_BITS = 9


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of every key among the distinct keys, and how many those are."""
    order = np.argsort(keys)
    ordered = keys[order]
    steps = np.empty(len(keys), np.int32)
    steps[0] = 0
    np.cumsum(ordered[1:] != ordered[:-1], out=steps[1:])
    ranks = np.empty(len(keys), np.int32)
    ranks[order] = steps
    return ranks, int(steps[-1]) + 1


class RunIndex:
    """Index of ``texts``, byte arrays laid end to end with their ``lengths``.

    Every text ends in a separator of its own, so no match reaches beyond a text's end.
    ``runs`` is the number of runs; samples are the match lengths at their ends.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        self.n = n = int(lengths.sum()) + len(lengths)
        ends = np.cumsum(lengths + 1)
        # Bytes count from 1; 0 is a separator.
        self._symbols = np.zeros(n, np.uint16)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        self._symbols[inside] = data.astype(np.uint16) + np.uint16(1)
        # Symbols up to and including the text's separator.
        self._left = (np.repeat(ends, lengths + 1) - np.arange(n)).astype(np.int32)
        self._sort()
        self._sample()

    def _sort(self) -> None:
        """Suffix order by prefix doubling; what ends alike is ordered by place."""
        n, left = self.n, self._left
        padded = np.append(self._symbols, np.zeros(_FIRST, np.uint16)).astype(np.uint64)
        keys = np.zeros(n, np.uint64)
        for k in range(_FIRST):
            keys <<= np.uint64(_BITS)
            keys |= np.where(left > k, padded[k : k + n], np.uint64(0))
        ranks, distinct = _dense(keys)
        self._levels, length, longest = [(_FIRST, ranks)], _FIRST, int(left.max())
        while distinct < n and length < longest:
            beyond = np.zeros(n, np.uint64)
            beyond[: n - length] = ranks[length:]
            beyond[: n - length] += np.uint64(1)
            beyond[left <= length] = 0
            ranks, distinct = _dense(ranks.astype(np.uint64) << np.uint64(32) | beyond)
            length *= 2
            self._levels.append((length, ranks))
        self._order = np.argsort(ranks.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols, without separators, agree from ``a`` and from ``b`` on."""
        common = np.zeros(len(a), np.int64)
        for length, ranks in reversed(self._levels):
            at = a + common
            same = ranks[at] == ranks[b + common]
            common += np.where(same, np.minimum(length, self._left[at] - 1), 0)
        going = np.arange(len(a))
        for _ in range(_FIRST):
            x, y = self._symbols[a[going] + common[going]], self._symbols[b[going] + common[going]]
            going = going[(x == y) & (x > 0)]
            common[going] += 1
        return common

    def _sample(self) -> None:
        """Match lengths at both ends of every run, with the neighbour beyond the end."""
        order = self._order
        before = self._symbols[order - 1]
        # A text's start follows a separator, which is like no other.
        before[order == 0] = 0
        border = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
        self.runs = len(border) + 1
        lengths = self._common(order[border - 1], order[border])
        self._heads = np.append(order[0], order[border]), np.append(0, lengths)
        self._tails = np.append(order[border - 1], order[-1]), np.append(lengths, 0)
        del self._levels, self._order

    def match_lengths(self) -> np.ndarray:
        """For every position, separators included, its longest match that starts elsewhere."""
        places = np.arange(self.n)
        longest = np.zeros(self.n, np.int64)
        for at, lengths in (self._heads, self._tails):
            reach = np.zeros(self.n, np.int64)
            reach[at] = at + lengths
            last = np.zeros(self.n, np.int64)
            last[at] = at
            np.maximum.accumulate(last, out=last)
            np.maximum(longest, reach[last] - places, out=longest)
        return longest
