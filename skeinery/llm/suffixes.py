"""Suffix order, common prefixes and nearest smaller values of many short segments at once.

A segment is a stretch of symbols; suffixes end with their segment, and an ended
suffix comes before a longer one.  Order is found by prefix doubling down to a depth
that the caller names; suffixes that agree so far are tied.  Symbols themselves are
compared, never hashes of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Positions that fit a sort key thrice; more of them are sorted more slowly.
BITS = 21


def dense(a: np.ndarray, b: np.ndarray | None = None, width: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pairs (a, b) and their dense ranks, from 1.  a holds ``width`` bits at most if b is left out."""
    n = len(a)
    if n < 1 << BITS and (b is not None or width + BITS <= 64):
        key = a << np.uint64(BITS) if b is None else (a << np.uint64(BITS) | b) << np.uint64(BITS)
        key |= np.arange(n, dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << BITS) - 1)).view(np.int64)
        key >>= np.uint64(BITS)
    else:
        key = a if b is None else a << np.uint64(32) | b
        order = np.argsort(key, kind="stable")
        key = key[order]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(new, dtype=np.uint64)
    return order, rank


class Order:
    """Suffixes of segments; ``left``: symbols from each position to the end of its segment."""

    def __init__(self, symbols: np.ndarray, left: np.ndarray, depth: int):
        """symbols: small numbers from 0 (bytes, or places in a dictionary)."""
        n = len(symbols)
        self.symbols, self.left, h = symbols, left, 1
        if symbols.dtype == np.uint8:
            key = np.zeros(n, np.uint64)
            for i in range(4):  # nine bits a byte, 0 for none
                key <<= np.uint64(9)
                key[: n - i] |= (symbols[i:].astype(np.uint64) + np.uint64(1)) * (left[: n - i] > i)
            h, rank = 4, dense(key, width=36)[1]
        else:
            rank = symbols.astype(np.uint64) + np.uint64(1)
        self.levels = [(h, rank)]
        while h * 2 < depth:
            rank = dense(rank, self.after(rank, h))[1]
            h *= 2
            self.levels.append((h, rank))

    def after(self, rank: np.ndarray, h: int) -> np.ndarray:
        """Ranks h symbols further on; 0 past the end."""
        out = np.zeros_like(rank)
        if h < len(rank):
            np.multiply(rank[h:], self.left[: len(rank) - h] > h, out=out[: len(rank) - h])
        return out

    def sort(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """at: places of suffixes.  Those that share the last level's depth with another, in order to twice that depth.

        Returns places in ``at`` and the common prefix of each suffix with the one before, 0 if under that depth.
        """
        h, rank = self.levels[-1]
        mine = rank[at]
        some = np.flatnonzero(np.bincount(mine.view(np.int64))[mine.view(np.int64)] > 1)
        at = at[some]
        further = np.minimum(at + h, len(rank) - 1)
        order, tie = dense(mine[some], rank[further] * (self.left[at] > h))
        return some[order], self.common(at[order], tie[order])

    def common(self, at: np.ndarray, tie: np.ndarray) -> np.ndarray:
        h, rank = self.levels[-1]
        out = np.zeros(len(at), np.int64)
        most = np.minimum(self.left[at[1:]], self.left[at[:-1]])
        same = tie[1:] == tie[:-1]
        out[1:][same] = np.minimum(2 * h, most[same])
        x = np.flatnonzero((rank[at[1:]] == rank[at[:-1]]) & ~same)
        a, b, most, got = at[x], at[x + 1], most[x], np.full(len(x), h)
        end = len(rank) - 1
        for h, rank in reversed(self.levels[:-1]):
            # positions past an end agree with nothing that counts, as ``most`` cuts there
            got += h * ((got < most) & (rank[np.minimum(a + got, end)] == rank[np.minimum(b + got, end)]))
        for _ in range(self.levels[0][0] - 1):
            # one symbol at a time, as long as every symbol before it agreed
            got += (got < most) & (self.symbols[np.minimum(a + got, end)] == self.symbols[np.minimum(b + got, end)])
        out[1:][x] = np.minimum(got, most)
        return out


def distinct(data: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment (bytes up to ``ends``) the one of least ``first`` that is equal to it, and how many are."""
    off = pa.py_buffer(np.append(0, ends).astype(np.int64).tobytes())
    text = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, off, pa.py_buffer(data)])
    code = text.dictionary_encode().indices.to_numpy()
    order = np.lexsort((first, code))
    heads = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(code) else np.zeros(0, np.int64)
    return order[heads][code], np.bincount(code)[code]


def smaller_before(value: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before it with a smaller value, -1: none, and the least ``common`` on the way.

    Pointers jump over places whose value isn't smaller, all at once; the way is
    given up where ``common`` falls under ``least``.
    """
    to, low = np.arange(len(value)) - 1, common.copy()
    x = np.arange(len(value))
    while True:
        x = x[(to[x] >= 0) & (low[x] >= least)]
        x = x[value[to[x]] >= value[x]]
        if not len(x):
            break
        t = to[x]
        low[x], to[x] = np.minimum(low[x], low[t]), to[t]
    lost = (to < 0) | (low < least)
    return np.where(lost, -1, to), np.where(lost, 0, low)


def previous_factors(position: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Longest match of each suffix (in suffix order) with one at a smaller position; 0 under ``least``.

    It is with the nearest smaller position before it or after it.
    """
    _, before = smaller_before(position, common, least)
    back = np.append(common[1:], 0)[::-1]
    _, after = smaller_before(position[::-1], back, least)
    return np.maximum(before, after[::-1])


def nodes(common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, first and last leaf of the suffix tree's internal nodes of depth ``least`` or more.

    A node is a stretch of suffix order whose common prefix is its depth: it reaches
    from each ``common`` value back and on to the nearest smaller ones.
    """
    at = np.flatnonzero(common >= least)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    wide = np.full(len(common), len(common))
    before, _ = smaller_before(common, wide, 0)
    after, _ = smaller_before(common[::-1], wide, 0)
    after = len(common) - 1 - after[::-1]  # one past the last leaf
    # common[i] stands between leaves i - 1 and i
    found = np.unique(np.stack([np.maximum(before[at], 0), np.minimum(after[at], len(common)) - 1, common[at]]), axis=1)
    return found[2], found[0], found[1]
