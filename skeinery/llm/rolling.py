"""Karp-Rabin hashes of symbols in a row, over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import words

_RNG = np.random.default_rng(20_240_117)
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64, endpoint=False) | np.uint64(1)
_M = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Windows handled at a time; also the longest run.
STEP = 1 << 16
#: Bytes of text that are held expanded at a time.
SLAB = 1 << 20

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M^0 .. M^(n-1) and their inverses modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP + 4096)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(m))])) for m in (_M, pow(_M, -1, 2**64))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    return h ^ (h >> np.uint64(31))


def prefix(x: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of x[i] * M^i."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(len(x))[0][: len(x)], out=out[1:])
    return out


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k symbols in a row."""
    g = prefix(x)
    return mix((g[k:] - g[:-k]) * powers(len(x))[1][: len(x) - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, n = 1, len(x) - w + 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. + lengths[0], starts[1] .. in one array."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Texts:
    """Some texts as a row of symbols; ``off``: where each text begins."""

    def __init__(self, data: np.ndarray, off: np.ndarray, unit: str):
        self.data, self.unit = data, unit
        if unit == "byte":
            self.off = off
        else:
            self.starts, self.ends, self.off = words(data, off)
        self.n = int(self.off[-1])

    def symbols(self, lo: int, hi: int) -> np.ndarray:
        if self.unit == "byte":
            return BYTE[self.data[lo:hi]]
        out = np.empty(hi - lo, np.uint64)
        at = lo
        while at < hi:  # some words at a time; their bytes are summed from the first on
            to = max(at + 1, min(hi, int(np.searchsorted(self.ends, self.starts[at] + STEP))))
            first = self.starts[at]
            g = prefix(BYTE[self.data[first : self.ends[to - 1]]])
            s, e = self.starts[at:to] - first, self.ends[at:to] - first
            out[at - lo : to - lo] = mix((g[e] - g[s]) * powers(len(g))[1][s] + (e - s).astype(np.uint64))
            at = to
        return out

    def cut(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The bytes of the stretches of ``lengths`` symbols from ``starts``; every word is followed by one space."""
        if self.unit == "byte":
            return self.data[ranges(starts, lengths)]
        at = ranges(starts, lengths)
        size = self.ends[at] - self.starts[at] + 1
        out = np.append(self.data, np.uint8(32))[ranges(self.starts[at], size)]
        out[np.cumsum(size) - 1] = 32
        return out

    def runs(self, w: int, k: int) -> tuple[np.ndarray, ...]:
        """Text, start in it, number of windows, minimizer, and may two windows be equal, for every run of windows.

        If two windows of a run are equal, the first place of the minimizer in the
        first of them starts a window of the run other than its last.
        """
        found = []
        for lo in range(0, self.n - w + 1, STEP):
            hi = min(lo + STEP, self.n - w + 1)
            g = grams(self.symbols(lo, hi + w - 1), k)
            m = sliding_min(g, w - k + 1)
            new = np.ones(hi - lo, bool)
            np.not_equal(m[1:], m[:-1], out=new[1:])
            heads = self.off[np.searchsorted(self.off, lo) : np.searchsorted(self.off, hi)]
            new[heads - lo] = True
            s = np.flatnonzero(new)
            own = np.zeros(len(s), bool)
            own[np.searchsorted(s, np.flatnonzero((g[: hi - lo - 1] == m[:-1]) & ~new[1:]), side="right") - 1] = True
            found.append((s + lo, np.append(s[1:], hi - lo) - s, m[s], own))
        if not found:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
        s, n, v, own = map(np.concatenate, zip(*found, strict=True))
        d = np.searchsorted(self.off, s, side="right") - 1
        n = np.minimum(n, self.off[d + 1] - w + 1 - s)  # a window ends within its text
        ok = n > 0
        return d[ok], (s - self.off[d])[ok], n[ok], v[ok], own[ok]


def slabs(data: np.ndarray, off: np.ndarray, unit: str) -> Iterator[tuple[int, Texts]]:
    """Consecutive texts of SLAB bytes, about; the number of the first text of each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLAB, side="right")) - 1)
        yield i, Texts(data[off[i] : off[j]], off[i : j + 1] - off[i], unit)
        i = j
