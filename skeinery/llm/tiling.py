"""Benchmark decontamination by greedy string tiling.

A test item and a document are compared only if they share a seed of k tokens.  The
longest matches that don't overlap are marked, longest first, found by Karp-Rabin
hashes of every length tried; what the tiles cover of the item is its coverage, so a
passage whose parts were put in another order is caught as well.

The benchmark is the small side.  It is cut into blocks of a bounded number of tokens.
The driver broadcasts each block and forgets it.  A pass over the documents takes HELD
blocks at most, which a task keeps; a larger benchmark takes more passes, each from
the table that the one before has left.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, scratch, words
from .rolling import BYTE, STEP, mix, powers, prefix, ranges

SLAB = 4_000_000
#: Tokens in a block of the benchmark that is sent to the executors, at most (8 bytes each and as much again for seeds).
BLOCK_TOKENS = 2_000_000
#: Blocks that a task holds, at most.
HELD = 4

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of a word that count: letters, digits and all of UTF-8 beyond ASCII.
_INK = np.zeros(256, bool)
_INK[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = True
_INK[128:] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased, ASCII punctuation is white space) and offsets by text."""
    data = _FOLD[data]
    data = np.where(_INK[data], data, np.uint8(32))
    starts, ends, at = words(data, off)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP)))
        g = prefix(BYTE[data[starts[i] : ends[j - 1]]])
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        out[i:j] = mix((g[e] - g[s]) * powers(len(g))[1][s] + (e - s).astype(np.uint64))
        i = j
    return out, at


def rolled(x: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every k tokens in a row."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    g = prefix(x)
    return mix((g[k:] - g[:-k]) * powers(len(g))[1][: len(x) - k + 1])


def _free_runs(marked: np.ndarray, k: int) -> np.ndarray:
    """Starts of k unmarked tokens in a row."""
    up = np.append(0, np.cumsum(marked))
    return np.flatnonzero(up[k:] == up[:-k]) if len(marked) >= k else np.zeros(0, np.int64)


def _common(item: np.ndarray, doc: np.ndarray, mi: np.ndarray, md: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, d = _free_runs(mi, k), _free_runs(md, k)
    return i, d, rolled(item, k)[i], rolled(doc, k)[d]


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length), longest first, of ``least`` tokens or more.

    Of equally long matches the first in the item, then in the document, is marked.
    """
    mi, md = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    top = min(len(item), len(doc))
    while top >= least:
        # the greatest length with a match: if k tokens match, k - 1 do
        lo, hi = least - 1, top
        while lo < hi:
            mid = (lo + hi + 1) // 2
            _, _, hi_, hd = _common(item, doc, mi, md, mid)
            if len(hi_) and len(hd) and np.isin(hi_, hd).any():
                lo = mid
            else:
                hi = mid - 1
        if lo < least:
            break
        i, d, hi_, hd = _common(item, doc, mi, md, lo)
        order = np.argsort(hd, kind="stable")
        left = np.searchsorted(hd[order], hi_)
        right = np.searchsorted(hd[order], hi_, side="right")
        for a, x, y in zip(i[left < right], left[left < right], right[left < right], strict=True):
            if mi[a : a + lo].any():
                continue
            for b in d[order[x:y]]:
                if not md[b : b + lo].any() and (item[a : a + lo] == doc[b : b + lo]).all():
                    mi[a : a + lo] = md[b : b + lo] = True
                    tiles.append((int(a), int(b), lo))
                    break
        top = lo if lo < top else lo - 1
        if not tiles or tiles[-1][2] != lo:
            top = lo - 1
    return tiles


class Index:
    """Seeds of a block of test items, sorted."""

    def __init__(self, ids: list[int], texts: pa.Array, k: int):
        self.ids, self.k = ids, k
        self.tokens, self.off = tokens(*buffers(texts))
        seeds, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n in sorted({min(k, x) for x in np.diff(self.off).tolist() if x}):
            h = rolled(self.tokens, n)
            at = np.arange(len(h))
            item = np.searchsorted(self.off, at, side="right") - 1
            size = np.diff(self.off)[item]
            ok = (at + n <= self.off[item + 1]) & (np.minimum(size, k) == n)
            seeds.append(h[ok] ^ np.uint64(n))
            owner.append(item[ok])
        seeds, owner = np.concatenate(seeds), np.concatenate(owner)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]
        self.lengths = sorted({min(k, x) for x in np.diff(self.off).tolist() if x})

    def state(self) -> dict:
        return dict(self.__dict__)

    @classmethod
    def of(cls, state: dict) -> Index:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def shared(self, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text, item) that share a seed."""
        pairs = [np.zeros(0, np.int64)]
        for n in self.lengths:
            h = rolled(x, n) ^ np.uint64(n)
            left = np.searchsorted(self.seeds, h)
            at = np.flatnonzero(self.seeds[np.minimum(left, len(self.seeds) - 1)] == h)
            text = np.searchsorted(off, at, side="right") - 1
            ok = at + n <= off[text + 1]
            at, text = at[ok], text[ok]
            found = np.unique(np.stack([text.astype(np.uint64), h[at]]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
            text, h = found[0].astype(np.int64), found[1]
            left, right = np.searchsorted(self.seeds, h), np.searchsorted(self.seeds, h, side="right")
            item = self.owner[ranges(left, right - left)]
            pairs.append(np.unique(np.repeat(text, right - left) * (len(self.ids) + 1) + item))
        both = np.unique(np.concatenate(pairs))
        return both // (len(self.ids) + 1), both % (len(self.ids) + 1)


class Blocks:
    """Some blocks of the benchmark, HELD at most, sent to the tasks of one pass over the documents."""

    def __init__(self, sent: list):
        self.sent = sent

    def each(self) -> Iterator[Index]:
        for x in self.sent:
            yield Index.of(x.value)


def passes(benchmark: DataFrame, text: str, key: str, k: int, most: int) -> Iterator[tuple[Blocks, bool]]:
    """The benchmark, as many blocks at a time as a task holds, and whether these are the last: a pass over the documents for each."""
    sc = benchmark.sparkSession.sparkContext
    sent: list = []
    for ids, texts in _blocks(benchmark, text, key, most):
        if len(sent) == HELD:
            yield Blocks(sent), False
            sent = []
        sent.append(sc.broadcast(Index(ids, texts, k).state()))
    yield Blocks(sent), True


def best_tiles(blocks: Blocks, threshold: float, data: np.ndarray, off: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Item covered most, its coverage and tiles, and items covered to the threshold, of each text."""
    n = len(off) - 1
    best, item, tiles, hits = np.zeros(n), [None] * n, np.zeros(n, np.int32), np.zeros(n, np.int32)
    for index in blocks.each():
        i = 0
        while i < n and len(index.seeds):
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLAB, side="right")) - 1)
            x, at = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for t, k in zip(*index.shared(x, at), strict=True):
                own = index.tokens[index.off[k] : index.off[k + 1]]
                found = tile(own, x[at[t] : at[t + 1]], min(index.k, len(own)))
                share = sum(f[2] for f in found) / len(own)
                hits[i + t] += share >= threshold
                # of equal coverage the smaller item is named
                if share > best[i + t] or (share == best[i + t] and share and index.ids[k] < item[i + t]):
                    best[i + t], item[i + t], tiles[i + t] = share, index.ids[k], len(found)
            i = j
    return item, best, tiles, hits


_FOUND = "item_id long, coverage double, n_tiles int, n_items int"


def _search(blocks: Blocks, threshold: float, last: bool) -> Callable:
    """Documents with what the passes so far have found in them; after the last one without their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, best, tiles, hits = best_tiles(blocks, threshold, *buffers(b.column("text")))
            before = b.column("coverage").to_numpy()
            named = b.column("item_id").to_pylist()
            for r in np.flatnonzero(before >= best):
                # of equal coverage the smaller item is named
                if before[r] > best[r] or (item[r] is None and named[r] is not None) or (named[r] is not None and named[r] < item[r]):
                    item[r], best[r], tiles[r] = named[r], before[r], b.column("n_tiles")[int(r)].as_py()
            hits = hits + b.column("n_items").to_numpy()
            cols = {"doc_id": b.column("doc_id"), "item_id": pa.array(item, pa.int64()), "coverage": pa.array(best), "n_tiles": pa.array(tiles), "n_items": pa.array(hits.astype(np.int32))}
            yield pa.RecordBatch.from_pydict(cols if last else cols | {"text": b.column("text")})

    return run


def _hits(blocks: Blocks, threshold: float) -> Callable:
    @F.arrow_udf("int")
    def hits(t: pa.Array) -> pa.Array:
        return pa.array(best_tiles(blocks, threshold, *buffers(t))[3])

    return hits


def _blocks(benchmark: DataFrame, text: str, key: str, most: int) -> Iterator[tuple[list[int], pa.Array]]:
    """The items in blocks of ``most`` words (or one item); one block at a time is on the driver."""
    rows = benchmark.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["id", "text"])
    ids, texts, size = [], [], 0
    for r in rows.filter("id is not null").toLocalIterator():
        n = len(r.text) // 2 + 1
        if ids and size + n > most:
            yield ids, pa.array(texts, pa.string())
            ids, texts, size = [], [], 0
        ids.append(r.id)
        texts.append(r.text)
        size += n
    yield ids, pa.array(texts, pa.string())


def coverage(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.5, text: str = "text", key: str = "doc_id", item: str = "item_id", most: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, n_items and contaminated of every row of docs.

    item_id: the test item that the document covers most (equal: the smaller id;
    null: none shares a seed), coverage: that share of its tokens, n_items: items
    covered to ``threshold`` or more, contaminated: there is one.  Items of fewer
    than k tokens must occur whole; items without tokens match nothing.  Null and
    empty texts cover nothing, repeated rows are judged each, whatever the number of
    blocks; other columns are left out, empty tables on either side give no hit.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.selectExpr("doc_id", "CAST(null AS BIGINT) AS item_id", "CAST(0 AS DOUBLE) AS coverage", "0 AS n_tiles", "0 AS n_items", "text")
    for blocks, last in passes(benchmark, text, item, k, most):
        found = found.mapInArrow(_search(blocks, threshold, last), f"doc_id long, {_FOUND}" + ("" if last else ", text string"))
        found = found if last else scratch(found, "tiling-pass")
    return found.withColumn("contaminated", F.col("n_items") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.5, text: str = "text", item: str = "item_id", most: int = BLOCK_TOKENS) -> DataFrame:
    """docs' rows that cover no test item to ``threshold``, as they are; no shuffle.  Odd cases are as in ``coverage``."""
    for blocks, last in passes(benchmark, text, item, k, most):
        docs = docs.filter(_hits(blocks, threshold)(F.coalesce(F.col(text), F.lit(""))) == 0)
        docs = docs if last else scratch(docs, "tiling-pass")
    return docs
