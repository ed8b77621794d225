"""Deals the windows of W symbols that may recur to groups, for texts of any number and length.

Symbols are bytes or words.  What becomes of a group is for the operator to say
(``subtrees``, ``factors``); dealing goes like this:

1. Each window is filed under its smallest K-gram hash (its minimizer), so equal
   windows meet in one group.  Adjacent windows of one group form a run, and only
   runs (one for about (W - K) / 2 symbols) are counted.
2. Runs of groups that occur once are dropped.  The text of the others, a segment
   for each run, goes to its group; the operator puts the segments' suffixes in
   order, symbol by symbol.
3. A group with more than ``hot`` runs is filed under the whole window instead: its
   prefix is lengthened to the full depth, and a bucket of documents sends one
   window of each content.  Such windows are compared by 128 bits of hashes, first
   those of a part of the buckets, then what is left of all.
4. The answer goes back to the texts, which are dealt by document once.

No step holds more than one bucket of a bounded number of bytes, or ``hot`` runs, and
no step makes pairs.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, scratch
from .rolling import Texts, mix, powers, prefix, ranges, slabs

#: Bytes of text that one bucket of documents, and one of groups, holds, about; that a task goes through, bucket by
#: bucket; and that are counted together on the map side.
BUCKET, GROUP, TASK, LOCAL = 4_000_000, 2_000_000, 32_000_000, 16_000_000
#: Runs that one group may hold.  Groups beyond it are named to the executors, 8 bytes each, so there is at most one
#: name for every HOT runs of the corpus.
HOT_RUNS = 100_000
_ENTRY, _PART = "part int, db int, kind int, blob binary", pa.schema([("part", pa.int32()), ("db", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
COUNTED, KNOWN, HOT, RUNS, WINDOWS, SPANS = range(6)
_RUN_TYPES = ["<i8", "<i8", "<u4", "<u4", "<u2", "<u8"]  # key, th, document, start, windows - 1, minimizer
_SEGMENT_TYPES = ["<i8", "<i8", "<u4", "<u4", "<u2", "u1"]  # the same without the minimizer, and the text
_WINDOW_TYPES = ["<i8", "<i8", "<u4", "<u4", "<u8", "<u8", "u1"]  # key, th, document, start, two hashes, known to recur
_SPAN_TYPES = ["<i8", "<i8", "<u4", "<u4", "<u4"]  # key, th, document, first symbol, end
_ODD = np.uint64(0xD6E8FEB86659FD93)
#: Parts of the buckets of documents whose hot windows meet first, and how far apart they are put.
FAN, STRIDE = 64, 101


def pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack(f"<{len(arrays)}I", *(a.nbytes for a in arrays))
    return head + b"".join(a.tobytes() for a in arrays)


def unpack(blobs: list, dtypes: list, doc: int | None = None) -> list[np.ndarray]:
    """The arrays of all blobs joined; the one at ``doc`` counts on over the blobs' document tables (the first array)."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in dtypes]
    seen = 0
    for b in blobs:
        b = memoryview(b)
        at = 4 * len(dtypes)
        for i, (size, t) in enumerate(zip(struct.unpack_from(f"<{len(dtypes)}I", b), dtypes, strict=True)):
            a = np.frombuffer(b, t, size // np.dtype(t).itemsize, at)
            parts[i].append(a + np.uint32(seen) if i == doc else a)
            at += size
        seen += len(parts[0][-1])
    return [np.concatenate(p) for p in parts]


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _PART, strict=True)], schema=_PART)


def split(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``by`` with the places that have it."""
    order = np.argsort(by, kind="stable")
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(by[part[0]]), part


def docs_of(d: np.ndarray, key: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents that d names: their keys and hashes, and d as places among them."""
    u, inv = np.unique(d, return_inverse=True)
    return key[u], th[u], inv.astype(np.uint32)


def bucket_of(v: np.ndarray, n: int) -> np.ndarray:
    # minimizers are small numbers; mixed once more they are even over the buckets
    return ((mix(v) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _keys(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return (t.column(c).to_numpy(zero_copy_only=False) for c in ("key", "th"))


def home(key: np.ndarray, th: np.ndarray, n_docs: int) -> np.ndarray:
    """The bucket of a document (key and text): rows that share a doc_id only are spread."""
    return (key ^ th) % n_docs


def seeds(unit: str, w: int, k: int, n_parts: int, n_docs: int) -> Callable:
    """Map side of the count: one entry for each minimizer and batch; the others of a batch are known to recur.

    n_parts: parts in which minimizers are counted, coarser than the groups of segments, so that an entry names a document for several runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, th = _keys(b)
            found, held = [], 0
            for i, t in slabs(*buffers(b.column("text")), unit):
                d, *rest = t.runs(w, k)
                found.append((i + d, *rest))
                held += len(t.data)
                if held >= LOCAL:
                    yield counted(found, key, th)
                    found, held = [], 0
            if found:
                yield counted(found, key, th)

    def counted(found: list, key: np.ndarray, th: np.ndarray) -> pa.RecordBatch:
        d, s, n, v, own = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(v, kind="stable")
        d, s, n, v, own = d[order], s[order].astype(np.uint32), (n[order] - 1).astype(np.uint16), v[order], own[order]
        new = np.append(True, v[1:] != v[:-1]) if len(v) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        count = np.add.reduceat(1 + own, first).astype(np.uint32) if len(v) else np.zeros(0, np.uint32)
        rows = []
        for p, at in split(bucket_of(v[first], n_parts)):
            f = first[at]
            rows.append((p, -1, COUNTED, pack(*docs_of(d[f], key, th), s[f], n[f], v[f], count[at])))
        rest = np.flatnonzero(~new)
        for db, at in split(home(key[d[rest]], th[d[rest]], n_docs)):
            f = rest[at]
            rows.append((db % n_parts, db, KNOWN, pack(*docs_of(d[f], key, th), s[f], n[f], v[f])))
        return batch(rows)

    return run


def recurring(n_docs: int, hot: int) -> Callable:
    """Reduce side: the runs whose minimizer occurs twice or more, by bucket of documents, and the hot minimizers."""

    def run(t: pa.Table) -> pa.Table:
        mine, rows = [], []
        for kind, db, blob in zip(t.column("kind").to_pylist(), t.column("db").to_pylist(), t.column("blob").combine_chunks(), strict=True):
            if kind == COUNTED:
                mine.append(blob.as_buffer())
            else:
                rows.append((0, db, KNOWN, blob.as_py()))
        key, th, d, s, n, v, count = unpack(mine, [*_RUN_TYPES, "<u4"], doc=2)
        del mine
        order = np.argsort(v)
        cut = np.flatnonzero(np.append(True, np.diff(v[order]) != 0)) if len(v) else np.zeros(0, np.int64)
        total = np.add.reduceat(count[order].astype(np.int64), cut) if len(v) else np.zeros(0, np.int64)
        keep = order[np.repeat(total >= 2, np.diff(np.append(cut, len(v))))]
        rows += [(0, db, KNOWN, pack(*docs_of(d[at], key, th), s[at], n[at], v[at])) for db, p in split(home(key[d[keep]], th[d[keep]], n_docs)) for at in [keep[p]]]
        if (total > hot).any():
            rows.append((0, -1, HOT, v[order][cut[total > hot]].tobytes()))
        return pa.Table.from_batches([batch(rows)])

    return run


def place(key: np.ndarray, th: np.ndarray, of_key: np.ndarray, of_th: np.ndarray) -> np.ndarray:
    """For each (of_key, of_th) the first place in (key, th) that has it."""
    rank = ranked(np.append(key, of_key), np.append(th, of_th))
    own, of = rank[: len(key)], rank[len(key) :]
    order = np.argsort(own, kind="stable")
    return order[np.searchsorted(own[order], of)]


def ranked(key: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Documents' ranks by key, then hash; equal documents have one rank."""
    order = np.lexsort((th, key))
    k, h = key[order], th[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.append(0, (np.diff(k) != 0) | (np.diff(h) != 0)))[: len(key)]
    return out


def classes(*hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal tuples stand together, and where each such class begins."""
    order = np.lexsort(hashes)
    new = np.zeros(len(order), bool)
    for h in hashes:
        new[1:] |= h[order][1:] != h[order][:-1]
    new[:1] = True
    return order, np.flatnonzero(new)


def settled(a: np.ndarray, b: np.ndarray, pos: np.ndarray, known: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """Windows told apart by two hashes: which come first of their class, and which also start earlier (later=True) or anywhere else (or are known to)."""
    if not len(a):
        return np.zeros(0, bool), np.zeros(0, bool)
    order, cut = classes(a, b)
    size = np.diff(np.append(cut, len(a)))
    p = pos[order]
    low = np.repeat(np.minimum.reduceat(p, cut), size)
    lead, again = np.empty(len(a), bool), np.empty(len(a), bool)
    lead[order] = p == low
    if later:
        again[order] = p > low
    else:
        more = (np.maximum.reduceat(p, cut) > np.minimum.reduceat(p, cut)) | np.logical_or.reduceat(known[order], cut)
        again[order] = np.repeat(more, size)
    return lead, again


def spans(flags: np.ndarray, starts: np.ndarray, lengths: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, first and end symbol of each stretch of flagged windows; flags go run after run."""
    head = np.cumsum(lengths) - lengths
    before = np.append(False, flags[:-1])
    before[head] = False
    after = np.append(flags[1:], False)
    after[head[1:] - 1] = False
    a, b = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
    run = np.searchsorted(head, a, side="right") - 1
    at = starts[run] - head[run]
    return run, at + a, at + b + w


def exposed(unit: str, w: int, n_parts: int, hot: np.ndarray, later: bool) -> Callable:
    """Takes a bucket of documents and its recurring runs; gives the runs with what is needed to compare them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list = []
        if len(left) and len(right):
            db = right.column("db")[0].as_py()
            own_key, own_th = _keys(left)
            key, th, d, s, n, v = unpack([x.as_buffer() for x in right.column("blob").combine_chunks()], _RUN_TYPES, doc=2)
            d = place(own_key, own_th, key, th)[d]
            order = np.lexsort((s, d))
            # rows that repeat a document have told of its runs as often
            order = order[np.append(True, (np.diff(d[order]) != 0) | (s[order][1:] != s[order][:-1]))]
            d, s, n, v = d[order], s[order].astype(np.int64), n[order].astype(np.int64) + 1, v[order]
            is_hot, pieces = np.isin(v, hot), {}
            for i, t in slabs(*buffers(left.column("text").combine_chunks()), unit):
                lo, hi = np.searchsorted(d, [i, i + len(t.off) - 1])
                for heat in (False, True):
                    at = lo + np.flatnonzero(is_hot[lo:hi] == heat)
                    first = t.off[d[at] - i] + s[at]
                    if heat and len(at):
                        _windows(rows, t, first, d[at], s[at], n[at], own_key, own_th, db)
                    elif len(at):
                        for p, x in split(bucket_of(v[at], n_parts)):
                            pieces.setdefault(p, []).append((at[x], t.cut(first[x], n[at[x]] + w - 1)))
            for p, parts in pieces.items():  # one entry for a bucket of documents and a group
                x = np.concatenate([a for a, _ in parts])
                what = np.concatenate([b for _, b in parts])
                rows.append((p, -1, RUNS, pack(*docs_of(d[x], own_key, own_th), s[x].astype(np.uint32), (n[x] - 1).astype(np.uint16), what)))
        return pa.Table.from_batches([batch(rows)])

    def _windows(rows, t, first, d, s, n, key, th, db):
        # one window of each content leaves the bucket; the others are settled here
        at = ranges(first, n)
        x = t.symbols(0, t.n)
        a, b = (mix((g[at + w] - g[at]) * powers(len(g))[1][at]) for g in (prefix(x), prefix(mix(x ^ _ODD))))
        d, s = np.repeat(d, n), ranges(s, n)
        rank = np.empty(len(key), np.int64)
        rank[np.lexsort((th, key))] = np.arange(len(key))
        lead, more = settled(a, b, rank[d] << 32 | s, np.zeros(len(a), bool), later)
        done = np.flatnonzero(more & ~lead)
        if len(done):
            k, h, i = docs_of(d[done], key, th)
            rows.append((db % n_parts, db, SPANS, pack(k, h, i, s[done].astype(np.uint32), (s[done] + w).astype(np.uint32))))
        rows += _leads(np.flatnonzero(lead), d, s, a, b, more, key, th, n_parts, db % FAN * STRIDE)

    return run


def _leads(x: np.ndarray, d, s, a, b, more, key, th, n_parts: int, shift: int) -> list:
    """Entries of the windows x, by their content's group; shift: that many groups further on."""
    rows = []
    for p, y in split((bucket_of(a[x], n_parts) + shift) % n_parts):
        f = x[y]
        rows.append((p, -1, WINDOWS, pack(*docs_of(d[f], key, th), s[f].astype(np.uint32), a[f], b[f], more[f].astype(np.uint8))))
    return rows


def compared(w: int, n_docs: int, n_parts: int, later: bool, repeated: Callable, last: bool) -> Callable:
    """Takes all runs of some groups; gives the spans to remove, by bucket of documents.

    Windows of hot groups come from FAN parts of the buckets; unless this is the last
    step, the first one of each content goes on to where all of it meets.
    """

    def run(t: pa.Table) -> pa.Table:
        mine: dict[int, list] = {RUNS: [], WINDOWS: []}
        rows: list = []
        for kind, db, blob in zip(t.column("kind").to_pylist(), t.column("db").to_pylist(), t.column("blob").combine_chunks(), strict=True):
            if kind == SPANS:
                rows.append((db % n_parts, db, SPANS, blob.as_py()))
            else:
                mine[kind].append(blob.as_buffer())
        for kind, blobs in mine.items():
            if not blobs:
                continue
            if kind == RUNS:
                key, th, d, s, n, what = unpack(blobs, _SEGMENT_TYPES, doc=2)
                s, n = s.astype(np.int64), n.astype(np.int64) + 1
                flags = repeated(n, what, ranked(key, th)[d] << 32 | s)
                del what
            else:
                key, th, d, s, a, b, known = unpack(blobs, _WINDOW_TYPES, doc=2)
                s, n = s.astype(np.int64), np.ones(len(s), np.int64)
                lead, flags = settled(a, b, ranked(key, th)[d] << 32 | s, known != 0, later)
                if not last:
                    rows += _leads(np.flatnonzero(lead), d, s, a, b, flags, key, th, n_parts, 0)
                    flags &= ~lead
            blobs.clear()
            i, a, b = spans(flags, s, n, w)
            i = d[i]
            rows += [(db % n_parts, db, SPANS, pack(*docs_of(i[at], key, th), a[at].astype(np.uint32), b[at].astype(np.uint32))) for db, at in split(home(key[i], th[i], n_docs))]
        return pa.Table.from_batches([batch(rows)])

    return run


def covered(off: np.ndarray, d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which symbols stand in a span."""
    n = int(off[-1])
    up = np.bincount(off[d] + a, minlength=n + 1) - np.bincount(off[d] + b, minlength=n + 1)
    return np.cumsum(up[:n]) > 0 if n else np.zeros(0, bool)


def primes_from(n: int) -> int:
    while any(n % p == 0 for p in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def without(docs: DataFrame, unit: str, w: int, k: int, later: bool, repeated: Callable, finish: Callable, schema: str, hot: int = HOT_RUNS, bucket: int = BUCKET) -> DataFrame:
    """Applies finish(Texts, covered symbols) -> columns to the texts; adds doc_id.

    docs: doc_id long, text string.  repeated(windows of each run, the segments'
    bytes, position of each run's first window) tells which windows of all runs are
    to go.  Null texts are empty.  Rows that repeat a document (same doc_id, same
    text) are the same document, not a match of it, and each gets the result; rows
    that share only the doc_id are documents of their own, in the order of a hash of
    their text.  A null doc_id comes first.
    """
    first = F.lit(-(2**63)).cast("long")
    d = docs.select(F.col("doc_id").cast("long").alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("own", F.coalesce("own", first).alias("key"), F.xxhash64("text").alias("th"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_docs = primes_from(max(2, -(-size // bucket)))
    n_parts = max(1, -(-size * BUCKET // (GROUP * bucket)))
    n_tasks = max(1, -(-size // TASK))
    entries = d.filter(F.octet_length("text") >= w).select("key", "th", "text").mapInArrow(seeds(unit, w, k, n_tasks, n_docs), _ENTRY)
    entries = entries.repartition(n_tasks, "part").groupBy("part").applyInArrow(recurring(n_docs, hot), _ENTRY)
    entries = scratch(entries, "repeats")
    heat = [np.frombuffer(r[0], "<u8") for r in entries.filter(F.col("kind") == HOT).select("blob").collect()]
    heat = np.sort(np.concatenate(heat)) if heat else np.zeros(0, np.uint64)
    d = d.withColumn("db", F.pmod(F.col("key").bitwiseXOR(F.col("th")), F.lit(n_docs)).cast("int")).repartition(n_tasks, "db")
    runs = entries.filter(F.col("kind") == KNOWN)
    shown = d.groupBy("db").cogroup(runs.groupBy("db")).applyInArrow(exposed(unit, w, n_parts, heat, later), _ENTRY)
    cut = shown.repartition(n_tasks, "part").groupBy("part").applyInArrow(compared(w, n_docs, n_parts, later, repeated, not len(heat)), _ENTRY)
    if len(heat):
        cut = cut.repartition(n_tasks, "part").groupBy("part").applyInArrow(compared(w, n_docs, n_parts, later, repeated, True), _ENTRY)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        own_key, own_th = _keys(left)
        key, th, doc, a, b = unpack([x.as_buffer() for x in right.column("blob").combine_chunks()] if len(right) else [], _SPAN_TYPES, doc=2)
        doc = place(own_key, own_th, key, th)[doc] if len(doc) else doc.astype(np.int64)
        order = np.argsort(doc, kind="stable")
        doc, a, b = doc[order], a[order].astype(np.int64), b[order].astype(np.int64)
        # rows that repeat a document get what its first row gets
        lead = place(own_key, own_th, own_key, own_th) if len(own_key) else np.zeros(0, np.int64)
        out = []
        for i, t in slabs(*buffers(left.column("text").combine_chunks()), unit):
            here = np.arange(i, i + len(t.off) - 1)
            lo, hi = np.searchsorted(doc, lead[here]), np.searchsorted(doc, lead[here], side="right")
            x = ranges(lo, hi - lo)
            out.append(finish(t, covered(t.off, np.repeat(here - i, hi - lo), a[x], b[x])))
        cols = {c: np.concatenate([o[c] for o in out]) for c in (out[0] if out else {})}
        return pa.table({"doc_id": left.column("own"), **{c: pa.array(x) for c, x in cols.items()}}) if out else pa.table({"doc_id": left.column("own")})

    return d.groupBy("db").cogroup(cut.filter(F.col("db") >= 0).groupBy("db")).applyInArrow(last, f"doc_id long, {schema}")
