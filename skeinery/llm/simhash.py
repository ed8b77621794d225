"""SimHash near-duplicates, searched with vantage-point trees.

Fingerprints are partitioned by Hamming distance to vantage points.  The upper part
of the tree, grown on a bounded sample, deals all fingerprints to shards: each
fingerprint has one home leaf, and a copy goes to every later leaf that triangle
bounds can't rule out (the boundary overlaps its ball).  In a shard the tree goes on
over all that arrived, with the same pruning, down to blocks that are compared bit by
bit.  A shard hands on a spanning forest of the links it found, no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, fresh, scratch, text_key, words
from .components import components
from .rolling import Texts, grams, mix, powers, prefix, ranges

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts of so many bytes, about, are held at a time.
SLAB = 1 << 20


def shingle_hashes(data: np.ndarray, off: np.ndarray, n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every n-word shingle (fewer words: the whole sequence) and n_texts + 1 offsets."""
    data = LOWER[data]
    starts, ends, at = words(data, off)
    size = ends - starts + 1
    line = np.append(data, np.uint8(32))
    to = np.cumsum(size)
    idx = np.repeat(starts - (to - size), size) + np.arange(to[-1] if len(to) else 0)
    line = line[idx]
    line[to - 1] = 32  # words joined by one space
    line = line.tobytes()
    count = np.diff(at)
    shingles = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_off = np.append(0, np.cumsum(shingles))
    first = np.repeat(at[:-1] - out_off[:-1], shingles) + np.arange(out_off[-1])
    last = np.minimum(first + n, np.repeat(at[1:], shingles)) - 1
    h = xxhash.xxh64_intdigest
    a, b = (to[first] - size[first]).tolist(), (to[last] - 1).tolist()
    return np.fromiter((h(line[i:j], seed) for i, j in zip(a, b, strict=True)), np.uint64, len(a)), out_off


#: Spreads the bits of a byte over eight counters of eight bits.
_COUNTERS = np.array([sum((v >> i & 1) << 8 * i for i in range(8)) for v in range(256)], np.uint64)


def fingerprints(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A bit is 1 if set in over half of a text's hashes; no hashes: zero."""
    n = np.diff(off)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # counters hold up to 255 hashes, so a text is summed in chunks of as many
    chunks = -(-n[some] // 255)
    first = np.append(0, np.cumsum(chunks))
    start = np.repeat(off[some], chunks) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], chunks))
    lanes = hashes[: off[-1], None].view(np.uint8)
    total = np.empty((len(some), 64), np.int64)
    for j in range(8):
        part = np.add.reduceat(_COUNTERS[lanes[:, j]], start)
        total[:, 8 * j : 8 * j + 8] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), first[:-1], axis=0)
    bit = total * 2 > n[some, None]
    out[some] = np.packbits(bit, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint_batches(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("text"))
            out, i = [np.zeros(0, np.uint64)], 0
            while i < len(off) - 1:
                j = max(i + 1, int(np.searchsorted(off, off[i] + SLAB, side="right")) - 1)
                out.append(fingerprints(*shingle_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], n)))
                i = j
            fp = np.concatenate(out).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return run


def fingerprint(docs: DataFrame, n: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and fp (64 bits as a long) of every row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprint_batches(n), "doc_id long, fp long")


# -- trees -------------------------------------------------------------------


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(x: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """Of some random points the one whose distances cut the set in the most even halves, and the cut."""
    best = None
    for p in x[rng.integers(0, len(x), 6)]:
        d = distance(x, p)
        mid = int(np.median(d))
        for cut in (mid, mid - 1):
            inner = np.count_nonzero(d <= cut)
            # points near the boundary are looked at on both sides
            cost = max(inner, len(x) - inner) + np.count_nonzero((d > cut - 3) & (d <= cut + 3)) / 2
            if 0 < inner < len(x) and (best is None or cost < best[0]):
                best = cost, p, cut
    return best and best[1:]


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple | int:
    """A tree (point, cut, inside, outside) down to ``depth``; leaves are numbers."""
    leaves = 0

    def build(x: np.ndarray, depth: int):
        nonlocal leaves
        found = vantage(x, rng) if depth and len(x) > 1 else None
        if found is None:
            leaves += 1
            return leaves - 1
        d = distance(x, found[0])
        return (*found, build(x[d <= found[1]], depth - 1), build(x[d > found[1]], depth - 1))

    return build(x, depth)


def deal(tree, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x, leaves, and is it the home leaf, for all leaves that the ball around a point may reach."""
    out = []

    def walk(node, at: np.ndarray, home: np.ndarray):
        if not len(at):
            return
        if isinstance(node, int):
            out.append((at, np.full(len(at), node, np.int32), home))
            return
        point, cut, inside, outside = node
        d = distance(x[at], point).astype(np.int16)
        i, o = d <= cut + radius, d > cut - radius
        walk(inside, at[i], home[i] & (d[i] <= cut))
        walk(outside, at[o], home[o] & (d[o] > cut))

    walk(tree, np.arange(len(x)), np.ones(len(x), bool))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))


def find(members: np.ndarray, queries: np.ndarray, radius: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (member, query) places at ``radius`` or less, by a tree over the members; in pieces."""
    rng = np.random.default_rng(11)
    todo = [(np.arange(len(members)), np.arange(len(queries)))]
    while todo:
        m, q = todo.pop()
        if not len(m) or not len(q):
            continue
        found = vantage(members[m], rng) if len(m) > block and len(q) > 8 else None
        if found is None:
            step = max(1, (1 << 21) // len(m))
            for i in range(0, len(q), step):
                x, y = np.nonzero(distance(members[m][:, None], queries[q[i : i + step]][None, :]) <= radius)
                yield m[x], q[i : i + step][y]
            continue
        point, cut = found
        d, e = distance(members[m], point).astype(np.int16), distance(queries[q], point).astype(np.int16)
        todo.append((m[d <= cut], q[e <= cut + radius]))
        todo.append((m[d > cut], q[e > cut - radius]))


class Forest:
    """Union-find; ``join`` keeps only links that connect something new."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        r = up[x]
        while (up[r] != r).any():
            r = up[r]
        up[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which links connected something new; of those offered together earlier ones win."""
        kept, at = np.zeros(len(a), bool), np.arange(len(a))
        while len(at):
            ra, rb = self.roots(a[at]), self.roots(b[at])
            ok = ra != rb
            at, ra, rb = at[ok], ra[ok], rb[ok]
            # each greater root is hung below one lesser root; links that lost are tried again
            high, first = np.unique(np.maximum(ra, rb), return_index=True)
            self.up[high] = np.minimum(ra, rb)[first]
            kept[at[first]] = True
        return kept


def _shard_links(radius: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy().view(np.uint64)
        home = t.column("home").to_numpy(zero_copy_only=False)
        order = np.argsort(~home, kind="stable")  # those at home first: they are the members
        fp, n = fp[order], int(home.sum())
        forest = Forest(len(fp))
        for m, q in find(fp[:n], fp, radius):
            forest.join(m, q)
        root = forest.roots(np.arange(len(fp)))
        some = np.flatnonzero(root != np.arange(len(fp)))
        x = fp.view(np.int64)
        return pa.table({"a": x[some], "b": x[root[some]]})

    return run


#: Fingerprints at home in a shard, about; each level of the upper tree copies half of them once more, so it is kept low.
#: And sampled fingerprints for each leaf, 8 bytes each.
SHARD, SAMPLE = 120_000, 256


def links(fps: DataFrame, radius: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """a, b: a spanning set of the links between the distinct fingerprints ``fp`` at ``radius`` or less.

    The upper tree is grown on ``sample`` fingerprints for each of its leaves (those of
    least hash; only the balance of shards depends on it), and every fingerprint is
    dealt by it.
    """
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard))))
    some = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample << depth).collect()
    x = np.array([r[0] for r in some], np.int64).view(np.uint64)
    tree = grow(x, depth, np.random.default_rng(5)) if len(x) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            at, leaf, home = deal(tree, fp, radius)
            own = np.zeros(len(fp), np.int32)
            own[at[home]] = leaf[home]
            ok = leaf >= own[at]  # of two leaves the later one sees both
            yield pa.RecordBatch.from_arrays([pa.array(leaf[ok]), pa.array(fp[at[ok]].view(np.int64)), pa.array(home[ok])], names=["leaf", "fp", "home"])

    dealt = fps.mapInArrow(run, "leaf int, fp long, home boolean")
    return dealt.groupBy("leaf").applyInArrow(_shard_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, radius: int = 3, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Fingerprints over n-word shingles link at ``radius`` or fewer differing bits;
    component_id is the smallest doc_id that links reach (null doc_ids apart).  A null
    or empty text has fingerprint zero, linked like any other; repeated rows are each
    returned; other columns are left out; an empty table gives an empty result.
    Copies share a fingerprint, so groups of copies of any size are one entry.
    """
    rows = scratch(fingerprint(docs, n, text, key), "simhash")
    fps = scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(fps.select("fp"), radius, **how))
    member = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = scratch(member, "simhash-member")
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = member.join(ids, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(by_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


# -- similar texts -----------------------------------------------------------

#: Min-hash views that deal texts to shards, and shingles that a view takes.  Texts of similarity 0.8 miss each other in
#: all views one time in 190, of 0.85 one in 1,600.
VIEWS, ROWS = 10, 4
#: Bits in which fingerprints of texts of similarity 0.8 differ: 9.7 on average, 2.9 standard deviation; three of these are allowed for.
RADIUS = 18
#: Texts of a shard that are compared with one another; larger shards are split anew in each view.
CHUNK = 2_048
#: Spanning forests that a shard proposes: a text that is nearest to one that it doesn't resemble has another way.
FORESTS = 2
_ODDS = np.random.default_rng(77).integers(0, 2**63, VIEWS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-word shingles as hashes, ascending, and their offsets; fewer words: one shingle of all."""
    t = Texts(LOWER[data], off, "word")
    x, count = t.symbols(0, t.n), np.diff(t.off)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), size)
    h = np.empty(len(text), np.uint64)
    long = count[text] >= n
    h[long] = grams(x, n)[ranges(t.off[:-1][count >= n], size[count >= n])] if long.any() else 0
    g = prefix(x)
    few = np.flatnonzero((count > 0) & (count < n))
    h[~long] = mix((g[t.off[few + 1]] - g[t.off[few]]) * powers(len(g))[1][t.off[few]] + count[few].astype(np.uint64))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.append(0, np.cumsum(np.bincount(text[new], minlength=len(count))))


def _slabs(b: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """From, to, shingles and their offsets, for a batch in pieces."""
    data, off = buffers(b.column("text"))
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLAB, side="right")) - 1)
        yield i, j, *word_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], n)
        i = j


def views(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, VIEWS): a hash of the ROWS shingles that come first in as many orders; texts without shingles have one in common."""
    out = np.zeros((len(at) - 1, VIEWS), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for j, odd in enumerate(_ODDS):
            out[some, j // ROWS] = mix(out[some, j // ROWS] + np.minimum.reduceat(h * odd, at[some]))
    return mix(out + np.arange(1, VIEWS + 1, dtype=np.uint64))


def _view_batches(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, fp, view = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros((0, VIEWS), np.uint64)]
            for _, _, h, at in _slabs(b, n):
                size.append(np.diff(at))
                fp.append(fingerprints(h, at))
                view.append(views(h, at))
            flat = pa.array(np.concatenate(view).view(np.int64).ravel())
            view = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, VIEWS, dtype=np.int32)), flat)
            cols = [b.column("doc_id"), b.column("g"), pa.array(np.concatenate(size)), pa.array(np.concatenate(fp).view(np.int64)), view]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "g", "size", "fp", "views"])

    return run


def spanning(fp: np.ndarray, size: np.ndarray, radius: int, similarity: float, forests: int = FORESTS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests without common links, nearest first, of the links between fingerprints within the radius, of sizes that allow the similarity."""
    grown, out = [Forest(len(fp)) for _ in range(forests)], [np.zeros((2, 0), np.int64)]
    seen = -1
    for r in [*range(2, radius, 4), radius]:
        for x, y in find(fp, fp, r):
            d = distance(fp[x], fp[y])
            ok = (x < y) & (d > seen) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9)
            order = np.argsort(d[ok], kind="stable")
            x, y = x[ok][order], y[ok][order]
            for forest in grown:
                kept = forest.join(x, y)
                out.append(np.stack([x[kept], y[kept]]))
                x, y = x[~kept], y[~kept]
        seen = r
        if not any(f.roots(np.arange(len(fp))).any() for f in grown):
            break  # all hang on the first
    return tuple(np.concatenate(out, axis=1))


def _proposed(radius: int, similarity: float) -> Callable:
    """Pairs to compare: of each shard some spanning forests."""

    def run(t: pa.Table) -> pa.Table:
        key, salt, ids, fp, size = (t.column(c).to_numpy() for c in ("key", "salt", "id", "fp", "size"))
        o = np.lexsort((ids, salt, key))
        key, salt, ids, fp, size = key[o], salt[o], ids[o], fp[o].view(np.uint64), size[o]
        cut = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(salt) != 0)))
        many = np.diff(np.append(cut, len(key)))
        # two texts are a pair; more are searched by a tree
        x = cut[many == 2]
        y = x + 1
        ok = (distance(fp[x], fp[y]) <= radius) & (np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9)
        a, b = [ids[x[ok]]], [ids[y[ok]]]
        for i, m in zip(cut[many > 2], many[many > 2], strict=True):
            x, y = spanning(fp[i : i + m], size[i : i + m], radius, similarity)
            a.append(ids[i + x])
            b.append(ids[i + y])
        p = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pa.table({"a": p[0].copy(), "b": p[1].copy()})

    return run


def _set_batches(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, at in _slabs(b, n):
                x = (h >> np.uint64(32)).astype(np.uint32)  # ascending still
                yield pa.RecordBatch.from_arrays([b.column("id")[i:j], pa.array([x[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())], names=["id", "hashes"])

    return run


def jaccard(a: pa.Array, b: pa.Array, most: int = 1 << 20) -> np.ndarray:
    """Similarities of pairs of sets, given as ascending 32-bit numbers; of two empty ones: 1."""
    out = []
    (x, xo), (y, yo) = ((d.view(np.uint32), o // 4) for d, o in (map(np.ascontiguousarray, buffers(c)) for c in (a, b)))
    i, n, size = 0, len(xo) - 1, xo + yo
    while i < n:
        j = max(i + 1, int(np.searchsorted(size, size[i] + most, side="right")) - 1)
        keys = []
        for v, o in ((x, xo), (y, yo)):
            own = np.repeat(np.arange(j - i, dtype=np.uint64), np.diff(o[i : j + 1]))
            keys.append(np.unique(own << np.uint64(32) | v[o[i] : o[j]]))
        p, q = keys
        both = p[np.isin(p, q, assume_unique=True)]
        one, two, both = (np.bincount((k >> np.uint64(32)).astype(np.int64), minlength=j - i) for k in (p, q, both))
        either = one + two - both
        out.append(np.where(either > 0, both / np.maximum(either, 1), 1.0))
        i = j
    return np.concatenate(out) if out else np.zeros(0)


def _confirmed(similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = jaccard(b.column("ha"), b.column("hb")) >= similarity - 1e-9
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return run


def similar_links(rows: DataFrame, nodes: DataFrame, n: int, similarity: float, radius: int = RADIUS, chunk: int = CHUNK, shard: int = 50_000) -> DataFrame:
    """rows: doc_id, id, text; nodes: id, least (a doc_id), size, fp, views.  a, b: links between ids.

    At this radius triangle bounds rule out no branch of one tree over all
    fingerprints, so texts are dealt to shards by min-hash views first.  A shard is
    searched by vantage-point trees and proposes FORESTS spanning forests, nearest
    first; each proposed pair is then compared shingle by shingle.
    """
    each = nodes.select("id", "size", "fp", F.explode("views").alias("key"))
    times = each.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    salt = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("times") / F.lit(chunk)))
    dealt = scratch(each.join(times, "key").select("key", salt.cast("long").alias("salt"), "id", "fp", "size"), "similar-dealt")
    shards = -(-dealt.count() // shard) or 1
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", "salt"), F.lit(shards)).cast("int"))
    pairs = scratch(dealt.groupBy("shard").applyInArrow(_proposed(radius, similarity), "a long, b long").distinct(), "similar-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "least"), "id")
    texts = rows.join(asked.select("id", F.col("least").alias("doc_id")), ["id", "doc_id"]).dropDuplicates(["id"])
    sets = scratch(texts.select("id", "text").mapInArrow(_set_batches(n), "id long, hashes binary"), "similar-sets")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb").mapInArrow(_confirmed(similarity), "a long, b long")


def similar_texts(docs: DataFrame, n: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id", complete: Callable | None = None, **how) -> DataFrame:
    """doc_id, g (key of the text), lead_id and lead_g (of the component's first document) of every row.

    Texts link if their sets of n-word shingles have this Jaccard similarity or more;
    no pair below it is linked (up to equal 32-bit hashes of shingles).  Pairs to
    compare are searched by fingerprints (see ``similar_links``), so a few at the very
    border can be missed; ``complete`` (texts by id, components found, n, the
    similarity as numerator and denominator) returns the links between components
    that are still missing, as ``ngramjoin.missing_links`` does.  Equal texts are one node;
    texts without words are like one another; texts of fewer than n words are
    compared as a whole.  A null doc_id comes last; repeated rows are each returned;
    an empty table gives an empty result.
    """
    last = F.lit(2**63 - 1).cast("long")
    docs = docs.select(F.coalesce(F.col(key).cast("long"), last).alias("doc_id"), text_key(F.col(text)).alias("g"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = scratch(docs.mapInArrow(_view_batches(n), "doc_id long, g binary, size long, fp long, views array<long>"), "similar")
    nodes = rows.groupBy("g").agg(F.min(F.struct("doc_id", "size", "fp", "views")).alias("m"))
    nodes = scratch(nodes.select("g", F.xxhash64("g").alias("id"), F.col("m.doc_id").alias("least"), "m.size", "m.fp", "m.views"), "similar-texts")
    texts = docs.select("doc_id", F.xxhash64("g").alias("id"), "text")
    roots = components(similar_links(texts, nodes, n, similarity, **how))
    if complete:
        least = Fraction(similarity).limit_denominator(1000)
        more = scratch(complete(texts.select("id", "text"), roots, n, least.numerator, least.denominator), "similar-missing")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    roots = roots.withColumnRenamed("node", "id")
    member = scratch(nodes.select("g", "id", "least").join(roots, "id", "left").select("g", "least", F.coalesce("root", "id").alias("root")), "similar-member")
    lead = member.groupBy("root").agg(F.min(F.struct("least", "g")).alias("m"))
    member = member.join(lead, "root").select("g", F.col("m.least").alias("lead_id"), F.col("m.g").alias("lead_g"))
    return rows.join(member, "g").select(F.nullif("doc_id", last).alias("doc_id"), "g", F.nullif("lead_id", last).alias("lead_id"), "lead_g")


def keep_first(docs: DataFrame, n: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """docs' rows, one of each component of similar texts: that of its smallest doc_id (see ``similar_texts``)."""
    lead = similar_texts(docs, n, similarity, text=text, key=key, **how).select("lead_g", "lead_id").distinct()
    g, i = fresh(docs, "g_", "lead_")
    lead = lead.select(F.col("lead_g").alias(g), F.col("lead_id").alias(i))
    # the join and the choice among repeated rows go by g, so texts are dealt once
    rows = docs.withColumn(g, text_key(F.col(text))).join(lead, g).filter(F.col(key).cast("long").eqNullSafe(F.col(i)))
    return rows.dropDuplicates([g]).drop(g, i)
