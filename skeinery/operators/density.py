"""Density clustering of whole tables, with a noise class, and its fallback.

Two points meet at the greatest of their distance and both core distances (that to
the ``neighbours``-th point, itself included).  What is connected at each distance is
all that the clusters depend on, and it is worked out in four steps, none of which
looks at a sample or brings points to the driver:

1. Points are dealt to cells around pivots, and cells are cut into blocks of bounded
   size.  Core distances come from pairs of blocks that triangle bounds can't rule out.
2. A point meets a near one of a smaller core distance at its own, so what has no such
   near one is a basin that others run into.  Near pairs and ways over the pivots tell at
   what distance two basins surely meet; pairs of blocks are looked at for shorter ways.
3. Rounds over the table of edges grow groups until they have ``least`` points: for each
   point, the distance at which it first was in such a group, and the group's seed.
4. What is left, seeds and the distances at which they meet, is the condensed hierarchy.
   There are n / least seeds at most; from sums by branch the clusters are chosen.

Products of matrices give bounds of distances; whatever such a bound doesn't rule out is
worked out by differences, so no distance that counts depends on how a product rounds.

Equal vectors are one point with a weight.  Where several groups meet at the same
distance they meet at once, so the result doesn't depend on the order of equal edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stored
from .mining import kmeans, want_count
from .vectors import matrix

#: Points of a block, about; two blocks are compared in a task.
BLOCK = 1_500
#: Blocks of either side that meet in one task: a block is sent once for so many, or for up to MOST_TOGETHER where there are enough tasks.
TOGETHER, MOST_TOGETHER = 8, 32
#: Pairs of points whose distances are worked out at once.
AT_ONCE = 1 << 15
#: Cells, at most; their centres travel to the tasks.
PIVOTS = 256
#: Edges of a tree of groups that one task grows in a round; the others wait for the next.
LIGHTEST = 20_000
#: Share of noise beyond which, and clusters under which, k-means takes over.
MOST_NOISE, LEAST_CLUSTERS = 0.40, 8

_EDGE = "u long, v long, d double"


def cluster_size(n: int) -> int:
    """The least size of a cluster among n points."""
    return max(5, min(80, n // 40))


# -- points, cells and blocks --------------------------------------------------


def _rows(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of rows to one point, by differences."""
    d = x - p
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class Cells:
    """Pivots, the blocks of each cell and what bounds distances between them.  All of it is of bounded size but a number for each block."""

    def __init__(self, nodes: DataFrame, block: int, most: int):
        n = nodes.count()
        rows = nodes.orderBy(F.xxhash64("id"), "id").select("v").limit(min(most, max(1, 2 * n // block))).collect()
        self.pivots = np.array([r[0] for r in rows], np.float64).reshape(len(rows), -1)
        self.block = block

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row and its distance."""
        d = np.stack([_rows(x, p) for p in self.pivots], axis=1)
        at = np.argmin(d, axis=1)
        return at, d[np.arange(len(x)), at]

    def dealt(self, nodes: DataFrame) -> DataFrame:
        """nodes with cell, far (distance from the pivot) and block."""

        @F.arrow_udf("struct<cell:int,far:double>")
        def place(v: pa.Array) -> pa.Array:
            at, far = self.near(matrix(v)[1])
            return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(far)], names=["cell", "far"])

        x = stored(nodes.withColumn("p", place("v")).select("id", "v", "w", "p.cell", "p.far"), "density-cells")
        found = sorted(x.groupBy("cell").agg(F.count(F.lit(1)), F.max("far")).collect())  # a row for each pivot
        blocks = [max(1, -(-n // self.block)) for _, n, _ in found]
        self.cell = np.repeat([c for c, *_ in found], blocks).astype(int)
        self.radius = np.repeat([r for *_, r in found], blocks)
        first, many = dict(zip([c for c, *_ in found], np.cumsum([0, *blocks]), strict=False)), dict(zip([c for c, *_ in found], blocks, strict=True))
        pick = lambda m: F.element_at(F.create_map(*[F.lit(int(v)) for kv in m.items() for v in kv]), F.col("cell"))
        return x.withColumn("block", (pick(first) + F.pmod(F.xxhash64("id"), pick(many))).cast("int"))

    def apart(self) -> np.ndarray:
        """Least possible distances between points of two blocks."""
        between = np.stack([_rows(self.pivots, p) for p in self.pivots])
        return np.maximum(0, between[np.ix_(self.cell, self.cell)] - self.radius[:, None] - self.radius[None, :])

    def together(self, tasks: int) -> int:
        """Blocks of a side that meet in a task, so that there are some tasks for each of those that run at once."""
        return max(1, min(MOST_TOGETHER, len(self.cell) // max(4, int(np.ceil(np.sqrt(16 * tasks))))))


def _groups(pairs: list[tuple[int, int]], together: int = TOGETHER) -> dict[int, list[tuple[int, int]]]:
    """Pairs of blocks by what meets in one task."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for p in pairs:
        found.setdefault((p[0] // together, p[1] // together), []).append(p)
    return dict(enumerate(found.values()))


def _met(x: DataFrame, pairs: list[tuple[int, int]], together: int, columns: list[str], run: Callable, schema: str) -> DataFrame:
    """run on the blocks, by number, that meet in a task, and the pairs of them that do."""
    spark, groups_ = x.sparkSession, _groups(pairs, together)
    sent = [(g, b) for g, ps in groups_.items() for b in sorted({b for p in ps for b in p})]
    dealt = x.select("block", *columns).join(F.broadcast(spark.createDataFrame(sent, "met int, block int")), "block")
    dealt = dealt.repartitionById(len(groups_), "met")  # one task each; by hash, some tasks would get several

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        o = np.argsort(t.column("block").to_numpy(), kind="stable")
        block = t.column("block").to_numpy()[o]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        of = {int(block[i]): t.take(pa.array(o[i:j])) for i, j in zip(starts, [*starts[1:], len(o)], strict=True)}
        return run(of, [p for p in groups_[t.column("met")[0].as_py()] if p[0] in of and p[1] in of])

    return dealt.groupBy("met").applyInArrow(meet, schema)


# -- core distances --------------------------------------------------------------


def _apart(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows r of x and rows c of y, by differences."""
    out = np.empty(len(r))
    for k in range(0, len(r), AT_ONCE):
        out[k : k + AT_ONCE] = _rows(x[r[k : k + AT_ONCE]], y[c[k : k + AT_ONCE]])
    return out


def _bounds(x: np.ndarray, y: np.ndarray, also: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of the squared distances of rows of x and rows of y by one product, and by how much of either row they may be too low.

    also: a square that the bounds are compared with; numbers are of a kind that holds it.
    """
    c = x.mean(axis=0)
    x, y = x - c, y - c
    a, b = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    top = max(a.max(), b.max())
    kind = np.float32 if 1e-20 < top < 1e30 and also < 1e30 else np.float64
    if not top < 1e300:
        return np.zeros((len(x), len(y))), np.full(len(x), np.inf), np.full(len(y), np.inf)
    off = 2 * (x.shape[1] + 8) * float(np.finfo(kind).eps)  # twice what adding up so many products can lose
    lose, miss = off * (a + 1e-6 * top), off * (b + 1e-6 * top)
    left = np.column_stack([-2 * x, a - lose, np.ones(len(x))]).astype(kind)
    right = np.column_stack([y, np.ones(len(y)), b - miss]).astype(kind)
    return left @ right.T, 2 * lose, 2 * miss


def _up(square: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Rounded up to numbers of a kind."""
    with np.errstate(over="ignore"):
        return (square * (1 + 4 * float(np.finfo(kind).eps))).astype(kind)


class _Near:
    """The nearest points that the points of a block have met, each as often as it weighs; distances are worked out at the end."""

    def __init__(self, t: pa.Table, many: int):
        self.id, self.w = t.column("id").to_numpy(), t.column("w").to_numpy()
        self.x = matrix(t.column("v").combine_chunks())[1]
        self.many = many
        bound = t.column("bound").to_numpy() if "bound" in t.column_names else np.full(len(self.id), np.inf)
        #: Squares, rounded up, beyond which nothing counts.
        self.limit = bound**2 * (1 + 1e-12)
        self.others: list[_Near] = []
        self.found: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, low: np.ndarray, lose: np.ndarray, miss: np.ndarray, other: _Near, by_column: bool = False) -> None:
        """Of the other block what is near enough, by ``_bounds``; by_column: this block's points are the columns."""
        limit = _up(self.limit, low.dtype)
        at = np.flatnonzero(low <= (limit if by_column else limit[:, None]))
        if not len(at):
            return
        r, c = np.divmod(at, low.shape[1])
        least = low.ravel()[at].astype(np.float64)
        most = least + lose[r] + miss[c]
        self.found.append(((c, r) if by_column else (r, c)) + (np.full(len(at), len(self.others)), least, most))
        self.others.append(other)
        self.waiting += len(at)
        if self.waiting > 4 * self.many * len(self.id):
            self._trim()

    def _trim(self) -> None:
        r, c, k, least, most = (np.concatenate(x) for x in zip(*self.found, strict=True))
        o = _ordered(r, most)
        last = np.flatnonzero(_rank(r[o]) == self.many - 1)
        self.limit[r[o[last]]] = np.minimum(self.limit[r[o[last]]], most[o[last]])
        ok = least <= self.limit[r]
        self.found, self.waiting = [(r[ok], c[ok], k[ok], least[ok], most[ok])], 0

    def table(self, all_rows: bool) -> pa.Table:
        n = len(self.id)
        r, d, who, w = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.found:
            self._trim()
            r, c, k, _, _ = self.found[0]
            o = np.argsort(k, kind="stable")
            r, c, k = r[o], c[o], k[o]
            d, who, w = np.empty(len(r)), np.empty(len(r), np.int64), np.empty(len(r), np.int64)
            starts = np.flatnonzero(np.diff(k, prepend=-1))
            for i, j in zip(starts, [*starts[1:], len(k)], strict=True):
                y = self.others[k[i]]
                d[i:j], who[i:j], w[i:j] = _apart(self.x, y.x, r[i:j], c[i:j]), y.id[c[i:j]], y.w[c[i:j]]
            o = _ordered(r, d)
            r, d, who, w = r[o], d[o], who[o], w[o]
        return _listed(self.id, r, d, who, w, self.many, all_rows)


def _listed(ids: np.ndarray, r: np.ndarray, d: np.ndarray, who: np.ndarray, w: np.ndarray, many: int, all_rows: bool) -> pa.Table:
    """Of each row, given in the order of distances, the least that weigh ``many``; bound: the last of them, if they do."""
    sums = np.cumsum(w)
    first = np.searchsorted(r, r)  # of the same row
    before = sums - w - (sums - w)[first]
    ok = before < many
    r, d, who, w, full = r[ok], d[ok], who[ok], w[ok], (before + w)[ok] >= many
    bound = np.full(len(ids), np.inf)
    bound[r[full]] = d[full]
    rows = np.arange(len(ids)) if all_rows else np.unique(r)
    offsets = pa.array(np.append(np.searchsorted(r, rows), len(r)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (d, who, w)]
    return pa.table([pa.array(ids[rows]), *lists, pa.array(bound[rows])], names=["id", "d", "who", "w", "bound"])


def _ordered(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The order by r, a small number, then d."""
    o = np.argsort(d, kind="stable")
    return o[np.argsort(r[o].astype(np.uint16 if r.max(initial=0) < 65536 else np.int64), kind="stable")]


def _rank(r: np.ndarray) -> np.ndarray:
    """The place of each among equal ones, given in order."""
    first = np.flatnonzero(np.diff(r, prepend=-1))
    return np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))


_NEAR = "block int, id long, d array<double>, who array<long>, w array<long>, bound double"


def core_distances(x: DataFrame, cells: Cells, many: int) -> DataFrame:
    """id, core: the distance to the ``many``-th nearest point; who, d: points that are no farther, and how far they are."""
    together, blocks = cells.together(x.sparkSession.sparkContext.defaultParallelism), len(cells.cell)
    pivots, cell, radius = cells.pivots, cells.cell, cells.radius

    def meet(of: dict[int, pa.Table], pairs: list[tuple[int, int]]) -> pa.Table:
        near = {b: _Near(t, many) for b, t in of.items()}
        within = False
        for i, j in sorted(pairs, key=lambda p: p[0] != p[1]):
            p, q = near[i], near[j]
            if i == j:
                within = True
                low, lose, miss = _bounds(p.x, p.x)
                if len(p.x) >= many:
                    p.limit = np.partition(low, many - 1, axis=1)[:, many - 1].astype(np.float64) + lose + miss.max()
                p.add(low, lose, miss, p)
            elif _rows(pivots[cell[i]][None], pivots[cell[j]])[0] - radius[i] - radius[j] <= np.sqrt(max(p.limit.max(), q.limit.max())) * (1 + 1e-12):
                low, lose, miss = _bounds(p.x, q.x)
                p.add(low, lose, miss, q)
                q.add(low, lose, miss, p, by_column=True)
        out = [(b, n.table(within)) for b, n in near.items()]
        return pa.concat_tables([t.add_column(0, "block", pa.array(np.full(len(t), b, np.int32))) for b, t in out])

    def merge(t: pa.Table) -> pa.Table:
        """Of a block's lists one for each point."""
        ids, row = np.unique(t.column("id").to_numpy(), return_inverse=True)
        lists = [t.column(c).combine_chunks() for c in ("d", "who", "w")]
        r = np.repeat(row, lists[0].value_lengths().to_numpy())
        d, who, w = (c.flatten().to_numpy() for c in lists)
        o = _ordered(r, d)
        return _listed(ids, r[o], d[o], who[o], w[o], many, True).drop_columns("w")

    own = [(i, j) for i in range(blocks) for j in range(i, min(blocks, (i // together + 1) * together))]
    inner = stored(_met(x, own, together, ["id", "v", "w"], meet, _NEAR), "density-near")
    with_bound = x.join(inner.select("id", "bound"), "id")
    reach = dict(with_bound.groupBy("block").agg(F.max("bound")).collect())  # a number for each block
    k = np.array([reach.get(b, 0.0) for b in range(blocks)])
    i, j = np.nonzero(np.triu(cells.apart() <= np.maximum(k[:, None], k[None, :]), 1))
    other = i // together != j // together
    found = inner
    if other.any():
        met = _met(with_bound, list(zip(i[other].tolist(), j[other].tolist(), strict=True)), together, ["id", "v", "w", "bound"], meet, _NEAR)
        found = inner.unionByName(met).groupBy("block").applyInArrow(merge, "id long, d array<double>, who array<long>, bound double")
    return found.select("id", F.col("bound").alias("core"), "d", "who")


# -- edges -----------------------------------------------------------------------


def _spanning(p: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and distances of the edges of a least spanning tree."""
    n = len(p)
    left = np.arange(1, n)
    best, by = np.maximum(_rows(p[1:], p[0]), np.maximum(core[1:], core[0])), np.zeros(n - 1, int)
    a, b, d = np.empty(n - 1, int), np.empty(n - 1, int), np.empty(n - 1)
    rest = p[1:].copy()
    for k in range(n - 1):
        at = int(np.argmin(best))
        a[k], b[k], d[k] = by[at], left[at], best[at]
        x, c, new = rest[at].copy(), core[left[at]], left[at]
        last = len(left) - 1 - k  # what is left stays in front
        for v in (left, best, by, rest):
            v[at] = v[last]
        best[last] = np.inf
        if last:
            far = np.maximum(_rows(rest[:last], x), np.maximum(core[left[:last]], c))
            closer = far < best[:last]
            best[:last][closer], by[:last][closer] = far[closer], new
    return a, b, d


def _minimax(d: np.ndarray) -> np.ndarray:
    """The least greatest step on a way between each two points, by the definition (``Ways`` has it for many)."""
    n, out = len(d), np.zeros_like(d)
    if n < 2:
        return out
    inside, best = [0], d[0].copy()
    reach = np.zeros((n, n))
    todo = np.ones(n, bool)
    todo[0] = False
    by = np.zeros(n, int)
    while todo.any():
        k = int(np.argmin(np.where(todo, best, np.inf)))
        reach[k, inside] = np.maximum(reach[by[k], inside], best[k])
        reach[inside, k] = reach[k, inside]
        inside.append(k)
        todo[k] = False
        closer = todo & (d[k] < best)
        best[closer], by[closer] = d[k][closer], k
    return reach


class Ways:
    """At what distance two basins surely meet, by a least spanning forest of them.

    Basins stand in an order in which those that meet at a distance are side by side,
    so the distance for two is the greatest of the gaps between them.
    """

    def __init__(self, names: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray):
        """Names ascending."""
        n = len(names)
        up, last, after, gap = list(range(n)), list(range(n)), [-1] * n, [np.inf] * n

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        a, b = np.searchsorted(names, u), np.searchsorted(names, v)
        for k in np.argsort(d, kind="stable").tolist():
            x, y = root(int(a[k])), root(int(b[k]))
            if x != y:  # rows are named by their first
                after[last[x]], gap[last[x]] = y, float(d[k])
                last[x] = last[y]
                up[y] = x
        order = []
        for c in range(n):
            if up[c] == c:
                while c >= 0:
                    order.append(c)
                    c = after[c]
        self.order = names[order]
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        self.names = names
        self.gaps = np.array([gap[c] for c in order[:-1]], float)
        #: The basin that meets another first.
        self.first = int(np.argmin(self.gaps)) if n > 1 else 0
        self.greatest: list[np.ndarray] | None = None

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By places; -1 where they are one."""
        if self.greatest is None:  # of 1, 2, 4 .. gaps from each
            self.greatest = [self.gaps]
            while 2 ** len(self.greatest) <= len(self.gaps):
                t, step = self.greatest[-1], 2 ** (len(self.greatest) - 1)
                self.greatest.append(np.maximum(t[:-step], t[step:]))
            length = [len(t) for t in self.greatest]
            self._flat, self._from = np.concatenate(self.greatest), np.cumsum([0, *length[:-1]])
            self._log = np.append(0, np.floor(np.log2(np.arange(1, len(self.gaps) + 1)))).astype(np.int64)
        a, b = np.broadcast_arrays(a, b)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        out = np.full(lo.shape, -1.0)
        two = lo < hi
        lo, hi = lo[two], hi[two]
        k = self._log[hi - lo]
        out[two] = np.maximum(self._flat[self._from[k] + lo], self._flat[self._from[k] + hi - (1 << k)])
        return out


class _Basins:
    """Points of a block in the order of their basins' places."""

    def __init__(self, x: np.ndarray, core: np.ndarray, at: np.ndarray):
        self.x, self.core, self.at = x, core, at

    @classmethod
    def of(cls, t: pa.Table) -> _Basins:
        o = np.argsort(t.column("at").to_numpy(), kind="stable")
        return cls(matrix(t.column("v").combine_chunks())[1][o], t.column("core").to_numpy()[o], t.column("at").to_numpy()[o])

    def some(self, mask: np.ndarray) -> _Basins:
        return self if mask.all() else _Basins(self.x[mask], self.core[mask], self.at[mask])


def _shorter(p: _Basins, q: _Basins, ways: Ways) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of two basins each the shortest way between points of p and q, if it is shorter than the known one."""
    if not len(p.at) or not len(q.at):
        return None
    m, lose, miss = _bounds(p.x, q.x, float(max(p.core.max(), q.core.max())) ** 2)
    eps = float(np.finfo(m.dtype).eps)
    for core in (p.core[:, None], q.core[None, :]):
        np.maximum(m, (core**2 * (1 - 4 * eps)).astype(m.dtype), out=m)
    rows, cols = np.flatnonzero(np.diff(p.at, prepend=-1)), np.flatnonzero(np.diff(q.at, prepend=-1))
    least = np.minimum.reduceat(np.minimum.reduceat(m, cols, axis=1), rows, axis=0)
    known = ways.meet(p.at[rows][:, None], q.at[cols][None, :])
    hit = (known >= 0) & (least <= _up(known**2, m.dtype))
    if not hit.any():
        return None
    bar = np.where(hit, least * (1 + 16 * eps) + (lose.max() + miss.max()) * (1 + 16 * eps), -1).astype(m.dtype)
    r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    of_row, of_col = np.cumsum(np.diff(p.at, prepend=-1) != 0) - 1, np.cumsum(np.diff(q.at, prepend=-1) != 0) - 1
    r, c = np.flatnonzero(np.isin(of_row, r)), np.flatnonzero(np.isin(of_col, c))
    i, j = np.nonzero(m[np.ix_(r, c)] <= bar[np.ix_(of_row[r], of_col[c])])
    i, j = r[i], c[j]
    d = np.maximum(_apart(p.x, q.x, i, j), np.maximum(p.core[i], q.core[j]))
    ok = d < ways.meet(p.at[i], q.at[j])
    return p.at[i[ok]], q.at[j[ok]], d[ok]


def _late(blocks: dict[int, _Basins], ways: Ways) -> dict[int, np.ndarray]:
    """Of each block and some basins the points that don't surely meet that basin at their core distances.

    Two points that do, meet each other at the greater of them, so no shorter way is between these.
    """
    often = [p.at[(starts := np.flatnonzero(np.diff(p.at, prepend=-1)))[np.argmax(np.diff(np.append(starts, len(p.at))))]] for p in blocks.values()]
    some = np.unique([ways.first, *often])
    return {b: p.core[None, :] < ways.meet(p.at[None, :], some[:, None]) for b, p in blocks.items()}


def _few(p: _Basins, q: _Basins, mine: np.ndarray, other: np.ndarray, ways: Ways) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_shorter`` finds by points of which one is late."""
    out = [_shorter(p.some(mine), q, ways)] if mine.any() else []
    if p is not q and other.any():
        out.append(_shorter(p.some(~mine), q.some(other), ways))
    return [o for o in out if o is not None and len(o[0])]


def basins(x: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps (u, v, d: a point, a near one of a smaller core distance) and the basin of each point (id, core, root)."""
    to = near.select("id", "core", F.explode("who").alias("who")).filter("who <> id")
    to = to.join(x.select(F.col("id").alias("who"), F.col("core").alias("least")), "who").filter("struct(least, who) < struct(core, id)")
    to = to.groupBy("id").agg(F.min(F.struct("least", "who")).alias("m")).select("id", F.col("m.who").alias("to"))
    step = stored(x.select("id", "core").join(to, "id", "left").select("id", "core", F.coalesce("to", "id").alias("root")), "density-steps")
    root = step
    while True:  # twice as far in each round
        on = root.select(F.col("id").alias("root"), F.col("root").alias("on"))
        root = stored(root.select("id", "core", "root").join(on, "root").select("id", "core", F.col("on").alias("root"), F.expr("on <> root").alias("moved")), "density-basins")
        if not root.filter("moved").limit(1).count():
            break
    return step.filter("root <> id").select(F.least("id", "root").alias("u"), F.greatest("id", "root").alias("v"), F.col("core").alias("d")), root.drop("moved")


def edges(x: DataFrame, cells: Cells, near: DataFrame) -> DataFrame:
    """u, v, d: edges that connect at each distance what all pairs of points (x: with core) connect.

    A basin is connected with each of its points at that point's core distance, so all
    other edges are between basins.  Basins are about n / neighbours; their forest is
    what the driver and the tasks hold.
    """
    spark = x.sparkSession
    steps, root = basins(x, near)
    x = stored(x.join(root.select("id", "root"), "id"), "density-rooted")
    names = np.array(sorted(r for (r,) in root.select("root").distinct().collect()), np.int64)
    if len(names) < 2:
        return steps

    ends = F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")
    known = root.withColumnRenamed("root", "a").join(near.select("id", F.explode(F.arrays_zip("who", "d")).alias("o")), "id").select("a", "core", F.col("o.who").alias("who"), F.col("o.d").alias("d"))
    known = known.join(root.select(F.col("id").alias("who"), F.col("root").alias("b"), F.col("core").alias("other")), "who")
    known = known.filter("a <> b").select(*ends, F.greatest("d", "core", "other").alias("d"))
    pivots = x.filter("far = 0").select("cell", F.col("root").alias("b"), F.col("core").alias("other"))  # a row for each pivot
    star = x.withColumnRenamed("root", "a").join(F.broadcast(pivots), "cell").filter("a <> b").select(*ends, F.greatest("far", "core", "other").alias("d"))
    centre = sorted(pivots.collect())
    i, j, d = _spanning(cells.pivots[[c for c, *_ in centre]], np.array([c for *_, c in centre]))
    tree = [(min(p, q), max(p, q), float(w)) for p, q, w in zip([centre[k][1] for k in i], [centre[k][1] for k in j], d, strict=True) if p != q]
    known = known.unionByName(star).unionByName(spark.createDataFrame(tree, _EDGE)).groupBy("u", "v").agg(F.min("d").alias("d"))
    known = stored(forest(known), "density-known")
    links = known.toArrow()  # less than basins
    ways = Ways(names, *(links.column(c).to_numpy() for c in ("u", "v", "d")))

    @F.arrow_udf("long")
    def place(r: pa.Array) -> pa.Array:
        return pa.array(ways.place[np.searchsorted(names, r.to_numpy())])

    x = stored(x.select("block", "v", "core", place("root").alias("at")), "density-placed")
    sums = {b: r for b, *r in x.groupBy("block").agg(F.min("core"), F.min("at"), F.max("at")).collect()}  # numbers for each block
    least, low, high = (np.array([sums[b][k] if b in sums else e for b in range(len(cells.cell))]) for k, e in ((0, np.inf), (1, 0), (2, 0)))
    apart = np.maximum(cells.apart(), np.maximum(least[:, None], least[None, :]))
    met = ways.meet(np.minimum(low[:, None], low[None, :]), np.maximum(high[:, None], high[None, :]))
    ways.greatest = ways._flat = None  # tasks make their own
    i, j = np.nonzero(np.triu(apart < met))

    def meet(of: dict[int, pa.Table], pairs: list[tuple[int, int]]) -> pa.Table:
        blocks = {b: _Basins.of(t) for b, t in of.items()}
        found, many = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        late = _late(blocks, ways)
        count = {b: x.sum(axis=1) for b, x in late.items()}
        for p, q in pairs:
            k = int(np.argmin(count[p] + count[q]))
            new = _few(blocks[p], blocks[q], late[p][k], late[q][k], ways)
            found += new
            many += sum(len(u) for u, *_ in new)
            if many > 1_000_000:
                found, many = [_thinned(found)], 0
        u, v, d = _thinned(found)
        u, v = ways.order[u], ways.order[v]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v), "d": d})

    out = steps.unionByName(known)
    if len(i):
        together = cells.together(spark.sparkContext.defaultParallelism)
        out = out.unionByName(_met(x, list(zip(i.tolist(), j.tolist(), strict=True)), together, ["v", "core", "at"], meet, _EDGE))
    return out.groupBy("u", "v").agg(F.min("d").alias("d"))


# -- groups --------------------------------------------------------------------


def _both(e: DataFrame) -> DataFrame:
    """Edges from either end: c, o, d."""
    return e.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("o"), "d"), F.struct(F.col("v").alias("c"), F.col("u").alias("o"), "d"))).alias("x")).select("x.*")


def _grown(least: int) -> Callable:
    """Within a tree of small groups: joins that no edge to elsewhere can come before.

    Rows: tree, u, v, d, su, sv (sizes); v null: the shortest way out of u.  Edges are
    taken in order; a group whose shortest way out is shorter must wait, and so must
    what comes to it.  A group that reaches ``least`` takes in whatever comes.
    """

    def run(t: pa.Table) -> pa.Table:
        u, d = t.column("u").to_numpy(), t.column("d").to_numpy()
        v = t.column("v").to_pylist()
        su, sv = t.column("su").to_pylist(), t.column("sv").to_pylist()
        up: dict[int, int] = {}
        size: dict[int, int] = {}
        out: dict[int, float] = {}
        big: dict[int, float | None] = {}
        members: dict[int, list[int]] = {}
        for k in range(len(u)):
            for c, s in ((int(u[k]), su[k]), (v[k], sv[k])):
                if c is not None and c not in up:
                    up[c], size[c], out[c], members[c], big[c] = c, s, np.inf, [c], None

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for k in range(len(u)):
            if v[k] is None:
                out[int(u[k])] = min(out[int(u[k])], d[k])
        at: dict[int, float] = {}
        for k in np.argsort(d, kind="stable"):
            if v[k] is None:
                continue
            a, b = root(int(u[k])), root(v[k])
            if a == b:
                continue
            waits = [c for c in (a, b) if size[c] < least and out[c] < d[k]]
            if waits or (size[a] >= least and size[b] >= least):
                out[a], out[b] = min(out[a], d[k]), min(out[b], d[k])
                continue
            for c in (a, b):  # who is in a large group now for the first time
                if size[c] < least and size[a] + size[b] >= least:
                    at |= dict.fromkeys(members[c], float(d[k]))
            if size[a] < size[b]:
                a, b = b, a
            up[b] = a
            size[a] += size[b]
            out[a] = min(out[a], out[b])
            members[a] += members[b]
        moved = [c for c in up if len(members[root(c)]) > 1]
        return pa.table({"c": pa.array(moved, pa.int64()), "to": pa.array([root(c) for c in moved], pa.int64()), "at": pa.array([at.get(c) for c in moved], pa.float64())})

    return run


def groups(nodes: DataFrame, e: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, w, comp, at) and edges between large groups (u, v, d).

    at: the distance at which a point was first connected to ``least`` points, null if
    never; comp: the group that it was of then, or later came to as a part too small
    to count.  In each round every small group looks at its shortest edge.  Groups
    whose edges lead to a large one go there, each at the length of its own edge; the
    others make up trees around two that are each other's nearest, which ``_grown``
    joins as far as the rest of the table can't matter.
    """
    member = stored(nodes.select("id", "w", F.col("id").alias("comp"), F.lit(None).cast("double").alias("at")), "density-member")
    e = stored(e, "density-edges")
    if least <= 1:
        raise ValueError("a cluster has two points at least")
    member = stored(member.withColumn("at", F.when(F.col("w") >= least, 0.0)), "density-member")
    while True:
        size = stored(member.groupBy("comp").agg(F.sum("w").alias("size")), "density-size")
        near = _both(e).join(size.filter(F.col("size") < least).withColumnRenamed("comp", "c"), "c").groupBy("c")
        near = near.agg(F.min(F.struct("d", F.least("c", "o").alias("x"), F.greatest("c", "o").alias("y"), "o")).alias("m")).select("c", "m.d", "m.o")
        near = stored(near, "density-nearest")
        back = near.select(F.col("c").alias("o"), F.col("o").alias("again"))
        # a large group, or the lesser of two that are each other's nearest, is where a way ends
        ways = near.join(back, "o", "left").select("c", "d", F.when(F.col("again") == F.col("c"), F.least("c", "o")).otherwise(F.col("o")).alias("to"))
        ways = stored(ways, "density-ways")
        for _ in range(3):  # eight steps; who is farther off waits
            on = ways.select(F.col("c").alias("to"), F.col("to").alias("on"))
            ways = ways.join(on, "to", "left").select("c", "d", F.coalesce("on", "to").alias("to"))
        ways = stored(ways, "density-ways")
        large = size.filter(F.col("size") >= least).select(F.col("comp").alias("to"))
        taken = ways.join(large, "to").select("c", "to", F.col("d").alias("at"))

        ends = ways.join(back.select(F.col("o").alias("to"), F.col("again").alias("twin")), "to")
        twin = back.select(F.col("o").alias("twin"), F.col("again").alias("home"))
        trees = ends.join(twin, "twin").filter(F.col("home") == F.col("to")).select("c", F.col("to").alias("tree"))
        trees = trees.join(size.withColumnRenamed("comp", "c"), "c")
        one = trees.select(F.col("c").alias("u"), F.col("tree").alias("tu"), F.col("size").alias("su"))
        two = trees.select(F.col("c").alias("v"), F.col("tree").alias("tv"), F.col("size").alias("sv"))
        met = e.join(one, "u", "left").join(two, "v", "left").filter("tu is not null or tv is not null")
        inner = met.filter("tu = tv").select(F.col("tu").alias("tree"), "u", "v", "d", "su", "sv")
        inner = inner.withColumn("k", F.row_number().over(W.partitionBy("tree").orderBy("d", "u", "v"))).filter(F.col("k") <= LIGHTEST).drop("k")
        out = met.filter("not tu <=> tv").select(F.explode(F.array(F.struct(F.col("tu").alias("tree"), "u", "d", F.col("su").alias("su")), F.struct(F.col("tv").alias("tree"), F.col("v").alias("u"), "d", F.col("sv").alias("su")))).alias("x"))
        out = out.select("x.*").filter("tree is not null").groupBy("tree", "u").agg(F.min("d").alias("d"), F.max("su").alias("su"))
        out = out.select("tree", "u", F.lit(None).cast("long").alias("v"), "d", "su", F.lit(None).cast("long").alias("sv"))
        # ways out of groups with no edge inside the tree that is looked at say nothing
        joined = inner.unionByName(out.join(inner.select("tree").distinct(), "tree", "left_semi"))
        joined = joined.groupBy("tree").applyInArrow(_grown(least), "c long, to long, at double")

        step = stored(taken.unionByName(joined), "density-step")
        if not step.limit(1).count():
            break
        to = step.withColumnRenamed("c", "comp")
        member = member.join(to.select("comp", "to", F.col("at").alias("now")), "comp", "left")
        member = stored(member.select("id", "w", F.coalesce("to", "comp").alias("comp"), F.coalesce("at", "now").alias("at")), "density-member")
        e = e.join(step.select(F.col("c").alias("u"), F.col("to").alias("tu")), "u", "left").join(step.select(F.col("c").alias("v"), F.col("to").alias("tv")), "v", "left")
        u, v = F.coalesce("tu", "u"), F.coalesce("tv", "v")
        e = e.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), "d").filter("u <> v").groupBy("u", "v").agg(F.min("d").alias("d"))
        e = stored(e, "density-edges")
    return member, e


def _least(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of edges those of a least spanning forest, by number: in each round every group takes its shortest."""
    n = len(d)
    o = np.argsort(d, kind="stable")
    names, at = np.unique(np.concatenate([u[o], v[o]]), return_inverse=True)
    a, b = at[:n], at[n:]
    kept = []
    e = np.arange(n)
    while True:
        live = a != b
        a, b, e = a[live], b[live], e[live]
        if not len(e):
            return o[np.sort(np.concatenate(kept))] if kept else o[:0]
        best = np.full(len(names), len(e))
        np.minimum.at(best, a, np.arange(len(e)))
        np.minimum.at(best, b, np.arange(len(e)))
        c = np.flatnonzero(best < len(e))
        kept.append(e[np.unique(best[c])])
        up = np.arange(len(names))
        up[c] = np.where(a[best[c]] == c, b[best[c]], a[best[c]])
        up = np.where((up[up] == np.arange(len(up))) & (np.arange(len(up)) < up), np.arange(len(up)), up)
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]


def _thinned(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, v, d = (np.concatenate(c) for c in zip(*found, strict=True))
    k = _least(u, v, d)
    return u[k], v[k], d[k]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's edges those of a least spanning forest."""
    t = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64()), ("d", pa.float64())]))
    yield from t.take(pa.array(_least(*(t.column(c).to_numpy() for c in ("u", "v", "d"))))).to_batches()


def forest(e: DataFrame) -> DataFrame:
    """A least spanning forest of edges: forests of parts, then of fewer parts, then one."""
    for parts in (64, 8, 1):
        e = e.repartition(parts).mapInArrow(_forest, _EDGE)
    return e


# -- the hierarchy ---------------------------------------------------------------


class Hierarchy:
    """Branches of the condensed hierarchy: parent, distance at which they begin (from below) and end."""

    def __init__(self, seeds: np.ndarray, born: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray):
        """Seeds ascending, the distances at which they are born, and a least spanning forest of them."""
        n = len(seeds)
        self.seeds = seeds
        self.parent, self.low, self.high = [-1] * n, born.tolist(), [np.inf] * n
        alias, up, branch = list(range(n)), list(range(n)), list(range(n))

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        a, b = np.searchsorted(seeds, u), np.searchsorted(seeds, v)
        o = np.argsort(d, kind="stable")
        k = 0
        while k < len(o):
            now, meet = d[o[k]], {}
            while k < len(o) and d[o[k]] == now:  # what meets at one distance meets at once
                x, y = root(a[o[k]]), root(b[o[k]])
                if x != y:
                    up[x] = y
                    meet[y] = meet.pop(y, [branch[y]]) + meet.pop(x, [branch[x]])
                k += 1
            for r, found in meet.items():
                older = [c for c in found if self.low[c] < now]
                if len(older) > 1:
                    to = len(self.parent)
                    self.parent.append(-1)
                    self.low.append(now)
                    self.high.append(np.inf)
                    for c in older:
                        self.parent[c], self.high[c] = to, now
                else:
                    to = older[0] if older else found[0]
                for c in found:
                    if c != to and c not in older:  # born just now: no branch of its own
                        alias.extend(range(len(alias), len(self.parent)))
                        alias[c] = to
                branch[r] = to
        alias.extend(range(len(alias), len(self.parent)))
        for c in range(len(alias)):
            while alias[alias[c]] != alias[c]:
                alias[c] = alias[alias[c]]
        self.alias = np.array(alias, int)
        self.parent, self.low, self.high = np.array(self.parent, int), np.array(self.low, float), np.array(self.high, float)

    def branch(self, comp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The branch that points of a seed fall out of, given when they came to it."""
        c = self.alias[np.searchsorted(self.seeds, comp)]
        while True:
            climb = self.high[c] <= at
            if not climb.any():
                return c
            c = np.where(climb, self.parent[c], c)

    def choose(self, weight: np.ndarray, densities: np.ndarray, densest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label of each branch (-1: noise) and by label the greatest density; given sums by branch over the points that fall out of it.

        Of nested branches those of the greatest stability are chosen (the sum over
        points of the density at which they leave, less that at which the branch
        begins), never a root.  Labels go by size, then by seed.
        """
        n = len(self.parent)
        level = lambda d: 1 / np.maximum(d, 1e-12)
        birth = np.where(np.isinf(self.high), 0.0, level(self.high))
        size, stable = weight.astype(float).copy(), densities - weight * birth
        best, chosen = np.zeros(n), np.zeros(n, bool)
        below, leaf = np.zeros(n), np.ones(n, bool)
        for c in range(n):  # children come before their parents
            p = self.parent[c]
            if self.alias[c] != c:
                continue
            if p >= 0:
                chosen[c] = leaf[c] or stable[c] >= below[c]
                best[c] = max(stable[c], below[c])
                size[p] += size[c]
                stable[p] += size[c] * (level(self.low[p]) - birth[p])
                below[p] += best[c]
                leaf[p] = False
        label, of = np.full(n, -1), np.full(n, -1)
        for c in range(n - 1, -1, -1):  # the topmost that is chosen
            p = self.parent[c]
            of[c] = of[p] if p >= 0 and of[p] >= 0 else c if chosen[c] else -1
        names = np.unique(of[of >= 0])
        names = names[np.lexsort((names, -size[names]))] if len(names) else names
        for k, c in enumerate(names):
            label[of == c] = k
        top = np.zeros(len(names))
        ok = label >= 0
        np.maximum.at(top, label[ok], densest[ok])
        return label, top


def density(df: DataFrame, key: str, vector: str, least: int | None = None, neighbours: int | None = None, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """key, cluster (-1: noise, or no vector), probability of every row.

    least: points of a cluster, at least (by default as ``cluster_size`` has it for
    all rows with a vector); neighbours: those that make the core distance.  Equal
    vectors have equal results; repeated and null keys are kept; labels go by size.
    The work in blocks grows with the square of the rows where vectors have no
    structure; tasks and what is sent to the driver (a number for each block, about
    n / neighbours basins, n / least seeds) stay small.
    """
    x = df.select(F.col(key).alias("key"), F.transform(F.col(vector), lambda c: c.cast("double") + 0.0).alias("v"))
    x = stored(x, "density-rows")
    usable = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    nodes = x.filter(usable).groupBy("v").agg(F.count(F.lit(1)).alias("w")).withColumn("id", F.monotonically_increasing_id())
    nodes = stored(nodes, "density-nodes")
    n = nodes.agg(F.sum("w")).first()[0] or 0
    least = least or cluster_size(n)
    if n < 2:
        return df.select(key, F.lit(-1).alias("cluster"), F.lit(0.0).alias("probability"))
    many = min(neighbours or max(5, least // 3), n)

    cells = Cells(nodes, block, pivots)
    blocks = stored(cells.dealt(nodes), "density-blocks")
    near = stored(core_distances(blocks, cells, many), "density-core")
    blocks = stored(blocks.join(near.select("id", "core"), "id"), "density-cores")
    # copies alone can be a cluster; they are connected at their core distance
    member, e = groups(blocks.select("id", "w"), edges(blocks, cells, near), least)
    member = member.join(blocks.select("id", "core"), "id").withColumn("at", F.when(F.col("w") >= least, F.col("core")).otherwise(F.col("at"))).select("id", "w", "comp", "at")
    member = stored(member, "density-member")

    seeds = sorted(member.filter("at is not null").groupBy("comp").agg(F.min("at")).collect())  # n / least at most
    links = sorted(forest(e).collect())
    h = Hierarchy(np.array([s for s, _ in seeds], np.int64), np.array([b for _, b in seeds], float), *(np.array([r[i] for r in links], t) for i, t in enumerate((np.int64, np.int64, float))))

    @F.arrow_udf("int")
    def branch(comp: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array(h.branch(comp.to_numpy(), at.to_numpy()).astype(np.int32))

    fell = stored(member.filter("at is not null").withColumn("branch", branch("comp", "at")), "density-branch")
    level = lambda c: 1 / F.greatest(F.col(c), F.lit(1e-12))
    weight, densities, densest = (np.zeros(len(h.parent)) for _ in range(3))
    for b, s, t, m in fell.groupBy("branch").agg(F.sum("w"), F.sum(F.col("w") * level("at")), F.max(level("at"))).collect():
        weight[b], densities[b], densest[b] = s, t, m
    label, top = h.choose(weight, densities, densest)

    @F.arrow_udf("struct<cluster:int,probability:double>")
    def place(b: pa.Array, at: pa.Array) -> pa.Array:
        has = ~np.asarray(b.is_null())
        k = np.where(has, label[np.where(has, b.fill_null(0).to_numpy(), 0)], -1) if len(label) else np.full(len(b), -1)
        p = np.minimum(1.0, 1 / np.maximum(at.fill_null(1.0).to_numpy(), 1e-12) / np.append(top, 1.0)[k])
        return pa.StructArray.from_arrays([pa.array(k.astype(np.int32)), pa.array(np.where(k < 0, 0.0, p))], names=["cluster", "probability"])

    by_vector = nodes.join(fell.select("id", "branch", "at"), "id", "left").select(F.col("v").alias("_v"), place("branch", "at").alias("p"))
    out = x.join(by_vector, F.col("v") == F.col("_v"), "left")
    return out.select(F.col("key").alias(key), F.coalesce("p.cluster", F.lit(-1)).alias("cluster"), F.coalesce("p.probability", F.lit(0.0)).alias("probability"))


def with_fallback(df: DataFrame, key: str, vector: str, least: int | None = None, seed: int = 42) -> DataFrame:
    """key, cluster, method: density clusters, or k-means ones if there is too much noise or too few clusters."""
    found = stored(density(df, key, vector, least), "density")
    n, noise, many = found.agg(F.count("*"), F.count_if(F.col("cluster") == -1), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster")))).first()
    if n and (noise > MOST_NOISE * n or many < LEAST_CLUSTERS):
        return kmeans(df, key, vector, want_count(n), seed).withColumn("method", F.lit("kmeans"))
    return found.select(key, "cluster").withColumn("method", F.lit("density"))
