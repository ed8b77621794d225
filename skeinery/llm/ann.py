"""Approximate nearest neighbours over robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by hash.  In a shard, points enter a directed graph in
growing batches: a greedy search from the entry point proposes neighbours, relaxed
distance pruning (factor ``alpha``) keeps those that no kept one makes redundant, and
edges back to the new point are pruned alike.  A query's beam search visits each
shard's graph; the best of all shards are merged.  Equal vectors are one point of the
graph, with as many ids as a result can show.  All distances are taken from
differences in double precision, so neither an offset nor a far point costs the others
their digits; points of very different magnitude go to shards of their own, scaled by
that magnitude, so no square overflows or vanishes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch

#: Points of a shard, out-degree, beam while building and while searching, pruning factor, queries searched at a time.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA, QUERIES = 16_000, 32, 64, 128, 1.2, 256
#: Components beyond this are divided by the largest, so that no square overflows.
HUGE = 1e150
#: Vectors whose largest components are so many powers of ten apart, about, go to different shards.
DECADES = 120


def norms(d: np.ndarray) -> np.ndarray:
    """Euclidean lengths along the last axis."""
    top = np.abs(d).max(axis=-1, initial=0)
    scale = np.where(top > HUGE, top, 1.0)
    d = d / scale[..., None] if (top > HUGE).any() else d
    return np.sqrt((d * d).sum(axis=-1)) * scale


def _near(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ids (B, C) to q (B, d)."""
    d = x[ids] - q[:, None, :]
    return np.einsum("bcd,bcd->bc", d, d)


def beam_search(x: np.ndarray, nbrs: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best points met and their squared distances, nearest first; places without a point: -1, inf.

    nbrs: (n, degree), -1 where there is none.
    """
    b, n = len(q), len(x)
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)  # the last column stands for no point
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = _near(x, ids[:, :1], q)[:, 0]
    seen[:, entry] = seen[:, n] = True
    live = np.arange(b)
    while len(live):
        at = np.argmin(np.where(done[live], np.inf, dist[live]), axis=1)
        open_ = ~done[live, at]
        live, at = live[open_], at[open_]
        if not len(live):
            break
        done[live, at] = True
        new = nbrs[ids[live, at]]
        new = np.where(new < 0, n, new)
        fresh = ~seen[live[:, None], new]
        seen[live[:, None], new] = True
        d = np.where(fresh, _near(x, np.minimum(new, n - 1), q[live]), np.inf)
        all_d = np.concatenate([dist[live], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        take = lambda a, z: np.take_along_axis(np.concatenate([a[live], z], axis=1), order, axis=1)
        ids[live] = take(ids, np.where(fresh, new, -1))
        done[live] = take(done, ~fresh)
        dist[live] = np.take_along_axis(all_d, order, axis=1)
    return np.where(np.isfinite(dist), ids, -1), dist


def prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point the candidates to keep (B, degree): the nearest, without those alpha times as near to a kept one."""
    b = len(points)
    cand = np.where(cand == points[:, None], -1, cand)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    safe = np.maximum(cand, 0)
    v = x[safe]
    to_point = np.where(cand < 0, np.inf, np.einsum("bcd,bcd->bc", v - x[points][:, None], v - x[points][:, None]))
    out = np.full((b, degree), -1)
    rows = np.arange(b)
    alive = to_point.copy()
    for k in range(degree):
        best = np.argmin(alive, axis=1)
        ok = np.isfinite(alive[rows, best])
        if not ok.any():
            break
        out[ok, k] = cand[rows, best][ok]
        far = v - v[rows, best][:, None]
        d = np.einsum("bcd,bcd->bc", far, far)
        alive[(alpha * alpha * d <= to_point) | ~ok[:, None]] = np.inf
        alive[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1) -> tuple[np.ndarray, int]:
    """Neighbours (n, degree) and the entry point, the one nearest to the median of each component."""
    n = len(x)
    entry = int(np.argmin(((x - np.median(x, axis=0)) ** 2).sum(axis=1)))
    nbrs = np.full((n, degree), -1)
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry]
    i = 0
    while i < len(order):
        new = order[i : i + max(1, min(256, i))]
        i += len(new)
        found, _ = beam_search(x, nbrs, entry, x[new], beam)
        nbrs[new] = prune(x, new, found, degree, alpha)
        src = np.repeat(new, degree)
        dst = nbrs[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        heads = np.flatnonzero(np.append(True, np.diff(dst) != 0)) if len(dst) else np.zeros(0, int)
        count = np.diff(np.append(heads, len(dst)))
        target = dst[heads]
        extra = np.full((len(target), int(count.max(initial=0))), -1)
        extra[np.repeat(np.arange(len(target)), count), np.arange(len(dst)) - np.repeat(heads, count)] = src
        for a in range(0, len(target), 256):
            t = target[a : a + 256]
            both = np.concatenate([nbrs[t], extra[a : a + 256]], axis=1)
            full = (both >= 0).sum(axis=1) > degree
            fits = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
            fits[full] = prune(x, t[full], both[full], degree, alpha) if full.any() else fits[full]
            nbrs[t] = fits
    return nbrs, entry


def valid(v: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name).combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)


def _build(t: pa.Table) -> pa.Table:
    t = t.sort_by("lead")
    nbrs, entry = build(_matrix(t, "v") * scale(int(t.column("size")[0].as_py())))
    flag = np.zeros(len(t), bool)
    flag[entry] = True
    cols = {"dim": t.column("dim"), "size": t.column("size"), "shard": t.column("shard"), "node": pa.array(np.arange(len(t), dtype=np.int32))}
    return pa.table(cols | {"ids": t.column("ids"), "v": t.column("v"), "nbrs": pa.array(list(nbrs.astype(np.int32)), pa.list_(pa.int32())), "entry": pa.array(flag)})


def scale(size: int) -> float:
    """What vectors of a class of magnitude are multiplied with."""
    return 10.0 ** (-DECADES * max(-2, min(2, size)))


def _size(v: Column) -> Column:
    """The class of magnitude of a vector's largest component: 0 for what is usual."""
    return F.round(F.log10(F.array_max(F.transform(v, F.abs))) / DECADES).cast("int")


INDEX = "dim int, size int, shard int, node int, ids array<long>, v array<double>, nbrs array<int>, entry boolean"


def index(vectors: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """vectors: vec_id, v.  A row for each different vector: shard (of a dimension and class of magnitude), node, its first k + 1 ids, neighbours.

    Every row is indexed; of equal vectors the ids beyond the first k + 1 can't be in
    a result, as ties go to the smaller id.
    """
    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    points = vectors.withColumn("n_", first).filter(F.col("n_") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = scratch(points.withColumn("dim", F.size("v")).withColumn("size", _size(F.col("v"))).withColumn("lead", F.col("ids")[0]), "ann-points")
    shards = max(1, -(-points.count() // shard))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("lead"), F.lit(shards)).cast("int"))
    return scratch(dealt.groupBy("dim", "size", "shard").applyInArrow(_build, INDEX), "ann-index")


class _Graph:
    """One shard, ready for queries."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.x = _matrix(t, "v")
        self.scale = scale(int(t.column("size")[0].as_py()))
        self.scaled = self.x * self.scale
        self.nbrs = t.column("nbrs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        self.entry = int(np.flatnonzero(t.column("entry").to_numpy(zero_copy_only=False))[0])
        ids = t.column("ids").combine_chunks()
        self.many = ids.value_lengths().to_numpy(zero_copy_only=False)
        self.off = np.append(0, np.cumsum(self.many))
        self.ids = ids.flatten().to_numpy(zero_copy_only=False)

    def nearest(self, own: np.ndarray, q: np.ndarray, k: int, beam: int) -> Iterator[tuple[np.ndarray, ...]]:
        found = np.empty((len(q), max(beam, k + 1)), int)
        with np.errstate(over="ignore"):
            around = q * self.scale
        far = ~(np.abs(around).max(axis=1) <= HUGE)  # beyond all that is here: by directions from afar
        found[~far] = beam_search(self.scaled, self.nbrs, self.entry, around[~far], found.shape[1])[0]
        for r in np.flatnonzero(far):
            top = np.abs(q[r]).max()
            found[r] = beam_search(self.x / top, self.nbrs, self.entry, q[r : r + 1] / top, found.shape[1])[0]
        exact = norms(self.x[np.maximum(found, 0)] - q[:, None, :])
        for r in range(len(found)):
            met = np.flatnonzero(found[r] >= 0)
            top = met[np.argsort(exact[r][met], kind="stable")]
            # the nearest points with k + 1 ids between them, and all that tie with the last
            last = min(int(np.searchsorted(np.cumsum(self.many[found[r][top]]), k + 1)), len(top) - 1)
            top = top[exact[r][top] <= exact[r][top[last]]]
            pid = found[r][top]
            n = self.many[pid]
            v = self.ids[np.repeat(self.off[pid] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            s = np.repeat(exact[r][top], n)
            v, s = v[v != own[r]], s[v != own[r]]
            best = np.lexsort((v, s))[:k]
            yield np.full(len(best), own[r]), v[best], s[best]


def _search(k: int, beam: int) -> Callable:
    """Rows in the order of dim, size, shard and kind: a shard's graph, then the queries, however many, that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, graph = None, [], None
        for b in batches:
            where = [b.column(c).to_numpy() for c in ("dim", "size", "shard", "kind")]
            kind = where[-1]
            cut = np.flatnonzero(np.append(True, np.any([np.diff(c) != 0 for c in where], axis=0))) if len(b) else []
            for i, j in zip(cut, [*cut[1:], len(b)], strict=True):
                piece = pa.Table.from_batches([b.slice(i, j - i)])
                here = tuple(int(c[i]) for c in where[:-1])
                if here != now:
                    now, parts, graph = here, [], None
                if kind[i] == 0:
                    parts.append(piece)
                    continue
                graph = graph or _Graph(pa.concat_tables(parts))
                parts = []
                own, q = piece.column("node").to_numpy(), _matrix(piece, "v")
                for a in range(0, len(q), QUERIES):
                    cols = map(np.concatenate, zip(*graph.nearest(own[a : a + QUERIES], q[a : a + QUERIES], k, beam), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def search(idx: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """queries: query_id, v.  query_id, rank, vec_id, score of each query's k nearest points other than its own id.

    Every query visits every shard; a task holds one shard's graph and streams the
    queries past it.  Scores are distances of the original vectors, in double precision.
    """
    shards = idx.select("dim", "size", "shard").distinct()
    asked = queries.withColumn("dim", F.size("v")).join(shards, "dim")
    graph = idx.select("dim", "size", "shard", F.lit(0).alias("kind"), F.col("node").cast("long").alias("node"), "v", "ids", "nbrs", "entry")
    none = [F.lit(None).cast(graph.schema[c].dataType).alias(c) for c in ("ids", "nbrs", "entry")]
    both = graph.unionByName(asked.select("dim", "size", "shard", F.lit(1).alias("kind"), F.col("query_id").alias("node"), "v", *none))
    dealt = both.repartition(max(1, shards.count()), "dim", "size", "shard").sortWithinPartitions("dim", "size", "shard", "kind", "node")
    found = dealt.mapInArrow(_search(k, beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(df: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """The k nearest by Euclidean distance of each row whose id ``every`` divides, against all other rows.

    Rows whose vector is null, empty, zero or not finite, or whose id is null, take no
    part; vectors of different length are never compared; rows that repeat id and
    vector count once; ties go to the smaller id; other columns are left out; an empty
    table gives an empty result.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & valid(F.col("v")))
    rows = scratch(rows.distinct(), "ann-rows")
    queries = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    return search(index(rows, k, shard), queries, k, beam)
