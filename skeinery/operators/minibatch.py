"""k-means in mini-batches: centres move with each batch, by a rate of their own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch_path, stored
from .mining import topic_count
from .vectors import matrix, unit

#: Rounds of seeding, and candidates of a round for each centre, on average.
ROUNDS, OVERSAMPLING = 5, 2.0
#: Rows of a batch, at least; batches that the table is dealt to, at most; times that it is gone through, at most.
BATCH, BATCHES, EPOCHS = 1_024, 24, 6
#: The centres stand still once this share of the inertia is no longer gained.
GAIN = 1e-3


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances; products first, so those of nearly equal vectors are only near 0."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0)


def _placed(x: DataFrame, centres: np.ndarray) -> DataFrame:
    """x with at (nearest centre, the first of equal ones) and far (squared distance)."""
    sent = x.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<at:int,far:double>")
    def place(v: pa.Array) -> pa.Array:
        d = _squares(matrix(v)[1], sent.value)
        at = np.argmin(d, axis=1)
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(d)), at])], names=["at", "far"])

    return x.withColumn("p_", place("v")).select(*x.columns, "p_.at", "p_.far")


def _moments(x: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """By centre the number and the sum of its rows, and the inertia: a row from each task."""
    k, width = centres.shape
    sent = x.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        n, total, inertia = np.zeros(k), np.zeros((k, width)), 0.0
        for b in batches:
            v = matrix(b.column("v"))[1]
            d = _squares(v, sent.value)
            at = np.argmin(d, axis=1)
            n += np.bincount(at, minlength=k)
            np.add.at(total, at, v)
            inertia += float(d[np.arange(len(d)), at].sum())
        yield pa.RecordBatch.from_arrays([pa.array([np.append(np.column_stack([n, total]).ravel(), inertia).tolist()])], names=["m"])

    sums = x.select("v").mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    m = np.array([r.v for r in sums.orderBy("i").collect()])  # the size of the centres
    table = m[:-1].reshape(k, width + 1)
    return table[:, 0], table[:, 1:], float(m[-1])


def seeds(x: DataFrame, k: int, seed: int) -> np.ndarray:
    """k centres: rows drawn in a few rounds with odds by squared distance, weighed by the rows near them, thinned out.

    x: h (a number that draws depend on), v.  Some OVERSAMPLING * k rows come to the
    driver in each round.
    """
    rng = np.random.default_rng(seed)
    found = [np.array(r.v) for r in x.orderBy(F.xxhash64("h", F.lit(seed)), "v").limit(1).collect()]
    for r in range(ROUNDS):
        placed = _placed(x, np.array(found))
        total = placed.agg(F.sum("far")).first()[0] or 0.0
        if total <= 0:
            break
        chance = (F.xxhash64("h", F.lit(seed), F.lit(r + 1)) / F.lit(2.0**64) + 0.5) < OVERSAMPLING * k * F.col("far") / total
        found += [np.array(c.v) for c in placed.filter(chance & (F.col("far") > 0)).select("v").distinct().orderBy("v").collect()]
    c = np.unique(np.array(found), axis=0)
    weight, _, _ = _moments(x, c)
    first = int(rng.choice(len(c), p=weight / weight.sum()))
    chosen, near = [first], _squares(c, c[first : first + 1])[:, 0]
    while len(chosen) < min(k, len(c)):
        odds = weight * near
        if odds.sum() <= 0:
            break
        # of several draws the one that leaves least
        draws = rng.choice(len(c), size=2 + int(np.log(k)), p=odds / odds.sum())
        best = min(draws, key=lambda i: float((weight * np.minimum(near, _squares(c, c[i : i + 1])[:, 0])).sum()))
        chosen.append(int(best))
        near = np.minimum(near, _squares(c, c[best : best + 1])[:, 0])
    centres = c[chosen]
    for _ in range(10):  # the candidates' own means
        at = np.argmin(_squares(c, centres), axis=1)
        for i in range(len(centres)):
            own = at == i
            if weight[own].sum() > 0:
                centres[i] = np.average(c[own], axis=0, weights=weight[own])
    return centres


def fit(x: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    """Centres of x (h, v).

    Rows are dealt to batches by hash and stored by batch, so a step reads its own
    rows only.  A centre moves to the running mean of all rows that it was nearest to,
    so its rate falls with their number.  An epoch that gains less than GAIN of the
    inertia is the last; a full pass has the last word, in which centres that lost
    their rows stay.
    """
    n = x.count()
    if not n:
        return np.zeros((0, 0))
    batches = max(1, min(BATCHES, n // BATCH))
    path = scratch_path(x.sparkSession, "batches")
    x.withColumn("batch", F.pmod(F.xxhash64("h", F.lit(seed), F.lit("batch")), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    dealt = x.sparkSession.read.schema("h long, v array<double>, batch int").parquet(path)
    centres = seeds(x, k, seed)
    seen, before = np.zeros(len(centres)), np.inf
    for _ in range(EPOCHS):
        inertia = 0.0
        for b in range(batches):
            many, total, far = _moments(dealt.filter(F.col("batch") == b), centres)
            if not len(many):
                continue
            inertia += far
            seen += many
            moved = many > 0
            centres[moved] += (total[moved] - many[moved, None] * centres[moved]) / seen[moved, None]
        if inertia >= before * (1 - GAIN):
            break
        before = inertia
    many, total, _ = _moments(x, centres)
    moved = many > 0
    centres[moved] = total[moved] / many[moved, None]
    return centres


def minibatch_kmeans(df: DataFrame, key: str, vector: str, k: int | None = None, seed: int = 42, cosine: bool = True) -> DataFrame:
    """key, cluster, far: the nearest of k centres (numbered by size) and the squared distance to it.

    With ``cosine`` vectors count by direction.  Rows without a vector have no row
    here; equal vectors share a cluster; the same rows and seed give the same
    centres, up to the order in which sums are formed.
    """
    v = F.transform(vector, lambda c: c.cast("double"))
    x = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(F.col(key)).alias("h"), v.alias("v"))
    if cosine:

        @F.arrow_udf("array<double>")
        def directions(a: pa.Array) -> pa.Array:
            m = unit(matrix(a)[1])
            return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)[: len(a) + 1]), pa.array(m.ravel()))

        x = x.withColumn("v", directions("v"))
    x = stored(x, "minibatch")
    centres = fit(x.select("h", "v"), k or topic_count(x.count()), seed)
    if not len(centres):
        return x.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0.0).alias("far"))
    placed = stored(_placed(x.select("key", "v"), centres).select("key", "at", "far"), "minibatch-placed")
    sizes = sorted(placed.groupBy("at").count().collect(), key=lambda r: (-r["count"], r["at"]))
    names = F.create_map(*[F.lit(v) for i, r in enumerate(sizes) for v in (r["at"], i)])
    return placed.select(F.col("key").alias(key), F.element_at(names, F.col("at")).alias("cluster"), "far")
