"""Centroids and projection of tickets onto them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.sinks import stored


def mean_vectors(df: DataFrame, by: str, vector: str = "v") -> DataFrame:
    """by, n, c: the mean vector of each group, summed dimension by dimension."""
    x = df.filter(F.col(by).isNotNull() & F.col(vector).isNotNull()).select(by, F.posexplode(vector).alias("i", "x"))
    x = x.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return x.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


#: Centroids that travel to the executors, at most; they are one for each want or topic.
MOST_CENTROIDS = 5_000
#: Vectors that meet a block of centroids in a task, where there are more.
MOST_VECTORS = 50_000


def collected(centroids: DataFrame, by: str) -> tuple[list, np.ndarray]:
    """Ids, ascending, and centroids as a matrix; more than MOST_CENTROIDS are refused."""
    rows = centroids.select(by, "c").orderBy(by).limit(MOST_CENTROIDS + 1).collect()
    if len(rows) > MOST_CENTROIDS:
        raise ValueError(f"over {MOST_CENTROIDS} centroids")
    return [r[0] for r in rows], np.array([r.c for r in rows], np.float64).reshape(len(rows), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a vector, as a mask, and their vectors."""
    has = ~np.asarray(vectors.is_null())
    flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return has, flat.reshape(int(has.sum()), -1) if has.any() else np.zeros((0, 0))


def _two_best(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and cosines of each row's nearest and second centroid, the first of equal ones; no second: its place is -1."""
    s = np.round(unit(x) @ c.T, 12)
    rows = np.arange(len(s))
    first = np.argmax(s, axis=1)
    top = s[rows, first]
    if len(c) < 2:
        return first, top, np.full(len(s), -1), np.zeros(len(s))
    s[rows, first] = -np.inf
    second = np.argmax(s, axis=1)
    return first, top, second, s[rows, second]


def nearest(df: DataFrame, centroids: DataFrame, by: str, vector: str = "v") -> DataFrame:
    """df with best, score and margin (best less second; one centroid: the score), by cosine; ties to the smaller id.

    Up to MOST_CENTROIDS centroids travel as one matrix, and a batch of vectors is
    compared in one product; more go in blocks (see ``_nearest_in_blocks``), with the
    same result.  Without a vector, or without centroids, all three are null.
    """
    n = centroids.limit(MOST_CENTROIDS + 1).count()
    if n > MOST_CENTROIDS:
        return _nearest_in_blocks(df, centroids, by, vector)
    ids, c = collected(centroids, by)
    c = unit(c) if len(ids) else c

    @F.arrow_udf("struct<at:int,score:double,margin:double>")
    def best(v: pa.Array) -> pa.Array:
        has, x = matrix(v)
        has = has & (len(ids) > 0)
        at, score, margin = np.zeros(len(v), np.int32), np.zeros(len(v)), np.zeros(len(v))
        if has.any():
            first, top, _, second = _two_best(x, c)
            at[has], score[has], margin[has] = first, top, top - second
        cols = [pa.array(a, mask=~has) for a in (at, score, margin)]
        return pa.StructArray.from_arrays(cols, names=["at", "score", "margin"])

    kind = centroids.schema[by].dataType.simpleString()
    names = F.array(*map(F.lit, ids)).cast(f"array<{kind}>")
    out = df.withColumn("s_", best(F.col(vector)))
    return out.withColumns({"best": F.get(names, F.col("s_.at")), "score": F.col("s_.score"), "margin": F.col("s_.margin")}).drop("s_")


def _nearest_in_blocks(df: DataFrame, centroids: DataFrame, by: str, vector: str) -> DataFrame:
    """Groups of vectors meet blocks of centroids; each block hands on a row's two best, and the two best of those count.

    A task holds MOST_VECTORS vectors and MOST_CENTROIDS centroids, about, however many
    there are of either.
    """
    df = stored(df.withColumn("row_", F.monotonically_increasing_id()), "nearest-rows")
    x = df.filter(F.col(vector).isNotNull()).select("row_", F.transform(vector, lambda v: v.cast("double")).alias("v"))
    c = stored(centroids.select(F.col(by).alias("id"), "c"), "nearest-centroids")
    groups, blocks = 1 + x.count() // MOST_VECTORS, 1 + c.count() // MOST_CENTROIDS
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = x.withColumn("group", F.pmod(F.xxhash64("row_"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))
    right = c.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("group", every(groups))

    def best(t: pa.Table, near: pa.Table) -> pa.Table:
        near = near.take(pc.sort_indices(near, [("id", "ascending")]))
        ids, rows = near.column("id").combine_chunks(), t.column("row_").combine_chunks()
        if not len(near) or not len(t):
            return pa.table({"row_": rows[:0], "id": ids[:0], "score": pa.array([], pa.float64())})
        first, top, second, next_ = _two_best(matrix(t.column("v").combine_chunks())[1], unit(matrix(near.column("c").combine_chunks())[1]))
        two = second >= 0
        return pa.table({"row_": pa.concat_arrays([rows, rows.filter(pa.array(two))]), "id": pa.concat_arrays([ids.take(pa.array(first)), ids.take(pa.array(second[two]))]), "score": np.append(top, next_[two])})

    kind = centroids.schema[by].dataType.simpleString()
    found = left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(best, f"row_ long, id {kind}, score double")
    two = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, 2)  # two for each block
    found = found.groupBy("row_").agg(two.alias("t"))
    score, second = -F.col("t")[0]["s"], F.when(F.size("t") > 1, -F.get("t", F.lit(1))["s"]).otherwise(0.0)
    found = found.select("row_", F.col("t")[0]["id"].alias("best"), score.alias("score"), (score - second).alias("margin"))
    return df.join(found, "row_", "left").drop("row_")


def threshold(confirmed: DataFrame, score: str = "own") -> DataFrame:
    """One row: the 10th percentile of confirmed self-similarity less 0.03, from 0.25 to 0.55."""
    return confirmed.agg(F.greatest(F.lit(0.25), F.least(F.lit(0.55), F.percentile(score, F.lit(0.10)) - 0.03)).alias("threshold"))


def method(confirmed: Column, vector: Column, chars: Column, score: Column, margin: Column, top: Column, least_margin: float, least_chars: int) -> Column:
    sure = (score >= top) & (margin >= least_margin)
    return t.cascade(
        [
            (confirmed, "llm_confirmed"),
            (~vector, "rule_hint_only"),
            ((chars < least_chars) & sure, "short_text_projection"),
            (chars < least_chars, "rule_hint_only"),
            (~sure, "low_confidence_projection"),
        ],
        "embedding_projection",
    )


def confidence_band(meth: Column, score: Column, margin: Column, top: Column, least_margin: float) -> Column:
    return t.cascade(
        [
            (meth == "llm_confirmed", "confirmed"),
            ((score >= top + 0.10) & (margin >= 2 * least_margin), "high"),
            ((score >= top) & (margin >= least_margin), "medium"),
        ],
        "low",
    )


def review_reason(meth: Column, score: Column, margin: Column, risk: Column, chars: Column, top: Column, least_margin: float, least_chars: int) -> Column:
    parts = [(score < top, "low_similarity"), (margin < least_margin, "ambiguous_match"), (risk >= 2, "high_risk_signal"), (chars < least_chars, "short_text")]
    return F.when(meth == "llm_confirmed", "").otherwise(F.concat_ws(", ", *[F.when(c, n) for c, n in parts]))


def uncertainty(score: Column, margin: Column, risk: Column, top: Column, least_margin: float) -> Column:
    return F.greatest(top - score, F.lit(0.0)) + F.greatest(F.lit(least_margin) - margin, F.lit(0.0)) + 0.05 * risk


def cluster_confidence(df: DataFrame, centroids: DataFrame, own: str, by: str, vector: str = "v") -> DataFrame:
    """clip(1 - distance to the own centre / mean distance to all, 0, 1)"""
    ids, c = collected(centroids, by)
    place = {v: i for i, v in enumerate(ids)}

    @F.arrow_udf("double")
    def confidence(v: pa.Array, mine: pa.Array) -> pa.Array:
        has, x = matrix(v)
        at = np.array([place.get(m, -1) for m in mine.to_pylist()])[has]
        out = np.full(len(v), np.nan)
        if has.any() and ids:
            d = np.empty((len(x), len(ids)))
            for i in range(len(ids)):  # differences, as a product of equal vectors would not be 0
                d[:, i] = np.sqrt(((x - c[i]) ** 2).sum(axis=1))
            mean = d.mean(axis=1)
            found = np.clip(1 - d[np.arange(len(x)), np.maximum(at, 0)] / np.where(mean == 0, 1.0, mean), 0, 1)
            out[has] = np.where(at < 0, np.nan, found)
        return pa.array(out, mask=np.isnan(out))

    return df.withColumn("confidence", confidence(F.col(vector), F.col(own)))


def cosine_silhouette(df: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """One row: mean silhouette under cosine distance, exact and linear, from the sums of unit vectors by label."""
    x = df.select(F.col(label).alias("l"), t.l2(vector).alias("u"))
    sums = mean_vectors(x, "l", "u").select(F.col("l").alias("id"), "n", "c")
    one = sums.agg(F.collect_list(F.struct("id", "n", "c")).alias("cs"))
    x = x.crossJoin(F.broadcast(one))
    # the mean distance to a group is 1 - u . mean; to the own one without oneself
    far = F.transform("cs", lambda c: F.struct(c["id"].alias("id"), c["n"].alias("n"), (1 - t.dot(F.col("u"), c["c"])).alias("d")))
    x = x.withColumn("far", far)
    own = F.get(F.filter("far", lambda c: c["id"] == F.col("l")), F.lit(0))
    a = own["d"] * own["n"] / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("far", lambda c: c["id"] != F.col("l")), lambda c: c["d"]))
    x = x.withColumns({"a": F.when(own["n"] > 1, a), "b": b})
    return x.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))
