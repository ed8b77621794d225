"""Exact quantiles without a state that holds every value: histograms that close in on the ranks asked for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a histogram; values that are few enough to be looked at one by one.
BUCKETS, FEW = 2_048, 1_024


def quantiles(df: DataFrame, asked: dict[str, list[float]]) -> dict[tuple[str, float], float | None]:
    """By column and share the quantile, interpolated between neighbours as ``percentile`` has it; of no values: None.

    Each pass counts the values of all columns in BUCKETS buckets around each rank
    that is still open, and keeps the bucket that holds it, cut to the values it has.
    A rank is found when its bucket has one value, or FEW.  The driver gets BUCKETS
    rows for each open rank, whatever the number of rows or of different values; nulls
    and NaN don't count.
    """
    columns = list(asked)
    spans = df.agg(*[f(F.when(~F.isnan(_double(c)), _double(c))).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    ranks: dict[tuple[int, int], float | None] = {}
    todo = {}
    for i, c in enumerate(columns):
        n = spans[f"n{i}"]
        for q in asked[c]:
            for k in {math.floor(q * (n - 1)), math.ceil(q * (n - 1))} if n else ():
                todo[i, k] = (spans[f"lo{i}"], spans[f"hi{i}"], k, n)  # lowest, highest, rank among them, number
    while todo:
        for key, (lo, hi, _, _) in list(todo.items()):
            if lo == hi:
                ranks[key] = lo
                del todo[key]
        small = {key: s for key, s in todo.items() if s[3] <= FEW}
        for key, values in _listed(df, columns, small).items():
            ranks[key] = values[small[key][2]]
            del todo[key]
        if todo:
            todo = _narrowed(df, columns, todo)
    out: dict[tuple[str, float], float | None] = {}
    for i, c in enumerate(columns):
        n = spans[f"n{i}"]
        for q in asked[c]:
            at = q * (n - 1)
            a, b = math.floor(at), math.ceil(at)
            out[c, q] = None if not n else ranks[i, a] if a == b else (b - at) * ranks[i, a] + (at - a) * ranks[i, b]
    return out


def _double(c: str):
    return F.col(c).cast("double")


def _within(df: DataFrame, columns: list[str], spans: dict) -> DataFrame:
    """key (place in spans), v: the values that lie in each span."""
    each = [F.when(_double(columns[i]).between(lo, hi), F.struct(F.lit(j).alias("key"), _double(columns[i]).alias("v"))) for j, ((i, _), (lo, hi, _, _)) in enumerate(spans.items())]
    return df.select(F.explode(F.array_compact(F.array(*each))).alias("x")).select("x.*")


def _listed(df: DataFrame, columns: list[str], spans: dict) -> dict:
    """The values of spans that hold few, in order."""
    if not spans:
        return {}
    rows = _within(df, columns, spans).groupBy("key").agg(F.sort_array(F.collect_list("v")).alias("v")).collect()
    keys = list(spans)
    return {keys[r.key]: r.v for r in rows}


def _narrowed(df: DataFrame, columns: list[str], spans: dict) -> dict:
    """The spans cut to the buckets that hold their ranks."""
    keys = list(spans)
    lows = F.array(*[F.lit(float(s[0])) for s in spans.values()])
    # halves, so that the width of the widest span is a number
    steps = F.array(*[F.lit((float(s[1]) / 2 - float(s[0]) / 2) / BUCKETS * 2) for s in spans.values()])
    x = _within(df, columns, spans)
    low, step = F.get(lows, F.col("key")), F.get(steps, F.col("key"))
    bucket = F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor((F.col("v") / 2 - low / 2) / step * 2))).cast("int")
    # a step too small to divide by: the lowest value alone, and the rest
    bucket = F.when(step > 0, bucket).otherwise((F.col("v") > low).cast("int"))
    found = x.withColumn("bucket", bucket).groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("key", "bucket").collect()
    out, before = {}, {}
    for r in found:
        key = keys[r.key]
        rank, start = spans[key][2], before.get(key, 0)
        if start <= rank < start + r.n:
            out[key] = (r.lo, r.hi, rank - start, r.n)
        before[key] = start + r.n
    return out
