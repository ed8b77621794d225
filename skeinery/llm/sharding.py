"""Minimax contiguous partition of documents into shards.

Atomic groups (equal texts) stand in one order: by group size, largest first,
then by text key.  The smallest capacity for which a greedy pass needs no more
than n shards is found by binary search, and the shards are cut there.  In this
order the sizes are a run-length list (size, number of groups), so the search
needs one entry for each different group size and never the groups themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh, scratch, text_key

#: Rows that one numbering task sorts, about.
BLOCK_ROWS = 50_000


def greedy(runs: list[tuple[int, int]], capacity: int, most: int) -> list[tuple[int, int]] | None:
    """Cuts (size, groups of that size before the cut) of a greedy pass; None: over ``most`` shards.

    runs: (size, number of groups), in order.
    """
    cuts, room = [], capacity
    for size, n in runs:
        if size > capacity:
            return None
        if size == 0 or n * size <= room:
            room -= n * size
            continue
        taken = 0
        while True:
            fit = min(n - taken, room // size)
            taken += fit
            room -= fit * size
            if taken == n:
                break
            cuts.append((size, taken))
            if len(cuts) >= most:
                return None
            room = capacity
    return cuts


def smallest(runs: list[tuple[int, int]], n_shards: int) -> tuple[int, list[tuple[int, int]]]:
    """The smallest feasible capacity and its cuts."""
    if not runs:
        return 0, []
    low = max(max(s for s, _ in runs), -(-sum(s * n for s, n in runs) // n_shards))
    high = low + max(s for s, _ in runs)
    while greedy(runs, high, n_shards) is None:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        if greedy(runs, mid, n_shards) is None:
            low = mid + 1
        else:
            high = mid
    return high, greedy(runs, high, n_shards)


def minimax(runs: list[tuple[int, int]], n_shards: int) -> tuple[int, list[tuple[int, int]]]:
    """The smallest feasible capacity and its cuts.

    runs: sizes descend.  A group that exceeds an even share of what is left fills a
    shard alone, and the capacity of the others is searched anew, as long as that
    raises no shard above the smallest capacity.
    """
    capacity, cuts = smallest(runs, n_shards)
    rest, alone, largest = [list(r) for r in runs], [], 0
    total, left = sum(s * n for s, n in runs), n_shards
    while left > 1 and rest and rest[0][0] * left > total:
        size = rest[0][0]
        alone.append(size)
        largest, total, left = max(largest, size), total - size, left - 1
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    if not alone:
        return capacity, cuts
    other, more = smallest([tuple(r) for r in rest], left)
    if max(largest, other) > capacity:
        return capacity, cuts
    before = {s: alone.count(s) for s in alone}
    own = [(s, 1 + alone[:i].count(s)) for i, s in enumerate(alone)]
    if not rest:
        own = own[:-1]
    return capacity, own + [(s, n + before.get(s, 0)) for s, n in more]


def _numbered(df: DataFrame, over: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Numbers rows from 0 within ``over`` in two levels: bucket by bucket, then within a bucket.

    Only counts by (over, bucket) are summed up in one place, so no task sorts a whole group.
    """
    (b, n, o) = fresh(df, "bucket_", "count_", "offset_")
    df = df.withColumn(b, bucket)
    counts = df.groupBy(*over, b).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy(*over).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*over, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(o))
    local = F.row_number().over(W.partitionBy(*over, b).orderBy(*order)) - 1
    return df.withColumn(name, local.cast("long")).join(offsets, [*over, b]).withColumn(name, F.col(name) + F.col(o)).drop(b, o)


def shard(docs: DataFrame, n_shards: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Size: UTF-8 bytes of the text plus 8; a null text has none, its checksum is
    null, and null texts are one group (as empty texts are).  Equal texts go to one
    shard whatever their number; repeated rows get slots of their own; slots run
    from 0 without gaps.  An empty table gives an empty result.  Other columns of
    docs are left out.  Law ``bytes``: sizes near equal; grown_shard is null.
    """
    base = scratch(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
            text_key(F.col(text)).alias("g"),
        ),
        "shard-rows",
    )
    groups = scratch(base.groupBy("g").agg(F.sum("size").alias("group_size")), "shard-groups")
    runs = [tuple(r) for r in groups.groupBy("group_size").agg(F.count(F.lit(1))).orderBy(F.desc("group_size")).collect()]
    _, cuts = minimax(runs, n_shards)
    split = sorted({s for s, n in cuts})  # only groups of these sizes need a rank among their like
    here = F.col("group_size").isin(split) if split else F.lit(False)
    ranked = _numbered(groups.filter(here), ["group_size"], F.hex(F.substring("g", 1, 2)), [F.col("g")], "rank_")
    ranked = ranked.unionByName(groups.filter(~here).withColumn("rank_", F.lit(0).cast("long")))
    at = F.lit(0)
    for s, n in cuts:
        at = at + F.when((F.col("group_size") < s) | ((F.col("group_size") == s) & (F.col("rank_") >= n)), 1).otherwise(0)
    placed = scratch(base.join(ranked.select("g", at.cast("int").alias("shard")), "g").drop("g"), "shard-placed")
    rows = placed.count()
    buckets = max(8, -(-rows // (n_shards * BLOCK_ROWS)))
    out = _numbered(placed, ["shard"], F.pmod(F.xxhash64("doc_id"), F.lit(buckets)), [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
