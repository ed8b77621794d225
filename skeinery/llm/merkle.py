"""Merkle manifest of a table: one root, and a proof for each row.

The rows of a group (a language, say) are leaves of one tree, in the order of their
ids; the trees' roots are leaves of one more tree, in the order of groups.  What is
stored of an inner node is its preimage, the hashes of its children in a row, 64
characters each.  A leaf joins the preimages of its ancestors: with its own slot cut
out, a preimage is the leaf's sibling in the proof; with another hash put into the
slot, it is what the parent would have been made from.

Positions come from a range partitioning and counts for each partition, so no group is
ordered in one task.  Blocks of 2^BITS neighbours make one row of preimages, so a tree
of n leaves takes log n / BITS shuffles, and each row is of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch

#: Levels of a tree that one row of preimages holds: 2^BITS neighbours at most.
BITS = 10
#: Characters of a hash.
WIDTH = 64
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else byte count, colon and value; so no two rows are written alike."""
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(values: list[Column]) -> Column:
    return digest(*map(field, values))


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with pos (from 0, in this order within each key) and n (rows of the key).

    Rows are dealt by ranges of key and order; a partition's share of a key is
    counted, and the counts before it say where its rows begin.  Rows equal in key
    and order are dealt by where they stood, so they spread as well.
    """
    o = [key, *order, "_at"]
    df = df.withColumn("_at", F.monotonically_increasing_id())
    df = df.repartitionByRange(*o).sortWithinPartitions(*o).withColumn("_at", F.monotonically_increasing_id())
    df = scratch(df.withColumn("_part", F.shiftright("_at", 33)), "merkle-order")
    share = df.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # a row for each partition in which a key is found
    w = W.partitionBy("_key").orderBy("_p")
    before = F.sum("_rows").over(w) - F.col("_rows")
    share = share.select("_key", "_p", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(W.partitionBy("_key")).alias("n"))
    df = df.join(share, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_p")))
    return df.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_key", "_p", "_shift")


def depth(n: Column) -> Column:
    """Levels above n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _levels(hashes: Column, many: Column) -> Column:
    """struct<up array<array<string>>, last array<string>>: preimages of ``many`` levels, and the hashes of the last."""

    def pairs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(h) - 1) / 2).cast("int"))
        return F.transform(at, lambda i: F.concat(F.get(h, 2 * i), F.coalesce(F.get(h, 2 * i + 1), F.lit(""))))

    steps = F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.array().cast("array<array<string>>").alias("up"), hashes.alias("last"))

    def higher(a: Column, _: Column) -> Column:
        up = pairs(a["last"])
        return F.struct(F.concat(a["up"], F.array(up)).alias("up"), F.transform(up, lambda p: F.sha2(p, 256)).alias("last"))

    return F.aggregate(steps, start, higher)


def tree(nodes: DataFrame, deepest: int, bits: int = BITS) -> list[DataFrame]:
    """nodes: key, pos, hash, depth.  Tables of preimages, lowest tier first, each of key, block, depth, up, hash.

    A row holds the preimages above 2^bits neighbours: up[j] those j + 1 levels above.
    The last table has one row for each key, whose hash is the tree's root.
    """
    tiers, done = [], 0
    while True:
        many = F.greatest(F.lit(0), F.least(F.lit(bits), F.first("depth") - F.lit(done)))
        packs = nodes.groupBy("key", F.shiftright("pos", bits).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("kids"), F.first("depth").alias("depth"), many.alias("many"))
        grown = _levels(F.transform("kids", lambda x: x["hash"]), F.col("many"))
        packs = packs.select("key", "block", "depth", grown.alias("g")).select("key", "block", "depth", "g.up", F.get("g.last", F.lit(0)).alias("hash"))
        tiers.append(scratch(packs, "merkle-tier"))
        done += bits
        if done >= deepest:
            return tiers
        nodes = tiers[-1].select("key", F.col("block").alias("pos"), "hash", "depth")


def ancestors(up: Column, pos: Column, bits: int = BITS) -> Column:
    """Of a row of preimages those above the node at pos, lowest first."""
    own = F.pmod(pos, F.lit(1 << bits))
    return F.transform(up, lambda level, j: F.get(level, F.call_function("shiftright", own, j + 1).cast("int")))


def climbs(tiers: list[DataFrame], bits: int = BITS) -> DataFrame:
    """key, block, over: for each row of the lowest tier the preimages above it, up to the tree's root."""
    over = tiers[-1].select("key", "block", F.array().cast("array<string>").alias("over"))
    for below, above in zip(tiers[-2::-1], tiers[:0:-1], strict=True):
        above = above.join(over, ["key", "block"]).select(F.col("key").alias("_k"), F.col("block").alias("_b"), "up", "over")
        met = below.select("key", "block").join(above, (F.col("key") == F.col("_k")) & (F.shiftright("block", bits) == F.col("_b")))
        over = met.select("key", "block", F.concat(ancestors(F.col("up"), F.col("block"), bits), F.col("over")).alias("over"))
    return over


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("depth")).first()[0] or 0


def prove(leaves: DataFrame, group: str, order: str, bits: int = BITS) -> DataFrame:
    """leaves: group, order, leaf and others.  Adds subroot, root, path and spot.

    path: the preimages of a leaf's ancestors, from its parent to the root; spot: its
    slots in them, a bit each.  Leaves of a group go by order (null first), then by
    leaf; groups by their UTF-8 bytes, null first.
    """
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    nodes = numbered(leaves.withColumn("key", key), "key", order, "leaf").withColumn("depth", depth(F.col("n"))).drop("n")
    nodes = scratch(nodes, "merkle-leaves")
    tiers = tree(nodes.select("key", "pos", F.col("leaf").alias("hash"), "depth"), _most(nodes), bits)

    tops = tiers[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), "hash", F.col("depth").alias("below"))
    tops = scratch(numbered(tops, "key", "name").withColumn("depth", depth(F.col("n"))).drop("n"), "merkle-groups")
    upper = tree(tops.select("key", "pos", "hash", "depth"), _most(tops), bits)
    root = upper[-1].select("key", F.col("hash").alias("root"))  # one row
    above = upper[0].join(climbs(upper, bits), ["key", "block"]).select(F.col("block").alias("_b"), "up", "over")
    tops = tops.join(above, F.shiftright("pos", bits) == F.col("_b")).join(F.broadcast(root), "key")
    crown = F.concat(ancestors(F.col("up"), F.col("pos"), bits), F.col("over"))
    tops = tops.select(F.col("name").alias("key"), F.col("hash").alias("subroot"), "root", crown.alias("crown"), F.expr("shiftleft(pos, below)").alias("high"))

    # what all leaves of a block have in common goes to the block, so a group's leaves don't meet in one place
    blocks = tiers[0].select("key", "block", "up").join(climbs(tiers, bits), ["key", "block"]).join(tops, "key")
    blocks = blocks.select("key", "block", "up", F.concat("over", "crown").alias("over"), "subroot", "root", "high")
    out = nodes.withColumn("block", F.shiftright("pos", bits)).join(blocks, ["key", "block"])
    path = F.concat(ancestors(F.col("up"), F.col("pos"), bits), F.col("over"))
    return out.select(*leaves.columns, "subroot", "root", path.alias("path"), F.col("high").bitwiseOR(F.col("pos")).alias("spot"))


def _sides(pre: Column, slot: Column) -> tuple[Column, Column]:
    """What stands before and after a slot of a preimage."""
    return pre.substr(F.lit(1), WIDTH * slot), pre.substr(WIDTH * (slot + 1) + 1, F.lit(WIDTH))


def _slot(spot: Column, j: Column) -> Column:
    return F.call_function("shiftright", spot, j).bitwiseAND(F.lit(1)).cast("int")


def siblings(path: Column, spot: Column) -> Column:
    """The proof: from each preimage the own slot is cut out."""
    return F.transform(path, lambda pre, j: F.concat(*_sides(pre, _slot(spot, j))))


def fold(leaf: Column, path: Column, spot: Column) -> Column:
    """The root that a leaf leads to: level by level the hash is put into its slot of the preimage."""
    steps = F.transform(path, lambda pre, j: F.struct(pre.alias("pre"), _slot(spot, j).alias("slot")))

    def put(h: Column, x: Column) -> Column:
        before, after = _sides(x["pre"], x["slot"])
        return digest(before, h, after)

    return F.aggregate(steps, leaf, put)


def audit(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``documents``.

    Where 7 divides the CRC-32 of the decimal doc_id, the row is folded with one
    added to n_chars, as if tampered with.  A null lang is a group of its own; a null
    doc_id comes first and isn't tampered with; repeated rows are leaves of their own,
    in any order, as they are equal; null and empty texts are told apart; other
    columns are left out; an empty table gives an empty result.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = [more if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", "lang", leaf([F.col(c) for c in FIELDS]).alias("leaf"), F.when(hit, leaf(changed)).alias("other"))
    proved = prove(leaves, "lang", "doc_id", bits)
    path, spot = F.col("path"), F.col("spot")
    out = proved.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join(siblings(path, spot), ""), 256).alias("proof_sha256"),
        fold(F.coalesce("other", "leaf"), path, spot).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
