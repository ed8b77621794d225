"""Temperature mixing of sources, with DataFrame functions only.

Source token shares p become weights p^a / sum(p^a).  The exponent a is bisected
to the largest one whose entropy reaches the target, and raised from there if a
source would be repeated more often than the limit.  The weights then turn into
token budgets, and the budgets into permutations of each source, epoch after
epoch, cut into blocks of the mixed stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, fresh, scratch

STEPS = 40
#: Parts that each source is split into where its rows meet its plan, so that no task holds a whole source.
SALTS = 64
#: Sources whose plan is broadcast, at most (some 100 bytes each); more of them are joined by key.
MOST_SENT = 50_000


def _weights(shares: Column, a: Column) -> Column:
    powers = F.transform(shares, lambda p: F.pow(p, a))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, y: s + y)


def _entropy(shares: Column, a: Column) -> Column:
    """ln(sum p^a) - a sum(p^a ln p) / sum(p^a)"""
    z = _sum(F.transform(shares, lambda p: F.pow(p, a)))
    return F.log(z) - a * _sum(F.transform(shares, lambda p: F.pow(p, a) * F.log(p))) / z


def _repeats(shares: Column, a: Column, epochs: Column) -> Column:
    """The most epochs of any source when the budget is ``epochs`` times all tokens."""
    z = _sum(F.transform(shares, lambda p: F.pow(p, a)))
    return epochs * F.array_max(F.transform(shares, lambda p: F.pow(p, a - 1))) / z


def _bisect(ok, low: float = 0.0, high: float = 1.0) -> Column:
    """The largest exponent for which ok holds (it holds at ``low``), within 2^-STEPS."""
    state = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        fits = ok(mid)
        return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, step, lambda s: s["lo"])


def temperatures(tokens: DataFrame, entropy: float | None, repeats: float, epochs: float | None) -> DataFrame:
    """tokens: source_, tokens (above 0).  Returns source_, tokens, exponent, weight, budget.

    entropy: target as a share of the greatest, ln(number of sources); None: only
    ``repeats`` counts, and the exponent is the smallest within it.  epochs: the
    budget as a multiple of all tokens; None: the smallest budget that shows every
    source whole once.  The exponent is kept to 6 decimals.  There is one entry for
    each source, so the table is as small as the number of sources.
    """
    one = tokens.agg(F.sort_array(F.collect_list(F.struct("source_", "tokens"))).alias("all"), F.sum("tokens").alias("total"))
    one = one.withColumn("p", F.transform("all", lambda x: x["tokens"] / F.col("total")))
    p, n = F.col("p"), F.size("p")
    if entropy is None:
        by_entropy = F.lit(0.0)
    else:
        goal = F.lit(float(entropy)) * F.log(n.cast("double"))
        by_entropy = F.when(_entropy(p, F.lit(1.0)) >= goal, F.lit(1.0)).otherwise(_bisect(lambda a: _entropy(p, a) >= goal))
    if epochs is None:
        # every source whole once: the budget is total / min over s of w_s / p_s, so repeats are a ratio of extremes
        most = lambda a: F.array_max(F.transform(p, lambda x: F.pow(x, a - 1))) / F.array_min(F.transform(p, lambda x: F.pow(x, a - 1)))
    else:
        most = lambda a: _repeats(p, a, F.lit(float(epochs)))
    by_repeats = F.when(most(F.lit(0.0)) <= repeats, F.lit(0.0)).otherwise(_bisect(lambda a: most(a) > repeats))
    one = one.withColumn("exponent", F.round(F.greatest(by_entropy, by_repeats), 6))
    one = one.withColumn("w", F.transform("p", lambda x: F.pow(x, F.col("exponent"))))
    one = one.withColumn("w", F.transform("w", lambda x: x / _sum(F.col("w"))))
    if epochs is None:
        size = F.ceil(F.col("total") / F.array_min(F.zip_with("w", "p", lambda w, x: w / x)) - 1e-6)
    else:
        size = F.round(F.col("total") * float(epochs))
    one = one.withColumn("size", size.cast("double"))
    budget = F.transform("w", lambda w: F.round(F.round(w, 9) * F.col("size")).cast("long"))
    if epochs is None:
        budget = F.zip_with(budget, F.transform("all", lambda x: x["tokens"]), lambda b, t: F.greatest(b, t))
    one = one.withColumn("budget", budget).withColumn("stream", F.aggregate("budget", F.lit(0).cast("long"), lambda s, b: s + b))
    each = one.select("exponent", "stream", F.explode(F.arrays_zip("all", "w", "budget")).alias("x"))
    return each.select(
        F.col("x.all.source_").alias("source_"), F.col("x.all.tokens").alias("tokens"), "exponent",
        F.round(F.col("x.w"), 9).alias("weight"), F.col("x.budget").alias("budget"), "stream",
    )


def plan(units: DataFrame, entropy: float | None = 0.95, repeats: float = 4.0, epochs: float | None = 1.0, block: int = 1_000_000) -> DataFrame:
    """units: source_, n_tokens.  source_, tokens, exponent, weight, budget, whole (epochs), blocks (of the stream)."""
    per = units.groupBy("source_").agg(F.sum("n_tokens").alias("tokens"))
    warm = temperatures(per.filter("tokens > 0"), entropy, repeats, epochs)
    warm = warm.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("stream") / F.lit(block)))).drop("stream")
    # sources without tokens never leave the first block
    cold = per.filter("tokens = 0").select("source_", "tokens", F.lit(1.0).alias("exponent"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).cast("long").alias("blocks"))
    out = warm.unionByName(cold)
    return out.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int"))


def _key(unit: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", unit.cast("string"), epoch.cast("string"), F.lit(str(seed))))


def walk(units: DataFrame, plans: DataFrame, seed: int, epoch: Column) -> DataFrame:
    """units: id_, source_, n_tokens.  One row for each unit and epoch, with the plan, key and upto.

    epoch: those to go through, an array.  upto: tokens of the source's stream up to
    the unit and with it, in the order of key; sums go bin by bin, then within a bin.
    """
    # as many bins as a bin has units, about, if all are of one source
    n, digits = units.count(), 1
    while 16 ** (2 * digits) < n:
        digits += 1
    plans = plans.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    x = units.withColumn("salt_", F.pmod(F.xxhash64("id_"), F.lit(SALTS)).cast("int")).join(plans, ["source_", "salt_"])
    x = x.withColumn("epoch", F.explode(epoch))
    x = x.withColumn("key", _key(F.col("id_"), F.col("epoch"), seed))
    x = x.withColumn("bin", F.substring("key", 1, digits))
    sums = x.groupBy("source_", "epoch", "bin").agg(F.sum("n_tokens").alias("sum_"))
    before = W.partitionBy("source_", "epoch").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source_", "epoch", "bin", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("before_"))
    local = F.sum("n_tokens").over(W.partitionBy("source_", "epoch", "bin").orderBy("key", "id_").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("upto", local).join(sums, ["source_", "epoch", "bin"])
    return x.withColumn("upto", F.col("upto") + F.col("before_") + F.col("epoch") * F.col("tokens"))


def draw(units: DataFrame, seed: int = 7, **how) -> DataFrame:
    """units: id_, source_, n_tokens.  One row for each time that a unit is drawn; how: see ``plan``.

    Adds exponent, weight, epoch, block and place.  An epoch goes through a source
    in the order of md5(id:epoch:seed); the last one stops before the unit that
    would pass the budget.  A drawn unit's block is its share of the way through
    its source's budget; within a block all sources are mixed by the same key.
    Units without tokens, and sources of such only, take part in whole epochs.
    """
    x = walk(units, plan(units, **how), seed, F.sequence(F.lit(0), F.col("whole")))
    x = x.filter((F.col("epoch") < F.col("whole")) | ((F.col("upto") <= F.col("budget")) & (F.col("n_tokens") > 0)))
    at = (F.col("upto") - F.col("n_tokens")) * F.col("blocks") / F.greatest(F.col("budget"), F.lit(1))
    x = x.withColumn("block", F.least(F.floor(at), F.col("blocks") - 1).cast("long"))
    x = x.withColumn("place", F.row_number().over(W.partitionBy("block").orderBy("key", "id_", "epoch")) - 1)
    return x.select(*units.columns, "exponent", "weight", "epoch", "block", "place")


def tokens(text: Column) -> Column:
    """Words of a text; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The mixed stream of doc_id, source, n_tokens (see ``draw``).

    A null source is a source by itself; repeated rows of one doc_id are drawn as
    one unit with their tokens added up; empty tables give an empty stream.
    """
    units = docs.groupBy(F.col(key).alias("id_"), F.col(source).alias("src")).agg(F.sum(tokens(F.col(text))).alias("n_tokens"))
    units = scratch(units.select("id_", F.coalesce("src", F.lit("\0")).alias("source_"), "n_tokens"), "mix-units")
    out = draw(units, **how)
    return out.withColumn("source_", F.when(F.col("source_") != "\0", F.col("source_"))).withColumnsRenamed({"id_": key, "source_": source})


def mix_rows(docs: DataFrame, text: str = "text", source: str = "source", seed: int = 7, **how) -> DataFrame:
    """As ``mix``, but returns docs' own columns, each row as often as it is drawn.

    A row is told by a 64-bit hash of all its columns; rows equal in all columns are
    drawn together, null values and null sources count as values, a null, empty or
    wordless text has no tokens and is drawn in whole epochs only, and an empty table
    gives an empty result.  Texts are not shuffled: an epoch's order is by key, so the
    last, partial epoch is told by one cut for each source, and rows meet only those.
    """
    (row, src, n, cut) = fresh(docs, "row_", "source_", "times_", "cut_")
    null = F.lit("\0")
    told = docs.withColumn(row, F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))).withColumn(src, F.coalesce(F.col(source).cast("string"), null))
    units = told.groupBy(F.col(row).alias("id_"), F.col(src).alias("source_")).agg(F.sum(tokens(F.col(text))).alias("n_tokens"))
    units = scratch(units, "mix-units")
    plans = scratch(plan(units, **how), "mix-plan")
    last = walk(units, plans, seed, F.array("whole")).filter((F.col("upto") <= F.col("budget")) & (F.col("n_tokens") > 0))
    cuts = last.groupBy("source_").agg(F.max(F.struct("key", "id_")).alias(cut))
    cuts = scratch(plans.select("source_", "whole").join(cuts, "source_", "left").select(F.col("source_").alias(src), F.col("whole").alias(n), cut), "mix-cuts")
    if cuts.count() <= MOST_SENT:
        told = told.join(F.broadcast(cuts), src)
    else:
        (salt,) = fresh(told, "salt_")
        cuts = cuts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = told.withColumn(salt, F.pmod(F.col(row), F.lit(SALTS)).cast("int")).join(cuts, [src, salt]).drop(salt)
    within = F.struct(_key(F.col(row), F.col(n), seed).alias("key"), F.col(row).alias("id_")) <= F.col(cut)
    times = F.col(n) + F.when(F.coalesce(within, F.lit(False)) & (tokens(F.col(text)) > 0), 1).otherwise(0)
    # a sequence down from 0 would not be empty
    copies = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return told.withColumn(n, F.explode(copies)).select(*docs.columns)
