"""Near-duplicates by the similarity of their sets of word n-grams, joined exactly.

Vertical partitioning: n-grams have one global order, the rare ones first; the order
is cut into fragments, what two documents have in common is counted in each fragment
by itself, and the counts are summed for each pair.  Three steps keep the pairs few,
and none of them loses a link:

1. Two similar sets share a part of the n-grams that come first in any order.  By the
   order of hashes, a document's first 30 % are looked up; who shares too few of them
   with anybody has no partner.
2. By the global order (among those that are left), similar sets share one of the
   first 15 %, and where they do, sizes and places bound what they can have in common.
3. Documents that share such an n-gram meet the few among them with the fewest n-grams
   of their own first.  What that joins needs no further look; in the n-grams that
   still connect different components every pair is compared.

Equal sets are one node, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import scratch
from .components import components
from .rolling import mix
from .simhash import _slabs

#: Fragments of the global order.
FRAGMENTS = 8
#: Documents of an n-gram that all others of it meet first.
LEADERS = 4
#: N-grams looked up in one task in the first step, about.
LOOKUP = 1 << 21
#: Bits of the map of documents that passed the first step; where more pass, more are read for nothing.
MAP = 1 << 25
_FEW = np.uint64(0x5851F42D4C957F2D)


def least_overlap(n, num: int, den: int):
    """What a set of n must have in common with any similar one: ceil(n * num / den)."""
    return -(-n * num // den)


def first_part(n, num: int, den: int):
    """How many n-grams are looked up in step 1: those that may differ and as many more, at least one more."""
    other = n - least_overlap(n, num, den)
    return np.minimum(n, 2 * other + 1)


def _node(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set of n-grams."""
    size = np.diff(at).astype(np.uint64)
    g = np.append(np.uint64(0), np.cumsum(mix(h ^ _FEW)))
    return mix(g[at[1:]] - g[at[:-1]] + mix(size + np.uint64(1)))


def _lists(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _sets(n: int, size_of: Callable | None) -> Callable:
    """doc_id, id, size and n-grams (all, or the first of them by hash) of each row of doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, at in _slabs(b, n):
                size = np.diff(at)
                many = size if size_of is None else size_of(size)
                rank = np.arange(len(h)) - np.repeat(at[:-1], size)
                few = h[rank < np.repeat(many, size)]
                cols = [b.column("doc_id")[i:j], pa.array(_node(h, at).view(np.int64)), pa.array(size.astype(np.int64)), _lists(few.view(np.int64), many)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "id", "size", "grams"])

    return run


_SET = "doc_id long, id long, size long, grams array<long>"


def sets(docs: DataFrame, n: int, size_of: Callable | None = None) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_sets(n, size_of), _SET)


#: What an entry of a part is: an n-gram of a set, an n-gram that is shared, or a set's count of such.
ONE, SHARED, COUNT = 0, 1, 2


def _pieces(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about so many n-grams, one row at least."""
    at = b.column("grams").offsets.to_numpy()
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield b.slice(i, j - i)
        i = j


def _dealt(parts: int, rooted: bool) -> Callable:
    """part and its entries: grams, ids, kind (and roots).

    An n-gram that several sets of a batch hold (of different roots, if there are
    roots) is known to be shared: it is sent once for the batch, and each of those
    sets gets a count, dealt by its id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in _pieces(whole, LOOKUP // 4)):
            grams = b.column("grams")
            g = grams.flatten().to_numpy().view(np.uint64)
            own, many = b.column("id").to_numpy(), np.diff(grams.offsets.to_numpy())
            ids = np.repeat(own, many)
            roots = np.repeat(b.column("root").to_numpy(), many) if rooted else ids
            o = np.lexsort((ids, roots, g))
            g, ids, roots = g[o], ids[o], roots[o]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (ids[1:] != ids[:-1])
            g, ids, roots = g[new], ids[new], roots[new]
            first, many = _heads(g)
            hot = np.repeat(roots[first] != roots[first + many - 1], many)
            own, count = np.unique(ids[hot], return_counts=True)
            sent = ~hot
            sent[first] = True
            kind = np.append(np.where(hot[sent], SHARED, ONE), np.full(len(own), COUNT)).astype(np.int8)
            part = np.append(g[sent] % np.uint64(parts), own.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            g, ids, roots = np.append(g[sent].view(np.int64), count), np.append(ids[sent], own), np.append(roots[sent], own)
            o = np.lexsort((ids, part))
            part, g, ids, roots, kind = part[o], g[o], ids[o], roots[o], kind[o]
            heads, many = _heads(part)
            cols = [pa.array(part[heads]), _lists(g, many), _lists(ids, many), _lists(kind, many)]
            names = ["part", "grams", "ids", "kind"]
            if rooted:
                cols, names = [*cols, _lists(roots, many)], [*names, "roots"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _flat(t: pa.Table, *names: str) -> Iterator[np.ndarray]:
    """The entries of columns of lists."""
    return (np.concatenate([np.zeros(0, np.int8), *(x.flatten().to_numpy() for x in t.column(c).chunks)]) for c in names)


def _heads(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and their lengths."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return first, np.diff(np.append(first, len(x)))


def _answers(parts: int, ids: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """part and lists of what is said of the sets that are dealt to it by id: one row for each part, whatever the number of sets."""
    part = (ids.view(np.uint64) % np.uint64(parts)).astype(np.int32)
    o = np.lexsort((ids, part))
    first, many = _heads(part[o])
    return pa.table({"part": part[o][first], "ids": _lists(ids[o], many)} | {c: _lists(x[o], many) for c, x in columns.items()})


def _looked_up(t: pa.Table, parts: int) -> pa.Table:
    """How many n-grams of this part a set shares (with other roots), and the counts that were sent here."""
    g, ids, kind = _flat(t, "grams", "ids", "kind")
    roots = next(_flat(t, "roots")) if "roots" in t.column_names else ids
    known = kind == COUNT
    sets, counts = [ids[known]], [g[known]]
    g, ids, roots, kind = g[~known], ids[~known], roots[~known], kind[~known]
    if len(g):
        o = np.lexsort((ids, roots, g))
        g, ids, roots, kind = g[o], ids[o], roots[o], kind[o]
        first, many = _heads(g)
        shared = (roots[first] != roots[first + many - 1]) | (np.maximum.reduceat(kind, first) == SHARED)
        new = np.append(True, (g[1:] != g[:-1]) | (ids[1:] != ids[:-1]) | (kind[1:] != kind[:-1]))
        ids = ids[np.repeat(shared, many) & (kind == ONE) & new]  # whose a SHARED one was is told by the counts
        sets.append(ids)
        counts.append(np.ones(len(ids), np.int64))
    own, total = _summed(np.concatenate(sets), np.concatenate(counts))
    return _answers(parts, own, counts=total.astype(np.int32))


def _summed(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(ids, return_inverse=True)
    return own, np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)


def _totals(t: pa.Table) -> pa.Table:
    own, total = _summed(*_flat(t, "ids", "counts"))
    return pa.table({"id": own, "shared": total})


def _sum(df: DataFrame, c: Column | str) -> int:
    return df.agg(F.sum(c)).first()[0] or 0


def promising(rows: DataFrame, nodes: DataFrame, num: int, den: int, roots: DataFrame | None = None) -> DataFrame:
    """nodes (id, least, size) that share enough of their first n-grams with others; with roots (doc_id, root), of another root.

    Take two similar sets and of their first parts the one that ends first.  All its
    n-grams that the other set holds are in the other's first part, and no more than
    size - least_overlap are missing there, so other + 1 are shared, or all that must
    be (see ``first_part``); least of all if the partner is as small as it may be.
    """
    parts = 1 + _sum(rows, F.size("grams")) // (LOOKUP if roots is None else LOOKUP // 2)  # roots make entries larger
    each, entries = rows.filter("size > 0").select("id", "grams"), "part int, grams array<long>, ids array<long>, kind array<byte>"
    if roots is not None:
        each = rows.filter("size > 0").join(roots, "doc_id", "left").select("id", "grams", F.coalesce("root", "doc_id").alias("root"))
        entries += ", roots array<long>"
    dealt = each.mapInArrow(_dealt(parts, roots is not None), entries)
    answers = dealt.groupBy("part").applyInArrow(lambda t: _looked_up(t, parts), "part int, ids array<long>, counts array<int>")
    counted = answers.groupBy("part").applyInArrow(_totals, "id long, shared long")
    need = lambda n: F.ceil(n * num / F.lit(den)).cast("long")
    small = need(F.col("size"))
    enough = F.least(need(small), small - need(small) + 1)
    return nodes.join(counted, "id").filter(F.col("shared") >= enough).select("id", "least", "size")


def _bit(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(MAP)).cast("long")


def _marked(ids: DataFrame, bit: Column) -> bytes:
    """A map of MAP bits, in which each row has its own: at most 4 MB, whatever the number of documents."""
    bit = bit + 1  # buckets and their bits are counted from 1
    maps = ids.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
    out = np.zeros(MAP // 8, np.uint8)
    for b, m in maps:
        out[4096 * (b - 1) : 4096 * b] = np.frombuffer(m, np.uint8)
    return out.tobytes()


def _held(marks: bytes, bit: np.ndarray) -> pa.Array:
    return pa.array((np.frombuffer(marks, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool))


def whole_sets(docs: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """id, size, grams of the nodes ``some`` (id, least), each from the rows of its least document; no text is moved.

    Repeated rows come again, and so do the few other sets whose document and id meet
    bits of the maps; they are as similar to others as their likes in ``some``.
    """
    rows, ids = (docs.sparkSession.sparkContext.broadcast(_marked(some, bit)) for bit in (_bit("least"), F.pmod("id", F.lit(MAP))))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["doc_id", "text"]).filter(_held(rows.value, b.column("bit").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sets(n, None)(picked(batches)):
            yield b.filter(_held(ids.value, b.column("id").to_numpy() % MAP)).select(["id", "size", "grams"])

    return docs.select("doc_id", "text", _bit("doc_id").alias("bit")).mapInArrow(run, "id long, size long, grams array<long>")


def _spread(parts: int) -> Callable:
    """part and its entries: grams, ids, sizes; of many sets at once."""

    def sent(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        many = np.concatenate([np.diff(b.column("grams").offsets.to_numpy()) for b in held])
        g, ids, sizes = (np.concatenate([c(b) for b in held]) for c in (lambda b: b.column("grams").flatten().to_numpy(), lambda b: b.column("id").to_numpy(), lambda b: b.column("size").to_numpy()))
        part = (g.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        o = np.argsort(part, kind="stable")
        first, each = _heads(part[o])
        cols = [pa.array(part[o][first]), *(_lists(x[o], each) for x in (g, np.repeat(ids, many), np.repeat(sizes.astype(np.int32), many)))]
        return pa.RecordBatch.from_arrays(cols, names=["part", "grams", "ids", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in (piece for whole in batches for piece in _pieces(whole, LOOKUP // 4)):
            held.append(b)
            n += len(b.column("grams").flatten())
            if n >= LOOKUP // 4:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    return run


def _frequent(t: pa.Table, parts: int) -> pa.Table:
    """The n-grams of this part that several sets hold, with the power of two of their number, to these sets."""
    g, ids, sizes = _flat(t, "grams", "ids", "sizes")
    o = np.lexsort((ids, g))
    g, ids, sizes = g[o], ids[o], sizes[o]
    new = np.append(True, (g[1:] != g[:-1]) | (ids[1:] != ids[:-1]))[: len(g)]
    g, ids, sizes = g[new], ids[new], sizes[new]
    _, many = _heads(g)
    often = np.repeat(np.frexp(many)[1].astype(np.int8), many)
    some = np.repeat(many > 1, many)
    return _answers(parts, ids[some], grams=g[some], sizes=sizes[some], often=often[some])


def _arranged(t: pa.Table, num: int, den: int) -> pa.Table:
    """id, size, lone, grams of the sets that share enough."""
    g, ids, sizes, often = _flat(t, "grams", "ids", "sizes", "often")
    o = np.lexsort((g, often, ids))
    g, ids, sizes, often = g[o], ids[o], sizes[o].astype(np.int64), often[o]
    first, many = _heads(ids)
    ok = many >= least_overlap(sizes[first], num, den)
    keep = np.repeat(ok, many)
    first, many = first[ok], many[ok]
    grams = pa.StructArray.from_arrays([pa.array(often[keep].astype(np.int32)), pa.array(g[keep])], names=["often", "gram"])
    return pa.table({"id": ids[first], "size": sizes[first], "lone": sizes[first] - many, "grams": _lists(grams, many)})


def ordered(full: DataFrame, total: int, num: int, den: int) -> DataFrame:
    """id, size, lone, grams: the n-grams that others share, in the global order, of sets that share enough.

    The order goes by the number of sets that hold an n-gram, in powers of two, then
    by hash; lone: how many n-grams come before, which the set has for itself.  Sets
    may be repeated; total: n-grams of all sets, about.  N-grams meet by hash, and
    what is said of them goes back to the sets, in lists both times.
    """
    parts = 1 + total // (LOOKUP // 2)
    spread = full.mapInArrow(_spread(parts), "part int, grams array<long>, ids array<long>, sizes array<int>")
    answers = spread.groupBy("part").applyInArrow(lambda t: _frequent(t, parts), "part int, ids array<long>, grams array<long>, sizes array<int>, often array<byte>")
    return answers.groupBy("part").applyInArrow(lambda t: _arranged(t, num, den), "id long, size long, lone long, grams array<struct<often:int,gram:long>>")


def _could(a: str, b: str, num: int, den: int) -> Column:
    """May two sets that share the n-gram at their places be similar, by sizes and places?"""
    sa, sb = F.col(f"{a}.size"), F.col(f"{b}.size")
    most = F.least(sa - F.col(f"{a}.place"), sb - F.col(f"{b}.place"))
    return (F.least(sa, sb) * den >= F.greatest(sa, sb) * num) & (most * (den + num) >= (sa + sb) * num)


def _prefixes(lists: DataFrame, num: int, den: int) -> DataFrame:
    """gram, id, size, place, lone: the first n-grams of each set, of which similar sets share one."""
    first = F.col("size") - F.ceil(F.col("size") * num / F.lit(den)).cast("long") + 1
    heads = F.slice("grams", F.lit(1), F.greatest(F.lit(0), first - F.col("lone")).cast("int"))
    out = lists.select("id", "size", "lone", F.posexplode(heads).alias("i", "g"))
    return out.select(F.col("g.gram").alias("gram"), "id", "size", (F.col("lone") + F.col("i")).alias("place"), "lone")


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _mixed(prefixes: DataFrame, roots: DataFrame) -> DataFrame:
    """The prefixes and their root (of node, root), of n-grams that different components share."""
    own = prefixes.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = own.groupBy("gram").agg(F.min("root").alias("l"), F.max("root").alias("h")).filter("l <> h").select("gram")
    return scratch(own.join(mixed, "gram"), "ngram-mixed")


def leading_pairs(prefixes: DataFrame, num: int, den: int, roots: DataFrame | None = None) -> DataFrame:
    """a, b: every set with the few of each of its n-grams that have the least share of their own; with roots, of other components."""
    own = prefixes.withColumn("root", F.col("id")) if roots is None else _mixed(prefixes, roots)
    w = W.partitionBy("gram").orderBy(F.col("lone") / F.col("size"), "id")
    lead = own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= LEADERS)
    x, y = lead.alias("x"), own.alias("y")
    return _pairs(x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.root") != F.col("y.root")) & _could("x", "y", num, den)))


def other_pairs(prefixes: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: all sets that share a first n-gram and are in different components (node, root)."""
    own = _mixed(prefixes, roots)
    x, y = own.alias("x"), own.alias("y")
    return _pairs(x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & _could("x", "y", num, den)))


def fragmented(lists: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """id, size, fragment, grams: every set cut at the same places of the global order, which halve, quarter .. all its n-grams."""
    counts = sorted(lists.select(F.explode("grams.often").alias("often")).groupBy("often").count().collect())  # one row for each power of two
    total, before, cuts = sum(n for _, n in counts), 0, []
    for often, n in counts:
        cuts.append(F.struct(F.lit(often).alias("key"), F.struct(F.lit(before / total).alias("from"), F.lit(n / total).alias("share")).alias("value")))
        before += n
    cuts = F.map_from_entries(F.array(*cuts)) if cuts else F.lit(None).cast("map<int,struct<from:double,share:double>>")

    def fragment(g: Column) -> Column:
        c = F.element_at(cuts, g["often"])
        along = g["gram"] / F.lit(2.0**64) + 0.5  # hashes are even, so a class is cut by value
        return F.least(F.lit(fragments - 1), F.floor((c["from"] + along * c["share"]) * fragments)).cast("int")

    named = lists.select("id", "size", F.transform("grams", lambda g: F.struct(fragment(g).alias("f"), g["gram"].alias("gram"))).alias("grams"))
    own = lambda f: F.transform(F.filter("grams", lambda g: g["f"] == f), lambda g: g["gram"])
    parts = F.transform(F.sequence(F.lit(0), F.lit(fragments - 1)), lambda f: F.struct(f.alias("fragment"), own(f).alias("grams")))
    return named.select("id", "size", F.explode(F.filter(parts, lambda p: F.size(p["grams"]) > 0)).alias("p")).select("id", "size", "p.fragment", "p.grams")


def similar(pairs: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: the pairs that are similar; overlaps are counted for each fragment and summed for each pair."""
    one = parts.select(F.col("id").alias("a"), F.col("size").alias("na"), "fragment", F.col("grams").alias("ga"))
    two = parts.select(F.col("id").alias("b"), F.col("size").alias("nb"), "fragment", F.col("grams").alias("gb"))
    met = pairs.join(one, "a").join(two, ["b", "fragment"])
    both = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("both"))
    both = both.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return both.filter(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num).select("a", "b")


def linked(lists: DataFrame, num: int, den: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) that the leaders have found, what they connect (node, root), and the links that are missing then.

    With known links (a, b; b: the least of a's component) only sets that these leave
    apart are compared.
    """
    prefixes, parts = scratch(_prefixes(lists, num, den), "ngram-prefixes"), scratch(fragmented(lists), "ngram-parts")
    tried = scratch(leading_pairs(prefixes, num, den, known and known.toDF("node", "root")), "ngram-pairs")
    links = scratch(similar(tried, parts, num, den), "ngram-links")
    roots = scratch(components(links.unionByName(known) if known else links), "ngram-roots")
    rest = other_pairs(prefixes, roots, num, den).join(tried, ["a", "b"], "left_anti")
    return links, roots, scratch(similar(rest, parts, num, den), "ngram-links")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two texts link if the sets of their n-word shingles (A-Z in lower case) have
    den * intersection >= num * union; a text of fewer words is one shingle.  A null
    or wordless text has none and links with nothing, not even its like.
    component_id is the smallest doc_id that links reach (null ones apart); equal sets
    are linked whatever their number, repeated rows are each returned, other columns
    are left out, an empty table gives an empty result.  N-grams and sets are told
    apart by 64-bit hashes.
    """
    last = F.lit(2**63 - 1).cast("long")
    docs = docs.select(F.coalesce(F.col(key).cast("long"), last).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = scratch(sets(docs, n, lambda size: first_part(size, num, den)), "ngram-rows")
    nodes = rows.filter("size > 0").groupBy("id", "size").agg(F.min("doc_id").alias("least"))
    some = scratch(promising(rows, nodes, num, den), "ngram-some")
    lists = scratch(ordered(whole_sets(docs, some, n), _sum(some, "size"), num, den), "ngram-lists")
    links, roots, more = linked(lists, num, den)
    if more.limit(1).count():
        roots = scratch(components(links.unionByName(more)), "ngram-roots")

    member = nodes.select("id", "least").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    member = scratch(member, "ngram-member")
    lead = member.groupBy("root").agg(F.min("least").alias("lead"))
    member = member.join(lead, "root").select("id", "lead")
    out = rows.select("doc_id", "id", "size").join(member, "id", "left")
    lead = F.when(F.col("size") > 0, F.col("lead")).otherwise(F.col("doc_id"))
    return out.select(F.nullif("doc_id", last).alias("doc_id"), F.col("size").alias("n_shingles"), F.nullif(lead, last).alias("component_id"))


def missing_links(docs: DataFrame, known: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """a, b: what the known components lack, so that no two similar texts stay apart.

    docs: id (one for each different text) and text, repeated rows allowed; known:
    node, root of the ids that another search has linked.  Texts of equal sets are
    linked, wordless ones too.  Only sets that share enough with other components are
    compared, so the better the other search, the less is left to do; of two groups
    the leaders meet first, and what they connect is left.  With no known links this
    finds what connects all.  Null and empty texts are alike; an empty table gives none.
    """
    docs = docs.select(F.col("id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = scratch(sets(docs, n, lambda size: first_part(size, num, den)), "missing-rows")
    nodes = scratch(rows.groupBy("id", "size").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "missing-nodes")
    same = rows.join(nodes.filter("least <> most").select("id", "least"), "id").filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()

    root = lambda c: known.select(F.col("node").alias(c), "root")
    few = promising(rows, nodes.filter("size > 0").select("id", "least", "size"), num, den, root("doc_id")).join(root("least"), "least", "left")
    few = scratch(few.select("id", "least", "size", F.coalesce("root", "least").alias("root")), "missing-few")
    if few.isEmpty():
        return same
    lists = scratch(ordered(whole_sets(docs, few, n), _sum(few, "size"), num, den), "missing-lists")
    lead = few.groupBy("root").agg(F.min("id").alias("b"))
    links, _, more = linked(lists, num, den, scratch(few.join(lead, "root").select(F.col("id").alias("a"), "b").filter("a <> b"), "missing-known"))
    links = links.unionByName(more)
    text = lambda c: few.select(F.col("id").alias(c), F.col("least").alias(f"t{c}"))
    return same.unionByName(links.join(text("a"), "a").join(text("b"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")))
