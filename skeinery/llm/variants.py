"""Spelling variants: words one edit apart, and the commoner form each is likely meant to be.

Even-partition pigeonhole join: a word is cut into two halves, whose lengths follow
from its own.  One edit leaves one of the halves whole, so two words one edit apart
agree in a half of the shorter one, in the longer one shifted by one place if the
edit came before it.  Halves are indexed by length and side; every word probes the
words of its own length and those one shorter; what agrees in a half is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, scratch

#: Letters of a run once A-Z are lower case.
LETTERS = r"[a-zÀ-ÿ]+"


def occurrences(docs: DataFrame, every: int | None = 97, text: str = "text", key: str = "doc_id", shortest: int = 5) -> DataFrame:
    """word: one row for each run of letters of at least ``shortest`` code points.

    With ``every``, runs lose a code point where it divides the CRC-32 of key, colon
    and run: noise that a repeated run of a document repeats.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(LETTERS), F.lit(0))
    out = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode(runs).alias("word")).filter(F.length("word") >= shortest)
    if every:
        out = out.withColumn("_h", F.crc32(F.concat_ws(":", "_key", "word")))
        at = F.pmod("_h", F.length("word")).cast("int")
        less = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
        out = out.withColumn("word", F.when(F.col("_h") % every == 0, less).otherwise(F.col("word"))).filter(F.length("word") >= shortest)
    return out.select("word")


def vocabulary(words: DataFrame, least: int = 3) -> DataFrame:
    """word, n of all words that occur ``least`` times or more."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _part(word: Column, start: Column, size: Column) -> Column:
    return word.substr(start + 1, size)


def near_pairs(vocab: DataFrame) -> DataFrame:
    """a, na, b, nb: every two words one insertion, deletion or replacement apart, once.

    b is the longer one, or of equal length the one later in code-point order.  A
    pair that agrees in both halves is kept under the first, so none comes twice and
    nothing is shuffled to drop doubles.
    """
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    piece = lambda side, text: F.struct(F.lit(side).alias("side"), text.alias("piece"))
    halves = F.array(piece(0, _part(F.col("word"), F.lit(0), half)), piece(1, _part(F.col("word"), half, size - half)))
    index = vocab.select(F.col("word").alias("a"), F.col("n").alias("na"), size.alias("size"), F.explode(halves).alias("h")).select("a", "na", "size", "h.side", "h.piece")

    short = F.floor((size - 1) / 2).cast("int")  # half of a word one shorter
    shifted = F.array(piece(0, _part(F.col("word"), F.lit(0), short)), piece(1, _part(F.col("word"), short + 1, size - 1 - short)))
    probe = lambda many, of: F.transform(of, lambda h: F.struct(many.alias("size"), h["side"].alias("side"), h["piece"].alias("piece")))
    probes = vocab.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.explode(F.concat(probe(size, halves), probe(size - 1, shifted))).alias("p"))
    probes = probes.select("b", "nb", "p.size", "p.side", "p.piece")

    a, b = F.col("a"), F.col("b")
    first = F.floor(F.length(a) / 2).cast("int")
    once = (F.col("side") == 0) | (a.substr(F.lit(1), first) != b.substr(F.lit(1), first))
    found = index.join(probes, ["size", "side", "piece"])
    return found.filter(((F.length(a) < F.length(b)) | (a < b)) & once & (F.levenshtein(a, b, 1) == 1)).select("a", "na", "b", "nb")


def forms(vocab: DataFrame, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n: a word's near words counted, and the commonest of them if ``times`` as common as the word."""
    pairs = near_pairs(vocab)
    one = F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m"))
    two = F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m"))
    each = pairs.select(F.explode(F.array(one, two)).alias("x")).select("x.*")
    best = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    out = vocab.join(best, "word", "left")
    m = -F.col("best.less")
    ok = m >= times * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("best.near")).alias("form"), F.when(ok, m).alias("form_n"))


def roots(table: DataFrame) -> DataFrame:
    """word, root: where following forms ends, for the words that have a form.

    Each form is at least twice as common, so there are no rings and chains are
    short; every round joins the table to itself and doubles the way that is known.
    """
    now = scratch(table.filter("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        longer = now.join(on, F.col("root") == F.col("_word"), "left")
        longer = scratch(longer.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "variant-roots")
        moved = longer.filter("moved").limit(1).count()
        now = longer.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, every: int | None = 97, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of at least 5 letters and 3 occurrences.

    A null text has no words; a null key counts as an empty one; repeated rows count
    each time; of near words equally common the first in code-point order is the
    form; other columns are left out; an empty table gives an empty result.
    """
    vocab = scratch(vocabulary(occurrences(docs, every, text, key)), "variant-words")
    table = scratch(forms(vocab), "variant-forms")
    out = table.join(roots(table), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
