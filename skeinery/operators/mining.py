"""Text statistics, regression and clustering."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import patterns as p
from ..sources.sinks import stored

# Words that label nothing.
STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "have", "has", "had", "you", "your", "but", "not", "can", "could", "should",
    "would", "they", "them", "their", "there", "any", "all", "into", "out", "user", "users", "ticket", "tickets", "support", "system", "issue", "issues",
    "feature", "process", "provide", "improve", "implement", "create", "ensure", "clear", "clarity", "options", "available", "make", "more", "better",
    "ban", "bans", "banned", "block", "blocked", "blocking",
]


@cache
def stop_words() -> list[str]:
    """English words that term statistics leave out: Spark's own list, from its library as it is installed, else by its session."""
    import glob
    import os
    import zipfile

    import pyspark

    for jar in glob.glob(os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            return z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords("english"))


def _accents() -> tuple[str, str]:
    """Small Latin letters with marks, and the letters below the marks, as compatibility decomposition has it."""
    import unicodedata

    found = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xDF, 0x250) if chr(c).islower()]
    pairs = [(a, d[0]) for a, d in found if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(d for _, d in pairs)


#: Three characters or more, apostrophes and hyphens inside.
TERM = r"[\p{L}\p{N}_][\p{L}\p{N}_'-]+[\p{L}\p{N}_]"


#: Words that terms are numbered by, at most; beyond it terms are grouped as they are.
MOST_CODED = 200_000


def _words(text: Column, stop: list[str] | None = None, pattern: str = TERM) -> Column:
    """Words in lower case without accents, stop words left out."""
    words = F.regexp_extract_all(F.translate(F.lower(text), *_accents()), F.lit(pattern), F.lit(0))
    drop = stop_words() if stop is None else stop
    return F.filter(words, lambda w: ~w.isin(drop)) if drop else words


def tokens(df: DataFrame, key: str, text: str, grams: int = 1, stop: list[str] | None = None, pattern: str = TERM) -> DataFrame:
    """key, w: a row for each word, and for each run of up to ``grams`` words, of a text.

    Words are lower case without accents; stop words are out before runs are formed.
    """
    df = df.select(key, _words(F.col(text), stop, pattern).alias("ws"))

    def runs(n: int) -> Column:
        at = F.when(F.size("ws") >= n, F.sequence(F.lit(1), F.size("ws") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice("ws", i, n), " "))

    return df.select(key, F.explode(F.concat("ws", *[runs(n) for n in range(2, grams + 1)])).alias("w"))


def _runs(ws: pa.Array, words: pa.Array, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of the runs of up to ``grams`` words that are all among ``words``, by row and code.

    A word's code is its place from 1; a run's has the codes of its words as digits.
    """
    base = len(words) + 1
    row = np.repeat(np.arange(len(ws)), pc.fill_null(pc.list_value_length(ws), 0).to_numpy(zero_copy_only=False))
    word = pc.fill_null(pc.index_in(pc.list_flatten(ws), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    code, rows, codes = word, [row], [word]
    for n in range(2, min(grams, len(row)) + 1):
        whole = (row[n - 1 :] == row[: len(row) - n + 1]) & (code[:-1] > 0) & (word[n - 1 :] > 0)
        code = np.where(whole, code[:-1] * base + word[n - 1 :], 0)
        rows.append(row[: len(code)])
        codes.append(code)
    row, code = np.concatenate(rows), np.concatenate(codes)
    row, code = row[code > 0], code[code > 0]
    o = np.lexsort((code, row))
    row, code = row[o], code[o]
    heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))) if len(row) else np.zeros(0, int)
    return row[heads], code[heads], np.diff(np.append(heads, len(row)))


def _lists(row: np.ndarray, n: int, **columns: pa.Array) -> pa.Array:
    """One list of structs for each of n rows."""
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _counted(words: list[str] | None, grams: int) -> Callable:
    """Counts of a batch's texts: of all words (w, df, total) or, given words, of runs of several of these (code, df, total).

    Batches: ws, and whether the text counts as a document; an empty word counts those that do and have words.
    """
    known = None if words is None else pa.array(words, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = b.column(0)
            names = pc.unique(pc.list_flatten(ws)) if known is None else known
            row, code, tf = _runs(ws, names, grams)
            if known is not None:
                row, code, tf = (v[code > len(known)] for v in (row, code, tf))
            found, at = np.unique(code, return_inverse=True)
            df, total = np.bincount(at, minlength=len(found)), np.bincount(at, tf, minlength=len(found)).astype(np.int64)
            if known is None:
                docs = np.count_nonzero(np.bincount(row, minlength=b.num_rows)[b.column(1).to_numpy(zero_copy_only=False)])
                found, df, total = pa.concat_arrays([names.take(pa.array(found - 1)).cast(pa.string()), pa.array([""])]), np.append(df, docs), np.append(total, docs)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df), pa.array(total)], names=["w" if known is None else "code", "df", "total"])

    return run


def _numbered(words: list[str], grams: int) -> None:
    if (len(words) + 1) ** grams >= 1 << 62:
        raise ValueError("runs are too long for their codes")


def _spelled(spark: SparkSession, x: DataFrame, words: list[str], grams: int) -> DataFrame:
    """x with w, the term that code stands for; words whose number is checked."""
    base = len(words) + 1
    named = spark.createDataFrame(list(enumerate(words, 1)), "digit long, word string") if words else spark.createDataFrame([], "digit long, word string")
    x = x.withColumn("w", F.lit("")).withColumn("left_", F.col("code"))
    for _ in range(grams):
        x = x.withColumn("digit", F.col("left_") % base).join(F.broadcast(named), "digit", "left")
        x = x.withColumn("w", F.when(F.col("word").isNull(), F.col("w")).when(F.col("w") == "", F.col("word")).otherwise(F.concat_ws(" ", "word", "w")))
        x = x.withColumn("left_", F.floor(F.col("left_") / base).cast("long")).drop("digit", "word")
    return x.drop("left_")


def _repeats(df: DataFrame, key: str) -> bool:
    return not df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _plain_rows(df: DataFrame, key: str, text: str, grams: int, least: int, most: float, features: int) -> tuple[DataFrame, list[str]]:
    """``tfidf_rows`` where keys repeat or words are too many: terms of a key are counted by a shuffle."""
    tok = tokens(df, key, text, grams)
    tf = stored(tok.groupBy(key, "w").agg(F.count("*").alias("tf")), "term-counts")
    n = tf.agg(F.count_distinct(key)).first()[0]
    terms = tf.groupBy("w").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    terms = terms.filter((F.col("df") >= least) & (F.col("df") <= most * n)).orderBy(F.desc("total"), "w").limit(features)
    found = sorted(terms.select("w", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).collect())
    places = df.sparkSession.createDataFrame([(w, i, f) for i, (w, f) in enumerate(found)], "w string, i int, idf double")
    x = tf.join(F.broadcast(places), "w").withColumn("x", F.col("tf") * F.col("idf"))
    x = x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return x.select(key, F.col("e.i").alias("i"), F.transform("e.x", lambda v: v / F.col("size")).alias("x")), [w for w, _ in found]


def tfidf_rows(df: DataFrame, key: str, text: str, grams: int, least: int, most: float, features: int = 6000) -> tuple[DataFrame, list[str]]:
    """Rows (key and the other columns of df but text, i, x: places of terms ascending, and weights) and the terms in order.

    Smooth idf, unit length; texts without a term are out, and so are terms in fewer
    than ``least`` or over ``most`` of the documents; of the others the ``features``
    most frequent count (ties: by term).  A run is no more frequent than its words, and
    in no more documents: so words are counted first, and of runs only those of words as
    frequent as the last word that would be kept.  Texts stay where they are; only
    where keys repeat are counts brought together by key.
    """
    spark, keep = df.sparkSession, [c for c in df.columns if c not in (key, text)]

    def plain() -> tuple[DataFrame, list[str]]:
        rows, terms = _plain_rows(df, key, text, grams, least, most, features)
        return (rows.join(df.select(key, *keep), key) if keep else rows), terms

    if _repeats(df, key):
        return plain()
    x = df.select(key, *keep, _words(F.col(text)).alias("ws"))
    told = x.select("ws", F.col(key).isNotNull().alias("told"))  # a null key is no document
    sums = [F.sum("df").alias("df"), F.sum("total").alias("total")]
    words = told.mapInArrow(_counted(None, 1), "w string, df long, total long").groupBy("w").agg(*sums)
    words = stored(words.filter((F.col("df") >= least) | (F.col("w") == "")), "words")
    n = (words.filter("w = ''").agg(F.max("df")).first()[0]) or 0
    words = words.filter((F.col("w") != "") & (F.col("df") >= least))
    fits = (F.col("df") >= least) & (F.col("df") <= most * n)
    last = words.filter(fits).orderBy(F.desc("total")).limit(features).agg(F.count("*").alias("n"), F.min("total").alias("total")).first()
    often = words.filter(F.col("total") >= F.lit(last.total if last.n == features else 0))
    found = often.orderBy("w").limit(MOST_CODED + 1).collect()
    if len(found) > MOST_CODED:
        return plain()
    known = [r.w for r in found]
    _numbered(known, grams)
    number = {w: k for k, w in enumerate(known, 1)}
    terms = often.filter(fits)
    if grams > 1:
        runs = told.mapInArrow(_counted(known, grams), "code long, df long, total long").groupBy("code").agg(*sums)
        if last.n == features:
            runs = runs.filter(F.col("total") >= last.total)
        terms = terms.unionByName(_spelled(spark, runs.filter(fits), known, grams).select("w", "df", "total"))
    terms = terms.orderBy(F.desc("total"), "w").limit(features)
    terms = sorted(terms.select("w", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).collect())
    codes = np.zeros(len(terms), np.int64)
    for k, (w, _) in enumerate(terms):
        for part in w.split(" "):
            codes[k] = codes[k] * (len(known) + 1) + number[part]
    o = np.argsort(codes)
    codes, idf, listed = codes[o], np.array([f for _, f in terms])[o], pa.array(known, pa.string())

    @F.arrow_udf("array<struct<i:int,x:double>>")
    def weigh(ws: pa.Array) -> pa.Array:
        row, code, tf = _runs(ws, listed, grams)
        at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
        ok = codes[at] == code if len(codes) else np.zeros(len(code), bool)
        row, at, v = row[ok], at[ok], tf[ok] * idf[at[ok]]
        v = v / np.sqrt(np.bincount(row, v * v, minlength=len(ws)))[row]
        back = np.lexsort((o[at], row))
        return _lists(row, len(ws), i=pa.array(o[at][back].astype(np.int32)), x=pa.array(v[back]))

    rows = x.select(key, *keep, weigh("ws").alias("e")).select(key, *keep, F.col("e.i").alias("i"), F.col("e.x").alias("x"))
    return rows.filter(F.size("i") > 0), [w for w, _ in terms]


def term_weights(rows: DataFrame, terms: list[str], by: list[str]) -> DataFrame:
    """by, w, docs, s: in how many rows a term is, and the sum of its weights; ``rows`` and ``terms`` as of ``tfidf_rows``."""
    x = rows.select(*by, F.inline_outer(F.arrays_zip("i", "x"))).groupBy(*by, "i").agg(F.count("*").alias("docs"), F.sum("x").alias("s"))
    spark = rows.sparkSession
    named = spark.createDataFrame(list(enumerate(terms)), "i int, w string") if terms else spark.createDataFrame([], "i int, w string")
    return x.join(F.broadcast(named), "i").select(*by, "w", "docs", "s")


def cluster_terms(df: DataFrame, key: str, text: str, by: str, n: int) -> DataFrame:
    """The terms of greatest mean tf-idf weight in each cluster; words and pairs of words."""
    size = df.groupBy(by).agg(F.count("*").alias("size"))
    rows, terms = tfidf_rows(df.select(key, by, text), key, text, 2, 3, 0.82)
    s = term_weights(rows.filter(F.col(key).isNotNull()), terms, [by]).join(size, by)
    s = s.withColumn("m", F.round(F.col("s") / F.col("size"), 6)).filter("m > 0")
    s = s.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.desc("m"), "w"))).filter(F.col("k") <= n)
    return s.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda a: a["w"]), ", ").alias("terms"))


def described(summary: DataFrame, x: DataFrame, key: str, text: str, by: str, n: int = 10) -> DataFrame:
    """A summary of clusters with top_terms, the terms of greatest mean tf-idf weight in each."""
    terms = cluster_terms(stored(x.select(key, text, by), "described"), key, text, by, n)
    return summary.join(terms.withColumnRenamed("terms", "top_terms"), by, "left").na.fill("", ["top_terms"])


def _best(x: DataFrame, by: str, n: int) -> DataFrame:
    """x with k, the place by x and w within by, up to n."""
    return x.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.desc("x"), "w"))).filter(F.col("k") <= n)


def class_terms(df: DataFrame, by: str, text: str, n: int, named: int = 4) -> DataFrame:
    """Topics of words and pairs of words by class-based tf-idf: term share in the class times ln(1 + mean class size / corpus count).

    by, name (the class and its ``named`` first terms), representation (its ``n`` first terms).
    A pair is no more frequent in a class than either word, so words are scored first;
    pairs count only of words that are frequent enough for a pair to get among a class's
    first n.  Texts stay where they are.
    """
    spark, kind = df.sparkSession, df.schema[by].dataType.simpleString()
    grouped = df.select(F.col(by).alias("by_"), _words(F.col(text)).alias("ws"))

    def counted(words: list[str] | None) -> Callable:
        known = None if words is None else pa.array(words, pa.string())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(class, w or code, tf) of a batch; without words an empty w has the terms of the class."""
            for b in batches:
                ws, classes = b.column(1), pc.dictionary_encode(b.column(0), null_encoding="encode")
                names = pc.unique(pc.list_flatten(ws)) if known is None else known
                row, code, tf = _runs(ws, names, 1 if known is None else 2)
                long = code > (0 if known is None else len(known))
                c, code, tf = classes.indices.to_numpy()[row[long]], code[long], tf[long]
                if known is None:  # pairs count among the terms of a class
                    sizes = pc.list_value_length(ws).fill_null(0).to_numpy(zero_copy_only=False)
                    c, code, tf = np.append(c, classes.indices.to_numpy()), np.append(code, np.zeros(len(ws), np.int64)), np.append(tf, np.maximum(2 * sizes - 1, 0))
                o = np.lexsort((code, c))
                c, code, tf = c[o], code[o], tf[o]
                heads = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (code[1:] != code[:-1]))) if len(c) else np.zeros(0, int)
                tf = np.add.reduceat(tf, heads).astype(np.int64) if len(c) else np.zeros(0, np.int64)
                term = pa.array(code[heads]) if known is not None else pa.concat_arrays([pa.array([""]), names.cast(pa.string())]).take(pa.array(code[heads]))
                yield pa.RecordBatch.from_arrays([classes.dictionary.take(pa.array(c[heads])), term, pa.array(tf)], names=["by_", "w" if known is None else "code", "tf"])

        return run

    words = grouped.mapInArrow(counted(None), f"by_ {kind}, w string, tf long").groupBy("by_", "w").agg(F.sum("tf").alias("tf"))
    words = stored(words, "class-words")
    sizes = words.filter("w = '' and tf > 0").select("by_", F.col("tf").alias("s"))  # a row for each class
    mean = sizes.agg(F.avg("s")).first()[0] or 0.0
    words = words.filter("w <> ''")

    def scored(c: DataFrame) -> DataFrame:
        c = c.withColumn("f", F.sum("tf").over(W.partitionBy("w"))).join(sizes.withColumnRenamed("by_", "of_"), F.col("by_").eqNullSafe(F.col("of_"))).drop("of_")
        return c.withColumn("x", F.round(F.col("tf") / F.col("s") * F.ln(1 + mean / F.col("f")), 8)).select("by_", "w", "tf", "s", "x")

    x = stored(scored(words), "class-scored")
    last = _best(x, "by_", n).groupBy("by_").agg(F.count("*").alias("many"), F.min("x").alias("last")).withColumnRenamed("by_", "of_")
    most = F.col("tf") / F.col("s") * F.ln(1 + mean / F.col("tf"))  # what a term so frequent in the class has at most
    often = x.join(last, F.col("by_").eqNullSafe(F.col("of_"))).filter((F.col("many") < n) | (most >= F.col("last") - 1e-8)).select("w").distinct()
    known = sorted(r.w for r in often.limit(MOST_CODED + 1).collect())
    if len(known) > MOST_CODED:  # pairs as they are
        pairs = tokens(df.withColumnRenamed(by, "by_"), "by_", text, 2).filter(F.contains("w", F.lit(" "))).groupBy("by_", "w").agg(F.count("*").alias("tf"))
    else:
        codes = grouped.mapInArrow(counted(known), f"by_ {kind}, code long, tf long").groupBy("by_", "code").agg(F.sum("tf").alias("tf"))
        pairs = _spelled(spark, codes, known, 2).select("by_", "w", "tf")
    x = _best(_best(x, "by_", n).drop("k").unionByName(scored(pairs)), "by_", n)
    terms = F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda s: s["w"])
    x = x.groupBy("by_").agg(terms.alias("terms"))
    return x.select(F.col("by_").alias(by), F.concat_ws("_", F.col("by_").cast("string"), F.array_join(F.slice("terms", 1, named), "_")).alias("name"), F.array_join("terms", ", ").alias("representation"))


def labels(df: DataFrame, by: str, text: str, n: int = 6) -> DataFrame:
    """Names from the most frequent words of more than three letters; ties by word."""
    x = df.select(by, F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z\-']{2,}"), F.lit(0))).alias("w")).withColumn("w", F.lower("w"))
    x = x.filter((F.length("w") > 3) & ~F.col("w").isin(STOPWORDS)).groupBy(by, "w").agg(F.count("*").alias("n"))
    x = x.withColumn("k", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "w"))).filter(F.col("k") <= n)
    return x.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda s: s["w"]), "_").alias("label"))


def hashed_grams(df: DataFrame, key: str, text: str, sizes: tuple[int, int] = (3, 5), buckets: int = 384) -> DataFrame:
    """key, bucket, x: counts of character grams within words (padded by a space on either side), by md5, unit length."""
    w = F.transform(F.split(F.lower(text), " "), lambda v: F.concat(F.lit(" "), v, F.lit(" ")))
    grams = lambda v, n: F.when(F.length(v) >= n, F.transform(F.sequence(F.lit(1), F.length(v) - n + 1), lambda i: F.substring(v, i, n))).otherwise(F.array().cast("array<string>"))
    all_ = F.flatten(F.transform(w, lambda v: F.flatten(F.array(*[grams(v, n) for n in range(sizes[0], sizes[1] + 1)]))))
    x = df.select(key, F.explode(all_).alias("g"))
    x = x.withColumn("bucket", F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("long") % buckets).groupBy(key, "bucket").agg(F.count("*").alias("n"))
    return x.select(key, "bucket", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(key)))).alias("x"))


def fallback_wants(desires: DataFrame, tops: DataFrame) -> DataFrame:
    """For each desire the largest want whose top job is its first job hint that any want has."""
    rows = [(d, i, j) for d, jobs in p.DESIRE_JOBS.items() for i, j in enumerate(jobs)]
    hints = desires.sparkSession.createDataFrame(rows, "primary_desire string, i int, job string")
    hit = hints.join(tops, "job").groupBy("primary_desire").agg(F.min_by("want", F.struct("i", -F.col("size"), "want")).alias("want"))
    return desires.join(hit, "primary_desire", "left").select("primary_desire", "want")


# -- regression --------------------------------------------------------------

#: Levels of all factors together that a dense design takes; beyond it the factor with the most is absorbed.
MOST_LEVELS = 1_500
#: Parts in which the sums of an absorbed factor's levels come together.
LEVEL_PARTS = 32
_COEFS = "term string, coef double, se double, z double, p double, r2 double"


class _Design:
    """Columns of a design: numeric ones, and for each factor all levels but the first."""

    def __init__(self, numeric: list[str], levels: dict[str, list[str]], const: bool):
        self.numeric, self.levels, self.const = numeric, levels, const
        self.names = [*(["const"] if const else []), *numeric, *[f"{c}={v}" for c, vs in levels.items() for v in vs[1:]]]

    def __call__(self, pdf) -> np.ndarray:
        import pandas as pd

        x = np.zeros((len(pdf), len(self.names)))
        x[:, : int(self.const)] = 1
        for i, c in enumerate(self.numeric, int(self.const)):
            x[:, i] = pdf[c].to_numpy()
        at = int(self.const) + len(self.numeric)
        for c, vs in self.levels.items():
            code = pd.Categorical(pdf[c], categories=vs).codes
            some = np.flatnonzero(code > 0)
            x[some, at + code[some] - 1] = 1
            at += max(0, len(vs) - 1)
        return x


def _summed(df: DataFrame, f) -> np.ndarray:
    """The sum of f(batch) over all batches: one array from each task."""

    def run(parts):
        import pandas as pd

        total = None
        for pdf in parts:
            m = f(pdf)
            total = m if total is None else total + m
        if total is not None:
            yield pd.DataFrame({"m": [total.ravel().tolist()]})

    sums = df.mapInPandas(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    return np.array([r.v for r in sums.orderBy("i").collect()])


def _by_level(df: DataFrame, f, width: int) -> DataFrame:
    """g, m: sums of f(batch), a row of ``width`` numbers for each row of df, by its level g; a task sums before it sends."""

    def partial(parts):
        import pandas as pd

        for pdf in parts:
            g, at = np.unique(pdf["g"].to_numpy(dtype=str), return_inverse=True)
            o = np.argsort(at, kind="stable")
            m = np.add.reduceat(f(pdf)[o], np.searchsorted(at[o], np.arange(len(g))), axis=0)
            yield pd.DataFrame({"g": g, "m": m.tolist()})

    def total(pdf):
        import pandas as pd

        g, at = np.unique(pdf["g"].to_numpy(dtype=str), return_inverse=True)
        o = np.argsort(at, kind="stable")
        m = np.add.reduceat(np.stack(pdf["m"].to_numpy())[o].reshape(-1, width), np.searchsorted(at[o], np.arange(len(g))), axis=0)
        return pd.DataFrame({"g": g, "m": m.tolist()})

    parts = df.mapInPandas(partial, "g string, m array<double>").withColumn("part", F.pmod(F.xxhash64("g"), F.lit(LEVEL_PARTS)).cast("int"))
    return parts.groupBy("part").applyInPandas(lambda pdf: total(pdf), "g string, m array<double>")


def _coefficients(names: list[str], b: np.ndarray, var: np.ndarray, r2: float) -> list[tuple]:
    se = np.sqrt(np.maximum(var, 0))
    z = np.where(se > 0, b / np.where(se > 0, se, 1), 0.0)
    return [(t, float(c), float(s), float(v), math.erfc(abs(v) / math.sqrt(2)), float(r2)) for t, c, s, v in zip(names, b, se, z, strict=True)]


def ols(df: DataFrame, y: str, numeric: list[str], factors: list[str]) -> DataFrame:
    """term, coef, se, z, p, r2: least squares with fixed effects and HC3 errors.

    Factors are coded against their first level.  The columns in use are kept, then
    two passes go over them: one sums X'X, X'y and the target's moments, the other the
    squared leave-one-out errors times xx'.  What reaches the driver has the size of
    the design (terms squared).  With over MOST_LEVELS levels in all, the factor with
    the most is absorbed (see ``_absorbed``); if the others still have as many, they
    are refused.
    """
    df = df.select(F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in numeric], *[F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("Unknown")).alias(c) for c in factors]).dropna()
    df = stored(df, "design")
    if df.isEmpty():
        return df.sparkSession.createDataFrame([], _COEFS)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in factors])).alias("x")
    found = stored(df.select(pairs).select("x.c", "x.v").distinct(), "levels") if factors else None
    many = dict(found.groupBy("c").count().collect()) if factors else {}
    absorbed = max(many, key=lambda c: (many[c], c)) if sum(many.values()) > MOST_LEVELS else None
    if sum(n for c, n in many.items() if c != absorbed) > MOST_LEVELS:
        raise ValueError(f"the factors but {absorbed} have over {MOST_LEVELS} levels")
    rows = found.filter(F.col("c") != F.lit(absorbed or "")).collect() if factors else []
    levels = {c: sorted(r.v for r in rows if r.c == c) for c in factors if c != absorbed}
    if absorbed:
        return _absorbed(df.withColumnRenamed(absorbed, "g"), _Design(numeric, levels, False), absorbed)
    design = _Design(numeric, levels, True)
    k = len(design.names)

    def moments(pdf):
        x, v = design(pdf), pdf["y"].to_numpy()
        return np.concatenate([(x.T @ x).ravel(), x.T @ v, [len(v), v.sum(), v @ v]])

    g = _summed(df, moments)
    xx, xy, (n, sy, syy) = g[: k * k].reshape(k, k), g[k * k : -3], g[-3:]
    inv = np.linalg.pinv(xx)
    b = inv @ xy

    def meat(pdf):
        x = design(pdf)
        e = (pdf["y"].to_numpy() - x @ b) / np.maximum(1 - ((x @ inv) * x).sum(axis=1), 1e-9)
        return (x * (e * e)[:, None]).T @ x

    cov = inv @ _summed(df, meat).reshape(k, k) @ inv
    r2 = 1 - (syy - b @ xy) / max(syy - sy * sy / n, 1e-12)
    return df.sparkSession.createDataFrame(_coefficients(design.names, b, np.diag(cov), r2), _COEFS)


def _absorbed(df: DataFrame, design: _Design, factor: str) -> DataFrame:
    """``ols`` with one factor (column g) of any number of levels, by elimination; the same figures as the dense design has.

    A level's rows are looked at as differences from the level's means, so what is
    solved has the size of the other columns.  Means and sums by level are a table,
    joined to the rows; a level's coefficient and error come from its own sums.
    """
    k, spark = len(design.names), df.sparkSession

    def sums(pdf):
        return np.column_stack([np.ones(len(pdf)), pdf["y"].to_numpy(), design(pdf)])

    level = _by_level(df, sums, k + 2)
    level = stored(level.select("g", F.col("m")[0].alias("n"), F.transform(F.slice("m", 2, k + 1), lambda v: v / F.col("m")[0]).alias("mean")), "level-means")
    # partitions go by level and a salt, so one level's rows are dealt to several tasks
    x = stored(df.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(8))).join(level.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))), ["g", "salt"]).drop("salt"), "level-rows")

    def within(pdf):
        mean = np.stack(pdf["mean"].to_numpy())
        return design(pdf) - mean[:, 1:], pdf["y"].to_numpy() - mean[:, 0]

    def moments(pdf):
        z, v = within(pdf)
        full = pdf["y"].to_numpy()
        return np.concatenate([(z.T @ z).ravel(), z.T @ v, [len(v), full.sum(), full @ full, v @ v]])

    s = _summed(x, moments)
    zz, zy, (n, sy, syy, inner) = s[: k * k].reshape(k, k), s[k * k : -4], s[-4:]
    inv = np.linalg.pinv(zz) if k else zz
    b = inv @ zy

    def errors(pdf):
        z, v = within(pdf)
        e = (v - z @ b) / np.maximum(1 - 1 / pdf["n"].to_numpy() - ((z @ inv) * z).sum(axis=1), 1e-9)
        return z, e * e

    def meat(pdf):
        z, ee = errors(pdf)
        return np.append((z * ee[:, None]).T @ z, 0.0)

    cov = inv @ _summed(x, meat)[:-1].reshape(k, k) @ inv
    r2 = 1 - (inner - b @ zy) / max(syy - sy * sy / n, 1e-12)

    def spread(pdf):
        z, ee = errors(pdf)
        return np.column_stack([ee, z * ee[:, None]])

    table = stored(level.join(_by_level(x, spread, k + 1).withColumnRenamed("m", "spread"), "g"), "level-table")
    zero = table.orderBy("g").first()  # the level that the others are compared with
    n0, m0, s0 = zero.n, np.array(zero.mean), np.array(zero.spread)

    def coefficients(parts):
        import pandas as pd

        for pdf in parts:
            if not len(pdf):
                continue
            n, mean, own = pdf["n"].to_numpy()[:, None], np.stack(pdf["mean"].to_numpy()), np.stack(pdf["spread"].to_numpy())
            first = (pdf["g"] == zero.g).to_numpy()
            base = np.where(first[:, None], 0.0, m0[None, :])
            alone = np.where(first, 0.0, 1.0)
            d = mean - base
            c = d[:, 0] - d[:, 1:] @ b
            r = own[:, 1:] / n - alone[:, None] * s0[1:] / n0
            var = own[:, 0] / n[:, 0] ** 2 + alone * s0[0] / n0**2 - 2 * ((d[:, 1:] @ inv) * r).sum(axis=1) + ((d[:, 1:] @ cov) * d[:, 1:]).sum(axis=1)
            names = np.where(first, "const", f"{factor}=" + pdf["g"].to_numpy(dtype=object))
            yield pd.DataFrame(_coefficients(list(names), c, var, r2), columns=["term", "coef", "se", "z", "p", "r2"])

    out = table.mapInPandas(coefficients, _COEFS)
    return out.unionByName(spark.createDataFrame(_coefficients(design.names, b, np.diag(cov), r2), _COEFS))


# -- clustering --------------------------------------------------------------


def topic_count(n: int) -> int:
    return max(8, min(35, int(math.sqrt(n / 2))))


def outlier_count(n: int, asked: int | None = None) -> int:
    return max(3, min(asked, max(3, n // 12))) if asked else max(8, min(32, round(math.sqrt(n / 2))))


def want_count(n: int) -> int:
    return max(8, min(24, n // 12))


def _ml(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features_", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def kmeans(df: DataFrame, key: str, vector: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """key, cluster by k-means with cosine distance, full passes."""
    from pyspark.ml.clustering import KMeans

    x = _ml(df.filter(F.col(vector).isNotNull()), vector)
    model = KMeans(k=k or topic_count(x.count()), seed=seed, distanceMeasure="cosine", featuresCol="features_", predictionCol="cluster", maxIter=10).fit(x)
    return model.transform(x).select(key, "cluster")


def pca(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, x1..xk: coordinates of a map, by principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    x = _ml(df.filter(F.col(vector).isNotNull()), vector)
    out = PCA(k=k, inputCol="features_", outputCol="o_").fit(x).transform(x).withColumn("o_", vector_to_array("o_"))
    return out.select(key, *[F.col("o_")[i].alias(f"x{i + 1}") for i in range(k)])


def svd(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, v: unit rows projected on the k first right singular vectors (uncentred, from X'X), unit length."""
    from ..functions import text as t

    x = df.filter(F.col(vector).isNotNull()).select(key, t.l2(vector).alias("u"))

    def gram(parts):
        import pandas as pd

        for pdf in parts:
            m = np.stack(pdf["u"].to_numpy())
            yield pd.DataFrame({"m": [(m.T @ m).ravel().tolist()]})

    sums = x.select("u").mapInPandas(gram, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    m = np.array([r.v for r in sums.orderBy("i").collect()])
    d = int(math.isqrt(len(m)))
    _, vec = np.linalg.eigh(m.reshape(d, d))
    basis = vec[:, ::-1][:, :k].T
    axes = [F.array(*[F.lit(float(c)) for c in row]) for row in basis]
    return x.select(key, t.l2(F.array(*[t.dot(F.col("u"), a) for a in axes])).alias("v"))


def merge_centroids(centroids: DataFrame, by: str, distance: float) -> DataFrame:
    """by, parent: average-linkage merging of centroids under cosine distance.

    Centroids number a few dozen by construction (``topic_count``), so the merge runs on
    the driver; more than a thousand are refused.
    """
    rows = centroids.select(by, "n", "c").orderBy(by).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("merge_centroids takes 1000 centroids at most")
    x = np.array([r.c for r in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1 - x @ x.T
    # means of distances between groups, updated by their sizes
    groups = [[i] for i in range(len(rows))]
    size = np.ones(len(rows))
    np.fill_diagonal(d, np.inf)
    while len(rows) > 1:
        i, j = sorted(divmod(int(np.argmin(d)), len(rows)))
        if not d[i, j] <= distance:
            break
        groups[i] += groups[j]
        groups[j] = []
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        size[i] += size[j]
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
    groups = [gr for gr in groups if gr]
    out = [(rows[i][by], min(rows[k][by] for k in gr)) for gr in groups for i in gr]
    kind = centroids.schema[by].dataType
    return centroids.sparkSession.createDataFrame(out, T.StructType([T.StructField(by, kind), T.StructField("parent", kind)]))
