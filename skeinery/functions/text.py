"""Column expressions on text; all stay in the JVM."""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x: Column | str) -> Column:
    """Null is empty, line ends are LF, runs of spaces and tabs are one space, ends are stripped."""
    x = F.regexp_replace(F.coalesce(c(x), F.lit("")), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", "")


def flat(x: Column | str) -> Column:
    """All white space is single spaces."""
    return F.trim(F.regexp_replace(F.coalesce(c(x), F.lit("")), r"\s+", " "))


def no_null_words(x: Column | str) -> Column:
    t = F.trim(F.coalesce(c(x), F.lit("")))
    return F.when(F.lower(t).isin("nan", "none", "null"), "").otherwise(t)


def key_repair(x: Column | str) -> Column:
    """``12.0`` is ``12``."""
    return F.regexp_replace(F.trim(c(x)), r"\.0$", "")


def digits(x: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(c(x), F.lit("")), r"[^0-9]", "")


def or_unknown(x: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(c(x)), F.lit("")), F.lit("Unknown"))


def truthy(x: Column | str, words: tuple[str, ...] = ("true", "1", "yes", "y")) -> Column:
    return F.coalesce(F.lower(F.trim(c(x).cast("string"))).isin(*words), F.lit(False))


def compact(x: Column | str, n: int) -> Column:
    """At most n characters; a longer text keeps n - 3 and an ellipsis."""
    t = flat(x)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 3)), F.lit("...")))


def strip_cjk_prefix(x: Column | str) -> Column:
    """Drops a leading run of Han text, its punctuation, & and spaces before a Latin letter."""
    return F.regexp_replace(c(x), r"^[一-鿿　-〿&\s]+(?=[A-Za-z])", "")


@cache
def quick(pattern: str) -> str:
    """The same vocabulary, with a look at the first letter before its words are tried one by one.

    Only plain vocabularies, ``(?i)\\b(?:one|two words|..)\\b``, are changed.
    """
    m = re.fullmatch(r"\(\?i\)\\b\(\?:([^()\[\]\\]*)\)\\b", pattern)
    first = sorted({w[:1] for w in m[1].split("|")}) if m else []
    if not first or any(not ch.isalpha() for ch in first):
        return pattern
    return rf"(?i)\b(?=[{''.join(first)}])(?:{m[1]})\b"


def count(x: Column | str, pattern: str) -> Column:
    return F.regexp_count(c(x), F.lit(quick(pattern))).cast("long")


def has(x: Column | str, pattern: str) -> Column:
    return F.coalesce(c(x).rlike(quick(pattern)), F.lit(False))


def found(x: Column | str, pattern: str, most: int) -> Column:
    """Different matches, sorted, at most ``most``."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(c(x), F.lit(pattern), F.lit(0)))), 1, most)


def contains_ci(x: Column | str, part: str) -> Column:
    return F.lower(F.coalesce(c(x), F.lit(""))).contains(part.lower())


def cascade(rules: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first condition that holds."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def as_int(x: Column | str) -> Column:
    return F.coalesce(c(x).cast("int"), F.lit(0))


def lookup(x: Column | str, table: dict[str, str], default: Column | None = None) -> Column:
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(m[c(x)], c(x) if default is None else default)


def slug(terms: Column, most: int = 5) -> Column:
    """Different tokens of the terms, joined by underscores."""
    words = F.flatten(F.transform(terms, lambda t: F.split(F.lower(t), r"[^a-z0-9]+")))
    return F.array_join(F.slice(F.array_distinct(F.filter(words, lambda w: w != "")), 1, most), "_")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def level(x: Column) -> Column:
    """1 to 5 after rounding half to even."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.bround(x, 0), F.lit(1.0)).cast("int")))


def day_first(x: Column | str) -> Column:
    """A timestamp of one value; ISO order as written, otherwise day first; null where nothing fits."""
    t = F.trim(c(x))
    forms = ["yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "d.M.yyyy H:m:s", "d.M.yyyy H:m", "d.M.yyyy", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d-M-yyyy"]
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])


def month(x: Column | str) -> Column:
    return F.coalesce(F.date_format(c(x), "yyyy-MM"), F.lit(""))


def l2(v: Column | str) -> Column:
    """Unit length; a zero vector stays zero."""
    v = F.transform(c(v), lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
