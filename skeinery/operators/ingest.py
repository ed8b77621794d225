"""Cleaning of raw exports into the canonical ticket table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patterns as p
from ..functions import text as t

#: Canonical column and the headers that it may have (fixed values).
ALIASES = {
    "source_row": ["#"], "date_raw": ["Date"], "manager": ["Manager"], "role": ["Role"], "role_secondary": ["Role.1", "role_1", "role_secondary"],
    "uid": ["UID"], "question_kind": ["Question Kind"], "question": ["Question"], "delegate_to": ["Deligate to", "Delegate to"],
    "status_en": ["Status"], "category": ["category", "分类"], "status_cn": ["status_cn", "Статус"],
}


def resolve(columns: list[str], aliases: list[str]) -> str | None:
    """The first alias that is a column; else the first that is one but for case and outer spaces."""
    exact = next((a for a in aliases if a in columns), None)
    loose = {c.strip().lower(): c for c in reversed(columns)}
    return exact or next((loose[a.strip().lower()] for a in aliases if a.strip().lower() in loose), None)


def drop_noise(df: DataFrame, header: str = r"^(?:Role|SVIP)\n", status: str | None = "Статус") -> DataFrame:
    """Drops columns by header, and the status column where it holds numbers (0.30 or more) or nothing (0.85 or more)."""
    df = df.drop(*[c for c in df.columns if __import__("re").match(header, c)])
    if status in df.columns:
        x = F.trim(F.coalesce(F.col(f"`{status}`"), F.lit("")))
        empty = F.avg((x == "").cast("int"))
        number = F.avg(F.when(x != "", x.rlike(r"^-?\d+(\.\d+)?$").cast("int")))
        r = df.agg(empty.alias("e"), F.coalesce(number, F.lit(0.0)).alias("n")).first()
        if r.e is not None and (r.e >= 0.85 or r.n >= 0.30):
            df = df.drop(status)
    return df


def drop_summaries(df: DataFrame, question: str = "question", uid: str = "uid") -> DataFrame:
    """Rows with neither question nor uid go."""
    return df.filter((F.trim(F.coalesce(question, F.lit(""))) != "") | (F.trim(F.coalesce(uid, F.lit(""))) != ""))


def numbered(df: DataFrame) -> tuple[DataFrame, Column]:
    """df, and the number of each row as read, from 1: counts by partition are added up, rows are not sorted.

    The partition and the place in it are the halves of a monotonic id; what is
    broadcast is one number for each partition of the scan.
    """
    df = df.withColumn("id_", F.monotonically_increasing_id())
    df = df.withColumns({"part_": F.shiftright("id_", 33), "place_": F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = df.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("part_", F.coalesce(before, F.lit(0)).alias("start_"))
    return df.join(F.broadcast(starts), "part_"), (F.col("start_") + F.col("place_") + 1).cast("string")


def canonical(df: DataFrame) -> DataFrame:
    """Canonical columns of a raw export; a missing one is empty, a missing row number counts the rows as read."""
    src = {k: resolve(df.columns, a) for k, a in ALIASES.items()}
    col = lambda k: t.flat(F.col(f"`{src[k]}`")) if src[k] else F.lit("")
    svip = next((c for c in df.columns if "SVIP" in c.upper()), None)
    if src["source_row"]:
        number = col("source_row")
    else:
        df, number = numbered(df)
    question = t.clean_text(F.col(f"`{src['question']}`")) if src["question"] else F.lit("")
    date = t.day_first(col("date_raw"))
    out = df.select(
        number.alias("source_row"), col("date_raw").alias("date_raw"), date.alias("date"), t.month(date).alias("month"),
        *((col(k) if src[k] or k != "manager" else F.lit("Unknown")).alias(k) for k in ("manager", "role", "role_secondary", "uid", "question_kind")),
        question.alias("question"), t.flat(question).alias("question_flat"), col("delegate_to").alias("delegate_to"), col("status_en").alias("status_en"),
        t.strip_cjk_prefix(col("category")).alias("category"), col("status_cn").alias("status_cn"),
        (t.flat(F.col(f"`{svip}`")) if svip else F.lit("")).alias("svip_level"),
    )
    return resolution(out)


def resolution(df: DataFrame) -> DataFrame:
    done = F.coalesce(F.col("status_en").isin(p.RESOLVED_EN), F.lit(False)) | F.coalesce(F.col("status_cn") == p.RESOLVED_CN, F.lit(False))
    return df.withColumns({"is_resolved": done, "is_unresolved": ~done})


def status_bucket(status: str = "status_en"):
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return t.cascade([(s.isin(v), k) for k, v in p.STATUS_BUCKETS.items()], "unknown")


def cleaned(df: DataFrame) -> DataFrame:
    """A ticket table whose columns have their names already."""
    q = t.clean_text("question")
    return resolution(df.withColumns({"question": q, "question_flat": t.flat(q), "month": t.month("date")}))
