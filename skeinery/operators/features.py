"""Features, scores and bands of a ticket: expressions only, one projection after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as p
from ..functions import text as t


def counted(df: DataFrame) -> DataFrame:
    """Counts come first, so that flags don't run a pattern again."""
    q, f = F.col("question"), F.col("question_flat")
    return df.withColumns(
        {
            "char_count": F.length(q).cast("long"),
            "word_count": t.count(f, p.WORD),
            "line_count": F.size(F.filter(F.split(q, "\n"), lambda x: F.trim(x) != "")).cast("long"),
            "url_count": t.count(q, p.URL),
            "image_url_count": t.count(q, p.IMAGE_URL),
            "timestamp_count": t.count(q, p.TIMESTAMP),
            "date_mention_count": t.count(q, p.DATE),
            "room_id_count": t.count(q, p.ROOM_ID),
            "long_id_count": t.count(q, p.LONG_ID),
            "urgency_signal": t.count(f, p.URGENCY),
        }
    )


def flagged(df: DataFrame) -> DataFrame:
    f = F.col("question_flat")
    return df.withColumns(
        {
            "has_url": F.col("url_count") > 0,
            "has_image_url": F.col("image_url_count") > 0,
            "has_timestamp": F.col("timestamp_count") > 0,
            "has_room_or_group_id": F.col("room_id_count") > 0,
            "has_long_uid_or_case_id": F.col("long_id_count") > 0,
            "has_multiline_note": F.col("line_count") >= 3,
            "has_ban_reason_language": t.has(f, p.BAN_REASON),
            "has_user_claim": t.has(f, p.USER_CLAIM),
            "has_money_terms": t.has(f, p.MONEY),
            "has_status_or_svip_terms": t.has(f, p.STATUS),
            "has_screenshot_evidence": (F.col("image_url_count") > 0) | t.has(f, p.SCREEN),
            **{f"desire__{k}": t.has(f, v) for k, v in p.DESIRES.items()},
        }
    )


def summed(df: DataFrame) -> DataFrame:
    desires = {k: F.col(f"desire__{k}") for k in p.DESIRES}
    return df.withColumns(
        {
            "desire_count": t.total([d.cast("int") for d in desires.values()]),
            "primary_desire": t.cascade([(d, k) for k, d in desires.items()], p.UNCLEAR),
            "evidence_element_count": t.total([F.col(e).cast("int") for e in p.EVIDENCE]),
            "model_text": t.flat(F.regexp_replace("question_flat", p.URL, " [URL] ")),
        }
    )


def caps(df: DataFrame) -> DataFrame:
    """One row: the 95th percentile of each capped count, 1 at least."""
    return df.agg(*[F.greatest(F.percentile(c, F.lit(0.95)), F.lit(1.0)).alias(f"cap_{c}") for c in p.DEPTH_CAPPED])


def band(score: Column) -> Column:
    return t.cascade([(score <= top, name) for top, name in p.BANDS if top is not None], p.BANDS[-1][1])


def deep(df: DataFrame) -> DataFrame:
    """Context score (0 to 100) and its band; the caps are one row, sent to all."""
    score = t.total(
        [F.lit(w) * F.least(F.lit(1.0), F.col(c) / F.col(f"cap_{c}")) for c, w in p.DEPTH_CAPPED.items()]
        + [F.lit(w) * F.col(c).cast("int") for c, w in p.DEPTH_FLAGS.items()]
    )
    out = df.crossJoin(F.broadcast(caps(df))).withColumn("context_depth_score", F.round(score, 2))
    return out.withColumn("context_depth_band", band(F.col("context_depth_score"))).drop(*[f"cap_{c}" for c in p.DEPTH_CAPPED])


def risky(df: DataFrame) -> DataFrame:
    risk = F.col("primary_desire").isin(p.RISK_DESIRES) | F.col("has_money_terms") | F.col("has_status_or_svip_terms")
    return df.withColumns(
        {
            "trust_money_flag": risk,
            "risk_signal_count": t.total([F.col(c).cast("int") for c in p.RISK_FLAGS]) + (F.col("context_depth_score") >= 24).cast("int"),
        }
    )


def enrich(df: DataFrame) -> DataFrame:
    """All features of a canonical table."""
    return risky(deep(summed(flagged(counted(df)))))
