"""Journeys of repeat users and monthly trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as t
from ..sources.sinks import stored
from .grouping import top_list
from .ingest import status_bucket

# Words that tell a journey's kind, tried in this order, and what to do about it.
PATTERNS = {
    "money_or_dealer_dispute": ["diamond", "dealer", "reseller", "money", "withdraw"],
    "safety_or_abuse_reporter": ["scam", "harassment", "abuse", "inappropriate", "report"],
    "account_recovery_loop": ["access", "account", "unban", "blocked", "banned", "recover"],
    "creator_or_group_operator": ["group", "channel", "visibility", "member", "room"],
    "status_or_privilege_loop": ["svip", "status", "points", "level"],
}
RECOMMENDED = {
    "multi_problem_power_user": "Assign an owner and review full history before replying; repeated isolated handling is creating churn.",
    "money_or_dealer_dispute": "Route to a transaction/dealer evidence lane with proof checklist and decision SLA.",
    "safety_or_abuse_reporter": "Use an abuse-report triage path with actor, room, screenshot, and enforcement-status fields.",
    "account_recovery_loop": "Give a single recovery/appeal status trail: reason, required proof, owner, next decision date.",
    "creator_or_group_operator": "Create group/channel diagnostics for visibility, limits, room access, and member-growth blockers.",
    "status_or_privilege_loop": "Give SVIP/status users a verification path and plain explanation of points/reward state.",
    "general_repeat_user": "Monitor; review if unresolved, high-risk, or active over a long span.",
}


def _path(e: DataFrame, value: str, name: str, limit: int = 9) -> DataFrame:
    """uid, name: the user's values in order, adjacent repeats and blanks left out, at most ``limit`` and an ellipsis.

    Only the first limit + 1 steps are gathered, however many events a user has.
    """
    x = e.select("uid", "k_", F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("v")).filter("v <> ''")
    w = W.partitionBy("uid").orderBy("k_")
    x = x.withColumn("b_", F.lag("v").over(w)).filter(F.col("b_").isNull() | (F.col("b_") != F.col("v")))
    x = x.withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= limit + 1)
    steps = F.transform(F.sort_array(F.collect_list(F.struct("r_", "v"))), lambda s: s["v"])
    return x.groupBy("uid").agg(F.concat(F.array_join(F.slice(steps, 1, limit), " -> "), F.when(F.count("*") > limit, " -> ...").otherwise("")).alias(name))


def journeys(x: DataFrame, least: int = 2, title: str = "want_title", review: str = "needs_llm_review", confidence: str = "assignment_confidence") -> DataFrame:
    """One row for each user with ``least`` records or more: counts, span, top wants, paths, latest state, kind, severity.

    x: cleaned tickets with want_id, title, review flag and confidence.  Events go by
    date (none: last), then by source_row as text.
    """
    w = W.partitionBy("uid").orderBy(F.col("date").asc_nulls_last(), "source_row")
    e = x.filter("uid <> ''").withColumns({"k_": F.row_number().over(w), "s_": status_bucket(), "n_": F.count("*").over(W.partitionBy("uid"))}).filter(F.col("n_") >= least)
    short = F.substring(F.trim(F.coalesce("question_flat", F.lit(""))), 1, 220).alias("q_")
    e = stored(e.select("uid", "k_", "s_", "date", "want_id", title, "category", "manager", "status_en", review, confidence, short), "journeys")
    bad = F.col("s_").isin("failed", "open")
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    two = lambda c, n: F.round(F.round(c, 8), n)
    s = e.groupBy("uid").agg(
        F.count("*").alias("records"), day(F.min("date")).alias("first_date"), day(F.max("date")).alias("last_date"),
        F.coalesce(F.datediff(F.max("date"), F.min("date")), F.lit(0)).cast("int").alias("active_days"),
        F.countDistinct("want_id").alias("unique_wants"), F.countDistinct("category").alias("unique_categories"), F.countDistinct("manager").alias("managers_touched"),
        F.count_if(F.col("s_") == "resolved").alias("resolved_records"), F.count_if(bad).alias("failed_or_open_records"), F.round(F.avg(bad.cast("int")), 3).alias("failed_or_open_share"),
        F.count_if(review).alias("review_queue_records"), two(F.avg(confidence), 3).alias("avg_assignment_confidence"),
        F.trim(F.max_by("status_en", "k_")).alias("latest_status"), F.max_by(title, "k_").alias("latest_want"),
        F.min_by("q_", "k_").alias("first_question"), F.max_by("q_", "k_").alias("last_question"),
    )
    s = s.join(top_list(e, ["uid"], title, 4, "top_wants", "{v} ({n})", "k_"), "uid", "left")
    for value, name in ((title, "want_path"), ("category", "category_path"), ("status_en", "status_path")):
        s = s.join(_path(e, value, name), "uid", "left")
    s = s.na.fill("", ["top_wants", "want_path", "category_path", "status_path", "latest_status", "latest_want"])
    text = F.lower(F.concat_ws(" ", "want_path", "top_wants", "first_question", "last_question"))
    any_ = lambda ws: reduce(lambda a, b: a | b, [text.contains(v) for v in ws])
    rules = [((F.col("unique_wants") >= 4) & (F.col("records") >= 5), "multi_problem_power_user"), *[(any_(ws), k) for k, ws in PATTERNS.items()]]
    severity = F.col("records") + 2 * F.col("unique_wants") + 2.5 * F.col("failed_or_open_records") + 0.75 * F.col("review_queue_records") + F.least(F.col("active_days") / 30, F.lit(12.0))
    s = s.withColumns({"journey_pattern": t.cascade(rules, "general_repeat_user"), "severity_score": two(severity, 2)})
    return s.withColumn("recommended_action", t.lookup("journey_pattern", RECOMMENDED))


def events(x: DataFrame, least: int = 2, title: str = "want_title") -> DataFrame:
    """The records of users with ``least`` or more, in order: index, days since the first, what was asked and what it was taken for.

    Columns of the assignment and of the model layer that x lacks are empty.
    """
    every = W.partitionBy("uid")
    w = every.orderBy(F.col("date").asc_nulls_last(), "source_row")
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in x.columns else F.lit("")
    e = x.filter("uid <> ''").withColumns({"event_index": F.row_number().over(w), "n_": F.count("*").over(every), "f_": F.min("date").over(every)}).filter(F.col("n_") >= least)
    return e.select(
        "uid", "event_index", "source_row", F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("date"), F.coalesce(F.datediff("date", "f_"), F.lit(0)).alias("days_since_first"),
        clean(title).alias("want_title"), clean("category").alias("category"), clean("status_en").alias("status"), clean("manager").alias("manager"), clean("confidence_band").alias("confidence_band"), F.substring(clean("question_flat"), 1, 280).alias("question"),
        *[F.substring(clean(c), 1, 180).alias(c) for c in ("actual_user_want", "support_next_step", "product_opportunity")],
    )


def archetypes(j: DataFrame, x: DataFrame, title: str = "want_title") -> DataFrame:
    """Journeys by pattern: users, records, medians, means, the wants that their records ask for most, what to do."""
    j = stored(j, "archetypes")
    r6 = lambda c: F.round(F.round(c, 8), 6)
    s = j.groupBy("journey_pattern").agg(
        F.count("*").alias("users"), F.sum("records").alias("records"), F.median("records").alias("median_records_per_user"), F.median("active_days").alias("median_active_days"),
        r6(F.avg("unique_wants")).alias("avg_unique_wants"), r6(F.avg("failed_or_open_share")).alias("failed_or_open_share"), F.sum("review_queue_records").alias("review_queue_records"),
    )
    e = x.join(j.select("uid", "journey_pattern"), "uid").withColumn("first_pos", F.col("source_row").cast("long"))
    s = s.join(top_list(e, ["journey_pattern"], title, 4, "top_wants", "{v} ({n})"), "journey_pattern", "left")
    return s.withColumn("recommended_action", t.lookup("journey_pattern", RECOMMENDED))


def complete_months(x: DataFrame, month: str = "month") -> DataFrame:
    """month, i (from 0, oldest first), back (from 1, newest first).

    The last month is left out if there are three or more and it has under 0.4 of the
    median of those before.  There is a row for each month of the data, so the frame
    is small whatever the input.
    """
    m = x.filter(F.col(month) != "").groupBy(month).agg(F.count("*").alias("n"))
    one = m.agg(F.max(month).alias("last_"), F.count("*").alias("k_"))
    m = m.crossJoin(F.broadcast(one))
    med = m.filter(F.col(month) < F.col("last_")).agg(F.median("n").alias("md_"))
    m = m.crossJoin(F.broadcast(med)).filter(~F.coalesce((F.col("k_") >= 3) & (F.col(month) == F.col("last_")) & (F.col("n") < 0.4 * F.col("md_")), F.lit(False)))
    return m.select(month, (F.row_number().over(W.orderBy(month)) - 1).alias("i"), F.row_number().over(W.orderBy(F.desc(month))).alias("back"))


def trends(x: DataFrame, by: str, month: str = "month", review: str = "needs_llm_review", title: str = "want_title") -> DataFrame:
    """For each group and title: last two complete months against the two before, slope over all of them (absent: 0), forecast, momentum, label.

    A table without titles has its groups' ids for them; null groups and titles have no row.
    Groups without a row in a complete month have no row here either.  With fewer than three
    complete months the slope is 0 and the forecast is the recent average; averages
    go by the months that there are.
    """
    x = x if title in x.columns else x.withColumn(title, F.col(by).cast("string"))
    all_ = W.partitionBy()  # there is a row for each month
    months = complete_months(x, month)
    names = lambda low, high: F.array_join(F.sort_array(F.collect_list(F.when(F.col("back").between(low, high), F.col(month))).over(all_)), ", ")
    after = F.date_format(F.add_months(F.to_date(F.concat(F.max(month).over(all_), F.lit("-01"))), 1), "yyyy-MM")
    months = F.broadcast(months.withColumns({"m_": F.count("*").over(all_), "recent_months": names(1, 2), "prior_months": names(3, 4), "forecast_month": after}))
    back, bad = F.col("back"), status_bucket().isin("failed", "open")
    rate = lambda c: F.coalesce(F.avg(F.when(back <= 2, c.cast("int"))), F.lit(0.0))
    s = x.join(months, month).filter(F.col(by).isNotNull() & F.col(title).isNotNull()).groupBy(by, title).agg(
        *[F.max(c).alias(c) for c in ("m_", "recent_months", "prior_months", "forecast_month")],
        F.count_if(back <= 2).alias("recent_records"), F.count_if(back.between(3, 4)).alias("prior_records"), F.count_if(back <= 3).alias("l3_"), F.count("*").alias("y_"), F.sum("i").alias("iy_"),
        F.round(rate(bad), 3).alias("recent_failed_or_open_share"), F.round(rate(F.col(review)), 3).alias("recent_review_queue_share"),
        F.countDistinct(F.when(back <= 2, F.col("uid"))).alias("recent_unique_users"),
    )
    n = F.col("m_").cast("double")
    # least squares over the months 0 .. n - 1
    slope = F.when(n >= 3, (F.col("iy_") - F.col("y_") * (n - 1) / 2) / (n * (n * n - 1) / 12)).otherwise(0.0)
    r = F.col("recent_records") / F.greatest(F.least(n, F.lit(2.0)), F.lit(1.0))
    p = F.col("prior_records") / F.greatest(F.least(n - 2, F.lit(2.0)), F.lit(1.0))
    two = lambda c, k: F.round(F.round(c, 8), k)
    forecast = F.when(n >= 3, F.greatest(F.lit(0.0), F.col("l3_") / 3 + slope)).otherwise(r)
    s = s.select(
        by, title, "recent_months", "prior_months", "recent_records", "prior_records", F.round(r, 2).alias("recent_avg_per_month"), F.round(p, 2).alias("prior_avg_per_month"), two(t.ratio(r - p, p), 3).alias("growth_ratio"), two(slope, 2).alias("monthly_slope"),
        two(forecast, 1).alias("forecast_next_month"), "forecast_month", "recent_failed_or_open_share", "recent_review_queue_share", "recent_unique_users",
    )
    momentum = two(F.col("forecast_next_month") * (1 + F.greatest("growth_ratio", F.lit(-0.5))) * (1 + F.col("recent_failed_or_open_share")), 2)
    label = t.cascade(
        [
            ((F.col("growth_ratio") >= 0.35) & (F.col("recent_records") >= 20), "rising"), ((F.col("growth_ratio") <= -0.35) & (F.col("prior_records") >= 20), "falling"),
            (F.col("monthly_slope") >= 5, "slow_rise"), (F.col("monthly_slope") <= -5, "slow_decline"),
        ],
        "stable",
    )
    return s.withColumns({"momentum_score": momentum, "trend_label": label})


def timeline_seed(x: DataFrame, by: str, month: str = "month", series: int = 5, choices: int = 12) -> DataFrame:
    """The ``choices`` largest groups of a timeline: total, place, seeded (one of the first ``series``), and the months shown.

    Months are the complete ones; where there are none, all but the last.
    """
    all_ = x.filter(F.col(month) != "")
    totals = all_.groupBy(by).agg(F.count("*").alias("total")).orderBy(F.desc("total"), by).limit(choices)
    totals = totals.withColumn("place", F.row_number().over(W.orderBy(F.desc("total"), by)))
    text = lambda df, name: df.agg(F.array_join(F.sort_array(F.collect_list(month)), ", ").alias(name), F.count("*").alias(f"n_{name}"))
    names = all_.select(month).distinct()
    last = names.agg(F.max(month).alias("last_"))
    rest = text(names.crossJoin(F.broadcast(last)).filter(F.col(month) < F.col("last_")), "rest")
    shown = text(complete_months(x, month), "full").crossJoin(F.broadcast(rest))
    shown = shown.select(F.when(F.col("n_full") > 0, F.col("full")).otherwise(F.col("rest")).alias("months"))
    return totals.withColumn("seeded", F.col("place") <= series).crossJoin(F.broadcast(shown))
