"""Group operators: summaries, top lists, windows of days, profiles, graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import patterns as p
from ..functions import text as t
from ..sources.sinks import stored

FEATURE_RATES = ["has_image_url", "has_timestamp", "has_room_or_group_id", "has_long_uid_or_case_id", "has_ban_reason_language", "has_user_claim", "has_money_terms", "has_status_or_svip_terms"]


def share(c: Column | str) -> Column:
    return F.avg(t.c(c).cast("int"))


def r4(c: Column) -> Column:
    """Four places; rounding to eight first lets a half be a half in whatever order a mean was summed."""
    return F.round(F.round(c, 8), 4)


def top_list(df: DataFrame, by: list[str], value: str, n: int, name: str, style: str = "{v}", first: str = "first_pos") -> DataFrame:
    """by, name: the n most frequent values joined by ', ', blanks left out, ties by first appearance, then value.

    style: ``{v}``, ``{v} ({n})`` or ``{v}:{n}``.
    """
    x = df.filter(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "")
    x = x.groupBy(*by, F.col(value).cast("string").alias("v_")).agg(F.count("*").alias("n_"), F.min(first).alias("f_"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n_"), "f_", "v_"))
    x = x.withColumn("r_", rank).filter(F.col("r_") <= n)
    a, b = (style.split("{n}") + [""])[:2] if "{n}" in style else (style, "")
    piece = F.concat(F.lit(a.split("{v}")[0]), F.col("v_"), F.lit(a.split("{v}")[1]), F.col("n_").cast("string") if "{n}" in style else F.lit(""), F.lit(b))
    return x.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r_", piece.alias("s")))), lambda s: s["s"]), ", ").alias(name))


def top_lists(df: DataFrame, by: list[str], tops: dict[str, tuple[str, int]], blanks: bool = False, first: str = "first_pos") -> DataFrame:
    """by and a column for each of tops, name: (column, n), as in ``top_list``, in one pass; blanks: they count as a value."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("t_"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v_")) for k, (c, _) in tops.items()])).alias("x")
    x = df.select(*by, F.col(first).alias("f_"), each).select(*by, "f_", "x.t_", "x.v_")
    x = x if blanks else x.filter(F.trim("v_") != "")
    x = x.groupBy(*by, "t_", "v_").agg(F.count("*").alias("n_"), F.min("f_").alias("f_"))
    x = x.withColumn("r_", F.row_number().over(W.partitionBy(*by, "t_").orderBy(F.desc("n_"), "f_", "v_"))).filter(F.col("r_") <= max(n for _, n in tops.values()))
    of = lambda k, n: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("t_") == k) & (F.col("r_") <= n), F.struct("r_", "v_")))), lambda s: s["v_"]), ", ")
    return x.groupBy(*by).agg(*[of(k, n).alias(k) for k, (_, n) in tops.items()])


def examples(df: DataFrame, by: list[str], order: list[Column], text: Column, n: int, name: str = "example_") -> DataFrame:
    """by, name1 .. n: texts of the first rows of each group, '' where there are fewer."""
    x = df.withColumn("k_", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("k_") <= n)
    return x.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("k_") == i, text)), F.lit("")).alias(f"{name}{i}") for i in range(1, n + 1)])


def same(df: DataFrame, other: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys meet, as rows of one group."""
    renamed = other.select(*[F.col(c).alias(f"k_{c}") if c in by else F.col(c) for c in other.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in by])
    return df.join(renamed, cond, how).drop(*[f"k_{c}" for c in by])


def users(uid: str = "uid") -> Column:
    return F.countDistinct(F.nullif(F.col(uid), F.lit("")))


def manager_summary(e: DataFrame) -> DataFrame:
    return e.groupBy("manager").agg(
        F.count("*").alias("tickets"), users().alias("unique_users"),
        r4(F.avg("context_depth_score")).alias("avg_context_score"), r4(F.median("context_depth_score")).alias("median_context_score"),
        F.round(F.avg("char_count"), 4).alias("avg_chars"), F.round(F.avg("evidence_element_count"), 4).alias("avg_evidence"),
        F.round(share(F.col("context_depth_band").isin("rich", "forensic")), 4).alias("rich_or_forensic_share"),
        F.round(share(F.col("context_depth_band") == "thin"), 4).alias("thin_share"), F.round(share("is_unresolved"), 4).alias("unresolved_share"),
        *[F.round(share(c), 4).alias(c.replace("has_", "") + "_share") for c in FEATURE_RATES],
    )


def desire_summary(e: DataFrame) -> DataFrame:
    """One row for each desire; a ticket counts in each of its desires, and a desire without tickets has a row."""
    flags = F.array(*[F.struct(F.lit(k).alias("desire"), F.col(f"desire__{k}").alias("on")) for k in p.DESIRES])
    x = e.select("manager", "is_unresolved", "context_depth_score", "source_row", F.explode(flags).alias("x")).select("*", "x.desire", "x.on")
    s = x.groupBy("desire").agg(
        F.count_if("on").alias("tickets"), F.count("*").alias("all_"),
        F.coalesce(F.round(F.avg(F.when(F.col("on"), F.col("is_unresolved").cast("int"))), 4), F.lit(0.0)).alias("unresolved_share"),
        F.coalesce(r4(F.avg(F.when(F.col("on"), F.col("context_depth_score")))), F.lit(0.0)).alias("avg_context_score"),
    )
    top = top_list(x.filter("on").withColumn("first_pos", F.col("source_row").cast("long")), ["desire"], "manager", 3, "top_managers")
    s = s.withColumn("share", F.round(F.col("tickets") / F.col("all_"), 4)).drop("all_")
    return s.join(top, "desire", "left").na.fill("", ["top_managers"])


def issues(e: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds issue_id and issue_label from the cluster; none: -999."""
    e = e.withColumn("issue_id", F.coalesce("cluster_id", F.lit(-999)))
    e = e.join(labels, "issue_id", "left")
    return e.withColumn("issue_label", F.coalesce("issue_label", F.concat(F.lit("cluster_"), F.col("issue_id").cast("string"))))


def windowed(e: DataFrame, prior_days: int) -> DataFrame:
    """Adds recent and prior flags against the greatest date of the frame: [max - 30 d, ...) and prior_days before it."""
    top = e.agg(F.max("date").alias("max_date"))
    e = e.crossJoin(F.broadcast(top))
    start = F.col("max_date") - F.expr("INTERVAL 30 DAYS")
    recent = F.coalesce(F.col("date") >= start, F.lit(False))
    prior = F.coalesce((F.col("date") >= F.col("max_date") - F.expr(f"INTERVAL {prior_days} DAYS")) & (F.col("date") < start), F.lit(False))
    return e.withColumns({"recent_": recent, "prior_": prior})


def lift(recent: Column, prior: Column) -> Column:
    return (recent + F.lit(0.0005)) / (prior + F.lit(0.0005))


def z_score(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Two-proportion z with a pooled share; both totals count 1 at least, and the variance 1e-9."""
    na, nb = F.greatest(na, F.lit(1)), F.greatest(nb, F.lit(1))
    pool = (a + b) / (na + nb)
    var = F.greatest(pool * (1 - pool) * (1 / na + 1 / nb), F.lit(1e-9))
    return (a / na - b / nb) / F.sqrt(var)


#: Columns that the backlog needs.
BACKLOG = [
    "issue_id", "issue_label", "source_row", "uid", "date", "primary_desire", "category", "manager", "is_unresolved", "trust_money_flag", "context_depth_band", "context_depth_score",
    "urgency_signal", "char_count", "question_flat",
]


def backlog(e: DataFrame) -> DataFrame:
    """Opportunity backlog by issue: volume, users, shares, lift and z of the last 30 days against the 90 before, tops, examples, score."""
    e = stored(e.select(*BACKLOG), "backlog")
    again = e.filter(F.coalesce("uid", F.lit("")) != "").groupBy("uid").agg(F.count("*").alias("n_")).filter("n_ >= 2").select("uid", F.lit(True).alias("again_"))
    x = windowed(e.join(again, "uid", "left"), 120).withColumn("first_pos", F.col("source_row").cast("long"))
    s = x.groupBy("issue_id", "issue_label").agg(
        F.count("*").alias("tickets"), users().alias("unique_users"), F.count_if("recent_").alias("recent_tickets"), F.count_if("prior_").alias("baseline_tickets"),
        F.avg(F.coalesce("again_", F.lit(False)).cast("int")).alias("again"), share("is_unresolved").alias("u"), share("trust_money_flag").alias("risk"),
        share(F.col("context_depth_band").isin("rich", "forensic")).alias("rich"), F.avg("context_depth_score").alias("ctx"), F.avg("urgency_signal").alias("urg"),
    )
    total = s.agg(F.sum("recent_tickets").alias("n_r"), F.sum("baseline_tickets").alias("n_b"))
    s = s.crossJoin(F.broadcast(total))
    rs, bs = F.col("recent_tickets") / F.greatest("n_r", F.lit(1)), F.col("baseline_tickets") / F.greatest("n_b", F.lit(1))
    s = s.withColumns({"l": lift(rs, bs), "z": z_score(F.col("recent_tickets"), F.col("n_r"), F.col("baseline_tickets"), F.col("n_b"))})
    rise = F.least(F.greatest(F.col("l") - 1, F.lit(0.0)), F.lit(3.0))
    score = F.sqrt(F.col("tickets").cast("double")) * (1 + 2.2 * F.col("u") + 1.2 * rise + 1.4 * F.col("risk")) + 8 * F.col("rich") + 0.06 * F.col("ctx")
    by = ["issue_id", "issue_label"]
    s = same(s, top_lists(x, by, {"top_desires": ("primary_desire", 5), "top_categories": ("category", 4), "top_managers": ("manager", 4)}), by)
    s = same(s, examples(x, by, [F.desc("context_depth_score"), F.desc("char_count"), F.col("first_pos")], t.compact("question_flat", 420), 3), by)
    two = lambda c, n: F.round(F.round(c, 8), n)
    return s.select(
        *by, "tickets", "unique_users", two(F.col("again"), 4).alias("repeat_user_share"), F.round("u", 4).alias("unresolved_share"), two(F.col("ctx"), 2).alias("avg_context_score"),
        F.round("rich", 4).alias("rich_or_forensic_share"), two(F.col("urg"), 3).alias("urgency_avg"), F.round("risk", 4).alias("trust_money_risk"), "recent_tickets", "baseline_tickets",
        two(F.col("l"), 3).alias("recent_lift"), two(F.col("z"), 3).alias("trend_z"), "top_desires", "top_categories", "top_managers", "example_1", "example_2", "example_3",
        two(score, 2).alias("opportunity_score"),
    ).na.fill("", ["top_desires", "top_categories", "top_managers"])


def cluster_summary(e: DataFrame, by: str = "issue_id") -> DataFrame:
    """Clusters by size, share, scores, their most frequent values (blanks count) and three examples."""
    x = stored(e.select(by, F.col("source_row").cast("long").alias("first_pos"), "context_depth_score", "is_unresolved", "primary_desire", "category", "manager", "model_text"), "clusters")
    s = x.groupBy(by).agg(F.count("*").alias("tickets"), F.round(F.round(F.avg("context_depth_score"), 8), 2).alias("avg_context_score"), F.round(share("is_unresolved"), 4).alias("unresolved_share"))
    s = s.crossJoin(F.broadcast(s.agg(F.sum("tickets").alias("all_")))).withColumn("share", F.round(F.col("tickets") / F.col("all_"), 4)).drop("all_")
    s = same(s, top_lists(x, [by], {"top_desires": ("primary_desire", 4), "top_categories": ("category", 4), "top_managers": ("manager", 4)}, blanks=True), [by])
    return same(s, examples(x, [by], [F.desc("context_depth_score"), F.col("first_pos")], F.col("model_text"), 3), [by])


def emerging(e: DataFrame) -> DataFrame:
    """Issues by growth; unclustered tickets (-999) are out before totals are taken.

    An issue goes by its most frequent label (ties: the first in order).  Windows end
    with the last date of all issues; the prior one has the 150 days before the last 30.
    """
    x = windowed(stored(e.filter("issue_id <> -999").select("issue_id", "issue_label", "date", "is_unresolved", "primary_desire", F.col("source_row").cast("long").alias("first_pos")), "emerging"), 180)
    days = lambda n: F.coalesce(F.col("date") >= F.col("max_date") - F.expr(f"INTERVAL {n} DAYS"), F.lit(False))
    s = x.groupBy("issue_id").agg(
        F.coalesce(F.mode("issue_label", True), F.first("issue_id").cast("string")).alias("issue_label"), F.count("*").alias("total_tickets"),
        *[F.count_if(days(n)).alias(f"last_{n}_tickets") for n in (30, 60, 90)], F.count_if("prior_").alias("p_"), F.coalesce(F.avg(F.when(days(30), F.col("is_unresolved").cast("int"))), F.lit(0.0)).alias("ru"),
    )
    s = s.crossJoin(F.broadcast(s.agg(F.sum("last_30_tickets").alias("n_r"), F.sum("p_").alias("n_p"))))  # one row
    rs, ps = F.col("last_30_tickets") / F.greatest("n_r", F.lit(1)), F.col("p_") / F.greatest("n_p", F.lit(1))
    s = s.withColumns(
        {
            **{f"last_{n}_share_of_issue": F.round(F.col(f"last_{n}_tickets") / F.col("total_tickets"), 4) for n in (30, 60, 90)},
            "recent_vs_prior_lift": F.round(lift(rs, ps), 3),
            "recent_vs_prior_z": F.round(z_score(F.col("last_30_tickets"), F.col("n_r"), F.col("p_"), F.col("n_p")), 3),
            "recent_unresolved_share": F.round("ru", 4),
        }
    )
    score = F.sqrt(F.col("last_30_tickets").cast("double")) * F.least(F.col("recent_vs_prior_lift"), F.lit(6.0)) * (1 + F.col("recent_unresolved_share"))
    s = s.withColumn("emergence_score", F.round(F.round(score, 8), 2)).drop("ru", "n_r", "n_p", "p_")
    return same(s, top_lists(x, ["issue_id"], {"top_desires": ("primary_desire", 4)}), ["issue_id"]).na.fill("", ["top_desires"])


def persona() -> Column:
    """Kind of repeat user, from the set ``desires_``, the joined labels ``labels_`` and the share ``u_``."""
    d = lambda x: F.array_contains("desires_", x)
    has = lambda w: F.col("labels_").contains(w)
    return t.cascade(
        [
            (d("earn_or_transact_money") & (d("protect_from_abuse_or_scam") | has("scam") | has("diamonds")), "commerce_dispute_or_scam_risk"),
            (d("clear_name_or_get_fairness") & (F.col("u_") >= 0.25), "repeat_ban_appeal_or_fairness_seeker"),
            (d("grow_audience_or_community"), "creator_channel_operator"),
            (d("gain_status_or_privileges"), "svip_status_optimizer"),
            (d("recover_access"), "account_recovery_repeat_user"),
            (F.size("desires_") >= 4, "multi_problem_power_user"),
        ],
        "general_repeat_user",
    )


def repeat_users(e: DataFrame, least: int = 2) -> DataFrame:
    """Users with two tickets or more: span, shares, persona.  Labels are those of the first 20 tickets by number."""
    x = e.filter(F.col("uid").isNotNull() & (F.col("uid") != "")).withColumn("pos_", F.col("source_row").cast("long"))
    x = stored(x.select("uid", "pos_", "date", "issue_id", "issue_label", "is_unresolved", "context_depth_score", "primary_desire", "manager", "question_flat"), "personas")
    x = x.withColumn("n_", F.row_number().over(W.partitionBy("uid").orderBy("pos_")))
    early = F.collect_list(F.when(F.col("n_") <= 20, F.struct("n_", F.lower("issue_label").alias("s"))))
    s = x.groupBy("uid").agg(
        F.count("*").alias("tickets"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("date").alias("dated_"),
        share("is_unresolved").alias("u_"), F.avg("context_depth_score").alias("c_"), F.countDistinct("issue_id").alias("unique_issues"),
        F.collect_set("primary_desire").alias("desires_"), F.array_join(F.transform(F.sort_array(early), lambda v: v["s"]), " ").alias("labels_"),
    )
    s = s.filter(F.col("tickets") >= least)
    span = F.when(F.col("dated_") == F.col("tickets"), F.datediff("last_date", "first_date"))
    x = x.withColumnRenamed("pos_", "first_pos")
    s = s.join(top_lists(x, ["uid"], {"managers_seen": ("manager", 5), "top_desires": ("primary_desire", 5), "top_issues": ("issue_label", 5)}), "uid", "left")
    s = s.join(examples(x, ["uid"], [F.desc("context_depth_score"), F.col("date").asc_nulls_last(), F.col("first_pos")], t.compact("question_flat", 420), 2, "high_context_example_"), "uid", "left")
    two = lambda c, n: F.round(F.round(c, 8), n)
    return s.select(
        "uid", persona().alias("persona"), "tickets", "unique_issues", "first_date", "last_date", span.cast("int").alias("span_days"),
        F.round("u_", 4).alias("unresolved_share"), two(F.col("c_"), 2).alias("avg_context_score"),
        "managers_seen", "top_desires", "top_issues", "high_context_example_1", "high_context_example_2",
    ).na.fill("", ["managers_seen", "top_desires", "top_issues"])


def manager_residuals(e: DataFrame) -> DataFrame:
    """Mean score against what the mix of categories and kinds makes one expect; no join."""
    x = e.withColumn("expected", F.avg("context_depth_score").over(W.partitionBy("category", "question_kind")))
    raw, exp = F.avg("context_depth_score"), F.avg("expected")
    return x.groupBy("manager").agg(F.count("*").alias("tickets"), r4(raw).alias("raw"), r4(exp).alias("expected"), r4(F.avg(F.col("context_depth_score") - F.col("expected"))).alias("residual"))


#: Evidence that tickets of these desires or label words should have.
REQUIRED = [
    (["clear_name_or_get_fairness"], r"\b(?:ban|unban|block|blocked|penalty)\b", ["has_timestamp", "has_ban_reason_language", "has_user_claim"]),
    (["earn_or_transact_money", "protect_from_abuse_or_scam"], r"\b(?:money|diamonds?|scam|fraud|dealer|seller)\b", ["has_money_terms", "has_image_url", "has_long_uid_or_case_id"]),
    (["grow_audience_or_community"], r"\b(?:channel|group|limit|room|creator)\b", ["has_room_or_group_id", "has_image_url"]),
]
REQUIRED_ELSE = ["has_url", "has_image_url", "has_multiline_note"]


def evidence_gaps(e: DataFrame, least: int = 20, dominant: float = 0.25) -> DataFrame:
    """By issue: which evidence is required, and how often it is missing; desires count from a share of ``dominant`` on."""
    per = e.groupBy("issue_label", "primary_desire").agg(F.count("*").alias("n"))
    per = per.withColumn("s", F.col("n") / F.sum("n").over(W.partitionBy("issue_label")))
    main = per.groupBy("issue_label").agg(F.collect_set(F.when(F.col("s") >= dominant, F.col("primary_desire"))).alias("d"))
    all_flags = sorted({c for *_, cols in REQUIRED for c in cols} | set(REQUIRED_ELSE))
    s = e.groupBy("issue_label").agg(F.count("*").alias("tickets"), F.avg("context_depth_score").alias("c"), share("is_unresolved").alias("u"), *[share(f).alias(f) for f in all_flags])
    s = s.filter(F.col("tickets") >= least).join(main, "issue_label")
    label = F.lower(F.regexp_replace("issue_label", "_", " "))
    need = F.array_distinct(F.flatten(F.array(*[F.when(F.arrays_overlap("d", F.array(*map(F.lit, ds))) | label.rlike(rx), F.array(*map(F.lit, cols))).otherwise(F.array().cast("array<string>")) for ds, rx, cols in REQUIRED])))
    s = s.withColumn("need", F.array_sort(F.when(F.size(need) > 0, need).otherwise(F.array(*map(F.lit, REQUIRED_ELSE)))))
    miss = F.create_map(*[x for f in all_flags for x in (F.lit(f), 1 - F.col(f))])
    s = s.withColumn("gaps", F.transform("need", lambda f: F.struct((-miss[f]).alias("o"), f.alias("f"))))
    mean = F.aggregate("gaps", F.lit(0.0), lambda a, g: a - g["o"]) / F.size("gaps")
    # a share in full percent, half up, as both engines round
    text = F.array_join(F.transform(F.slice(F.array_sort("gaps"), 1, 4), lambda g: F.concat(g["f"], F.lit(" "), F.round(-g["o"] * 100).cast("int").cast("string"), F.lit("%"))), ", ")
    return s.select("issue_label", "tickets", F.round("c", 2).alias("avg_context_score"), F.round("u", 4).alias("unresolved_share"), F.array_join("need", ", ").alias("required_evidence"), F.round(mean, 4).alias("mean_gap"), text.alias("top_gaps"))


def coaching(e: DataFrame, benchmark: str | None = None, least_gap: float = 0.03) -> DataFrame:
    """By manager the evidence in which the benchmark manager (given, else the best mean score) is ahead; at most four."""
    rates = e.filter("manager <> ''").groupBy("manager").agg(F.count("*").alias("tickets"), F.avg("context_depth_score").alias("c"), *[share(f).alias(f) for f in FEATURE_RATES])
    order = ([F.desc(F.col("manager") == benchmark)] if benchmark else []) + [F.desc("c"), F.col("manager")]
    best = rates.orderBy(*order).limit(1).select(F.col("manager").alias("benchmark"), *[F.col(f).alias(f"b_{f}") for f in FEATURE_RATES])
    x = rates.crossJoin(F.broadcast(best))
    gaps = F.filter(F.array(*[F.struct((F.col(f) - F.col(f"b_{f}")).alias("o"), F.lit(f).alias("f")) for f in FEATURE_RATES]), lambda g: g["o"] < -least_gap)
    text = F.array_join(F.transform(F.slice(F.array_sort(gaps), 1, 4), lambda g: F.concat(g["f"], F.lit(" +"), F.round(-g["o"] * 100).cast("int").cast("string"), F.lit("pp"))), ", ")
    return x.select("manager", "benchmark", "tickets", r4(F.col("c")).alias("avg_context_score"), F.size(gaps).alias("n_gaps"), text.alias("gaps"))


def co_occurrence(nodes: DataFrame, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """nodes: source_row, node (a row for each).  Edges (a < b, weight) of ``least`` and more, and all nodes with degree.

    A ticket has a handful of nodes, so pairs within one are few.
    """
    sets = nodes.groupBy("source_row").agg(F.array_sort(F.collect_set("node")).alias("s"))
    pair = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    edges = sets.select(F.explode(pair).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("weight"))
    both = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    names = nodes.select("node").distinct()
    deg = names.join(both.groupBy("node").agg(F.sum("weight").alias("weighted_degree"), F.count("*").alias("degree")), "node", "left").na.fill(0)
    deg = deg.crossJoin(F.broadcast(names.agg(F.count("*").alias("all_"))))  # one row
    deg = deg.withColumn("centrality", F.round(F.col("degree") / F.greatest(F.col("all_") - 1, F.lit(1)), 6)).drop("all_")
    return edges.filter(F.col("weight") >= least), deg


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """A row for each column: distinct values, dominance, normalised entropy, degenerate or not."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.*").filter("v IS NOT NULL")
    n = x.groupBy("field", "v").agg(F.count("*").alias("n"))
    n = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("field")))
    ent = F.when(F.count("*") > 1, F.sum(-F.col("p") * F.ln("p")) / F.ln(F.count("*").cast("double"))).otherwise(0.0)
    s = n.groupBy("field").agg(F.count("*").alias("values_"), F.max("p").alias("d"), ent.alias("h"))
    return s.select("field", F.col("values_").alias("distinct_values"), F.round("d", 4).alias("dominance"), F.round("h", 4).alias("entropy"), ((F.col("d") >= 0.85) | (F.col("h") <= 0.35)).alias("degenerate"))


def grouping_sets(df: DataFrame, sets: list[list[str]], measures: list[Column]) -> DataFrame:
    """Columns of all sets (null where a set lacks one), grouping_id and measures: one row for each group of each set.

    grouping_id has a bit for each column, the first the highest: 1 where the row is
    over all its values, so totals and groups of a null value are told apart.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.grouping_id().alias("grouping_id"), *measures)


def rollup(df: DataFrame, by: list[str], measures: list[Column]) -> DataFrame:
    """Subtotals from all columns down to the grand total."""
    return grouping_sets(df, [by[:i] for i in range(len(by), -1, -1)], measures)


def cube(df: DataFrame, by: list[str], measures: list[Column]) -> DataFrame:
    """Subtotals over every set of the columns."""
    return grouping_sets(df, [[c for i, c in enumerate(by) if k >> i & 1] for k in range(2 ** len(by))], measures)
