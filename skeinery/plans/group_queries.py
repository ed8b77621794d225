"""Queries on joins, groups, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import patterns as p
from ..functions import text as t
from ..operators import grouping as g
from ..sources.tables import ISSUES, table, tickets
from .oracle import CLEANED, ENRICHED, m, q
from .registry import query
from .row_queries import BUCKET, cleaned, enriched

W = "WITH "
ISSUE_ROWS = [(int(x.split("_")[0]), x) for x in ISSUES]
LABELS = ", ".join(f"({i}, {q(x)})" for i, x in ISSUE_ROWS)
ISSUE = f"""{ENRICHED}, labels(issue_id, issue_label) AS (VALUES {LABELS}),
iss AS (SELECT e.*, coalesce(e.cluster_id, -999) AS issue_id, coalesce(l.issue_label, 'cluster_' || coalesce(e.cluster_id, -999)) AS issue_label FROM enriched e LEFT JOIN labels l ON coalesce(e.cluster_id, -999) = l.issue_id)"""


def issues(spark: SparkSession, d: str) -> DataFrame:
    return g.issues(enriched(spark, d), spark.createDataFrame(ISSUE_ROWS, "issue_id int, issue_label string"))


def av(c: str, a: str | None = None, n: int = 4) -> str:
    return f"round(round(avg(CAST({c} AS DOUBLE)), 8), {n}) AS {a or c}"


def sh(c: str, a: str, n: int = 4) -> str:
    return f"round(avg(CAST(({c}) AS INT)), {n}) AS {a}"


CNT = "CAST(count(*) AS BIGINT)"

# -- joins -------------------------------------------------------------------


@query(f"{W}{ISSUE} SELECT source_row, issue_id, issue_label FROM iss")
def f01_cluster_join(spark, d):
    return issues(spark, d).select("source_row", "issue_id", "issue_label")


@query(f"{W}{CLEANED}, o AS (SELECT source_row, 'sub_' || (CAST(source_row AS BIGINT) % 5) AS sub FROM cleaned WHERE cluster_id = -1) SELECT c.source_row, CASE WHEN cluster_id = -1 THEN coalesce(sub, '-1') ELSE CAST(cluster_id AS VARCHAR) END AS issue FROM cleaned c LEFT JOIN o USING (source_row)")
def f05_update_from_join(spark, d):
    c = cleaned(spark, d).select("source_row", "cluster_id")
    sub = c.filter("cluster_id = -1").select("source_row", F.concat(F.lit("sub_"), (F.col("source_row").cast("long") % 5).cast("string")).alias("sub"))
    return c.join(sub, "source_row", "left").select("source_row", F.when(F.col("cluster_id") == -1, F.coalesce("sub", F.lit("-1"))).otherwise(F.col("cluster_id").cast("string")).alias("issue"))


@query(f"{W}{CLEANED}, labels(issue_id, issue_label) AS (VALUES {LABELS}) SELECT source_row, cluster_id, issue_label FROM cleaned LEFT JOIN labels ON cluster_id = issue_id WHERE cluster_id = -1")
def f04_outlier_join(spark, d):
    labels = F.broadcast(spark.createDataFrame(ISSUE_ROWS, "issue_id int, issue_label string"))
    return cleaned(spark, d).join(labels, F.col("cluster_id") == F.col("issue_id"), "left").filter("cluster_id = -1").select("source_row", "cluster_id", "issue_label")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def f08_dimension_joins(spark, d):
    # nation and region are code tables of fixed size; the customers' size is left to the planner
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT doc_id, quality AS a, CAST(n_chars > 500 AS INT) AS b FROM labels JOIN documents USING (doc_id)")
def f09_run_alignment(spark, d):
    b = table(spark, d, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("b"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("a")).join(b, "doc_id")


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("rn_ = 1").drop("rn_")


@query("SELECT c_custkey, o_orderkey AS first_order FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1) ON c_custkey = o_custkey")
def f10_first_match_join(spark, d):
    o = first_of(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT o_orderkey, true AS labelled FROM orders WHERE o_orderkey IN (SELECT doc_id FROM labels) UNION ALL SELECT o_orderkey, false FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def f11_semi_anti(spark, d):
    o, ids = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "labels").select(F.col("doc_id").alias("o_orderkey"))
    return o.join(ids, "o_orderkey", "left_semi").withColumn("labelled", F.lit(True)).unionByName(o.join(ids, "o_orderkey", "left_anti").withColumn("labelled", F.lit(False)))


# -- groups ------------------------------------------------------------------

RATES = ", ".join(sh(c, c.replace("has_", "") + "_share") for c in g.FEATURE_RATES)
USERS = "CAST(count(DISTINCT nullif(uid, '')) AS BIGINT) AS unique_users"
G01 = f"""SELECT manager, {CNT} AS tickets, {USERS}, {av('context_depth_score', 'avg_context_score')}, round(round(median(context_depth_score), 8), 4) AS median_context_score,
  {av('char_count', 'avg_chars')}, {av('evidence_element_count', 'avg_evidence')}, {sh("context_depth_band IN ('rich', 'forensic')", 'rich_or_forensic_share')},
  {sh("context_depth_band = 'thin'", 'thin_share')}, {sh('is_unresolved', 'unresolved_share')}, {RATES} FROM enriched GROUP BY manager"""


@query(f"{W}{ENRICHED} {G01}")
def g01_manager_summary(spark, d):
    return g.manager_summary(enriched(spark, d))


def top_sql(src: str, by: str, value: str, n: int, name: str, pos: str = "CAST(source_row AS BIGINT)", piece: str = "v") -> str:
    return f"""SELECT {by}, string_agg({piece}, ', ' ORDER BY r) AS {name} FROM (SELECT {by}, v, n, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, f, v) AS r
    FROM (SELECT {by}, CAST({value} AS VARCHAR) AS v, count(*) AS n, min({pos}) AS f FROM {src} WHERE trim(coalesce(CAST({value} AS VARCHAR), '')) <> '' GROUP BY {by}, {value})) WHERE r <= {n} GROUP BY {by}"""


G02 = " UNION ALL ".join(f"SELECT '{k}' AS desire, desire__{k} AS on_, manager, is_unresolved, context_depth_score, source_row FROM enriched" for k in p.DESIRES)
G02_SQL = f"""d AS ({G02}), top AS ({top_sql('(SELECT * FROM d WHERE on_)', 'desire', 'manager', 3, 'top_managers')}),
dsum AS (SELECT d.desire, CAST(count(*) FILTER (on_) AS BIGINT) AS tickets, round(count(*) FILTER (on_) / count(*), 4) AS share,
  coalesce(round(avg(CAST(is_unresolved AS INT)) FILTER (on_), 4), 0.0) AS unresolved_share, coalesce(round(round(avg(context_depth_score) FILTER (on_), 8), 4), 0.0) AS avg_context_score FROM d GROUP BY desire)"""


@query(f"{W}{ENRICHED}, {G02_SQL} SELECT dsum.*, coalesce(top_managers, '') AS top_managers FROM dsum LEFT JOIN top USING (desire)")
def g02_desire_summary(spark, d):
    return g.desire_summary(enriched(spark, d))


def tops_sql(src: str, by: str, tops: dict, blanks: bool = False) -> str:
    """CTE bodies t_<name>, one for each top list."""
    full = f"(SELECT *, 1 AS one_ FROM {src})"
    make = lambda c, n, k: top_sql(full, by, c, n, k) if not blanks else top_sql(full, by, c, n, k).replace(f"WHERE trim(coalesce(CAST({c} AS VARCHAR), '')) <> ''", "")
    return ", ".join(f"t_{k} AS ({make(c, n, k)})" for k, (c, n) in tops.items())


def ex_sql(src: str, by: str, order: str, text: str, n: int, name: str = "example_") -> str:
    cols = ", ".join(f"coalesce(max({text}) FILTER (k_ = {i}), '') AS {name}{i}" for i in range(1, n + 1))
    return f"exs AS (SELECT {by}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k_ FROM {src}) GROUP BY {by})"


SHORT = "CASE WHEN length(question_flat) <= 420 THEN question_flat ELSE rtrim(substr(question_flat, 1, 417)) || '...' END"
CLUSTER_TOPS = {"top_desires": ("primary_desire", 4), "top_categories": ("category", 4), "top_managers": ("manager", 4)}

Z = "({a} / {na} - {b} / {nb}) / sqrt(greatest((({a} + {b}) / ({na} + {nb})) * (1 - ({a} + {b}) / ({na} + {nb})) * (1.0 / {na} + 1.0 / {nb}), 1e-9))"
G04 = f"""mx AS (SELECT max(date) AS top FROM iss), w AS (SELECT iss.*, coalesce(date >= top - INTERVAL 30 DAY, false) AS r, coalesce(date >= top - INTERVAL 120 DAY AND date < top - INTERVAL 30 DAY, false) AS b FROM iss, mx),
tot AS (SELECT greatest(count(*) FILTER (r), 1) AS nr, greatest(count(*) FILTER (b), 1) AS nb FROM w),
rep AS (SELECT uid FROM w WHERE uid <> '' GROUP BY uid HAVING count(*) >= 2),
s AS (SELECT issue_id, issue_label, {CNT} AS tickets, {USERS}, CAST(count(*) FILTER (r) AS BIGINT) AS recent_tickets, CAST(count(*) FILTER (b) AS BIGINT) AS baseline_tickets, avg(CAST(uid IN (SELECT uid FROM rep) AS INT)) AS again,
  avg(CAST(is_unresolved AS INT)) AS u, avg(CAST(trust_money_flag AS INT)) AS risk, avg(CAST(context_depth_band IN ('rich', 'forensic') AS INT)) AS rich, avg(context_depth_score) AS ctx, avg(urgency_signal) AS urg FROM w GROUP BY ALL),
s2 AS (SELECT s.*, (recent_tickets / nr + 0.0005::DOUBLE) / (baseline_tickets / nb + 0.0005::DOUBLE) AS l, {Z.format(a='recent_tickets', na='nr', b='baseline_tickets', nb='nb')} AS z FROM s, tot),
{tops_sql('w', 'issue_id', {'top_desires': ('primary_desire', 5), 'top_categories': ('category', 4), 'top_managers': ('manager', 4)})}, {ex_sql('w', 'issue_id', 'context_depth_score DESC, char_count DESC, CAST(source_row AS BIGINT)', SHORT, 3)},
backlog AS (SELECT issue_id, issue_label, tickets, unique_users, round(round(again, 8), 4) AS repeat_user_share, round(u, 4) AS unresolved_share, round(round(ctx, 8), 2) AS avg_context_score, round(rich, 4) AS rich_or_forensic_share,
  round(round(urg, 8), 3) AS urgency_avg, round(risk, 4) AS trust_money_risk, recent_tickets, baseline_tickets, round(round(l, 8), 3) AS recent_lift, round(round(z, 8), 3) AS trend_z, coalesce(top_desires, '') AS top_desires, coalesce(top_categories, '') AS top_categories,
  coalesce(top_managers, '') AS top_managers, example_1, example_2, example_3,
  round(round(sqrt(tickets) * (1 + 2.2::DOUBLE * u + 1.2::DOUBLE * least(greatest(l - 1, 0), 3) + 1.4::DOUBLE * risk) + 8 * rich + 0.06::DOUBLE * ctx, 8), 2) AS opportunity_score
  FROM s2 LEFT JOIN t_top_desires USING (issue_id) LEFT JOIN t_top_categories USING (issue_id) LEFT JOIN t_top_managers USING (issue_id) LEFT JOIN exs USING (issue_id))"""


@query(f"{W}{ISSUE}, {G04} SELECT * FROM backlog")
def g04_opportunity_backlog(spark, d):
    return g.backlog(issues(spark, d))


@query(f"{W}{ISSUE}, {G04} SELECT issue_id, opportunity_score FROM backlog")
def d11_opportunity_score(spark, d):
    return g.backlog(issues(spark, d)).select("issue_id", "opportunity_score")


G05 = f"""x AS (SELECT * FROM iss WHERE issue_id <> -999), mx AS (SELECT max(date) AS top FROM x),
w AS (SELECT x.*, coalesce(date >= top - INTERVAL 30 DAY, false) AS r30, coalesce(date >= top - INTERVAL 60 DAY, false) AS r60, coalesce(date >= top - INTERVAL 90 DAY, false) AS r90,
  coalesce(date >= top - INTERVAL 180 DAY AND date < top - INTERVAL 30 DAY, false) AS b FROM x, mx),
tot AS (SELECT greatest(count(*) FILTER (r30), 1) AS nr, greatest(count(*) FILTER (b), 1) AS nb FROM w),
s AS (SELECT issue_id, issue_label, {CNT} AS total_tickets, CAST(count(*) FILTER (r30) AS BIGINT) AS last_30_tickets, CAST(count(*) FILTER (r60) AS BIGINT) AS last_60_tickets, CAST(count(*) FILTER (r90) AS BIGINT) AS last_90_tickets,
  CAST(count(*) FILTER (b) AS BIGINT) AS prior_tickets, coalesce(avg(CAST(is_unresolved AS INT)) FILTER (r30), 0.0) AS ru FROM w GROUP BY ALL),
s2 AS (SELECT s.*, round((last_30_tickets / nr + 0.0005::DOUBLE) / (prior_tickets / nb + 0.0005::DOUBLE), 3) AS recent_vs_prior_lift, round({Z.format(a='last_30_tickets', na='nr', b='prior_tickets', nb='nb')}, 3) AS recent_vs_prior_z, round(ru, 4) AS recent_unresolved_share FROM s, tot),
tops_emerging AS ({top_sql('w', 'issue_id', 'primary_desire', 4, 'top_desires')}),
emerging AS (SELECT issue_id, issue_label, total_tickets, last_30_tickets, round(last_30_tickets / total_tickets, 4) AS last_30_share_of_issue, last_60_tickets, round(last_60_tickets / total_tickets, 4) AS last_60_share_of_issue, last_90_tickets, round(last_90_tickets / total_tickets, 4) AS last_90_share_of_issue,
  recent_vs_prior_lift, recent_vs_prior_z, recent_unresolved_share, coalesce(top_desires, '') AS top_desires, round(round(sqrt(last_30_tickets) * least(recent_vs_prior_lift, 6) * (1 + recent_unresolved_share), 8), 2) AS emergence_score FROM s2 LEFT JOIN tops_emerging USING (issue_id))"""


@query(f"{W}{ISSUE}, {G05} SELECT * FROM emerging")
def g05_emerging_topics(spark, d):
    return g.emerging(issues(spark, d))


@query(f"{W}{ISSUE}, {G05} SELECT issue_id, emergence_score FROM emerging")
def d12_emergence_score(spark, d):
    return g.emerging(issues(spark, d)).select("issue_id", "emergence_score")


G06 = f"""n AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CAST(source_row AS BIGINT)) AS rn FROM iss WHERE uid <> ''),
s AS (SELECT uid, CAST(count(*) AS BIGINT) AS tickets, CAST(count(DISTINCT issue_id) AS BIGINT) AS unique_issues, min(date) AS first_date, max(date) AS last_date, count(date) AS dated, avg(CAST(is_unresolved AS INT)) AS u, avg(context_depth_score) AS c,
  list(DISTINCT primary_desire) AS ds, string_agg(lower(issue_label), ' ') FILTER (rn <= 20) AS ls FROM n GROUP BY uid HAVING count(*) >= 2),
{tops_sql('n', 'uid', {'managers_seen': ('manager', 5), 'top_desires': ('primary_desire', 5), 'top_issues': ('issue_label', 5)})}, {ex_sql('n', 'uid', 'context_depth_score DESC, date NULLS LAST, CAST(source_row AS BIGINT)', SHORT, 2, 'high_context_example_')},
personas AS (SELECT uid, CASE WHEN list_contains(ds, 'earn_or_transact_money') AND (list_contains(ds, 'protect_from_abuse_or_scam') OR contains(ls, 'scam') OR contains(ls, 'diamonds')) THEN 'commerce_dispute_or_scam_risk'
  WHEN list_contains(ds, 'clear_name_or_get_fairness') AND u >= 0.25 THEN 'repeat_ban_appeal_or_fairness_seeker' WHEN list_contains(ds, 'grow_audience_or_community') THEN 'creator_channel_operator'
  WHEN list_contains(ds, 'gain_status_or_privileges') THEN 'svip_status_optimizer' WHEN list_contains(ds, 'recover_access') THEN 'account_recovery_repeat_user' WHEN len(ds) >= 4 THEN 'multi_problem_power_user' ELSE 'general_repeat_user' END AS persona,
  tickets, unique_issues, first_date, last_date, CASE WHEN dated = tickets THEN CAST(date_diff('day', CAST(first_date AS DATE), CAST(last_date AS DATE)) AS INT) END AS span_days, round(u, 4) AS unresolved_share, round(round(c, 8), 2) AS avg_context_score,
  coalesce(managers_seen, '') AS managers_seen, coalesce(top_desires, '') AS top_desires, coalesce(top_issues, '') AS top_issues, high_context_example_1, high_context_example_2
  FROM s LEFT JOIN t_managers_seen USING (uid) LEFT JOIN t_top_desires USING (uid) LEFT JOIN t_top_issues USING (uid) LEFT JOIN exs USING (uid))"""


@query(f"{W}{ISSUE}, {G06} SELECT * FROM personas")
def g06_repeat_user_personas(spark, d):
    return g.repeat_users(issues(spark, d))


@query(f"{W}{ISSUE}, {G06} SELECT persona, {CNT} AS users, CAST(sum(tickets) AS BIGINT) AS tickets FROM personas GROUP BY persona")
def e07_persona_counts(spark, d):
    return g.repeat_users(issues(spark, d)).groupBy("persona").agg(F.count("*").alias("users"), F.sum("tickets").alias("tickets"))


@query(f"{W}{ENRICHED}, x AS (SELECT *, avg(context_depth_score) OVER (PARTITION BY category, question_kind) AS e FROM enriched) SELECT manager, {CNT} AS tickets, round(round(avg(context_depth_score), 8), 4) AS raw, round(round(avg(e), 8), 4) AS expected, round(round(avg(context_depth_score - e), 8), 4) AS residual FROM x GROUP BY manager")
def g07_manager_residuals(spark, d):
    return g.manager_residuals(enriched(spark, d))


@query(f"{W}{ENRICHED} SELECT source_row, round(avg(context_depth_score) OVER (PARTITION BY category, question_kind), 4) AS expected, round(context_depth_score - avg(context_depth_score) OVER (PARTITION BY category, question_kind), 4) AS residual FROM enriched")
def f07_group_mean_back_join(spark, d):
    mean = F.avg("context_depth_score").over(Window.partitionBy("category", "question_kind"))
    return enriched(spark, d).select("source_row", F.round(mean, 4).alias("expected"), F.round(F.col("context_depth_score") - mean, 4).alias("residual"))


_ALL = sorted({c for *_, cols in g.REQUIRED for c in cols} | set(g.REQUIRED_ELSE))
_NEED = " || ".join(f"CASE WHEN list_has_any(coalesce(d, []), [{', '.join(map(q, ds))}]) OR regexp_matches(lower(replace(issue_label, '_', ' ')), {q(rx)}) THEN [{', '.join(map(q, cols))}] ELSE [] END" for ds, rx, cols in g.REQUIRED)
G08 = f"""per AS (SELECT issue_label, primary_desire, count(*) AS n FROM iss GROUP BY ALL), dom AS (SELECT issue_label, list(primary_desire) AS d FROM (SELECT *, n / sum(n) OVER (PARTITION BY issue_label) AS s FROM per) WHERE s >= 0.25 GROUP BY issue_label),
s AS (SELECT issue_label, {CNT} AS tickets, avg(context_depth_score) AS c, avg(CAST(is_unresolved AS INT)) AS u, {', '.join(f'1 - avg(CAST({f} AS INT)) AS {f}' for f in _ALL)} FROM iss GROUP BY issue_label HAVING count(*) >= 20),
w AS (SELECT s.*, list_sort(list_distinct({_NEED})) AS need0 FROM s LEFT JOIN dom USING (issue_label)), w2 AS (SELECT *, CASE WHEN len(need0) > 0 THEN need0 ELSE list_sort([{', '.join(map(q, g.REQUIRED_ELSE))}]) END AS need FROM w),
lng AS (SELECT issue_label, f, CASE f {' '.join(f"WHEN '{f}' THEN {f}" for f in _ALL)} END AS miss FROM (SELECT *, unnest(need) AS f FROM w2)),
rk AS (SELECT *, row_number() OVER (PARTITION BY issue_label ORDER BY miss DESC, f) AS r FROM lng),
gp AS (SELECT issue_label, round(avg(miss), 4) AS mean_gap, string_agg(f || ' ' || CAST(round(miss * 100) AS INT) || '%', ', ' ORDER BY r) FILTER (r <= 4) AS top_gaps FROM rk GROUP BY issue_label)"""


@query(f"{W}{ISSUE}, {G08} SELECT issue_label, tickets, round(c, 2) AS avg_context_score, round(u, 4) AS unresolved_share, array_to_string(need, ', ') AS required_evidence, mean_gap, top_gaps FROM w2 JOIN gp USING (issue_label)")
def g08_evidence_gaps(spark, d):
    return g.evidence_gaps(issues(spark, d))


G09 = f"""rt AS (SELECT manager, {CNT} AS tickets, avg(context_depth_score) AS c, {', '.join(f'avg(CAST({f} AS INT)) AS {f}' for f in g.FEATURE_RATES)} FROM enriched WHERE manager <> '' GROUP BY manager),
bm AS (SELECT manager AS benchmark, {', '.join(f'{f} AS b_{f}' for f in g.FEATURE_RATES)} FROM rt ORDER BY c DESC, manager LIMIT 1),
lg AS ({' UNION ALL '.join(f"SELECT manager, '{f}' AS f, b_{f} - {f} AS gap FROM rt, bm" for f in g.FEATURE_RATES)}), rk AS (SELECT *, row_number() OVER (PARTITION BY manager ORDER BY gap DESC, f) AS r FROM lg WHERE gap > 0.03),
gp AS (SELECT manager, CAST(count(*) AS INT) AS n_gaps, string_agg(f || ' +' || CAST(round(gap * 100) AS INT) || 'pp', ', ' ORDER BY r) FILTER (r <= 4) AS gaps FROM rk GROUP BY manager)"""


@query(f"{W}{ENRICHED}, {G09} SELECT manager, benchmark, tickets, round(round(c, 8), 4) AS avg_context_score, coalesce(n_gaps, 0) AS n_gaps, coalesce(gaps, '') AS gaps FROM rt, bm LEFT JOIN gp USING (manager)".replace("FROM rt, bm LEFT JOIN gp USING (manager)", "FROM (SELECT * FROM rt, (SELECT benchmark FROM bm)) LEFT JOIN gp USING (manager)"))
def g09_manager_coaching(spark, d):
    return g.coaching(enriched(spark, d))


def pair_nodes(spark, d):
    e = enriched(spark, d)
    desires = [F.when(F.col(f"desire__{k}"), F.lit(f"d:{k}")) for k in p.DESIRES]
    nodes = F.array_compact(F.array(*desires, F.concat(F.lit("c:"), "category"), F.when(F.col("manager") != "", F.concat(F.lit("m:"), "manager"))))
    return e.select("source_row", F.explode(nodes).alias("node"))


G12 = f"""nd AS (SELECT source_row, unnest(list_filter([{', '.join(f"CASE WHEN desire__{k} THEN 'd:{k}' END" for k in p.DESIRES)}, 'c:' || category, CASE WHEN manager <> '' THEN 'm:' || manager END], lambda x: x IS NOT NULL)) AS node FROM enriched),
ed AS (SELECT a.node AS a, b.node AS b, {CNT} AS weight FROM nd a JOIN nd b ON a.source_row = b.source_row AND a.node < b.node GROUP BY ALL)"""


@query(f"{W}{ENRICHED}, {G12} SELECT * FROM ed WHERE weight >= 8")
def g12_co_occurrence_edges(spark, d):
    return g.co_occurrence(pair_nodes(spark, d))[0]


@query(f"{W}{ENRICHED}, {G12}, b AS (SELECT a AS node, weight FROM ed UNION ALL SELECT b, weight FROM ed), s AS (SELECT node, sum(weight) AS w, count(*) AS k FROM b GROUP BY node), n AS (SELECT DISTINCT node FROM nd) SELECT node, CAST(coalesce(w, 0) AS BIGINT) AS weighted_degree, CAST(coalesce(k, 0) AS BIGINT) AS degree, round(coalesce(k, 0) / greatest((SELECT count(*) FROM n) - 1, 1), 6) AS centrality FROM n LEFT JOIN s USING (node)")
def f15_co_occurrence_degrees(spark, d):
    return g.co_occurrence(pair_nodes(spark, d))[1]


@query(f"{W}{CLEANED} SELECT category, {CNT} AS n FROM cleaned GROUP BY category")
def g13_value_counts(spark, d):
    return cleaned(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query(f"{W}{ENRICHED}, a AS ({top_sql('enriched', 'uid', 'primary_desire', 3, 'plain')}), b AS ({top_sql('enriched', 'uid', 'primary_desire', 3, 'counted', piece='''v || ' (' || n || ')' ''')}), c AS ({top_sql('enriched', 'uid', 'primary_desire', 3, 'colons', piece='''v || ':' || n''')}) SELECT uid, plain, counted, colons FROM a JOIN b USING (uid) JOIN c USING (uid)")
def g14_top_lists(spark, d):
    e = enriched(spark, d).withColumn("first_pos", F.col("source_row").cast("long")).select("uid", "primary_desire", "first_pos")
    one = lambda name, style: g.top_list(e, ["uid"], "primary_desire", 3, name, style)
    return one("plain", "{v}").join(one("counted", "{v} ({n})"), "uid").join(one("colons", "{v}:{n}"), "uid")


@query(f"{W}{ENRICHED}, x AS (SELECT manager, primary_desire AS v, count(*) AS n, min(CAST(source_row AS BIGINT)) AS f FROM enriched GROUP BY ALL) SELECT manager, arg_min(v, (-n, f)) AS first_mode, arg_min(v, (-n, v)) AS least_mode FROM x GROUP BY manager".replace("arg_min(v, (-n, f))", "first(v ORDER BY n DESC, f)").replace("arg_min(v, (-n, v))", "first(v ORDER BY n DESC, v)"))
def g15_modes(spark, d):
    x = enriched(spark, d).groupBy("manager", F.col("primary_desire").alias("v")).agg(F.count("*").alias("n"), F.min(F.col("source_row").cast("long")).alias("f"))
    return x.groupBy("manager").agg(F.min_by("v", F.struct(-F.col("n"), "f")).alias("first_mode"), F.min_by("v", F.struct(-F.col("n"), "v")).alias("least_mode"))


@query(f"{W}{CLEANED} SELECT category, {', '.join(f'''CAST(count(*) FILTER (status_en = '{s}') AS BIGINT) AS "{s}"''' for s in ('Closed', 'In process', 'Failed'))} FROM cleaned GROUP BY category")
def g16_crosstab(spark, d):
    return cleaned(spark, d).groupBy("category").pivot("status_en", ["Closed", "In process", "Failed"]).count().na.fill(0)


@query(f"{W}{CLEANED}, x AS (SELECT *, {BUCKET} AS s FROM cleaned WHERE month <> '') SELECT month, want_id, {CNT} AS records, CAST(count(DISTINCT uid) AS BIGINT) AS users, CAST(count(*) FILTER (s = 'failed') AS BIGINT) AS failed, round(count(*) FILTER (s = 'failed') / count(*), 4) AS failed_share FROM x GROUP BY ALL")
def g17_monthly_wants(spark, d):
    from ..operators.ingest import status_bucket

    x = cleaned(spark, d).filter("month <> ''").withColumn("s", status_bucket())
    return x.groupBy("month", "want_id").agg(F.count("*").alias("records"), F.countDistinct("uid").alias("users"), F.count_if(F.col("s") == "failed").alias("failed"), F.round(F.avg((F.col("s") == "failed").cast("int")), 4).alias("failed_share"))


@query(f"{W}{ENRICHED}, top AS (SELECT primary_desire FROM enriched GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8) SELECT month, primary_desire, {CNT} AS n FROM enriched SEMI JOIN top USING (primary_desire) GROUP BY ALL")
def g18_monthly_top_desires(spark, d):
    e = enriched(spark, d).groupBy("month", "primary_desire").agg(F.count("*").alias("n"))
    top = e.groupBy("primary_desire").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "primary_desire").limit(8)
    return e.join(F.broadcast(top), "primary_desire", "left_semi")


@query(f"{W}{CLEANED}, x AS (SELECT month, want_id, count(*) AS r, count(*) FILTER (NOT is_resolved) AS f FROM cleaned GROUP BY ALL) SELECT month, CASE WHEN want_id < 3 THEN 'low' ELSE 'high' END AS title, CAST(sum(r) AS BIGINT) AS records, round(sum(f) / sum(r), 4) AS failed_share FROM x GROUP BY ALL")
def g19_title_monthly(spark, d):
    x = cleaned(spark, d).groupBy("month", "want_id").agg(F.count("*").alias("r"), F.count_if("is_unresolved").alias("f"))
    title = F.when(F.col("want_id") < 3, "low").otherwise("high")
    return x.groupBy("month", title.alias("title")).agg(F.sum("r").alias("records"), F.round(F.sum("f") / F.sum("r"), 4).alias("failed_share"))


@query(f"{W}{CLEANED} SELECT category, CAST(count(DISTINCT want_id) AS BIGINT) AS wants, CAST(count(DISTINCT uid) AS BIGINT) AS users FROM cleaned GROUP BY category")
def g21_fan_out(spark, d):
    return cleaned(spark, d).groupBy("category").agg(F.countDistinct("want_id").alias("wants"), F.countDistinct("uid").alias("users"))


@query(f"{W}{ISSUE}, s AS (SELECT issue_label, count(*) AS n, avg(context_depth_score) AS c FROM iss GROUP BY 1) SELECT CASE WHEN contains(issue_label, 'diamond') THEN 'money' ELSE 'other' END AS theme, CAST(sum(n) AS BIGINT) AS tickets, round(avg(c), 4) AS mean_context, round(sum(n) / (SELECT sum(n) FROM s), 4) AS share FROM s GROUP BY 1")
def g22_theme_rollup(spark, d):
    s = issues(spark, d).groupBy("issue_label").agg(F.count("*").alias("n"), F.avg("context_depth_score").alias("c"))
    x = s.groupBy(F.when(F.col("issue_label").contains("diamond"), "money").otherwise("other").alias("theme")).agg(F.sum("n").alias("tickets"), F.round(F.avg("c"), 4).alias("mean_context"))
    return x.withColumn("share", F.round(F.col("tickets") / F.sum("tickets").over(Window.partitionBy()), 4))


@query(f"{W}{ENRICHED}, x AS (SELECT unnest(list_filter([{', '.join(f'''CASE WHEN NOT {c} THEN '{c}' END''' for c in p.EVIDENCE)}], lambda x: x IS NOT NULL)) AS missing FROM enriched) SELECT missing, {CNT} AS n FROM x GROUP BY 1")
def g23_list_cells(spark, d):
    missing = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in p.EVIDENCE]))
    return enriched(spark, d).select(F.explode(missing).alias("missing")).groupBy("missing").agg(F.count("*").alias("n"))


PROFILE = ["date", "manager", "uid", "cluster_id", "category"]


@query(f"{W}{CLEANED} " + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST(count(*) - count({c}) AS BIGINT) AS nulls, round((count(*) - count({c})) / count(*), 4) AS null_share, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values FROM cleaned" for c in PROFILE))
def g24_column_profile(spark, d):
    x = cleaned(spark, d)
    one = x.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in PROFILE], *[F.countDistinct(c).alias(f"d_{c}") for c in PROFILE])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), (F.col("n") - F.col(f"n_{c}")).alias("nulls"), F.round((F.col("n") - F.col(f"n_{c}")) / F.col("n"), 4).alias("null_share"), F.col(f"d_{c}").alias("distinct_values")) for c in PROFILE])
    return one.select(F.explode(rows).alias("x")).select("x.*")


@query(f"{W}{ENRICHED} SELECT CAST(least(floor(context_depth_score / 10), 9) AS INT) AS bin, {CNT} AS n, round(quantile_cont(char_count, 0.25), 4) AS q1, round(quantile_cont(char_count, 0.5), 4) AS q2, round(quantile_cont(char_count, 0.75), 4) AS q3 FROM enriched GROUP BY 1")
def g25_histogram(spark, d):
    bin_ = F.least(F.floor(F.col("context_depth_score") / 10), F.lit(9)).cast("int")
    return enriched(spark, d).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), *[F.round(F.percentile("char_count", F.lit(x)), 4).alias(n) for n, x in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])


_PF = ["status_en", "context_depth_band", "primary_desire", "has_user_claim"]


@query(f"{W}{ENRICHED}, x AS ({' UNION ALL '.join(f'''SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS v FROM enriched''' for c in _PF)}), n AS (SELECT field, v, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY field) AS p FROM n), r AS (SELECT field, {CNT} AS distinct_values, max(p) AS d, CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0.0 END AS h FROM s GROUP BY field) SELECT field, distinct_values, round(d, 4) AS dominance, round(h, 4) AS entropy, d >= 0.85 OR h <= 0.35 AS degenerate FROM r")
def g26_quality_profile(spark, d):
    return g.profile(enriched(spark, d), _PF)


G27 = "x AS (SELECT doc_id, quality AS a, CAST(n_chars > 500 AS INT) AS b FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {G27} SELECT {CNT} AS n, round(avg(CAST(a = b AS INT)), 4) AS agreement, (SELECT a || '->' || b FROM x WHERE a <> b GROUP BY a, b ORDER BY count(*) DESC, a, b LIMIT 1) AS top_flip, round(avg(b) - avg(a), 4) AS mean_shift FROM x")
def g27_run_diff(spark, d):
    x = f09_run_alignment(spark, d)
    flips = x.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    top = flips.agg(F.min_by(F.concat_ws("->", F.col("a").cast("string"), F.col("b").cast("string")), F.struct(-F.col("n"), "a", "b")).alias("top_flip"))
    s = x.agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 4).alias("agreement"), F.round(F.avg("b") - F.avg("a"), 4).alias("mean_shift"))
    return s.crossJoin(F.broadcast(top))


@query(f"{W}{CLEANED} SELECT uid, {CNT} AS records, max(date) AS latest, last(status_en ORDER BY date NULLS FIRST, CAST(source_row AS BIGINT)) AS last_status, last(want_id ORDER BY date NULLS FIRST, CAST(source_row AS BIGINT)) AS last_want FROM cleaned WHERE uid <> '' GROUP BY uid")
def g28_user_rollup(spark, d):
    o = F.struct("date", F.col("source_row").cast("long"))
    return cleaned(spark, d).filter("uid <> ''").groupBy("uid").agg(F.count("*").alias("records"), F.max("date").alias("latest"), F.max_by("status_en", o).alias("last_status"), F.max_by("want_id", o).alias("last_want"))


@query(f"{W}{CLEANED} SELECT CASE WHEN want_id < 3 THEN 'low' ELSE 'high' END AS title, {CNT} AS estimated, CAST(count(*) FILTER (is_resolved) AS BIGINT) AS confirmed, CAST(count(DISTINCT want_id) AS BIGINT) AS clusters FROM cleaned GROUP BY 1")
def g29_wants_by_title(spark, d):
    return cleaned(spark, d).groupBy(F.when(F.col("want_id") < 3, "low").otherwise("high").alias("title")).agg(F.count("*").alias("estimated"), F.count_if("is_resolved").alias("confirmed"), F.countDistinct("want_id").alias("clusters"))


G30 = ", ".join(f"CAST(SUM(CAST({c} AS INT)) AS BIGINT) AS {c}" for c in p.EVIDENCE)


@query(f"{W}{ENRICHED} SELECT {G30} FROM enriched")
def g30_flag_sums(spark, d):
    return enriched(spark, d).selectExpr(*[x.strip() for x in G30.split(", ")])


@query("SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT date_diff('second', min(ts), max(ts)) FROM events) * 3600, 4) AS per_hour FROM events GROUP BY 1")
def g31_progress(spark, d):
    e = table(spark, d, "events")
    span = e.agg(F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("s"))
    return e.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(span)).select("status", "n", F.round(F.col("n") / F.col("s") * 3600, 4).alias("per_hour"))


@query("SELECT quality, toxic, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY ALL")
def g32_flag_counts(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


# -- order and sets ----------------------------------------------------------

SEQ = "row_number() OVER (PARTITION BY uid ORDER BY date NULLS LAST, source_row)"


def journey_events(x: DataFrame) -> DataFrame:
    """Rows of a user in the order of date (null last) and of the row's key as text."""
    w = Window.partitionBy("uid").orderBy(F.col("date").asc_nulls_last(), "source_row")
    first = F.min("date").over(Window.partitionBy("uid"))
    return x.filter("uid <> ''").withColumns({"event_index": F.row_number().over(w), "days_since_first": F.datediff("date", first)})


@query(f"{W}{CLEANED} SELECT uid, source_row, CAST({SEQ} AS INT) AS event_index, CAST(date_diff('day', CAST(min(date) OVER (PARTITION BY uid) AS DATE), CAST(date AS DATE)) AS INT) AS days_since_first FROM cleaned WHERE uid <> ''")
def h01_event_index(spark, d):
    return journey_events(cleaned(spark, d)).select("uid", "source_row", "event_index", "days_since_first")


@query(f"{W}{CLEANED} SELECT uid, first(status_en ORDER BY date NULLS LAST, source_row) AS first_status, last(status_en ORDER BY date NULLS LAST, source_row) AS last_status FROM cleaned WHERE uid <> '' GROUP BY uid")
def h02_first_last(spark, d):
    x = journey_events(cleaned(spark, d))
    return x.groupBy("uid").agg(F.min_by("status_en", "event_index").alias("first_status"), F.max_by("status_en", "event_index").alias("last_status"))


def path(x: DataFrame, by: str, value: str, order: str, limit: int = 9, name: str = "path") -> DataFrame:
    """Values of a group in order, blanks and repeats of the one before left out, joined by arrows."""
    x = x.filter(F.coalesce(F.col(value).cast("string"), F.lit("")) != "")
    x = x.withColumn("b_", F.lag(value).over(Window.partitionBy(by).orderBy(order))).filter(F.col("b_").isNull() | (F.col("b_") != F.col(value)))
    a = F.sort_array(F.collect_list(F.struct(order, F.col(value).cast("string").alias("v"))))
    x = x.groupBy(by).agg(F.transform(a, lambda s: s["v"]).alias("a_"))
    return x.select(by, F.concat(F.array_join(F.slice("a_", 1, limit), " -> "), F.when(F.size("a_") > limit, " -> ...").otherwise("")).alias(name))


H03 = """SELECT {by}, string_agg(v, ' -> ' ORDER BY o) FILTER (k <= 9) || CASE WHEN max(k) > 9 THEN ' -> ...' ELSE '' END AS path FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY o) AS k FROM
  (SELECT *, lag(v) OVER (PARTITION BY {by} ORDER BY o) AS b FROM {src}) WHERE b IS NULL OR b <> v) GROUP BY {by}"""


@query(f"{W}{CLEANED}, x AS (SELECT uid, CAST(want_id AS VARCHAR) AS v, {SEQ} AS o FROM cleaned WHERE uid <> '') " + H03.format(by="uid", src="x"))
def h03_collapsed_path(spark, d):
    return path(journey_events(cleaned(spark, d)), "uid", "want_id", "event_index")


@query("WITH x AS (SELECT conv_id, role AS v, turn AS o FROM conversations WHERE role <> '') " + H03.format(by="conv_id", src="x"))
def h03_conversation_path(spark, d):
    return path(table(spark, d, "conversations"), "conv_id", "role", "turn")


@query(f"{W}{ISSUE}, r AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY context_depth_score DESC, source_row) AS k FROM iss), n AS (SELECT greatest(1, 40 // count(DISTINCT issue_id)) AS per FROM iss), h AS (SELECT source_row FROM r, n WHERE k <= per), t AS (SELECT source_row FROM r ANTI JOIN h USING (source_row) ORDER BY context_depth_score DESC, source_row LIMIT greatest(0, 40 - (SELECT count(*) FROM h))) SELECT source_row, 'head' AS part FROM h UNION ALL SELECT source_row, 'top_up' FROM t".replace("LIMIT greatest(0, 40 - (SELECT count(*) FROM h))", "LIMIT (SELECT greatest(0, 40 - count(*)) FROM h)"))
def h04_balanced_sample(spark, d, limit: int = 40):
    x = issues(spark, d).select("source_row", "issue_id", "context_depth_score")
    n = x.select("issue_id").distinct().count()
    order = [F.desc("context_depth_score"), F.col("source_row")]
    head = x.withColumn("k", F.row_number().over(Window.partitionBy("issue_id").orderBy(*order))).filter(F.col("k") <= max(1, limit // n)).select("source_row")
    rest = x.join(head, "source_row", "left_anti").orderBy(*order).limit(max(0, limit - head.count())).select("source_row")
    return head.withColumn("part", F.lit("head")).unionByName(rest.withColumn("part", F.lit("top_up")))


@query(f"{W}{ISSUE}, r AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY context_depth_score DESC, char_count DESC, source_row) AS k FROM iss) SELECT issue_id, {', '.join(f'''coalesce(max(CASE WHEN k = {i} THEN source_row END), '') AS example_{i}''' for i in (1, 2, 3))} FROM r GROUP BY issue_id")
def h05_examples(spark, d):
    w = Window.partitionBy("issue_id").orderBy(F.desc("context_depth_score"), F.desc("char_count"), "source_row")
    x = issues(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return x.groupBy("issue_id").agg(*[F.coalesce(F.max(F.when(F.col("k") == i, F.col("source_row"))), F.lit("")).alias(f"example_{i}") for i in (1, 2, 3)])


@query(f"{W}{CLEANED} SELECT source_row, count(*) OVER (PARTITION BY uid) >= 2 AS repeat FROM cleaned WHERE uid <> ''")
def h11_repeat_flag(spark, d):
    return cleaned(spark, d).filter("uid <> ''").select("source_row", (F.count("*").over(Window.partitionBy("uid")) >= 2).alias("repeat"))


@query(f"{W}{CLEANED} SELECT category, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cleaned GROUP BY category")
def h10_share_of_total(spark, d):
    x = cleaned(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    return x.select("category", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query(f"{W}{CLEANED}, f AS (SELECT category, min(CAST(source_row AS BIGINT)) AS first_pos FROM cleaned GROUP BY 1) SELECT category, first_pos, CAST(row_number() OVER (ORDER BY first_pos) AS INT) AS place FROM f")
def h12_first_appearance(spark, d):
    f = cleaned(spark, d).groupBy("category").agg(F.min(F.col("source_row").cast("long")).alias("first_pos"))
    return f.withColumn("place", F.row_number().over(Window.orderBy("first_pos")))


@query("SELECT event_id, ts FROM events ORDER BY event_id DESC LIMIT 25")
def h13_table_tail(spark, d):
    return table(spark, d, "events").orderBy(F.desc("event_id")).limit(25).select("event_id", "ts")


@query(f"{W}{ENRICHED} SELECT source_row, context_depth_score FROM enriched ORDER BY context_depth_score DESC, source_row LIMIT 80")
def i01_top_examples(spark, d):
    return enriched(spark, d).select("source_row", "context_depth_score").orderBy(F.desc("context_depth_score"), "source_row").limit(80)


@query(f"{W}{CLEANED}, s AS (SELECT manager, category, {CNT} AS n FROM cleaned GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY n DESC, category, manager) AS INT) AS place FROM s")
def i02_mixed_sort(spark, d):
    s = cleaned(spark, d).groupBy("manager", "category").agg(F.count("*").alias("n"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "category", "manager")))


@query(f"{W}{ENRICHED} SELECT source_row, risk_signal_count, char_count FROM enriched ORDER BY risk_signal_count DESC, char_count DESC, source_row LIMIT 800")
def i03_review_queue(spark, d):
    return enriched(spark, d).select("source_row", "risk_signal_count", "char_count").orderBy(F.desc("risk_signal_count"), F.desc("char_count"), "source_row").limit(800)


RISK = " + ".join(f"CAST({c} AS INT)" for c in ("has_money_terms", "has_status_or_svip_terms", "has_ban_reason_language", "has_user_claim", "is_unresolved"))


@query(f"{W}{ENRICHED} SELECT source_row, {RISK} AS risk FROM enriched WHERE context_depth_score >= 24 AND char_count >= 40 ORDER BY {RISK} DESC, context_depth_score DESC, source_row LIMIT 250")
def i04_risk_balanced_candidates(spark, d):
    e = enriched(spark, d).filter("context_depth_score >= 24 AND char_count >= 40").withColumn("risk", F.expr(RISK))
    return e.orderBy(F.desc("risk"), F.desc("context_depth_score"), "source_row").limit(250).select("source_row", "risk")


@query(f"{W}{CLEANED} SELECT source_row, date FROM cleaned WHERE date IS NOT NULL ORDER BY date DESC, source_row LIMIT 100")
def i05_browse(spark, d):
    return cleaned(spark, d).filter("date IS NOT NULL").select("source_row", "date").orderBy(F.desc("date"), "source_row").limit(100)


@query(f"{W}{CLEANED} SELECT source_row, category FROM cleaned ORDER BY md5(source_row || ':42'), source_row LIMIT 500")
def i06_fixed_sample(spark, d):
    return cleaned(spark, d).select("source_row", "category").orderBy(F.md5(F.concat("source_row", F.lit(":42"))), "source_row").limit(500)


@query(f"{W}{CLEANED} SELECT DISTINCT category FROM cleaned WHERE category IS NOT NULL ORDER BY 1")
def i07_facet_values(spark, d):
    return cleaned(spark, d).select("category").filter("category IS NOT NULL").distinct().orderBy("category")


@query(f"{W}{CLEANED}, s AS (SELECT want_id, {CNT} AS size FROM cleaned GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY size DESC, want_id) AS INT) AS place FROM s")
def i08_taxonomy_order(spark, d):
    s = cleaned(spark, d).groupBy("want_id").agg(F.count("*").alias("size"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "want_id")))


@query("SELECT doc_id FROM labels INTERSECT SELECT o_orderkey FROM orders")
def j02_intersect(spark, d):
    return table(spark, d, "labels").select("doc_id").intersect(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def j03_except(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def j04_distinct_on_key(spark, d):
    return first_of(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("WITH a AS (SELECT lang AS v, count(*) AS x FROM documents WHERE lang <> 'es' GROUP BY 1), b AS (SELECT lang AS v, count(*) AS y FROM documents JOIN labels USING (doc_id) WHERE lang <> 'fr' GROUP BY 1), o AS (SELECT coalesce(a.v, b.v) AS v, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b ON a.v = b.v) SELECT v, 'a' AS run, CAST(x AS BIGINT) AS n FROM o UNION ALL SELECT v, 'b', CAST(y AS BIGINT) FROM o")
def j05_outer_align_melt(spark, d):
    docs, lab = table(spark, d, "documents").select("doc_id", F.col("lang").alias("v")), table(spark, d, "labels").select("doc_id")
    a = docs.filter("v <> 'es'").groupBy("v").agg(F.count("*").alias("a"))
    b = docs.join(lab, "doc_id").filter("v <> 'fr'").groupBy("v").agg(F.count("*").alias("b"))
    return a.join(b, "v", "full").na.fill(0).unpivot(["v"], ["a", "b"], "run", "n")


@query("WITH u AS (SELECT doc_id AS k, 1 AS src FROM labels UNION ALL SELECT doc_id, 2 FROM documents) SELECT k, min(src) AS src FROM u GROUP BY k")
def j06_keyed_union(spark, d):
    u = table(spark, d, "labels").select(F.col("doc_id").alias("k"), F.lit(1).alias("src")).unionByName(table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.lit(2).alias("src")))
    return first_of(u, ["k"], ["src"])


@query("SELECT doc_id, 'a' AS part FROM documents UNION ALL SELECT doc_id, 'b' FROM labels WHERE quality = 0")
def j01_union(spark, d):
    a = table(spark, d, "documents").select("doc_id").withColumn("part", F.lit("a"))
    return a.unionByName(table(spark, d, "labels").filter("quality = 0").select("doc_id").withColumn("part", F.lit("b")))
