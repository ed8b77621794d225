"""Queries on vectors, projection, extraction, journeys, trends, text mining and the SQL surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import patterns as p
from ..functions import text as t
from ..operators import decomposition as de
from ..operators import extraction as ex
from ..operators import grouping as g
from ..operators import longitudinal as lo
from ..operators import mining as mi
from ..operators import minibatch as mb
from ..operators import vectors as ve
from ..sources.tables import PHRASES, table, tickets
from . import catalog
from .group_queries import CLUSTER_TOPS, CNT, G01, G02_SQL, G04, G05, G06, ISSUE, av, ex_sql, issues, sh, top_sql, tops_sql
from .oracle import CLEANED, ENRICHED, FLAT, m, q
from .registry import query
from .row_queries import BUCKET, MONEY_AMOUNT, cleaned, enriched

W = "WITH "
# -- vectors -----------------------------------------------------------------

EMB = """emb AS (SELECT vec_id, label, vec_id % 4 = 0 AS confirmed, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ex AS (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM emb WHERE confirmed), mn AS (SELECT label, i, avg(x) AS m FROM ex GROUP BY ALL), cen AS (SELECT label AS id, list(m ORDER BY i) AS c FROM mn GROUP BY label),
sc AS (SELECT vec_id, label, confirmed, id, round(list_cosine_similarity(v, c), 12) AS s FROM emb, cen), rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, id) AS k FROM sc),
near AS (SELECT vec_id, any_value(label) AS label, any_value(confirmed) AS confirmed, max(CASE WHEN k = 1 THEN id END) AS best, max(CASE WHEN k = 1 THEN s END) AS score, max(CASE WHEN k = 1 THEN s END) - coalesce(max(CASE WHEN k = 2 THEN s END), 0) AS margin, max(CASE WHEN id = label THEN s END) AS own FROM rk GROUP BY vec_id),
th AS (SELECT greatest(0.25, least(0.55, quantile_cont(own, 0.10) - 0.03)) AS top FROM near WHERE confirmed)"""
MARGIN, CHARS = 0.02, 40


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", (F.col("vec_id") % 4 == 0).alias("confirmed"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return ve.mean_vectors(vectors(spark, d).filter("confirmed"), "label")


def projected(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the nearest want of their vector, method, band and reason; vectors may be missing."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("n_chars").alias("chars"), F.when(F.col("lang") == "en", 2).otherwise(1).alias("risk"))
    c = centroids(spark, d)
    near = ve.nearest(vectors(spark, d), c, "label")
    mine = vectors(spark, d).filter("confirmed").join(F.broadcast(c.select("label", "c")), "label").select("vec_id", t.dot(t.l2("v"), t.l2("c")).alias("own"))
    near = near.join(mine, "vec_id", "left").select("vec_id", "label", "confirmed", "best", "score", "margin", "own")
    x = docs.join(near, "vec_id", "left").crossJoin(F.broadcast(ve.threshold(near.filter("confirmed"))))
    ok, has = F.coalesce("confirmed", F.lit(False)), F.col("best").isNotNull()
    x = x.withColumns({"want": F.when(ok, F.col("label")).otherwise(F.coalesce("best", F.lit(0))), "score": F.when(ok, F.col("own")).otherwise(F.coalesce("score", F.lit(0.0))), "margin": F.coalesce("margin", F.lit(0.0))})
    x = x.withColumn("method", ve.method(ok, has, F.col("chars"), F.col("score"), F.col("margin"), F.col("threshold"), MARGIN, CHARS))
    x = x.withColumn("band", ve.confidence_band(F.col("method"), F.col("score"), F.col("margin"), F.col("threshold"), MARGIN))
    x = x.withColumn("reason", ve.review_reason(F.col("method"), F.col("score"), F.col("margin"), F.col("risk"), F.col("chars"), F.col("threshold"), MARGIN, CHARS))
    return x.withColumn("uncertainty", ve.uncertainty(F.col("score"), F.col("margin"), F.col("risk"), F.col("threshold"), MARGIN))


PROJ = f"""{EMB}, pj0 AS (SELECT doc_id AS vec_id, n_chars AS chars, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS risk, coalesce(confirmed, false) AS ok, best IS NOT NULL AS has, CASE WHEN confirmed THEN label ELSE coalesce(best, 0) END AS want,
  CASE WHEN confirmed THEN own ELSE coalesce(score, 0) END AS score, coalesce(margin, 0) AS margin, top FROM documents LEFT JOIN near ON doc_id = vec_id, th),
pj1 AS (SELECT *, CASE WHEN ok THEN 'llm_confirmed' WHEN NOT has THEN 'rule_hint_only' WHEN chars < {CHARS} AND score >= top AND margin >= {MARGIN} THEN 'short_text_projection' WHEN chars < {CHARS} THEN 'rule_hint_only' WHEN score < top OR margin < {MARGIN} THEN 'low_confidence_projection' ELSE 'embedding_projection' END AS method FROM pj0),
pj AS (SELECT *, CASE WHEN ok THEN 'confirmed' WHEN score >= top + 0.10 AND margin >= {2 * MARGIN} THEN 'high' WHEN score >= top AND margin >= {MARGIN} THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN ok THEN '' ELSE concat_ws(', ', CASE WHEN score < top THEN 'low_similarity' END, CASE WHEN margin < {MARGIN} THEN 'ambiguous_match' END, CASE WHEN risk >= 2 THEN 'high_risk_signal' END, CASE WHEN chars < {CHARS} THEN 'short_text' END) END AS reason,
  greatest(top - score, 0) + greatest({MARGIN} - margin, 0) + 0.05 * risk AS uncertainty FROM pj1)"""


@query(f"{W}{EMB} SELECT vec_id, CAST(best AS INT) AS best, round(score, 5) AS score, round(margin, 5) AS margin FROM near")
def f12_nearest_centroid(spark, d):
    x = ve.nearest(vectors(spark, d), centroids(spark, d), "label")
    return x.select("vec_id", "best", F.round("score", 5).alias("score"), F.round("margin", 5).alias("margin"))


@query(f"{W}{EMB} SELECT vec_id, round(margin, 5) AS margin FROM near")
def h06_rank_margin(spark, d):
    return ve.nearest(vectors(spark, d), centroids(spark, d), "label").select("vec_id", F.round("margin", 5).alias("margin"))


@query(f"{W}{EMB} SELECT id AS label, CAST(i AS INT) AS i, round(m, 6) AS m FROM cen JOIN mn ON id = label")
def k14_centroids(spark, d):
    return centroids(spark, d).select("label", F.posexplode("c").alias("i", "m")).select("label", (F.col("i") + 1).alias("i"), F.round("m", 6).alias("m"))


@query(f"{W}{EMB} SELECT round(top, 5) AS threshold FROM th")
def k15_threshold(spark, d):
    c = F.broadcast(centroids(spark, d).select("label", "c"))
    own = vectors(spark, d).filter("confirmed").join(c, "label").select(t.dot(t.l2("v"), t.l2("c")).alias("own"))
    return ve.threshold(own).select(F.round("threshold", 5).alias("threshold"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS x1, round(list_sum(list_transform(v, lambda x: x * x)), 5) AS sq FROM e")
def k21_l2_normalise(spark, d):
    return vectors(spark, d).select("vec_id", F.round(t.l2("v")[0], 6).alias("x1"), F.round(t.dot(F.col("v"), F.col("v")), 5).alias("sq"))


@query(f"{W}{EMB}, ds AS (SELECT vec_id, label, id, list_distance(v, c) AS d FROM emb, cen) SELECT vec_id, round(least(1, greatest(0, 1 - max(CASE WHEN id = label THEN d END) / avg(d))), 5) AS confidence FROM ds GROUP BY vec_id")
def k12_cluster_confidence(spark, d):
    x = ve.cluster_confidence(vectors(spark, d), centroids(spark, d), "label", "label")
    return x.select("vec_id", F.round("confidence", 5).alias("confidence"))


@query("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, 1 - list_cosine_similarity(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), s AS (SELECT vec_id, la, lb, avg(d) AS d FROM p GROUP BY ALL), ab AS (SELECT vec_id, max(CASE WHEN la = lb THEN d END) AS a, min(CASE WHEN la <> lb THEN d END) AS b FROM s GROUP BY vec_id) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM ab")
def k13_silhouette(spark, d):
    return ve.cosine_silhouette(vectors(spark, d), "label").select(F.round("silhouette", 5).alias("silhouette"))


@query()
def k13_before_and_after_merge(spark, d):
    """The silhouette of the clusters and of those that are left when near ones are merged."""
    x, c = vectors(spark, d), centroids(spark, d)
    merged = x.join(mi.merge_centroids(c, "label", 0.2), "label")
    one = lambda df, by, name: ve.cosine_silhouette(df, by).select(F.lit(name).alias("labels"), F.round("silhouette", 5).alias("silhouette"))
    return one(x, "label", "before").unionByName(one(merged, "parent", "after"))


@query(f"{W}{PROJ} SELECT vec_id, band FROM pj")
def d07_confidence_band(spark, d):
    return projected(spark, d).select("vec_id", "band")


@query(f"{W}{PROJ} SELECT vec_id, reason FROM pj")
def d08_review_reason(spark, d):
    return projected(spark, d).select("vec_id", "reason")


@query(f"{W}{PROJ} SELECT vec_id, round(uncertainty, 5) AS uncertainty FROM pj")
def d09_uncertainty(spark, d):
    return projected(spark, d).select("vec_id", F.round("uncertainty", 5).alias("uncertainty"))


@query(f"{W}{PROJ} SELECT vec_id, CAST(want AS INT) AS want, method FROM pj")
def e16_assignment_method(spark, d):
    return projected(spark, d).select("vec_id", "want", "method")


@query(f"{W}{PROJ} SELECT CAST(want AS INT) AS want, {CNT} AS tickets, CAST(count(*) FILTER (ok) AS BIGINT) AS confirmed, CAST(count(*) FILTER (band = 'low') AS BIGINT) AS low, round(avg(score), 4) AS mean_score, round(count(*) / (SELECT count(*) FROM pj), 4) AS share FROM pj GROUP BY want")
def g11_corpus_summary(spark, d):
    s = projected(spark, d).groupBy("want").agg(F.count("*").alias("tickets"), F.count_if(F.col("method") == "llm_confirmed").alias("confirmed"), F.count_if(F.col("band") == "low").alias("low"), F.round(F.avg("score"), 4).alias("mean_score"))
    return s.withColumn("share", F.round(F.col("tickets") / F.sum("tickets").over(Window.partitionBy()), 4))


@query("SELECT doc_id, label AS want FROM documents JOIN embeddings ON doc_id = vec_id WHERE vec_id % 4 = 0")
def f13_confirmed_row_join(spark, d):
    c = vectors(spark, d).filter("confirmed").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("want"))
    return table(spark, d, "documents").select("doc_id").join(c, "doc_id")


# -- extraction --------------------------------------------------------------


def _lv(x: str) -> str:
    return f"CAST(greatest(1, least(5, round_even({x}, 0))) AS INT)"


def _case(col: str, table: dict, other: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in table.items()) + f" ELSE {other} END"


_LIST = lambda rows: "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(v)} END" for c, v in rows) + "], lambda x: x IS NOT NULL)"
_ALL = lambda pattern: f"regexp_extract_all(question, {q(pattern)})"
_Q = lambda pattern: m("question", pattern)
EXTRACT = f"""r1 AS (SELECT *, {_ALL(ex.UID)} AS au, {_ALL(ex.ROOM)} AS ar, {_ALL(ex.TIMESTAMP)} AS ats, {_ALL(ex.BAN_WHY)} AS aw, list_slice({_ALL(ex.AMOUNT)}, 1, 8) AS amounts, {_Q(ex.BAN_STATE)} AS ban, {_Q(ex.CLAIM)} AS claim, {_Q(ex.SCAM)} AS scam,
  {_Q(ex.STATUS)} AS stat, {_Q(ex.MONEY)} AS mon, {_Q(ex.URL)} AS link, {_Q(ex.IMAGE)} AS img, {_case('primary_desire', ex.PRIMARY_JOB, 'NULL')} AS hint FROM enriched),
r2 AS (SELECT *, CASE WHEN {_Q(ex.GAME)} AND NOT ban THEN 'fix_product_flow' WHEN primary_desire = 'protect_from_abuse_or_scam' OR {_Q(ex.SCAM_REPORT)} THEN 'avoid_scam' WHEN {_Q(ex.ABUSE_REPORT)} AND NOT ban THEN 'protect_community' WHEN claim OR ban THEN 'prove_innocence'
  WHEN hint IS NOT NULL THEN hint WHEN scam THEN 'avoid_scam' WHEN {_Q(ex.TRANSACTION)} THEN 'buy_or_sell_diamonds' WHEN len(ar) > 0 OR {_Q(ex.PLACE)} THEN 'grow_channel' WHEN {_Q(ex.ACCOUNT)} THEN 'recover_access' WHEN stat THEN 'gain_status' ELSE 'other' END AS job_to_be_done,
  CASE WHEN scam OR contains(lower(question_flat), 'betray') THEN 'betrayed' WHEN {m('question_flat', ex.FEELS_URGENT)} THEN 'urgent' WHEN claim OR {m('question_flat', ex.FEELS_CONFUSED)} THEN 'confused' WHEN {m('question_flat', ex.FEELS_ANGRY)} THEN 'angry' ELSE 'unknown' END AS user_emotion,
  {_LIST([('img', 'screenshots'), ('link', 'urls'), ('len(ats) > 0', 'timestamps'), ('len(au) > 0', 'uid'), ('len(ar) > 0', 'room_or_group_id'), ('len(aw) > 0', 'ban_reason'), ('len(amounts) > 0', 'money_amount'), ('claim', 'user_claim')])} AS pres,
  {_LIST([('ban AND len(ats) = 0', ex.MISSING['ban_time']), ('ban AND len(aw) = 0', ex.MISSING['ban_reason']), ('ban AND NOT claim', ex.MISSING['claim']), ('(mon OR scam) AND len(amounts) = 0', ex.MISSING['amount']), ('(mon OR scam) AND len(au) < 2', ex.MISSING['party']), ('(mon OR scam) AND NOT img AND NOT link', ex.MISSING['proof']), (f'{_Q(ex.PLACE)} AND len(ar) = 0', ex.MISSING['room'])])} AS gone,
  {_lv(f"1 + len({_ALL(ex.URGENT)}) / 2 + CAST(claim AS INT) + CAST(scam AS INT)")} AS urgency_level, {_lv('1 + 2 * CAST(ban AS INT) + 2 * CAST(scam AS INT) + CAST(stat AS INT)')} AS trust_risk_level,
  {_lv('1 + 3 * CAST(mon AS INT) + CAST(scam AS INT)')} AS money_risk_level, {_lv(f"1 + 3 * CAST({_Q(ex.UNSAFE)} AS INT)")} AS safety_policy_risk_level,
  array_to_string(list_slice(list_sort(list_distinct(au)), 1, 12), '|') AS uids, array_to_string(list_slice(list_sort(list_distinct(ar)), 1, 12), '|') AS room_or_group_ids, array_to_string(list_slice(ats, 1, 12), '|') AS timestamps, array_to_string(list_slice(list_sort(list_distinct(aw)), 1, 8), '|') AS ban_reasons,
  array_to_string(amounts, '|') AS money_amounts, CAST(len({_ALL(ex.URL)}) AS BIGINT) AS links FROM r1),
rules AS (SELECT *, array_to_string(CASE WHEN len(pres) > 0 THEN pres ELSE ['none'] END, '|') AS present, array_to_string(CASE WHEN len(gone) > 0 THEN gone ELSE [{q(ex.MISSING['none'])}] END, '|') AS missing,
  CASE WHEN context_depth_score >= 60 THEN 'forensic' WHEN context_depth_score >= 35 THEN 'rich' ELSE 'adequate' END AS manager_note_quality, substr(question_flat, 1, 180) AS literal_request,
  {_case('job_to_be_done', ex.ACTUAL, q(ex.ACTUAL['other']))} AS actual_user_want, {_case('job_to_be_done', ex.NEXT_STEP, q(ex.NEXT_STEP_ELSE))} AS support_next_step, {_case('job_to_be_done', ex.IDEA, q(ex.IDEA_ELSE))} AS product_opportunity,
  greatest(trust_risk_level, money_risk_level, safety_policy_risk_level) >= 4 AS needs_human_review FROM r2)"""
_RULE_COLS = [
    "source_row", "job_to_be_done", "user_emotion", "urgency_level", "trust_risk_level", "money_risk_level", "safety_policy_risk_level", "manager_note_quality", "literal_request", "actual_user_want",
    "support_next_step", "product_opportunity", "needs_human_review",
]
_RULE_LISTS = ["uids", "room_or_group_ids", "timestamps", "ban_reasons"]


@query(f"{W}{ENRICHED}, {EXTRACT} SELECT {', '.join(_RULE_COLS)}, present, missing, {', '.join(_RULE_LISTS)}, money_amounts, links FROM rules")
def n01_rules_extraction(spark, d):
    lists = {"present": "evidence_present", "missing": "evidence_missing", **{c: c for c in _RULE_LISTS}, "money_amounts": "amounts"}
    return ex.rules(enriched(spark, d)).select(*_RULE_COLS, *[F.array_join(c, "|").alias(k) for k, c in lists.items()], F.col("url_count").alias("links"))


RECORDS = """VALUES ('1', '1', 'wants refund of diamonds', 'wants money back now', 'avoid_scam', 'angry', 'check the payment and call the seller', 'a receipt workflow for every diamond sale', 0.9, false),
('string', '2', 'a', 'b', 'other', 'neutral', 'c', 'd', 0.1, false), ('9', '3', 'a', 'b', 'other', 'neutral', 'c', 'd', 0.2, false), ('4', '4', '', 'b', 'other', 'neutral', 'c', 'd', 0.3, true),
('5', '5', 'one of: x', 'b', 'other', 'neutral', 'c', 'd', 0.4, false), ('6', '6', 'lost account', 'b', 'report_fraud', 'stressed', 'c', 'd', 0.5, false), ('7', '7', 'lost account', 'b', 'other', 'stressed', 'c', 'd', 0.5, true),
('8', '8', 'unknown', 'n/a', 'other', 'neutral', 'analyze', 'd', NULL, NULL), (' 10 ', '10', 'fix_issue', 'Fix  issue', 'other', 'neutral', 'verify the account status by hand', 'Improve user experience', 0.7, false)"""
_RC = ["source_row", "expected_row", "literal_request", "actual_user_want", "job_to_be_done", "user_emotion", "support_next_step", "product_opportunity", "confidence", "needs_human_review"]
REC = f"rec({', '.join(_RC)}) AS ({RECORDS})"


def records(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {RECORDS} AS r({', '.join(_RC)})").withColumn("confidence", F.col("confidence").cast("double"))


_S = lambda c: f"trim(coalesce({c}, ''))"
_SAID = "lower(concat_ws(' ', literal_request, actual_user_want, job_to_be_done, user_emotion, support_next_step, product_opportunity, CAST(confidence AS VARCHAR)))"
_FLAG = f"""CASE WHEN {_S('source_row')} IN ('', 'string') THEN 'source_row_schema_echo' WHEN {_S('source_row')} <> expected_row THEN 'source_row_mismatch' WHEN {' OR '.join(f"{_S(c)} = ''" for c in ex.TEXTS)} THEN 'empty_required_fields'
  WHEN {' OR '.join(f'contains({_SAID}, {q(w)})' for w in ex.ECHOES)} THEN 'schema_echo' WHEN {_S('job_to_be_done')} NOT IN ({', '.join(map(q, p.JOBS))}) THEN 'invalid_job' WHEN {_S('user_emotion')} NOT IN ({', '.join(map(q, p.EMOTIONS))}) THEN 'invalid_emotion'
  WHEN {' + '.join(f"CAST(lower({_S(c)}) IN ({', '.join(map(q, ex.VAGUE))}) AS INT)" for c in ex.TEXTS)} >= 2 THEN 'too_vague' END"""


@query(f"{W}{REC} SELECT expected_row, {_FLAG} AS flag FROM rec")
def n04_quality_flag(spark, d):
    return records(spark).select("expected_row", ex.quality_flag().alias("flag"))


def _conc(c: str, field: str = "") -> str:
    low = f"lower(trim(regexp_replace(replace({_S(c)}, '_', ' '), '\\s+', ' ', 'g')))"
    out = f"length({_S(c)}) >= 8 AND NOT contains({_S(c)}, '_') AND {low} NOT IN ({', '.join(map(q, ex.GENERIC))})"
    out += f" AND length({_S(c)}) >= 24" if field == "support_next_step" else ""
    return out + (f" AND length({_S(c)}) >= 36 AND ({' OR '.join(f'contains({low}, {q(w)})' for w in ex.PRODUCT)})" if field == "product_opportunity" else "")


@query(f"{W}{REC} SELECT expected_row, {', '.join(f'{_conc(c, c)} AS {c}' for c in ex.TEXTS)} FROM rec")
def n05_concrete_phrases(spark, d):
    return records(spark).select("expected_row", *[ex.concrete(c, c).alias(c) for c in ex.TEXTS])


_JOBS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in p.JOB_ALIASES.items())


@query(f"{W}{REC} SELECT expected_row, CASE job_to_be_done {_JOBS} ELSE job_to_be_done END AS job, CASE WHEN job_to_be_done IN ({', '.join(map(q, p.JOB_ALIASES))}) THEN job_to_be_done END AS job_from, CASE user_emotion WHEN 'stressed' THEN 'anxious' ELSE user_emotion END AS emotion, CASE WHEN user_emotion = 'stressed' THEN 'stressed' END AS emotion_from FROM rec")
def n06_alias_normalisation(spark, d):
    return ex.normalised(records(spark)).select("expected_row", F.col("job_to_be_done").alias("job"), F.col("_normalized_job_to_be_done_from").alias("job_from"), F.col("user_emotion").alias("emotion"), F.col("_normalized_user_emotion_from").alias("emotion_from"))


@query(f"{W}{ENRICHED}, {EXTRACT}, {REC}, mr AS (SELECT *, '1' || expected_row AS k FROM rec), b AS (SELECT * FROM rules WHERE source_row IN (SELECT k FROM mr)) SELECT b.source_row, CASE WHEN {_conc('mr.literal_request', 'literal_request')} THEN mr.literal_request ELSE b.literal_request END AS literal_request, CASE WHEN {_conc('mr.support_next_step', 'support_next_step')} THEN mr.support_next_step ELSE b.support_next_step END AS support_next_step, b.needs_human_review OR coalesce(mr.needs_human_review, false) AS needs_human_review, greatest(0.55, CAST(coalesce(mr.confidence, 0) AS DOUBLE)) AS confidence FROM b JOIN mr ON b.source_row = mr.k")
def n02_hybrid_merge(spark, d):
    m_ = records(spark).withColumn("source_row", F.concat(F.lit("1"), "expected_row"))
    base = ex.rules(enriched(spark, d).join(F.broadcast(m_.select("source_row")), "source_row", "left_semi"))
    return ex.hybrid(base, m_).select("source_row", "literal_request", "support_next_step", "needs_human_review", "confidence")


@query(f"{W}{ENRICHED} SELECT source_row, 'Ticket ' || source_row || ' (' || category || ', score ' || CAST(CAST(context_depth_score AS INT) AS VARCHAR) || '): ' || substr(question_flat, 1, 60) AS prompt FROM enriched")
def n03_prompts(spark, d):
    return enriched(spark, d).select("source_row", F.format_string("Ticket %s (%s, score %d): %s", "source_row", "category", F.bround("context_depth_score").cast("int"), F.substring("question_flat", 1, 60)).alias("prompt"))


@query("SELECT * FROM (VALUES (1, 1, CAST(NULL AS VARCHAR), 'ok'), (2, 2, 'x', 'ok'), (3, NULL, NULL, 'bad_output'), (4, NULL, NULL, 'bad_output'), (5, NULL, NULL, 'bad_output')) v(id, a, b, status)")
def n07_tolerant_json(spark, d):
    x = spark.createDataFrame([(1, '```json\n{"a": 1}\n```'), (2, 'Sure: {"a": 2, "b": "x"} done'), (3, "{broken"), (4, ""), (5, '{"a": "z"}')], "id int, raw string")
    x = x.withColumn("s", ex.parse(F.col("raw"), "a int, b string"))
    return x.select("id", "s.a", "s.b", F.when(F.col("s.a").isNotNull(), "ok").otherwise("bad_output").alias("status"))


@query(f"{W}{REC} SELECT expected_row, confidence BETWEEN 0 AND 1 AND job_to_be_done IN ({', '.join(map(q, p.JOBS))}) AND literal_request IS NOT NULL AND needs_human_review IS NOT NULL IS TRUE AS valid FROM rec".replace("IS NOT NULL IS TRUE", "IS NOT NULL").replace("SELECT expected_row, confidence", "SELECT expected_row, coalesce(confidence").replace(" AS valid", ", false) AS valid"))
def n08_record_schema(spark, d):
    ok = F.col("confidence").between(0, 1) & F.col("job_to_be_done").isin(p.JOBS) & F.col("literal_request").isNotNull() & F.col("needs_human_review").isNotNull()
    return records(spark).select("expected_row", F.coalesce(ok, F.lit(False)).alias("valid"))


TITLES = "VALUES ('Recover lost accounts', 1), ('title_with_code', 2), ('', 3), ('A', 4), ('Title: pay sellers', 5), ('This title goes on and on far beyond what a short heading should ever hold at all', 6)"


@query(f"SELECT x, length(x) BETWEEN 4 AND 60 AND NOT contains(x, '_') AND NOT contains(x, ':') AS clean FROM ({TITLES}) v(x, n)")
def n09_clean_titles(spark, d):
    x = F.col("x")
    return spark.sql(f"SELECT col1 AS x FROM {TITLES}").select("x", (F.length(x).between(4, 60) & ~x.contains("_") & ~x.contains(":")).alias("clean"))


@query(f"{W}{ENRICHED} SELECT source_row FROM enriched WHERE context_depth_score >= 24 AND char_count >= 40 ORDER BY context_depth_score DESC, source_row LIMIT 100")
def n10_candidate_queue(spark, d):
    e = enriched(spark, d).filter("context_depth_score >= 24 AND char_count >= 40")
    return e.orderBy(F.desc("context_depth_score"), "source_row").limit(100).select("source_row")


@query("SELECT doc_id, quality AS a, toxic AS b, quality <> toxic AS differs FROM labels JOIN documents USING (doc_id)")
def n11_side_by_side(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"), (F.col("quality") != F.col("toxic")).alias("differs"))


_WANT_TEXT = "concat_ws(' ', literal_request, actual_user_want)"
_SIM = "CAST(source_row AS BIGINT) % 101 / 101"
_PIECE = "v || ':' || n"
G10 = f"""{EXTRACT}, rw AS (SELECT *, {_WANT_TEXT} AS want_text, {_SIM} AS sim FROM rules), tj AS ({top_sql('rw', 'want_id', 'job_to_be_done', 3, 'top_jobs', piece=_PIECE)}), te AS ({top_sql('rw', 'want_id', 'user_emotion', 3, 'top_emotions', piece=_PIECE)}),
{ex_sql('rw', 'want_id', 'sim DESC, CAST(source_row AS BIGINT)', 'want_text', 3)}, nx AS (SELECT want_id, max(support_next_step) FILTER (k_ = 1) AS next_step_1, max(support_next_step) FILTER (k_ = 2) AS next_step_2 FROM (SELECT *, row_number() OVER (PARTITION BY want_id ORDER BY sim DESC, CAST(source_row AS BIGINT)) AS k_ FROM rw) GROUP BY want_id),
tax AS (SELECT want_id, {CNT} AS size, round(count(*) / (SELECT count(*) FROM rw), 6) AS share, {av('money_risk_level', 'avg_money_risk', 2)}, {av('trust_risk_level', 'avg_trust_risk', 2)}, {av('urgency_level', 'avg_urgency', 2)},
  {sh('money_risk_level >= 4', 'high_money_risk_share', 6)}, {sh('trust_risk_level >= 4', 'high_trust_risk_share', 6)} FROM rw GROUP BY want_id)"""


@query(f"{W}{ENRICHED}, {G10} SELECT tax.*, top_jobs, top_emotions, example_1, example_2, example_3, coalesce(next_step_1, '') AS next_step_1, coalesce(next_step_2, '') AS next_step_2 FROM tax JOIN tj USING (want_id) JOIN te USING (want_id) JOIN exs USING (want_id) JOIN nx USING (want_id)")
def g10_want_taxonomy(spark, d):
    x = ex.rules(enriched(spark, d)).withColumns({"first_pos": F.col("source_row").cast("long"), "want_text": F.concat_ws(" ", "literal_request", "actual_user_want")})
    return ex.taxonomy(x.withColumn("centroid_similarity", F.col("first_pos") % 101 / 101))


@query(f"{W}{ENRICHED}, {EXTRACT}, s AS (SELECT job_to_be_done AS job, count(*) AS volume, avg(money_risk_level) AS m, avg(trust_risk_level) AS t, avg(urgency_level) AS u FROM rules GROUP BY 1) SELECT job, CAST(volume AS BIGINT) AS volume, round(round(volume * (coalesce(m, 1) + coalesce(t, 1) + coalesce(u, 1)) / 3, 8), 4) AS priority FROM s ORDER BY priority DESC LIMIT 8")
def d14_executive_priority(spark, d):
    s = ex.rules(enriched(spark, d)).groupBy(F.col("job_to_be_done").alias("job")).agg(F.count("*").alias("volume"), *[F.avg(c).alias(c) for c in ("money_risk_level", "trust_risk_level", "urgency_level")])
    risk = t.total([F.coalesce(c, F.lit(1.0)) for c in ("money_risk_level", "trust_risk_level", "urgency_level")]) / 3
    return s.select("job", "volume", g.r4(F.col("volume") * risk).alias("priority")).orderBy(F.desc("priority")).limit(8)


# -- actions, titles, SQL ----------------------------------------------------

#: What to do about an issue.
ACTIONS = {
    "split": "Split semantic outlier bucket: sample, relabel, and rerun guided topics.", "fix": "Fix source data quality: missing or unclustered text rows need review.",
    "escalate": "Create escalation playbook + policy owner; this is trust/money/status risk.", "watch": "Investigate as emerging issue; create daily monitor and sample 20 cases.",
    "automate": "Automate/self-serve; high-volume low-complexity support demand.", "casebook": "Build casebook/training set; rich evidence can teach classifiers and agents.",
    "money": "Map money journey; separate legitimate commerce from scam/dispute flows.", "ban": "Improve ban transparency: reason, evidence, appeal path, repeat penalty history.",
    "account": "Design account-recovery self-service with identity and phone/SIM edge cases.", "channel": "Create creator/channel ops workflow: visibility, limits, ownership, feed health.",
    "review": "Review representative examples; decide FAQ, macro, product fix, or escalation.",
}


def issue_action() -> object:
    """By rounded figures of a backlog row and its label."""
    c = F.col
    label = F.lower(F.concat_ws(" ", "issue_label", "top_desires"))
    any_ = lambda *ws: __import__("functools").reduce(lambda a, b: a | b, [label.contains(w) for w in ws])
    rules = [
        ((c("issue_id") == -1) | c("issue_label").startswith("-1_"), "split"), (c("issue_id") == -999, "fix"), ((c("trust_money_risk") >= 0.35) & (c("unresolved_share") >= 0.20), "escalate"),
        ((c("recent_lift") >= 1.8) & (c("recent_tickets") >= 10), "watch"), ((c("tickets") >= 100) & (c("unresolved_share") < 0.10) & (c("avg_context_score") < 14), "automate"),
        ((c("avg_context_score") >= 24) & (c("rich_or_forensic_share") >= 0.25), "casebook"), (any_("dealer", "diamonds", "seller", "scam"), "money"), (any_("blocked", "unban", "ban"), "ban"),
        (any_("account", "restore", "deleted"), "account"), (any_("channel", "group", "limit"), "channel"),
    ]
    return t.cascade([(k, ACTIONS[v]) for k, v in rules], ACTIONS["review"])


_ANY = lambda *ws: " OR ".join(f"contains(lb, '{w}')" for w in ws)
E06 = f"""act AS (SELECT *, CASE WHEN issue_id = -1 OR starts_with(issue_label, '-1_') THEN {q(ACTIONS['split'])} WHEN issue_id = -999 THEN {q(ACTIONS['fix'])} WHEN trust_money_risk >= 0.35 AND unresolved_share >= 0.20 THEN {q(ACTIONS['escalate'])}
  WHEN recent_lift >= 1.8 AND recent_tickets >= 10 THEN {q(ACTIONS['watch'])} WHEN tickets >= 100 AND unresolved_share < 0.10 AND avg_context_score < 14 THEN {q(ACTIONS['automate'])} WHEN avg_context_score >= 24 AND rich_or_forensic_share >= 0.25 THEN {q(ACTIONS['casebook'])}
  WHEN {_ANY('dealer', 'diamonds', 'seller', 'scam')} THEN {q(ACTIONS['money'])} WHEN {_ANY('blocked', 'unban', 'ban')} THEN {q(ACTIONS['ban'])} WHEN {_ANY('account', 'restore', 'deleted')} THEN {q(ACTIONS['account'])} WHEN {_ANY('channel', 'group', 'limit')} THEN {q(ACTIONS['channel'])} ELSE {q(ACTIONS['review'])} END AS action
  FROM (SELECT *, lower(concat_ws(' ', issue_label, top_desires)) AS lb FROM backlog))"""


def acted(spark, d):
    return g.backlog(issues(spark, d)).withColumn("action", issue_action())


@query(f"{W}{ISSUE}, {G04}, {E06} SELECT issue_id, top_desires, action FROM act")
def e06_issue_action(spark, d):
    return acted(spark, d).select("issue_id", "top_desires", "action")


@query(f"{W}{ISSUE}, x AS (SELECT * EXCLUDE (issue_id, issue_label), CASE WHEN issue_id = -1 THEN 100 + CAST(source_row AS BIGINT) % 3 ELSE issue_id END AS issue_id, CASE WHEN issue_id = -1 THEN 'sub_' || (CAST(source_row AS BIGINT) % 3) ELSE issue_label END AS issue_label FROM iss), {G04.replace('FROM iss', 'FROM x').replace('iss.*', 'x.*')} SELECT issue_label, tickets, opportunity_score FROM backlog".replace("FROM iss, mx", "FROM x, mx"))
def o10_refined_backlog(spark, d):
    e = issues(spark, d)
    sub = F.col("source_row").cast("long") % 3
    out = F.col("issue_id") == -1
    e = e.withColumns({"issue_label": F.when(out, F.concat(F.lit("sub_"), sub.cast("string"))).otherwise(F.col("issue_label")), "issue_id": F.when(out, sub + 100).otherwise(F.col("issue_id"))})
    return g.backlog(e).select("issue_label", "tickets", "opportunity_score")


@query(f"{W}{ISSUE}, s AS (SELECT issue_label, count(*) AS records FROM iss GROUP BY 1) SELECT issue_label, CAST(records AS BIGINT) AS records FROM s WHERE records >= 50")
def e05_having(spark, d):
    return issues(spark, d).groupBy("issue_label").agg(F.count("*").alias("records")).filter("records >= 50")


TITLE_ROWS = [(0, "recover", "Get back in"), (1, "pay", ""), (2, "pay", None), (3, "x", "Get back in"), (4, "zzz", "Other")]
_TV = ", ".join(f"({a}, {q(b)}, {'NULL' if c is None else q(c)})" for a, b, c in TITLE_ROWS)


@query(f"WITH v(id, label, human) AS (VALUES {_TV}), x AS (SELECT id, coalesce(nullif(trim(human), ''), upper(substr(label, 1, 1)) || substr(label, 2)) AS t FROM v) SELECT id, CASE WHEN count(*) OVER (PARTITION BY t) > 1 THEN t || ' (#' || id || ')' ELSE t END AS title FROM x")
def e11_display_titles(spark, d):
    x = spark.createDataFrame(TITLE_ROWS, "id int, label string, human string")
    x = x.withColumn("t", F.coalesce(F.nullif(F.trim("human"), F.lit("")), F.concat(F.upper(F.substring("label", 1, 1)), F.substring("label", 2, 100))))
    twice = F.count("*").over(Window.partitionBy("t")) > 1
    return x.select("id", F.when(twice, F.concat("t", F.lit(" (#"), F.col("id").cast("string"), F.lit(")"))).otherwise(F.col("t")).alias("title"))


def _console(name: str, view: str, sql: str, make, oracle: str) -> None:
    def run(spark, d):
        return catalog.Run(spark, {view: make(spark, d)}).sql(sql)

    query(oracle + " " + sql, name)(run)


_console("e14_sql_managers", "manager_context_quality", "SELECT manager, tickets, avg_context_score, rich_or_forensic_share FROM manager_context_quality ORDER BY avg_context_score DESC", lambda s, d: g.manager_summary(enriched(s, d)), f"{W}{ENRICHED}, manager_context_quality AS ({G01})")
_console("e14_sql_unresolved", "backlog", "SELECT issue_label, tickets, unresolved_share, recent_lift FROM backlog WHERE tickets >= 50 ORDER BY unresolved_share DESC LIMIT 25", lambda s, d: g.backlog(issues(s, d)), f"{W}{ISSUE}, {G04}")
_console("e14_sql_growing", "emerging", "SELECT issue_label, last_30_tickets, recent_vs_prior_lift FROM emerging WHERE recent_vs_prior_lift > 1.0 AND last_30_tickets >= 5 ORDER BY emergence_score DESC", lambda s, d: g.emerging(issues(s, d)), f"{W}{ISSUE}, {G05}")
_console("e14_sql_repeat_users", "personas", "SELECT uid, persona, tickets, unresolved_share FROM personas WHERE tickets >= 5 ORDER BY tickets DESC, uid LIMIT 50", lambda s, d: g.repeat_users(issues(s, d)), f"{W}{ISSUE}, {G06}")
_console("e14_sql_money_topics", "backlog", "SELECT issue_label, tickets, trust_money_risk, opportunity_score FROM backlog WHERE trust_money_risk >= 0.4 ORDER BY opportunity_score DESC", lambda s, d: g.backlog(issues(s, d)), f"{W}{ISSUE}, {G04}")
_console("e14_sql_richest", "enriched", "SELECT source_row, manager, primary_desire, context_depth_score, char_count FROM enriched WHERE context_depth_band IN ('rich', 'forensic') ORDER BY context_depth_score DESC, source_row LIMIT 50", lambda s, d: enriched(s, d), f"{W}{ENRICHED}")
_console("e14_sql_evidence_counts", "enriched", "SELECT " + ", ".join(f"CAST(SUM(CAST({c} AS INT)) AS BIGINT) AS {c}" for c in p.EVIDENCE) + " FROM enriched", lambda s, d: enriched(s, d), f"{W}{ENRICHED}")
_console("a13_high_risk_needs", "dsum", "SELECT desire, tickets, unresolved_share, avg_context_score FROM dsum WHERE unresolved_share >= 0.20 OR avg_context_score >= 24 ORDER BY unresolved_share DESC, tickets DESC", lambda s, d: g.desire_summary(enriched(s, d)), f"{W}{ENRICHED}, {G02_SQL}")


@query(f"{W}{CLEANED} SELECT source_row, category FROM cleaned WHERE manager = 'M1' AND category = '1-URGENT'")
def e03_sql_parameters(spark, d):
    return catalog.Run(spark, {"cleaned": cleaned(spark, d)}).sql("SELECT source_row, category FROM cleaned WHERE manager = ? AND category = ?", ["M1", "1-URGENT"])


# -- journeys and trends -----------------------------------------------------


def asked(spark, d):
    """The tickets with what the assignment stage adds: title, review flag, confidence and its band (made up from the key)."""
    k = F.col("source_row").cast("long")
    return cleaned(spark, d).withColumns({"want_title": F.concat(F.lit("want "), F.col("want_id").cast("string")), "needs_llm_review": k % 5 == 0, "assignment_confidence": (k % 97) / 97, "confidence_band": F.when(k % 97 >= 70, "high").when(k % 97 >= 30, "medium").otherwise("low")})


def journeys(spark, d):
    return lo.journeys(asked(spark, d))


_EV = f"""asked AS (SELECT *, 'want ' || want_id AS want_title, CAST(source_row AS BIGINT) % 5 = 0 AS needs_llm_review, CAST(source_row AS BIGINT) % 97 / 97 AS assignment_confidence, CASE WHEN CAST(source_row AS BIGINT) % 97 >= 70 THEN 'high' WHEN CAST(source_row AS BIGINT) % 97 >= 30 THEN 'medium' ELSE 'low' END AS confidence_band FROM cleaned),
ev AS (SELECT *, {BUCKET} AS s, row_number() OVER (PARTITION BY uid ORDER BY date NULLS LAST, source_row) AS k, count(*) OVER (PARTITION BY uid) AS nn FROM asked WHERE uid <> '')"""


def _path_sql(value: str, name: str) -> str:
    return f"""p_{name} AS (SELECT uid, string_agg(v, ' -> ' ORDER BY r) FILTER (r <= 9) || CASE WHEN max(r) > 9 THEN ' -> ...' ELSE '' END AS {name} FROM
  (SELECT uid, v, row_number() OVER (PARTITION BY uid ORDER BY k) AS r FROM (SELECT uid, k, {value} AS v, lag({value}) OVER (PARTITION BY uid ORDER BY k) AS b FROM ev WHERE trim(coalesce({value}, '')) <> '') WHERE b IS NULL OR b <> v) GROUP BY uid)"""


_ACT = " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in lo.RECOMMENDED.items())
_COUNTED = "v || ' (' || n || ')'"
_KINDS = " ".join("WHEN " + " OR ".join(f"contains(tx, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in lo.PATTERNS.items())
JOUR = f"""{CLEANED}, {_EV}, {_path_sql('want_title', 'want_path')}, {_path_sql('category', 'category_path')}, {_path_sql('status_en', 'status_path')}, tw AS ({top_sql("ev", "uid", "want_title", 4, "top_wants", "k", _COUNTED)}),
js AS (SELECT uid, {CNT} AS records, coalesce(strftime(min(date), '%Y-%m-%d'), '') AS first_date, coalesce(strftime(max(date), '%Y-%m-%d'), '') AS last_date,
  CAST(CASE WHEN max(date) IS NULL THEN 0 ELSE date_diff('day', CAST(min(date) AS DATE), CAST(max(date) AS DATE)) END AS INT) AS active_days, CAST(count(DISTINCT want_id) AS BIGINT) AS unique_wants,
  CAST(count(DISTINCT category) AS BIGINT) AS unique_categories, CAST(count(DISTINCT manager) AS BIGINT) AS managers_touched, CAST(count(*) FILTER (s = 'resolved') AS BIGINT) AS resolved_records,
  CAST(count(*) FILTER (s IN ('failed', 'open')) AS BIGINT) AS failed_or_open_records, round(avg(CAST(s IN ('failed', 'open') AS INT)), 3) AS failed_or_open_share, CAST(count(*) FILTER (needs_llm_review) AS BIGINT) AS review_queue_records,
  round(round(avg(assignment_confidence), 8), 3) AS avg_assignment_confidence, last(status_en ORDER BY k) AS latest_status, last(want_title ORDER BY k) AS latest_want,
  substr(first(question_flat ORDER BY k), 1, 220) AS first_question, substr(last(question_flat ORDER BY k), 1, 220) AS last_question FROM ev GROUP BY uid HAVING count(*) >= 2),
jr0 AS (SELECT js.*, top_wants, want_path, category_path, status_path, lower(want_path || ' ' || top_wants || ' ' || first_question || ' ' || last_question) AS tx FROM js JOIN p_want_path USING (uid) JOIN p_category_path USING (uid) JOIN p_status_path USING (uid) JOIN tw USING (uid)),
jr1 AS (SELECT * EXCLUDE (tx), round(round(records + 2 * unique_wants + 2.5::DOUBLE * failed_or_open_records + 0.75::DOUBLE * review_queue_records + least(active_days / 30, 12), 8), 2) AS severity_score,
  CASE WHEN unique_wants >= 4 AND records >= 5 THEN 'multi_problem_power_user' {_KINDS} ELSE 'general_repeat_user' END AS journey_pattern FROM jr0),
jr AS (SELECT *, CASE journey_pattern {_ACT} END AS recommended_action FROM jr1)"""


@query(f"{W}{JOUR} SELECT * FROM jr")
def o01_journeys(spark, d):
    return journeys(spark, d)


_MODEL = ["actual_user_want", "support_next_step", "product_opportunity"]


@query(
    f"""{W}{ENRICHED}, {EXTRACT}, {_EV} SELECT ev.uid, CAST(k AS INT) AS event_index, source_row, coalesce(strftime(ev.date, '%Y-%m-%d'), '') AS date,
  CAST(coalesce(date_diff('day', CAST(min(ev.date) OVER (PARTITION BY ev.uid) AS DATE), CAST(ev.date AS DATE)), 0) AS INT) AS days_since_first, want_title, ev.category, ev.status_en AS status, ev.manager, confidence_band,
  substr(ev.question_flat, 1, 280) AS question, {", ".join(f"substr(trim(rules.{c}), 1, 180) AS {c}" for c in _MODEL)} FROM ev JOIN rules USING (source_row) WHERE nn >= 2"""
)
def o01_journey_events(spark, d):
    """Events with what the rules extractor, as the model layer, says of each ticket."""
    said = ex.rules(enriched(spark, d)).select("source_row", *_MODEL)
    return lo.events(asked(spark, d).join(said, "source_row", "left"))


@query(f"{W}{JOUR} SELECT uid, severity_score FROM jr")
def d10_severity(spark, d):
    return journeys(spark, d).select("uid", "severity_score")


@query(f"{W}{JOUR} SELECT uid, journey_pattern AS pattern FROM jr")
def e08_journey_pattern(spark, d):
    return journeys(spark, d).select("uid", F.col("journey_pattern").alias("pattern"))


@query(f"{W}{JOUR} SELECT journey_pattern AS pattern, recommended_action AS recommended, {CNT} AS users FROM jr GROUP BY ALL")
def e09_recommended_action(spark, d):
    return journeys(spark, d).groupBy(F.col("journey_pattern").alias("pattern"), F.col("recommended_action").alias("recommended")).agg(F.count("*").alias("users"))


_JT = top_sql("jv", "journey_pattern", "want_title", 4, "top_wants", piece=_COUNTED)


@query(f"{W}{JOUR}, jv AS (SELECT journey_pattern, asked.want_title, source_row FROM asked JOIN jr USING (uid)), jt AS ({_JT}) SELECT jr.journey_pattern, {CNT} AS users, CAST(sum(records) AS BIGINT) AS records, median(records) AS median_records_per_user, median(active_days) AS median_active_days, round(round(avg(unique_wants), 8), 6) AS avg_unique_wants, round(round(avg(failed_or_open_share), 8), 6) AS failed_or_open_share, CAST(sum(review_queue_records) AS BIGINT) AS review_queue_records, any_value(jt.top_wants) AS top_wants, any_value(recommended_action) AS recommended_action FROM jr LEFT JOIN jt ON jr.journey_pattern = jt.journey_pattern GROUP BY jr.journey_pattern")
def g20_archetypes(spark, d):
    return lo.archetypes(journeys(spark, d), asked(spark, d))


@query(f"{W}{JOUR} SELECT uid, active_days FROM jr WHERE active_days >= 90 AND failed_or_open_records > 0")
def o03_long_cases(spark, d):
    return journeys(spark, d).filter("active_days >= 90 AND failed_or_open_records > 0").select("uid", "active_days")


@query(f"{W}{JOUR}, worst AS (SELECT uid FROM jr ORDER BY severity_score DESC, uid LIMIT 1) SELECT uid, CAST(k AS INT) AS event_index, source_row, want_title, status_en AS status FROM ev WHERE uid = (SELECT uid FROM worst)")
def o19_worst_journey(spark, d):
    """The events of the user whose journey is the most severe."""
    worst = journeys(spark, d).orderBy(F.desc("severity_score"), "uid").limit(1).select("uid")
    return lo.events(asked(spark, d)).join(F.broadcast(worst), "uid").select("uid", "event_index", "source_row", "want_title", "status")


@query(f"{W}{JOUR} SELECT CAST(sum(records) AS BIGINT) AS records, CAST(count(*) FILTER (active_days >= 90) AS BIGINT) AS long_cases, CAST(count(*) AS BIGINT) AS users, CAST(count(DISTINCT journey_pattern) AS BIGINT) AS archetypes FROM jr")
def o19_journey_totals(spark, d):
    return journeys(spark, d).agg(F.sum("records").alias("records"), F.count_if(F.col("active_days") >= 90).alias("long_cases"), F.count("*").alias("users"), F.countDistinct("journey_pattern").alias("archetypes"))


TREND = f"""{CLEANED}, {_EV}, mo AS (SELECT month, count(*) AS n FROM cleaned WHERE month <> '' GROUP BY month), lastm AS (SELECT max(month) AS lm, count(*) AS k FROM mo), med AS (SELECT median(n) AS md FROM mo, lastm WHERE month < lm),
cm AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i, row_number() OVER (ORDER BY month DESC) AS back FROM mo, lastm, med WHERE NOT (k >= 3 AND month = lm AND n < 0.4 * md)),
nm AS (SELECT count(*) AS nm, string_agg(month, ', ' ORDER BY month) FILTER (back <= 2) AS recent_months, string_agg(month, ', ' ORDER BY month) FILTER (back BETWEEN 3 AND 4) AS prior_months, strftime(CAST(max(month) || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS forecast_month FROM cm),
rows_ AS (SELECT a.*, i, back, {BUCKET} IN ('failed', 'open') AS f FROM asked a JOIN cm USING (month)),
grid AS (SELECT w.want_id, i, back, coalesce(c.n, 0) AS y FROM (SELECT DISTINCT want_id FROM rows_) w, cm LEFT JOIN (SELECT want_id, month, count(*) AS n FROM rows_ GROUP BY ALL) c ON c.want_id = w.want_id AND c.month = cm.month),
gs AS (SELECT want_id, regr_slope(y, i) AS sl, avg(y) FILTER (back <= 3) AS l3 FROM grid GROUP BY want_id),
t1 AS (SELECT want_id, CAST(count(*) FILTER (back <= 2) AS BIGINT) AS recent_records, CAST(count(*) FILTER (back BETWEEN 3 AND 4) AS BIGINT) AS prior_records, round(coalesce(avg(CAST(f AS INT)) FILTER (back <= 2), 0), 3) AS recent_failed_or_open_share,
  round(coalesce(avg(CAST(needs_llm_review AS INT)) FILTER (back <= 2), 0), 3) AS recent_review_queue_share, CAST(count(DISTINCT uid) FILTER (back <= 2) AS BIGINT) AS recent_unique_users FROM rows_ GROUP BY want_id),
t2 AS (SELECT *, recent_records / greatest(least(nm, 2), 1) AS ra, prior_records / greatest(least(nm - 2, 2), 1) AS pa, CASE WHEN nm >= 3 THEN sl ELSE 0 END AS sl2 FROM t1 JOIN gs USING (want_id), nm),
t3 AS (SELECT want_id, 'want ' || want_id AS want_title, recent_months, coalesce(prior_months, '') AS prior_months, recent_records, prior_records, round(ra, 2) AS recent_avg_per_month, round(pa, 2) AS prior_avg_per_month, CASE WHEN pa = 0 THEN 0 ELSE round(round((ra - pa) / pa, 8), 3) END AS growth_ratio, round(round(sl2, 8), 2) + 0.0 AS monthly_slope,
  round(round(CASE WHEN nm >= 3 THEN greatest(0, l3 + sl) ELSE ra END, 8), 1) AS forecast_next_month, forecast_month, recent_failed_or_open_share, recent_review_queue_share, recent_unique_users FROM t2),
tr AS (SELECT *, round(round(forecast_next_month * (1 + greatest(growth_ratio, -0.5)) * (1 + recent_failed_or_open_share), 8), 2) AS momentum_score, CASE WHEN growth_ratio >= 0.35 AND recent_records >= 20 THEN 'rising' WHEN growth_ratio <= -0.35 AND prior_records >= 20 THEN 'falling' WHEN monthly_slope >= 5 THEN 'slow_rise' WHEN monthly_slope <= -5 THEN 'slow_decline' ELSE 'stable' END AS trend_label FROM t3)"""


def trends(spark, d):
    return lo.trends(asked(spark, d), "want_id")


@query(f"{W}{TREND} SELECT * FROM tr")
def h08_trends(spark, d):
    return trends(spark, d)


@query(f"{W}{TREND} SELECT want_id, momentum_score FROM tr")
def d13_momentum(spark, d):
    return trends(spark, d).select("want_id", "momentum_score")


#: Titles of wants as the warning list shows them; two wants share one.
WARN = "CASE want_id WHEN 0 THEN 'Get back in' WHEN 3 THEN 'Get back in' ELSE 'want ' || want_id END"


@query(f"{W}{TREND}, lb AS (SELECT *, {WARN} AS title FROM tr), dup AS (SELECT title, count(*) AS c FROM lb GROUP BY title) SELECT want_id, CASE WHEN c > 1 THEN title || ' [' || want_id || ']' ELSE title END AS label, trend_label, momentum_score FROM lb JOIN dup USING (title) ORDER BY momentum_score DESC, want_id LIMIT 5")
def o16_early_warnings(spark, d):
    x = trends(spark, d).withColumn("title", F.expr(WARN))
    # one row a want
    label = F.when(F.count("*").over(Window.partitionBy("title")) > 1, F.concat("title", F.lit(" ["), F.col("want_id").cast("string"), F.lit("]"))).otherwise(F.col("title"))
    return x.withColumn("label", label).orderBy(F.desc("momentum_score"), "want_id").limit(5).select("want_id", "label", "trend_label", "momentum_score")


@query(f"{W}{TREND} SELECT month FROM cm")
def h07_complete_months(spark, d):
    return lo.complete_months(cleaned(spark, d)).select("month")


@query(f"{W}{CLEANED}, s AS (SELECT want_id, month, count(*) AS n FROM cleaned WHERE month <> '' GROUP BY ALL), l AS (SELECT *, n - lag(n) OVER (PARTITION BY want_id ORDER BY month) AS delta FROM s) SELECT want_id, month, CAST(n AS BIGINT) AS n, CAST(delta AS BIGINT) AS delta FROM l WHERE month = (SELECT max(month) FROM s)")
def h09_latest_delta(spark, d):
    s = cleaned(spark, d).filter("month <> ''").groupBy("want_id", "month").agg(F.count("*").alias("n"))
    s = s.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy("want_id").orderBy("month")))
    return s.join(F.broadcast(s.agg(F.max("month").alias("month"))), "month").select("want_id", "month", "n", "delta")


@query(f"{W}{CLEANED} SELECT month, {CNT} AS semantic, CAST(count(*) FILTER ({m('question', p.NO_BAN)}) AS BIGINT) AS keyword FROM cleaned WHERE month <> '' GROUP BY month")
def o02_timeline_audit(spark, d):
    return cleaned(spark, d).filter("month <> ''").groupBy("month").agg(F.count("*").alias("semantic"), F.count_if(F.col("question").rlike(p.NO_BAN)).alias("keyword"))


def uid_score(uid, asked: str, n):
    return F.when(uid.startswith(asked), 1_000_000).otherwise(0) + F.when(uid.endswith(asked), 500_000).otherwise(0) + F.least(n, F.lit(999)) * 100 - F.length(uid)


@query(f"{W}{CLEANED}, u AS (SELECT uid, count(*) AS n FROM cleaned WHERE contains(uid, '12') GROUP BY uid) SELECT uid, CAST(CASE WHEN starts_with(uid, '12') THEN 1000000 ELSE 0 END + CASE WHEN ends_with(uid, '12') THEN 500000 ELSE 0 END + least(n, 999) * 100 - length(uid) AS BIGINT) AS score FROM u ORDER BY score DESC, uid LIMIT 50")
def d16_uid_match(spark, d):
    u = cleaned(spark, d).filter(F.col("uid").contains("12")).groupBy("uid").agg(F.count("*").alias("n"))
    return u.select("uid", uid_score(F.col("uid"), "12", F.col("n")).alias("score")).orderBy(F.desc("score"), "uid").limit(50)


@query(f"{W}{CLEANED} SELECT source_row, date, status_en FROM cleaned WHERE uid = '120'")
def o04_uid_lookup(spark, d):
    return cleaned(spark, d).filter("uid = '120'").select("source_row", "date", "status_en")


@query(f"{W}{CLEANED}, s AS (SELECT want_id, count(*) AS n FROM cleaned GROUP BY 1) SELECT CAST((SELECT sum(n) FROM s) AS BIGINT) AS tickets, round(median(n), 4) AS median_want, (SELECT want_id FROM s ORDER BY n DESC, want_id LIMIT 1) AS top_want FROM s")
def o05_kpis(spark, d):
    s = cleaned(spark, d).groupBy("want_id").agg(F.count("*").alias("n"))
    return s.agg(F.sum("n").alias("tickets"), F.round(F.median("n"), 4).alias("median_want"), F.max_by("want_id", F.struct("n", -F.col("want_id"))).alias("top_want"))


@query(f"{W}{TREND}, mm AS (SELECT want_id, month, count(*) AS n FROM cleaned WHERE month <> '' GROUP BY ALL) SELECT want_id, month, CAST(n AS BIGINT) AS n, coalesce(forecast_next_month, 0.0) AS forecast FROM mm LEFT JOIN tr USING (want_id)")
def o06_forecast_join(spark, d):
    mm = cleaned(spark, d).filter("month <> ''").groupBy("want_id", "month").agg(F.count("*").alias("n"))
    return mm.join(trends(spark, d).select("want_id", F.col("forecast_next_month").alias("forecast")), "want_id", "left").na.fill(0.0, ["forecast"])


@query(f"{W}{ENRICHED}, {EXTRACT}, u AS (SELECT job_to_be_done, unnest(string_split(missing, '|')) AS v, source_row FROM rules) {top_sql('u', 'job_to_be_done', 'v', 3, 'top_missing')}")
def o07_missing_evidence(spark, d):
    x = ex.rules(enriched(spark, d)).select("job_to_be_done", F.explode("evidence_missing").alias("v"), F.col("source_row").cast("long").alias("first_pos"))
    return g.top_list(x, ["job_to_be_done"], "v", 3, "top_missing")


_STATUS = "CASE WHEN quality = 1 THEN 'ok' WHEN toxic = 1 THEN 'error' ELSE 'bad_output' END"


@query(f"SELECT CAST(count(*) AS BIGINT) AS rows_, CAST(count(*) FILTER (s = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (s = 'bad_output') AS BIGINT) AS bad_output, CAST(count(*) FILTER (s = 'error') AS BIGINT) AS error, arg_min('model_' || doc_id % 3, doc_id) AS model, arg_min('backend_' || doc_id % 2, doc_id) AS backend FROM (SELECT *, {_STATUS} AS s FROM labels)")
def o12_run_summary(spark, d):
    k = F.col("doc_id")
    x = table(spark, d, "labels").select(k.alias("row"), F.expr(_STATUS).alias("_status"), F.concat(F.lit("model_"), (k % 3).cast("string")).alias("_model"), F.concat(F.lit("backend_"), (k % 2).cast("string")).alias("_backend"))
    return ex.run_summary(x, "row")


@query(f"{W}{CLEANED} SELECT source_row, strftime(date, '%Y-%m-%d') AS day, month, 'Want ' || want_id AS title FROM cleaned")
def o13_assignment_audit(spark, d):
    return cleaned(spark, d).select("source_row", F.date_format("date", "yyyy-MM-dd").alias("day"), "month", F.concat(F.lit("Want "), F.col("want_id").cast("string")).alias("title"))


@query(f"{W}{CLEANED}, v(id, label, human) AS (VALUES {_TV}) SELECT source_row, coalesce(nullif(human, ''), label, 'want ' || want_id) AS title FROM cleaned LEFT JOIN v ON id = want_id")
def o14_prepared_assignments(spark, d):
    v = F.broadcast(spark.createDataFrame(TITLE_ROWS, "id int, label string, human string"))
    x = cleaned(spark, d).join(v, F.col("id") == F.col("want_id"), "left")
    return x.select("source_row", F.coalesce(F.nullif(F.col("human"), F.lit("")), "label", F.concat(F.lit("want "), F.col("want_id").cast("string"))).alias("title"))


@query(f"{W}{TREND}, tt AS (SELECT want_id, count(*) AS total FROM cleaned WHERE month <> '' GROUP BY 1), rk AS (SELECT *, row_number() OVER (ORDER BY total DESC, want_id) AS place FROM tt), ml AS (SELECT coalesce((SELECT string_agg(month, ', ' ORDER BY month) FROM cm), (SELECT string_agg(month, ', ' ORDER BY month) FROM mo, lastm WHERE month < lm), '') AS months) SELECT want_id, CAST(total AS BIGINT) AS total, CAST(place AS INT) AS place, place <= 5 AS seeded, months FROM rk, ml WHERE place <= 12")
def o15_timeline_seed(spark, d):
    return lo.timeline_seed(cleaned(spark, d), "want_id")


_NB = f"nb AS (SELECT * FROM cleaned WHERE {m('question', p.NO_BAN)})"


@query(f"{W}{CLEANED}, {_NB} SELECT * FROM (SELECT DISTINCT 'category' AS facet, category AS value FROM nb UNION SELECT DISTINCT 'manager', manager FROM nb UNION SELECT DISTINCT 'status_en', status_en FROM nb) WHERE trim(coalesce(value, '')) <> ''")
def o17_facet_lists(spark, d):
    x = cleaned(spark, d).filter(F.col("question").rlike(p.NO_BAN))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("category", "manager", "status_en")])).alias("x")
    return x.select(each).select("x.facet", "x.value").filter(F.trim(F.coalesce("value", F.lit(""))) != "").distinct()


@query(f"{W}{CLEANED} SELECT source_row FROM cleaned WHERE {m('question', p.NO_BAN)} AND category = '2-HIGH' AND contains(lower(question), 'please')")
def o17_no_ban_facets(spark, d):
    from .row_queries import facets

    return facets(cleaned(spark, d).filter(F.col("question").rlike(p.NO_BAN)), {"category": ["2-HIGH"], "manager": []}, {"question": "please"}).select("source_row")


@query(f"{W}{CLEANED}, {_EV} SELECT uid, source_row, CAST(k AS INT) AS k, lead(k) OVER (PARTITION BY uid ORDER BY k) IS NULL AS latest FROM ev")
def o18_uid_timeline(spark, d):
    w = Window.partitionBy("uid").orderBy(F.col("date").asc_nulls_last(), "source_row")
    x = cleaned(spark, d).filter("uid <> ''")
    return x.select("uid", "source_row", F.row_number().over(w).alias("k"), F.lead("source_row").over(w).isNull().alias("latest"))


@query(f"{W}{ENRICHED} SELECT desire, CAST(n AS VARCHAR) AS n FROM (SELECT primary_desire AS desire, count(*) AS n FROM enriched GROUP BY 1) ORDER BY n DESC, desire LIMIT 12")
def a17_chart_page(spark, d):
    """A bar chart written as a page, read back from its table."""
    from ..sources import sinks

    s = enriched(spark, d).groupBy(F.col("primary_desire").alias("desire")).agg(F.count("*").alias("n"))
    path = sinks.scratch_path(spark, "chart") + ".html"
    sinks.bar_chart(s.orderBy(F.desc("n"), "desire").limit(12), "desire", "n", path, "What users want")
    line = spark.read.text(path)
    cells = line.select(F.regexp_extract_all("value", F.lit(r"<td>([^<]*)</td>"), F.lit(1)).alias("c")).filter("size(c) = 2")
    return cells.select(F.col("c")[0].alias("desire"), F.col("c")[1].alias("n"))


# -- text mining -------------------------------------------------------------

_STOP = "[" + ", ".join(map(q, mi.stop_words())) + "]"


def words_sql(src: str, key: str, by: str, text: str) -> str:
    """tk: words, tk2: words and pairs of words, of src's texts, with key and by."""
    return f"""wd AS (SELECT {key}, {by}, list_filter(regexp_extract_all(strip_accents(lower({text})), {q(mi.TERM)}), lambda w: NOT list_contains({_STOP}, w)) AS ws FROM {src}),
tk AS (SELECT {key}, {by}, unnest(ws) AS w FROM wd), tk2 AS (SELECT * FROM tk UNION ALL SELECT {key}, {by}, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM wd)"""


def tfidf_sql(src: str, key: str, by: str, text: str) -> str:
    return f"""{words_sql(src, key, by, text)}, tf AS (SELECT {key}, w, count(*) AS tf FROM tk2 GROUP BY ALL), nd AS (SELECT count(DISTINCT {key}) AS n FROM tk2), df AS (SELECT w, count(*) AS df, sum(tf) AS total FROM tf GROUP BY w), vc AS (SELECT w, df FROM df, nd WHERE df >= 3 AND df <= 0.82 * n ORDER BY total DESC, w LIMIT 6000),
wt AS (SELECT {key}, w, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN vc USING (w), nd), tfidf AS (SELECT {key}, w, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS x FROM wt)"""


def terms_sql(src: str, key: str, by: str, n: int) -> str:
    """by, terms: the terms of greatest mean weight."""
    return f"""SELECT {by}, string_agg(w, ', ' ORDER BY k) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY m DESC, w) AS k FROM (SELECT {by}, w, round(sum(x) / any_value(size), 6) AS m
  FROM tfidf JOIN (SELECT {key}, {by}, count(*) OVER (PARTITION BY {by}) AS size FROM {src}) USING ({key}) GROUP BY ALL) WHERE m > 0) WHERE k <= {n} GROUP BY {by}"""


DOCTOK = words_sql("documents", "doc_id", "source", "text")
K05 = tfidf_sql("documents", "doc_id", "source", "text")


#: Rows of a lookup of two numbers that go to all tasks, at most, so that texts stay where they are.
MOST_SENT = 1_000_000


def corpus(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


@query(f"WITH {DOCTOK} SELECT w, CAST(count(*) AS BIGINT) AS n FROM tk GROUP BY w ORDER BY n DESC, w LIMIT 200")
def k04_token_frequencies(spark, d):
    return mi.tokens(corpus(spark, d), "doc_id", "text").groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(200)


@query(f"WITH {K05} SELECT w, {CNT} AS docs, round(sum(x), 4) AS weight FROM tfidf GROUP BY w")
def k05_tfidf(spark, d):
    x = mi.term_weights(*weighed(spark, d), [])
    return x.select("w", "docs", F.round("s", 4).alias("weight"))


@query(f"WITH {K05} {terms_sql('documents', 'doc_id', 'source', 12)}")
def k06_cluster_terms(spark, d):
    return mi.cluster_terms(corpus(spark, d), "doc_id", "text", "source", 12)


@query(
    f"""{W}{ISSUE}, {tops_sql('iss', 'issue_id', CLUSTER_TOPS, True)}, {ex_sql('iss', 'issue_id', 'context_depth_score DESC, CAST(source_row AS BIGINT)', 'model_text', 3)}, {tfidf_sql('iss', 'source_row', 'issue_id', 'model_text')}, ct AS ({terms_sql('iss', 'source_row', 'issue_id', 10)}),
s AS (SELECT issue_id, {CNT} AS tickets, round(count(*) / (SELECT count(*) FROM iss), 4) AS share, {av('context_depth_score', 'avg_context_score', 2)}, {sh('is_unresolved', 'unresolved_share')} FROM iss GROUP BY issue_id)
SELECT s.*, coalesce(terms, '') AS top_terms, top_desires, top_categories, top_managers, example_1, example_2, example_3 FROM s JOIN t_top_desires USING (issue_id) JOIN t_top_categories USING (issue_id) JOIN t_top_managers USING (issue_id) JOIN exs USING (issue_id) LEFT JOIN ct USING (issue_id)"""
)
def g03_cluster_summary(spark, d):
    return mi.described(g.cluster_summary(issues(spark, d)), issues(spark, d), "source_row", "model_text", "issue_id")


@query(f"WITH {DOCTOK}, cl AS (SELECT source, w, count(*) AS tf FROM tk2 GROUP BY ALL), tot AS (SELECT w, sum(tf) AS f FROM cl GROUP BY w), a AS (SELECT avg(s) AS a FROM (SELECT sum(tf) AS s FROM cl GROUP BY source)), x AS (SELECT source, w, round(tf / sum(tf) OVER (PARTITION BY source) * ln(1 + a / f), 8) AS x FROM cl JOIN tot USING (w), a), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY x DESC, w) AS k FROM x), sz AS (SELECT source, {CNT} AS docs FROM documents GROUP BY source) SELECT source, docs, source || '_' || string_agg(w, '_' ORDER BY k) FILTER (k <= 4) AS name, string_agg(w, ', ' ORDER BY k) AS representation FROM r JOIN sz USING (source) WHERE k <= 10 GROUP BY source, docs")
def k18_class_tfidf(spark, d):
    docs = corpus(spark, d)
    topics = mi.class_terms(docs, "source", "text", 10)
    return topics.join(docs.groupBy("source").agg(F.count("*").alias("docs")), "source")


@query(f"WITH {DOCTOK}, tp AS (SELECT d.doc_id, coalesce(label, -1) AS topic FROM documents d LEFT JOIN embeddings ON d.doc_id = vec_id), cl AS (SELECT topic, w, count(*) AS tf FROM tk2 JOIN tp USING (doc_id) GROUP BY ALL), tot AS (SELECT w, sum(tf) AS f FROM cl GROUP BY w), a AS (SELECT avg(s) AS a FROM (SELECT sum(tf) AS s FROM cl GROUP BY topic)), x AS (SELECT topic, w, round(tf / sum(tf) OVER (PARTITION BY topic) * ln(1 + a / f), 8) AS x FROM cl JOIN tot USING (w), a), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY x DESC, w) AS k FROM x), sz AS (SELECT topic, {CNT} AS count FROM tp GROUP BY topic) SELECT CAST(topic AS INT) AS topic, count, topic || '_' || string_agg(w, '_' ORDER BY k) FILTER (k <= 4) AS name, string_agg(w, ', ' ORDER BY k) AS representation FROM r JOIN sz USING (topic) WHERE k <= 10 GROUP BY topic, count")
def k18_topics(spark, d):
    """Topics of the documents' vector clusters; those without a vector are in none, topic -1, which has terms and a count as well."""
    found = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("topic"))
    if found.count() <= MOST_SENT:
        found = F.broadcast(found)
    docs = corpus(spark, d).join(found, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit(-1)))
    terms = mi.class_terms(docs, "topic", "text", 10)
    return terms.join(docs.groupBy("topic").agg(F.count("*").alias("count")), "topic").select("topic", "count", "name", "representation")


@query(f"{W}{CLEANED}, tk AS (SELECT want_id, unnest(regexp_extract_all(question_flat, '[A-Za-z][A-Za-z\\-'']{{2,}}')) AS w FROM cleaned), n AS (SELECT want_id, lower(w) AS w, count(*) AS n FROM tk WHERE length(w) > 3 AND lower(w) NOT IN ({', '.join(map(q, mi.STOPWORDS))}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY want_id ORDER BY n DESC, w) AS k FROM n) SELECT want_id, string_agg(w, '_' ORDER BY k) AS label FROM r WHERE k <= 6 GROUP BY want_id")
def k19_cluster_labels(spark, d):
    return mi.labels(cleaned(spark, d), "want_id", "question_flat")


@query(f"{W}{CLEANED} SELECT source_row, substr(concat_ws(' | ', nullif(category, ''), nullif(question_kind, ''), CASE WHEN lower(manager) NOT IN ('', 'nan', 'none', 'other') THEN manager END, nullif(question_flat, '')), 1, 1600) AS model_input FROM cleaned")
def k20_embedding_text(spark, d):
    parts = ["category", "question_kind", "manager", "question_flat"]
    return cleaned(spark, d).select("source_row", F.substring(F.concat_ws(" | ", *[F.when(~F.lower(c).isin("", "nan", "none", "other"), F.col(c)) for c in parts]), 1, 1600).alias("model_input"))


GRAMS = """gw AS (SELECT source_row, ' ' || unnest(string_split(lower(question_flat), ' ')) || ' ' AS w FROM cleaned),
gg AS (SELECT source_row, unnest(list_concat(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)), list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5)))) AS gram FROM gw),
gb AS (SELECT source_row, CAST('0x' || substr(md5(gram), 1, 8) AS BIGINT) % 384 AS bucket, count(*) AS n FROM gg GROUP BY ALL)"""


@query(f"{W}{CLEANED}, {GRAMS} SELECT bucket, {CNT} AS rows_, round(sum(x), 3) AS weight FROM (SELECT bucket, n / sqrt(sum(n * n) OVER (PARTITION BY source_row)) AS x FROM gb) GROUP BY bucket")
def d15_hashed_ngrams(spark, d):
    x = mi.hashed_grams(cleaned(spark, d), "source_row", "question_flat", (3, 5), 384)
    return x.groupBy("bucket").agg(F.count("*").alias("rows_"), F.round(F.sum("x"), 3).alias("weight"))


@query(f"{W}{ENRICHED} SELECT primary_desire, j.want AS want FROM (SELECT DISTINCT primary_desire FROM enriched) LEFT JOIN (VALUES ('recover_access', 3), ('fix_product_or_technical_flow', 5)) j(d, want) ON d = primary_desire")
def k16_fallback_want(spark, d):
    tops = spark.createDataFrame([(3, "recover_access", 10), (4, "recover_access", 9), (5, "fix_product_flow", 2), (6, "other", 50)], "want int, job string, size int")
    return mi.fallback_wants(enriched(spark, d).select("primary_desire").distinct(), tops)


@query()
def k01_ols_hc3(spark, d):
    return mi.ols(enriched(spark, d), "context_depth_score", [], ["manager", "category", "question_kind", "role", "status_en", "month"])


@query()
def k02_linear_probability(spark, d):
    x = enriched(spark, d).withColumn("y", F.col("is_resolved").cast("double") * 100)
    return mi.ols(x, "y", ["context_depth_score", "urgency_signal", "evidence_element_count"], ["category", "question_kind"])


@query()
def k10_kmeans(spark, d):
    return mi.kmeans(vectors(spark, d), "vec_id", "v")


@query()
def k08_projection_2d(spark, d):
    """Coordinates of a map, by principal components."""
    return mi.pca(vectors(spark, d), "vec_id", "v", 2)


@query()
def k08_principal_components(spark, d):
    return mi.pca(vectors(spark, d), "vec_id", "v", 2)


@query()
def k08_projection_10d(spark, d):
    """Coordinates for clustering: ten principal components."""
    return mi.pca(vectors(spark, d), "vec_id", "v", 10)


@query()
def k07_truncated_svd(spark, d):
    return mi.svd(vectors(spark, d), "vec_id", "v", 8)


def weighed(spark, d):
    """Weights of the terms of all documents, and the terms."""
    return mi.tfidf_rows(corpus(spark, d).select("doc_id", "text"), "doc_id", "text", 2, 3, 0.82)


@query()
def k07_sparse_decomposition(spark, d):
    """Coordinates of every document in the space of its tf-idf weights' first 80 singular vectors."""
    return de.decomposed(*weighed(spark, d), "doc_id")[0]


@query()
def k07_components(spark, d):
    """Singular values of the tf-idf weights, with the strongest terms of each component."""
    return de.decomposed(*weighed(spark, d), "doc_id")[1].select("component", F.round("value", 6).alias("value"), "terms")


@query()
def k10_minibatch_kmeans(spark, d):
    return mb.minibatch_kmeans(vectors(spark, d), "vec_id", "v").select("vec_id", "cluster", F.round("far", 6).alias("far"))


@query()
def k17_merge_centroids(spark, d):
    return mi.merge_centroids(centroids(spark, d), "label", 0.2)


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT CAST(greatest(8, least(35, CAST(floor(sqrt(n / 2)) AS INT))) AS INT) AS topics, CAST(greatest(8, least(32, CAST(round_even(sqrt(n / 2), 0) AS INT))) AS INT) AS outliers, CAST(greatest(8, least(24, n // 12)) AS INT) AS wants FROM n")
def k10_cluster_counts(spark, d):
    n = table(spark, d, "embeddings").count()
    return spark.createDataFrame([(mi.topic_count(n), mi.outlier_count(n), mi.want_count(n))], "topics int, outliers int, wants int")
