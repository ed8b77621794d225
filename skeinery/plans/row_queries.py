"""Queries on scans, cleaning, features, scores and rules: one row in, one row out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as p
from ..functions import text as t
from ..operators import features, ingest
from ..sources.tables import table, tickets
from .oracle import CLEANED, ENRICHED, FLAT, m, q
from .registry import query


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return ingest.cleaned(tickets(spark, d))


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return features.enrich(cleaned(spark, d))


W = "WITH "
RAW = "source_row, question"


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def a03_projected_scan(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus")


@query("SELECT * EXCLUDE (c_acctbal), CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def a02_typed_table_scan(spark, d):
    return table(spark, d, "customer")


@query("SELECT vec_id, embedding IS NOT NULL AS has_embedding, CAST(len(embedding) AS INT) AS dim FROM embeddings UNION ALL SELECT doc_id, false, NULL FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def a07_vector_alignment(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = ids.join(v, "vec_id", "full")
    return both.select("vec_id", F.col("embedding").isNotNull().alias("has_embedding"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"))


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def a06_json_parse(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


@query(f"{W}{CLEANED} SELECT source_row, question, CAST(length(question) AS INT) AS n FROM cleaned")
def b01_clean_text(spark, d):
    return tickets(spark, d).select("source_row", t.clean_text("question").alias("question")).withColumn("n", F.length("question"))


@query(f"{W}{CLEANED} SELECT source_row, question_flat FROM cleaned")
def b02_normalize_space(spark, d):
    return cleaned(spark, d).select("source_row", "question_flat")


@query(f"{W}{CLEANED} SELECT source_row, uid FROM cleaned WHERE question <> '' OR uid <> ''")
def b05_drop_summary_rows(spark, d):
    return ingest.drop_summaries(cleaned(spark, d)).select("source_row", "uid")


CJK = "VALUES ('封禁 Ban appeal'), ('封禁 & 解封Unban'), ('已解决'), ('Money'), ('  钱 money'), ('钱 1x'), ('')"


@query(f"SELECT x, CASE WHEN regexp_matches(x, '^[一-鿿　-〿&\\s]+[A-Za-z]') THEN regexp_replace(x, '^[一-鿿　-〿&\\s]+([A-Za-z])', '\\1') ELSE x END AS y FROM ({CJK}) v(x)")
def b06_strip_cjk_prefix(spark, d):
    return spark.sql(f"SELECT col1 AS x FROM {CJK}").select("x", t.strip_cjk_prefix("x").alias("y"))


@query(f"{W}{CLEANED} SELECT source_row, date, month, manager, role, uid, question_kind, category, status_en, status_cn, question, question_flat, is_resolved, is_unresolved FROM cleaned")
def b07_canonical(spark, d):
    return cleaned(spark, d).select("source_row", "date", "month", "manager", "role", "uid", "question_kind", "category", "status_en", "status_cn", "question", "question_flat", "is_resolved", "is_unresolved")


DATES = "VALUES ('03.04.2026'), ('04/04/2026'), ('2026-04-05'), ('bad-date'), (''), ('5.3.2026 7:05'), ('2026-04-05 10:11:12'), ('31/12/2025 23:59')"


@query(
    f"""SELECT x, coalesce(try_strptime(x, '%Y-%m-%d %H:%M:%S'), try_strptime(x, '%Y-%m-%d %H:%M'), try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%d.%m.%Y %H:%M'),
    try_strptime(x, '%d.%m.%Y'), try_strptime(x, '%d/%m/%Y %H:%M'), try_strptime(x, '%d/%m/%Y')) AS ts FROM ({DATES}) v(x)"""
)
def b08_day_first_dates(spark, d):
    return spark.sql(f"SELECT col1 AS x FROM {DATES}").select("x", t.day_first("x").alias("ts"))


@query(f"{W}{CLEANED} SELECT month, CAST(count(*) AS BIGINT) AS n FROM cleaned GROUP BY month")
def b09_month_bucket(spark, d):
    return cleaned(spark, d).groupBy("month").agg(F.count("*").alias("n"))


@query(f"{W}{CLEANED} SELECT status_en, status_cn, is_resolved, is_unresolved, CAST(count(*) AS BIGINT) AS n FROM cleaned GROUP BY ALL")
def b10_resolution_flags(spark, d):
    return cleaned(spark, d).groupBy("status_en", "status_cn", "is_resolved", "is_unresolved").agg(F.count("*").alias("n"))


BUCKET = "CASE WHEN lower(status_en) IN ('closed', 'done') THEN 'resolved' WHEN lower(status_en) IN ('failed', 'no action') THEN 'failed' WHEN lower(status_en) = 'in process' THEN 'open' ELSE 'unknown' END"


@query(f"{W}{CLEANED} SELECT source_row, {BUCKET} AS status_bucket FROM cleaned")
def b11_status_bucket(spark, d):
    return cleaned(spark, d).select("source_row", ingest.status_bucket().alias("status_bucket"))


WORDS = "VALUES ('true'), ('Yes'), ('Y'), ('1'), ('0'), ('no'), (''), (NULL), ('nan'), ('None'), ('NULL'), (' x '), ('12.0'), ('77.0'), ('a12b3')"


@query(f"SELECT x, coalesce(lower(trim(x)) IN ('true', '1', 'yes', 'y'), false) AS b, coalesce(lower(trim(x)) IN ('true', '1'), false) AS strict FROM ({WORDS}) v(x)")
def b12_truthy(spark, d):
    return spark.sql(f"SELECT col1 AS x FROM {WORDS}").select("x", t.truthy("x").alias("b"), t.truthy("x", ("true", "1")).alias("strict"))


@query(f"SELECT x, CASE WHEN lower(trim(coalesce(x, ''))) IN ('nan', 'none', 'null') THEN '' ELSE trim(coalesce(x, '')) END AS y FROM ({WORDS}) v(x)")
def b13_null_words(spark, d):
    return spark.sql(f"SELECT col1 AS x FROM {WORDS}").select("x", t.no_null_words("x").alias("y"))


@query(f"SELECT x, regexp_replace(trim(x), '\\.0$', '') AS key, regexp_replace(coalesce(x, ''), '[^0-9]', '', 'g') AS digits FROM ({WORDS}) v(x)")
def b14_key_repair(spark, d):
    return spark.sql(f"SELECT col1 AS x FROM {WORDS}").select("x", t.key_repair("x").alias("key"), t.digits("x").alias("digits"))


@query(f"{W}{CLEANED} SELECT source_row, coalesce(nullif(trim(manager), ''), 'Unknown') AS manager FROM cleaned")
def b15_fill_unknown(spark, d):
    return tickets(spark, d).select("source_row", t.or_unknown("manager").alias("manager"))


def _compact_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substr({x}, 1, {n - 3})) || '...' END"


@query(f"{W}{CLEANED} SELECT source_row, {_compact_sql('question_flat', 80)} AS short, {_compact_sql('question_flat', 420)} AS example FROM cleaned")
def b16_compact(spark, d):
    return tickets(spark, d).select("source_row", t.compact("question", 80).alias("short"), t.compact("question", 420).alias("example"))


def _enriched(name: str, cols: str) -> None:
    query(f"{W}{ENRICHED} SELECT source_row, {cols} FROM enriched", name)(lambda spark, d: enriched(spark, d).selectExpr("source_row", *[c.strip() for c in cols.split(",")]))


_enriched("c01_lengths", "char_count, word_count, line_count")
_enriched("c02_url_counts", "url_count, image_url_count")
_enriched("c03_time_counts", "timestamp_count, date_mention_count")
_enriched("c04_id_counts", "room_id_count, long_id_count")
_enriched("c05_has_flags", "has_url, has_image_url, has_timestamp, has_room_or_group_id, has_long_uid_or_case_id, has_multiline_note")
_enriched("c06_vocabulary_flags", "has_ban_reason_language, has_user_claim, has_money_terms, has_status_or_svip_terms")
_enriched("c07_screenshot_flag", "has_screenshot_evidence")
_enriched("c08_desire_flags", ", ".join(f"desire__{k}" for k in p.DESIRES))
_enriched("c09_primary_desire", "desire_count, primary_desire")
_enriched("c10_urgency_signal", "urgency_signal")
_enriched("c11_evidence_count", "evidence_element_count")
_enriched("c12_model_text", "model_text")
_enriched("d02_context_score", "context_depth_score")
_enriched("d03_context_band", "context_depth_band")
_enriched("d04_trust_money_flag", "trust_money_flag")
_enriched("d06_risk_signal_count", "risk_signal_count")


def _found_sql(pattern: str, most: int) -> str:
    return f"array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(question, {q(pattern)}))), 1, {most}), '|')"


MONEY_AMOUNT = r"(?i)(?:[$€£₽]\s?\d[\d,.]*|\d[\d,.]*\s?(?:[$€£₽]|diamonds?|beans?|usd|rubles?))"


@query(f"{W}{CLEANED} SELECT source_row, {_found_sql(p.UID, 12)} AS uids, {_found_sql(p.ROOM_ID, 12)} AS rooms, {_found_sql(p.TIMESTAMP, 12)} AS times FROM cleaned")
def c13_entities(spark, d):
    return cleaned(spark, d).select("source_row", *[F.array_join(t.found("question", x, 12), "|").alias(n) for n, x in (("uids", p.UID), ("rooms", p.ROOM_ID), ("times", p.TIMESTAMP))])


@query(f"{W}{CLEANED} SELECT source_row, {_found_sql(MONEY_AMOUNT, 8)} AS amounts FROM cleaned")
def c14_money_amounts(spark, d):
    return cleaned(spark, d).select("source_row", F.array_join(t.found("question", MONEY_AMOUNT, 8), "|").alias("amounts"))


def snippet(x, pattern: str, around: int = 120):
    """The first match with so many characters on each side."""
    at = F.regexp_instr(x, F.lit(pattern))
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(x, start, at - start + F.length(F.regexp_extract(x, pattern, 0)) + around))


@query(
    f"""{W}{ENRICHED}, s AS (SELECT *, regexp_extract(question_flat, {q(p.NO_BAN)}) AS hit FROM enriched WHERE {m("question || chr(10) || question_flat || chr(10) || model_text", p.NO_BAN)})
    SELECT source_row, concat_ws(', ', CASE WHEN {m('question', p.NO_BAN)} THEN 'question' END, CASE WHEN {m('question_flat', p.NO_BAN)} THEN 'question_flat' END, CASE WHEN {m('model_text', p.NO_BAN)} THEN 'model_text' END) AS matched_fields,
    substr(question_flat, greatest(1, instr(question_flat, hit) - 120), instr(question_flat, hit) - greatest(1, instr(question_flat, hit) - 120) + length(hit) + 120) AS context FROM s"""
)
def c15_keyword_search(spark, d):
    fields = ["question", "question_flat", "model_text"]
    e = enriched(spark, d).filter(F.concat_ws("\n", *fields).rlike(p.NO_BAN))
    return e.select("source_row", F.concat_ws(", ", *[F.when(F.col(f).rlike(p.NO_BAN), f) for f in fields]).alias("matched_fields"), snippet(F.col("question_flat"), p.NO_BAN).alias("context"))


@query(f"{W}{CLEANED} SELECT source_row FROM cleaned WHERE contains(lower(question), 'diamonds')")
def c16_substring_search(spark, d):
    return cleaned(spark, d).filter(t.contains_ci("question", "Diamonds")).select("source_row")


@query(f"{W}{ENRICHED} SELECT {', '.join(f'round(cap_{c}, 6) AS cap_{c}' for c in p.DEPTH_CAPPED)} FROM caps")
def d01_caps(spark, d):
    x = features.caps(features.counted(cleaned(spark, d)))
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


RISK_FOUR = ["has_money_terms", "has_status_or_svip_terms", "has_ban_reason_language", "has_user_claim"]


@query(f"{W}{ENRICHED} SELECT source_row, {' + '.join(f'CAST({c} AS INT)' for c in [*RISK_FOUR, 'is_unresolved'])} AS risk_score FROM enriched")
def d05_candidate_risk(spark, d):
    return enriched(spark, d).select("source_row", t.total([F.col(c).cast("int") for c in [*RISK_FOUR, "is_unresolved"]]).alias("risk_score"))


LEVELS = "VALUES (0.0), (1.5), (2.5), (3.5), (4.5), (9.0), (-1.0), (NULL)"


@query(f"SELECT x, greatest(1, least(5, coalesce(CAST(round_even(x, 0) AS INT), 1))) AS level, CASE WHEN x IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, x)) END AS confidence FROM (SELECT CAST(x AS DOUBLE) AS x FROM ({LEVELS}) v(x))")
def d17_bounded_level(spark, d):
    x = spark.sql(f"SELECT CAST(col1 AS DOUBLE) AS x FROM {LEVELS}")
    return x.select("x", t.level(F.col("x")).alias("level"), F.coalesce(F.when(F.col("x").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x")))), F.lit(0.5)).alias("confidence"))


@query(f"{W}{CLEANED} SELECT source_row FROM cleaned WHERE length(question) >= 8")
def e01_valid_text(spark, d):
    return cleaned(spark, d).filter(F.length("question") >= 8).select("source_row")


@query(f"{W}{ENRICHED} SELECT source_row FROM enriched WHERE context_depth_score >= 24 AND char_count >= 40")
def e02_candidates(spark, d):
    return enriched(spark, d).filter((F.col("context_depth_score") >= 24) & (F.col("char_count") >= 40)).select("source_row")


def facets(df: DataFrame, among: dict[str, list], like: dict[str, str] | None = None, least: dict[str, float] | None = None) -> DataFrame:
    """Rows that meet all facets; an empty list means no facet."""
    for col, values in among.items():
        df = df.filter(F.col(col).isin(values)) if values else df
    for col, part in (like or {}).items():
        df = df.filter(t.contains_ci(col, part)) if part else df
    for col, low in (least or {}).items():
        df = df.filter(F.col(col) >= low)
    return df


@query(f"{W}{ENRICHED} SELECT source_row FROM enriched WHERE manager IN ('M1', 'M2') AND category = '1-URGENT' AND contains(lower(question), 'help')")
def e03_filter_builder(spark, d):
    return facets(enriched(spark, d), {"manager": ["M1", "M2"], "category": ["1-URGENT"], "role": []}, {"question": "Help"}).select("source_row")


@query(f"{W}{ENRICHED} SELECT source_row FROM enriched WHERE context_depth_band IN ('rich', 'forensic') AND evidence_element_count >= 4")
def e04_facets(spark, d):
    return facets(enriched(spark, d), {"context_depth_band": ["rich", "forensic"]}, least={"evidence_element_count": 4}).select("source_row")


def theme(job, label):
    """Six themes."""
    label = F.lower(F.coalesce(label, F.lit("")))
    return t.cascade(
        [
            (job.isin("recover_access", "prove_innocence", "understand_punishment"), "Trust and account recovery"),
            (job.isin("protect_community", "avoid_scam"), "Safety, abuse and fraud"),
            (job.isin("buy_or_sell_diamonds", "restore_income") | label.contains("diamond") | label.contains("dealer"), "Money, diamonds and dealer risk"),
            (job.isin("restore_visibility", "grow_channel"), "Visibility and growth"),
            ((job == "gain_status") | label.contains("svip"), "Status and privileges"),
        ],
        "Other operational friction",
    )


THEMES = "VALUES ('recover_access:3, other:1', 'x'), ('', 'Dealer trust'), (NULL, 'svip points'), ('grow_channel:2', ''), ('avoid_scam:9', NULL), ('other:1', 'y')"


@query(
    f"""SELECT jobs, label, CASE WHEN head IN ('recover_access', 'prove_innocence', 'understand_punishment') THEN 'Trust and account recovery' WHEN head IN ('protect_community', 'avoid_scam') THEN 'Safety, abuse and fraud'
    WHEN head IN ('buy_or_sell_diamonds', 'restore_income') OR contains(l, 'diamond') OR contains(l, 'dealer') THEN 'Money, diamonds and dealer risk' WHEN head IN ('restore_visibility', 'grow_channel') THEN 'Visibility and growth'
    WHEN head = 'gain_status' OR contains(l, 'svip') THEN 'Status and privileges' ELSE 'Other operational friction' END AS theme
    FROM (SELECT jobs, label, lower(coalesce(label, '')) AS l, coalesce(nullif(trim(split_part(split_part(jobs, ',', 1), ':', 1)), ''), 'other') AS head FROM ({THEMES}) v(jobs, label))"""
)
def e10_themes(spark, d):
    head = F.coalesce(F.nullif(F.trim(F.regexp_extract("jobs", r"^([^,:]*)", 1)), F.lit("")), F.lit("other"))
    return spark.sql(f"SELECT col1 AS jobs, col2 AS label FROM {THEMES}").select("jobs", "label", theme(head, F.col("label")).alias("theme"))


@query(f"{W}{ENRICHED} SELECT source_row, uid, date, manager AS agent, context_depth_band AS band FROM enriched")
def e12_display_projection(spark, d):
    names = {"source_row": "source_row", "uid": "uid", "absent": "absent", "date": "date", "manager": "agent", "context_depth_band": "band"}
    e = enriched(spark, d)
    return e.select(*[F.col(c).alias(n) for c, n in names.items() if c in e.columns])


@query(f"{W}{CLEANED} SELECT source_row, uid, category FROM cleaned")
def e13_drop_attribution(spark, d):
    x = cleaned(spark, d).select("source_row", "uid", "manager", "role", "category")
    return x.drop("manager", "role", "role_secondary", "delegate_to", "agent")


@query(f"{W}{ENRICHED} SELECT primary_desire, CASE primary_desire WHEN 'recover_access' THEN 'Recover access' ELSE upper(substr(replace(primary_desire, '_', ' '), 1, 1)) || substr(replace(primary_desire, '_', ' '), 2) END AS title, CAST(count(*) AS BIGINT) AS n FROM enriched GROUP BY ALL")
def e15_humanise(spark, d):
    words = F.replace(F.col("primary_desire"), F.lit("_"), F.lit(" "))
    title = t.lookup("primary_desire", {"recover_access": "Recover access"}, F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 100)))
    return enriched(spark, d).groupBy("primary_desire", title.alias("title")).agg(F.count("*").alias("n"))


@query(f"SELECT array_to_string(x, ' ') AS terms, array_to_string(list_slice(list_filter(y, lambda w, i: NOT list_contains(list_slice(y, 1, i - 1), w)), 1, 5), '_') AS slug FROM (SELECT x, list_filter(string_split_regex(lower(array_to_string(x, ' ')), '[^a-z0-9]+'), lambda w: w <> '') AS y FROM (VALUES (['Dealer Trust', 'dealer', 'x9', 'pay-out', 'a', 'b']), (['', '!!'])) v(x))")
def e17_slug(spark, d):
    x = spark.sql("SELECT col1 AS x FROM VALUES (array('Dealer Trust', 'dealer', 'x9', 'pay-out', 'a', 'b')), (array('', '!!'))")
    return x.select(F.array_join("x", " ").alias("terms"), t.slug(F.col("x")).alias("slug"))
