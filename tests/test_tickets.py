"""Literal tickets through cleaning and features; every value is worked out by hand."""

import pytest
from pyspark.sql import functions as F

from skeinery.functions import patterns as p
from skeinery.functions import text as t
from skeinery.operators import features, grouping, ingest, longitudinal, vectors

RAW = [
    ("1", "03.04.2026", "M1", "u1", "封禁 Ban appeal", "Closed", "I was banned without reason. https://x.io/a.png?k=1 2026-04-02 14:30 room_abcdef1 123456789012"),
    ("2", "04/04/2026", "M1", "u1", "Money", "Failed", "seller took my diamonds\r\nplease help now\r\nproof https://x.io/p"),
    ("3", "2026-04-05", "M2", "u2", "Money", "In process", "topup failed"),
    ("4", "bad-date", "M2", "", "已解决", "Done", "ok"),
    ("5", "", "M3", "", "", "", ""),
    ("6", "05.03.2026", "", "u3", "Access", "Done", "lost password" + "x" * 200),
    ("7", "01.01.2026", "M1", "77.0", "Access", "No action", "Albania album"),
    ("8", "05.04.2026", "M1", "u1", "Money", "Closed", "no_ban please"),
]
NAMES = ["#", "Date ", "MANAGER", "UID", "分类", "Status", "Question"]


@pytest.fixture(scope="module")
def canonical(spark):
    raw = spark.createDataFrame(RAW, ", ".join(f"`{n}` string" for n in NAMES))
    return ingest.drop_summaries(ingest.canonical(raw))


@pytest.fixture(scope="module")
def rows(canonical):
    return {r.source_row: r for r in features.enrich(canonical).collect()}


def test_canonical(canonical):
    got = {r.source_row: r for r in canonical.collect()}
    assert sorted(got) == ["1", "2", "3", "4", "6", "7", "8"]
    assert got["1"].category == "Ban appeal" and got["4"].category == "已解决"
    assert [got[k].month for k in "1234"] == ["2026-04", "2026-04", "2026-04", ""]
    assert got["3"].date.day == 5 and got["4"].date is None
    assert got["2"].question.split("\n")[1] == "please help now"
    assert [got[k].is_resolved for k in "12348"] == [True, False, False, True, True]


def test_flags(rows):
    on = {e for e in p.EVIDENCE if rows["1"][e]}
    assert on == set(p.EVIDENCE) - {"has_money_terms", "has_status_or_svip_terms", "has_multiline_note"}
    assert rows["1"].evidence_element_count == 7
    assert rows["2"].line_count == 3 and rows["2"].has_money_terms and rows["2"].urgency_signal == 3
    assert rows["3"].primary_desire == "earn_or_transact_money" and rows["3"].desire__fix_product_or_technical_flow
    assert rows["4"].primary_desire == p.UNCLEAR and rows["6"].primary_desire == "recover_access"
    assert not rows["7"].has_ban_reason_language and not rows["8"].has_ban_reason_language
    assert rows["1"].model_text.startswith("I was banned without reason. [URL] 2026")


def test_order_does_not_matter(spark, canonical):
    a = sorted(map(str, features.enrich(canonical).collect()))
    b = sorted(map(str, features.enrich(canonical.orderBy(F.rand(7)).repartition(5)).collect()))
    assert a == b


def test_bands_and_levels(spark):
    x = spark.sql("SELECT explode(array(15D, 15.01D, 35D, 60D, 60.5D)) AS s").select(features.band(F.col("s")).alias("b"))
    assert [r.b for r in x.collect()] == ["thin", "basic", "basic", "rich", "forensic"]
    x = spark.sql("SELECT explode(array(2.5D, 3.5D, 9D, 0D)) AS s").select(t.level(F.col("s")).alias("b"))
    assert [r.b for r in x.collect()] == [2, 4, 5, 1]


def test_lift_and_z(spark):
    one = spark.range(1).select(grouping.lift(F.lit(0.0), F.lit(0.0)).alias("l"), grouping.z_score(F.lit(0), F.lit(10), F.lit(0), F.lit(10)).alias("z")).first()
    assert one.l == 1.0 and one.z == 0.0


def test_profile_entropy(spark):
    x = spark.sql("SELECT * FROM VALUES ('a', 'c'), ('a', 'c'), ('b', 'c'), ('b', 'c') AS t(x, y)")
    got = {r.field: r for r in grouping.profile(x, ["x", "y"]).collect()}
    assert (got["x"].entropy, got["x"].degenerate) == (1.0, False) and (got["y"].entropy, got["y"].degenerate) == (0.0, True)


@pytest.mark.parametrize(("last", "kept"), [(3, 2), (4, 3)])
def test_complete_months(spark, last, kept):
    rows = [("2026-01",)] * 10 + [("2026-02",)] * 10 + [("2026-03",)] * last
    assert longitudinal.complete_months(spark.createDataFrame(rows, "month string")).count() == kept


def test_co_occurrence(spark):
    rows = [(str(i), n) for i in range(9) for n in ("a", "b")] + [(str(20 + i), n) for i in range(7) for n in ("a", "c")] + [("99", "lone")]
    edges, deg = grouping.co_occurrence(spark.createDataFrame(rows, "source_row string, node string"))
    assert [(r.a, r.b, r.weight) for r in edges.collect()] == [("a", "b", 9)]
    assert {r.node: (r.weighted_degree, r.degree) for r in deg.collect()} == {"a": (16, 2), "b": (9, 1), "c": (7, 1), "lone": (0, 0)}


def test_projection_bands(spark):
    cen = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id int, c array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "k int, v array<double>")
    got = {r.k: r for r in vectors.nearest(v, cen, "id").collect()}
    assert (got[1].best, got[1].score, got[1].margin) == (0, 1.0, 1.0)
    assert got[2].best == 0 and got[2].margin == 0.0 and got[3].score == 0.0 and got[4].best is None
    band = lambda s, m: spark.range(1).select(vectors.confidence_band(F.lit("x"), F.lit(s), F.lit(m), F.lit(0.4), 0.1).alias("b")).first().b
    assert [band(0.5, 0.2), band(0.45, 0.1), band(0.39, 0.3)] == ["high", "medium", "low"]


# one text for each branch of the extractor: text, primary desire, job, emotion, urgency, trust, money, safety, missing
EXTRACTED = [
    ("the fishing game took my points", "", "fix_product_flow", "unknown", 1, 2, 1, 1, ["none obvious from rules preview"]),
    ("he owes me", "", "avoid_scam", "unknown", 1, 1, 1, 1, ["none obvious from rules preview"]),
    ("hello", "protect_from_abuse_or_scam", "avoid_scam", "unknown", 1, 1, 1, 1, ["none obvious from rules preview"]),
    ("they harass me", "", "protect_community", "unknown", 1, 1, 1, 1, ["none obvious from rules preview"]),
    ("banned after a game", "", "prove_innocence", "unknown", 1, 3, 1, 1, ["exact ban/review timestamp", "copied ban/review reason", "user's own claim/denial"]),
    ("it was unfair", "", "prove_innocence", "confused", 2, 1, 1, 1, ["none obvious from rules preview"]),
    ("my followers", "grow_audience_or_community", "grow_channel", "unknown", 1, 1, 1, 1, ["none obvious from rules preview"]),
    ("a fraud", "", "avoid_scam", "betrayed", 2, 3, 5, 4, ["amount/currency/diamond quantity", "buyer/seller/counterparty UID", "payment or chat proof screenshots"]),
    ("recharge of 500 diamonds", "play_or_entertainment", "buy_or_sell_diamonds", "unknown", 1, 1, 4, 1, ["buyer/seller/counterparty UID", "payment or chat proof screenshots"]),
    ("open the room", "", "grow_channel", "unknown", 1, 1, 1, 1, ["room/group/channel ID"]),
    ("my login", "", "recover_access", "unknown", 1, 1, 1, 1, ["none obvious from rules preview"]),
    ("the badge", "", "gain_status", "unknown", 1, 2, 1, 1, ["none obvious from rules preview"]),
    ("hm", "", "other", "unknown", 1, 1, 1, 1, ["none obvious from rules preview"]),
    ("wtf, please help now", "", "other", "urgent", 2, 1, 1, 1, ["none obvious from rules preview"]),
]


def test_extraction_by_rules(spark):
    from skeinery.operators import extraction

    rows = [(str(i), text, desire, 36.0 if i else None) for i, (text, desire, *_) in enumerate(EXTRACTED)]
    df = spark.createDataFrame(rows, "source_row string, question string, primary_desire string, context_depth_score double").selectExpr("*", "question AS question_flat")
    got = {int(r.source_row): r for r in extraction.rules(df).collect()}
    for i, (_, _, job, emotion, *levels, missing) in enumerate(EXTRACTED):
        r = got[i]
        assert (r.job_to_be_done, r.user_emotion, r.evidence_missing) == (job, emotion, missing), EXTRACTED[i]
        assert [r.urgency_level, r.trust_risk_level, r.money_risk_level, r.safety_policy_risk_level] == levels, EXTRACTED[i]
    assert got[0].manager_note_quality == "adequate" and got[1].manager_note_quality == "rich"
    text = "ids 12345678 12345678 87654321 my_abcdef 2026-04-02 14:30 https://x.io/a.png 5 beans, category b"
    r = extraction.rules(spark.createDataFrame([("1", text, text, "", 1.0)], "source_row string, question string, question_flat string, primary_desire string, context_depth_score double")).first()
    assert (r.uids, r.room_or_group_ids, r.timestamps, r.ban_reasons, r.url_count) == (["12345678", "87654321"], ["my_abcdef"], ["2026-04-02 14:30"], ["category b"], 1)
    assert r.evidence_present == ["screenshots", "urls", "timestamps", "uid", "room_or_group_id", "ban_reason", "money_amount"] and "buyer/seller/counterparty UID" not in r.evidence_missing
    assert r.support_next_step.startswith("Check ban history") and r.product_opportunity.startswith("Expose ban reason") and (r.money_risk_level, r.needs_human_review) == (4, True)


def test_trends_of_few_months(spark):
    from skeinery.operators import longitudinal

    rows = [(1, "2026-01", "u", "Closed", "", True), (1, "2026-01", "v", "Failed", "", False), (2, "2026-02", "", "Closed", "", False)]
    df = spark.createDataFrame(rows, "want_id int, month string, uid string, status_en string, status_cn string, needs_llm_review boolean")
    got = {r.want_id: r for r in longitudinal.trends(df, "want_id").collect()}
    assert (got[1].monthly_slope, got[1].recent_avg_per_month, got[1].forecast_next_month, got[1].recent_failed_or_open_share, got[1].recent_review_queue_share) == (0.0, 1.0, 1.0, 0.5, 0.5)
    assert (got[2].recent_months, got[2].prior_months, got[2].forecast_month, got[2].recent_unique_users) == ("2026-01, 2026-02", "", "2026-03", 1)
    one = longitudinal.trends(df.filter("month = '2026-01'"), "want_id").first()
    assert (one.recent_avg_per_month, one.forecast_next_month) == (2.0, 2.0)
    assert longitudinal.trends(df.limit(0), "want_id").count() == 0


def test_rows_are_numbered_as_read(spark, tmp_path):
    from skeinery.operators import ingest as ing

    path = f"file://{tmp_path}/raw"
    spark.range(1000).repartition(7).selectExpr("concat('question ', id) AS question").write.parquet(path)
    raw = spark.read.option("maxPartitionBytes", 1).parquet(path)
    rows = ing.canonical(raw).select("source_row", "question").collect()
    assert sorted(int(r.source_row) for r in rows) == list(range(1, 1001)) and len({r.question for r in rows}) == 1000
    assert [r.question for r in sorted(rows, key=lambda r: int(r.source_row))] == [r.question for r in raw.collect()]
