"""Structured records from text by rules, and checks of records from a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as p
from ..functions import text as t
from ..sources.sinks import stored
from . import grouping as g

# Patterns of the rule extractor, which has its own besides those of the features.
URL = r"(?i)https?://\S+"
IMAGE = r"(?i)https?://\S+?\.(?:jpg|jpeg|png|webp|gif)(?:\?\S*)?"
TIMESTAMP = r"\b20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2})?\b"
UID = r"\b\d{8,18}\b"
ROOM = r"(?i)\b(?:bg|sg|cg|my|voice|room|channel|group)[._:-]?[a-z0-9][a-z0-9._:-]{5,}\b"
BAN_WHY = r"(?i)\b(?:pornographic|pornography|moaning|insults?|personal attacks?|severe|abuse|scam|fraud|spam|competitor|blacklist|category [abc]|class [abc]|penalty|violation|ban reason|review reason)\b"
MONEY = r"(?i)\b(?:money|withdraw|withdrawal|salary|cash|payment|pay|payout|diamonds?|crystals?|beans?|recharge|top.?up|seller|dealer|reseller|rubles?|₽|income|earn|scammed|fraud)\b"
TRANSACTION = r"(?i)\b(?:diamond sales|sent money|took the money|payment|withdraw|withdrawal|recharge|top.?up|diamonds?|crystals?|beans?|seller|buyer|dealer|reseller|rubles?|₽|salary|payout|income)\b"
SCAM_REPORT = r"(?i)\b(?:this is a scammer|is a scammer|scammer,|scammed|deceived|tricked|cheated|took the money|sent money|owes|didn'?t send|did not send|send the money back|return the money|official dealer)\b"
BAN_STATE = r"(?i)\b(?:ban|banned|blocked|unblock|unblocked|unban|blacklist|penalty|violation|review reason|review time|block start|block duration|category [abc]|class [abc]|voice room ban)\b"
GAME = r"(?i)\b(?:game|fishing|fish-themed|fish themed|win|winning|level|play|bonus|lottery|draw)\b"
ABUSE_REPORT = r"(?i)\b(?:insult|insults|abuse|abusive|harass|harassment|threat|violence|foul language)\b"
STATUS = r"(?i)\b(?:svip|vip|level|points?|badge|status|privilege|frame)\b"
CLAIM = r"(?i)\b(?:i did nothing|did absolutely nothing|without reason|no reason|by mistake|mistake|unfair|wrongly|false|i don't know|dont know|do not understand|why was i|why i was|did not violate|didn't violate|not guilty)\b"
URGENT = r"(?i)\b(?:urgent|asap|please|plz|help|immediately|now|very|again|many times|still|cannot|can't|failed|why|complaint)\b"
AMOUNT = r"(?i)(?:\d[\d\s,.]*\s?(?:₽|rubles?|diamonds?|crystals?|beans?)|(?:₽|rubles?)\s?\d[\d\s,.]*)"
PLACE = r"(?i)\b(?:channel|group|room|voice)\b"
ACCOUNT = r"(?i)\b(?:account|restore|recover|login|phone|sim|number|access)\b"
SCAM = r"(?i)\b(?:scam|fraud|deceived|tricked|cheated|impersonat|official dealer)\b"
FEELS_URGENT = r"(?i)\b(?:urgent|asap|immediately|please help|why is no one)\b"
FEELS_CONFUSED = r"(?i)\b(?:why|don't understand|unfair)\b"
FEELS_ANGRY = r"(?i)\b(?:angry|complain|wtf|fuck|insult)\b"
UNSAFE = r"(?i)\b(?:pornographic|insult|abuse|scam|fraud|violence|threat)\b"

# The job that a primary desire stands for.
PRIMARY_JOB = {
    "clear_name_or_get_fairness": "prove_innocence", "recover_access": "recover_access", "earn_or_transact_money": "buy_or_sell_diamonds", "protect_from_abuse_or_scam": "avoid_scam",
    "grow_audience_or_community": "grow_channel", "gain_status_or_privileges": "gain_status", "understand_rules_or_system_logic": "understand_punishment",
    "fix_product_or_technical_flow": "fix_product_flow", "customize_identity_or_assets": "customize_identity",
}

# Phrases by job, and what evidence can be missing.
ACTUAL = {
    "avoid_scam": "User wants protection or redress from a scam/fraud dispute.",
    "buy_or_sell_diamonds": "User wants a safer money/diamonds transaction path.",
    "prove_innocence": "User wants fairness, ban transparency, or an appeal path.",
    "grow_channel": "User wants channel/group growth, visibility, ownership, or room functionality restored.",
    "recover_access": "User wants access/account identity restored.",
    "gain_status": "User wants SVIP/status/points/privilege clarity or restoration.",
    "understand_punishment": "User wants a clear explanation of rules, penalties, and what to do next.",
    "restore_visibility": "User wants visibility, reach, or discoverability restored.",
    "fix_product_flow": "User wants a broken product/support flow fixed.",
    "customize_identity": "User wants profile, naming, avatar, or identity assets changed or restored.",
    "restore_income": "User wants lost income, payout, or monetization restored.",
    "protect_community": "User wants moderation action to protect a room, group, or community.",
    "other": "User wants support to interpret and resolve a product/support problem.",
}
_TRADE_STEP = "Verify payment/diamond evidence, identify counterparties, and route to fraud/commerce escalation if proof is sufficient."
_TRADE_IDEA = "Create safer dealer/payment flow with receipt validation, counterparty identity, and dispute workflow."
NEXT_STEP = {
    "prove_innocence": "Check ban history, reason, timestamp, room/user IDs, and compare against provided user claim/evidence.",
    "avoid_scam": _TRADE_STEP,
    "buy_or_sell_diamonds": _TRADE_STEP,
    "grow_channel": "Check channel/group ID, feed visibility, limits, ownership, and active restrictions.",
    "recover_access": "Verify account ownership, phone/SIM status, deletion/block state, and recovery eligibility.",
    "understand_punishment": "Translate the rule, penalty, duration, and eligibility requirements into a user-readable explanation.",
    "fix_product_flow": "Reproduce the reported flow, capture device/account context, and route to the owning product team.",
    "customize_identity": "Verify the requested identity/profile asset change and check account safety restrictions.",
    "protect_community": "Review reported abuse proof, identify the user/dealer/room, and decide the correct moderation action.",
    "restore_income": "Verify payout, balance, transaction, and monetization records before routing to finance or creator ops.",
}
NEXT_STEP_ELSE = "Review evidence and classify into product fix, support macro, or escalation owner."
IDEA = {
    "prove_innocence": "Expose ban reason, evidence summary, penalty timeline, and self-serve appeal requirements.",
    "avoid_scam": _TRADE_IDEA,
    "buy_or_sell_diamonds": _TRADE_IDEA,
    "grow_channel": "Build creator ops dashboard for visibility, limits, ownership, and restriction status.",
    "recover_access": "Build account recovery flow that explains deletion/block/login states and required proof.",
    "understand_punishment": "Expose a penalty explainer with rule text, timeline, appeal eligibility, and required evidence.",
    "fix_product_flow": "Add guided diagnostics that collect context and route broken flows to the right owner automatically.",
    "customize_identity": "Build a self-service identity asset workflow with status, rejection reason, and appeal path.",
    "protect_community": "Create an abuse-report workflow that captures proof, actor identity, room context, and moderation status.",
    "restore_income": "Build a monetization ledger with payout status, failed-step diagnostics, and dispute escalation.",
}
IDEA_ELSE = "Convert repeated support patterns into self-service explanations and escalation forms."
MISSING = {
    "ban_time": "exact ban/review timestamp", "ban_reason": "copied ban/review reason", "claim": "user's own claim/denial", "amount": "amount/currency/diamond quantity",
    "party": "buyer/seller/counterparty UID", "proof": "payment or chat proof screenshots", "room": "room/group/channel ID", "none": "none obvious from rules preview",
}


def rules(e: DataFrame) -> DataFrame:
    """Extraction by rules of an enriched table: entities, job, emotion, evidence, levels, phrases, note quality, confidence.

    Of the table's features only primary_desire and context_depth_score count; the
    text is searched with the extractor's own patterns.
    """
    q, f = "question", F.col("question_flat")
    every = lambda pattern: F.regexp_extract_all(F.col(q), F.lit(pattern), F.lit(0))
    x = e.withColumns({"uids_": every(UID), "rooms_": every(ROOM), "times": every(TIMESTAMP), "why_": every(BAN_WHY), "amounts": F.slice(every(AMOUNT), 1, 8), "ban_": t.has(q, BAN_STATE), "claim_": t.has(q, CLAIM), "scam_": t.has(q, SCAM), "status_": t.has(q, STATUS), "money_": t.has(q, MONEY), "url_count": t.count(q, URL)})
    ban, claim, scam, status, money = (F.col(c) for c in ("ban_", "claim_", "scam_", "status_", "money_"))
    any_ = lambda c: F.size(c) > 0
    room = any_("rooms_") | t.has(q, PLACE)
    desire = F.coalesce("primary_desire", F.lit(""))
    hint = t.lookup(desire, PRIMARY_JOB, F.lit(None).cast("string"))
    job = t.cascade(
        [
            (t.has(q, GAME) & ~ban, "fix_product_flow"), ((desire == "protect_from_abuse_or_scam") | t.has(q, SCAM_REPORT), "avoid_scam"), (t.has(q, ABUSE_REPORT) & ~ban, "protect_community"),
            (claim | ban, "prove_innocence"), (hint.isNotNull(), hint), (scam, "avoid_scam"), (t.has(q, TRANSACTION), "buy_or_sell_diamonds"), (room, "grow_channel"), (t.has(q, ACCOUNT), "recover_access"),
            (status, "gain_status"),
        ],
        "other",
    )
    emotion = t.cascade([(scam | F.lower(f).contains("betray"), "betrayed"), (t.has(f, FEELS_URGENT), "urgent"), (claim | t.has(f, FEELS_CONFUSED), "confused"), (t.has(f, FEELS_ANGRY), "angry")], "unknown")
    link, image = F.col("url_count") > 0, t.has(q, IMAGE)
    present = F.array_compact(F.array(*[F.when(c, name) for c, name in [
        (image, "screenshots"), (link, "urls"), (any_("times"), "timestamps"), (any_("uids_"), "uid"), (any_("rooms_"), "room_or_group_id"), (any_("why_"), "ban_reason"), (any_("amounts"), "money_amount"), (claim, "user_claim")]]))
    deal = money | scam
    gone = F.array_compact(F.array(*[F.when(c, MISSING[k]) for c, k in [
        (ban & ~any_("times"), "ban_time"), (ban & ~any_("why_"), "ban_reason"), (ban & ~claim, "claim"), (deal & ~any_("amounts"), "amount"), (deal & (F.size("uids_") < 2), "party"),
        (deal & ~image & ~link, "proof"), (room & ~any_("rooms_"), "room")]]))
    i = lambda c: c.cast("int")
    few = lambda c, n: F.slice(F.array_sort(F.array_distinct(c)), 1, n)
    score = F.coalesce("context_depth_score", F.lit(0.0))
    x = x.withColumns(
        {
            "job_to_be_done": job, "user_emotion": emotion,
            "evidence_present": F.when(F.size(present) > 0, present).otherwise(F.array(F.lit("none"))),
            "evidence_missing": F.when(F.size(gone) > 0, gone).otherwise(F.array(F.lit(MISSING["none"]))),
            "urgency_level": t.level(1 + t.count(q, URGENT) / 2 + i(claim) + i(scam)), "trust_risk_level": t.level((1 + 2 * i(ban) + 2 * i(scam) + i(status)).cast("double")),
            "money_risk_level": t.level((1 + 3 * i(money) + i(scam)).cast("double")), "safety_policy_risk_level": t.level((1 + 3 * i(t.has(q, UNSAFE))).cast("double")),
            "manager_note_quality": t.cascade([(score >= 60, "forensic"), (score >= 35, "rich")], "adequate"),
            "literal_request": F.substring("question_flat", 1, 180), "confidence": F.lit(0.55),
            "uids": few("uids_", 12), "room_or_group_ids": few("rooms_", 12), "timestamps": F.slice("times", 1, 12), "ban_reasons": few("why_", 8),
        }
    )
    high = F.greatest("trust_risk_level", "money_risk_level", "safety_policy_risk_level") >= 4
    by_job = lambda table, other: t.lookup("job_to_be_done", table, F.lit(other))
    phrases = {"actual_user_want": by_job(ACTUAL, ACTUAL["other"]), "support_next_step": by_job(NEXT_STEP, NEXT_STEP_ELSE), "product_opportunity": by_job(IDEA, IDEA_ELSE)}
    return x.withColumns({"needs_human_review": high, **phrases}).drop("uids_", "rooms_", "times", "why_", "ban_", "claim_", "scam_", "status_", "money_")


# What a model echoes or says when it has nothing to say.
ECHOES = ["one of:", "short string", "what the user explicitly asked for", "deeper user want", "specific next operational action", "what product/system should exist", "number 0-1"]
VAGUE = ["unknown", "infer_goal", "resolve issue", "analyze", "investigate", "n/a", "none"]
TEXTS = ["literal_request", "actual_user_want", "support_next_step", "product_opportunity"]


def quality_flag(expected: str = "expected_row") -> Column:
    """The first of seven defects of a record; null: none."""
    s = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    said = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in ["literal_request", "actual_user_want", "job_to_be_done", "user_emotion", "support_next_step", "product_opportunity", "confidence"]]))
    anyof = lambda cs: __import__("functools").reduce(lambda a, b: a | b, cs)
    return t.cascade(
        [
            (s("source_row").isin("", "string"), "source_row_schema_echo"), (s("source_row") != F.col(expected), "source_row_mismatch"), (anyof([s(c) == "" for c in TEXTS]), "empty_required_fields"),
            (anyof([said.contains(w) for w in ECHOES]), "schema_echo"), (~s("job_to_be_done").isin(p.JOBS), "invalid_job"), (~s("user_emotion").isin(p.EMOTIONS), "invalid_emotion"),
            (t.total([F.lower(s(c)).isin(VAGUE).cast("int") for c in TEXTS]) >= 2, "too_vague"),
        ],
        F.lit(None).cast("string"),
    )


# Phrases that say nothing, and words of which a product idea has one.
GENERIC = [
    "unknown", "infer goal", "resolve issue", "analyze", "investigate", "n/a", "none", "fix issue", "block user", "unblock user", "account restored", "ban audit", "ban verification", "ban resolution",
    "improve user experience", "improve dispute resolution process", "review rule layer and data integrity",
]
PRODUCT = ["system", "workflow", "flow", "dashboard", "form", "tool", "receipt", "evidence", "appeal", "status", "timeline", "validation", "dispute", "self-service", "automation"]


def concrete(c: str, field: str = "") -> Column:
    """Is a phrase more than a code or a commonplace?"""
    x = F.trim(F.coalesce(F.col(c), F.lit("")))
    low = F.lower(t.flat(F.regexp_replace(x, "_", " ")))
    ok = (F.length(x) >= 8) & ~x.contains("_") & ~low.isin(GENERIC)
    if field == "support_next_step":
        ok = ok & (F.length(x) >= 24)
    if field == "product_opportunity":
        ok = ok & (F.length(x) >= 36) & __import__("functools").reduce(lambda a, b: a | b, [low.contains(w) for w in PRODUCT])
    return ok


def normalised(df: DataFrame) -> DataFrame:
    """Jobs and emotions by their aliases; what was replaced is kept beside."""
    out = df
    for col, table in (("job_to_be_done", p.JOB_ALIASES), ("user_emotion", p.EMOTION_ALIASES)):
        key = F.trim(F.coalesce(F.col(col), F.lit("")))
        new = t.lookup(key, table, F.lit(None).cast("string"))
        out = out.withColumn(f"_normalized_{col}_from", F.when(new.isNotNull(), key)).withColumn(col, F.coalesce(new, F.col(col)))
    return out


def hybrid(base: DataFrame, model: DataFrame) -> DataFrame:
    """Records by rules, with a model's phrases where they are concrete; review if either asks, the greater confidence."""
    m = model.select("source_row", *[F.col(c).alias(f"m_{c}") for c in [*TEXTS, "needs_human_review", "confidence"] if c in model.columns])
    x = base.join(m, "source_row", "left")
    for c in TEXTS:
        if f"m_{c}" in x.columns:
            x = x.withColumn(c, F.when(concrete(f"m_{c}", c), F.col(f"m_{c}")).otherwise(F.col(c) if c in base.columns else F.lit("")))
    x = x.withColumn("needs_human_review", F.col("needs_human_review") | F.coalesce("m_needs_human_review", F.lit(False)))
    return x.withColumn("confidence", F.greatest("confidence", F.coalesce("m_confidence", F.lit(0.0)))).drop(*[c for c in m.columns if c.startswith("m_")])


def parse(raw: Column, schema: str) -> Column:
    """A struct from text with a JSON object somewhere in it, null if there is none."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema)


def taxonomy(x: DataFrame, by: str = "want_id", text: str = "want_text", similarity: str = "centroid_similarity") -> DataFrame:
    """Wants by size, share, top jobs and emotions, risks, and the texts and next steps nearest to the centre."""
    x = stored(x.select(by, text, similarity, "first_pos", "job_to_be_done", "user_emotion", "support_next_step", "money_risk_level", "trust_risk_level", "urgency_level"), "taxonomy")
    s = x.groupBy(by).agg(
        F.count("*").alias("size"), *[F.round(F.round(F.avg(c), 8), 2).alias(a) for c, a in (("money_risk_level", "avg_money_risk"), ("trust_risk_level", "avg_trust_risk"), ("urgency_level", "avg_urgency"))],
        *[F.round(g.share(F.col(c) >= 4), 6).alias(a) for c, a in (("money_risk_level", "high_money_risk_share"), ("trust_risk_level", "high_trust_risk_share"))],
    )
    s = s.crossJoin(F.broadcast(s.agg(F.sum("size").alias("all_")))).withColumn("share", F.round(F.col("size") / F.col("all_"), 6)).drop("all_")
    for c, a in (("job_to_be_done", "top_jobs"), ("user_emotion", "top_emotions")):
        s = g.same(s, g.top_list(x, [by], c, 3, a, "{v}:{n}"), [by])
    order = [F.desc(similarity), F.col("first_pos")]
    s = g.same(s, g.examples(x, [by], order, F.col(text), 3), [by])
    return g.same(s, g.examples(x.filter(F.col("support_next_step").isNotNull()), [by], order, F.col("support_next_step"), 2, "next_step_"), [by])


def run_summary(x: DataFrame, order: str) -> DataFrame:
    """rows_, ok, bad_output, error of a run's records, and the model and backend of its first one."""
    of = lambda s: F.count_if(F.col("_status") == s).alias(s)
    return x.agg(F.count("*").alias("rows_"), of("ok"), of("bad_output"), of("error"), F.min_by("_model", order).alias("model"), F.min_by("_backend", order).alias("backend"))
