"""Vocabularies and codes.  All are fixed values that results depend on; pass others to change a deployment's language."""

# Regular expressions, case-insensitive unless they hold digits only.
URL = r"(?i)https?://\S+"
IMAGE_URL = r"(?i)https?://\S+?\.(?:jpg|jpeg|png|webp|gif)(?:\?\S*)?"
TIMESTAMP = r"\b20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2})?\b"
DATE = r"\b(?:20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]20\d{2})\b"
ROOM_ID = r"(?i)\b(?:bg|sg|cg|voice|room|channel|group)[._:-]?[a-z0-9][a-z0-9._:-]{5,}\b"
LONG_ID = r"\b\d{12,18}\b"
UID = r"\b\d{8,18}\b"
WORD = r"[\p{L}\p{N}_]+"
NO_BAN = r"(?i)\bno[\s_-]*ban\b"
BAN_REASON = r"(?i)\b(?:ban|banned|block|blocked|blacklist|unban|quick unban|insults?|personal attacks?|severe|violation|abuse|scam|fraud|punishment|kick|source|reason)\b"
USER_CLAIM = r"(?i)\b(?:i did nothing|did absolutely nothing|without reason|no reason|by mistake|mistake|unfair|wrongly|false|i don't know|dont know|do not understand|why was i|why i was|i was banned|i got blocked|not guilty|didn't do|did not do)\b"
MONEY = r"(?i)\b(?:money|withdraw|withdrawal|salary|cash|payment|pay|payout|diamonds?|beans?|recharge|top.?up|seller|dealer|reseller|host salary|income|earn)\b"
ACCOUNT = r"(?i)\b(?:account|recover|recovery|login|log in|password|phone number|uid|restore|lost|cannot access|can't access|add friends?)\b"
STATUS = r"(?i)\b(?:svip|vip|level|points?|badge|status|privilege)\b"
GROWTH = r"(?i)\b(?:channel|group|room|family|host|agency|limit|followers?|friends?|create|open channel|open group|increase limit)\b"
REPORT = r"(?i)\b(?:report|complaint|scam|fraud|abuse|insult|attack|harass|blackmail|evidence)\b"
TECH = r"(?i)\b(?:bug|error|issue|problem|not working|cannot|can't|failed|crash|version|function|screen|loading)\b"
RULES = r"(?i)\b(?:how|why|policy|rule|reason|explain|understand|what happened|new policy|allowed|forbidden)\b"
URGENCY = r"(?i)\b(?:urgent|asap|please|plz|help|immediately|now|very|again|many times|still|cannot|can't|failed)\b"
SCREEN = r"(?i)\bscreens?\b|screenshot"
FAIRNESS = r"(?i)\b(?:unban|ban|banned|block|blocked|blacklist|without reason|unfair|wrongly|appeal|reason)\b"
IDENTITY = r"(?i)\b(?:gift|prop|frame|avatar|profile|custom|name|photo|badge|skin)\b"
PLAY = r"(?i)\b(?:game|games|win|durak|play|guess|casino|bet)\b"

# Desires in the order in which the first true one is the primary desire.
DESIRES = {
    "recover_access": ACCOUNT,
    "clear_name_or_get_fairness": FAIRNESS,
    "earn_or_transact_money": MONEY,
    "grow_audience_or_community": GROWTH,
    "gain_status_or_privileges": STATUS,
    "protect_from_abuse_or_scam": REPORT,
    "fix_product_or_technical_flow": TECH,
    "understand_rules_or_system_logic": RULES,
    "customize_identity_or_assets": IDENTITY,
    "play_or_entertainment": PLAY,
}
UNCLEAR = "unclear_or_needs_llm"

# Evidence flags that are counted.
EVIDENCE = [
    "has_url", "has_image_url", "has_timestamp", "has_room_or_group_id", "has_long_uid_or_case_id",
    "has_ban_reason_language", "has_user_claim", "has_money_terms", "has_status_or_svip_terms", "has_multiline_note",
]

# Desires and flags that mean risk.
RISK_DESIRES = [
    "clear_name_or_get_fairness", "earn_or_transact_money", "protect_from_abuse_or_scam",
    "gain_status_or_privileges", "fix_product_or_technical_flow",
]
RISK_FLAGS = ["has_money_terms", "has_status_or_svip_terms", "has_ban_reason_language", "has_user_claim", "is_unresolved", "has_screenshot_evidence"]

# Statuses.
RESOLVED_EN, RESOLVED_CN = ["Closed", "Done"], "已解决"
STATUS_BUCKETS = {"resolved": ["closed", "done"], "failed": ["failed", "no action"], "open": ["in process"]}

# Codes of extracted records.
JOBS = [
    "recover_access", "prove_innocence", "restore_income", "grow_channel", "avoid_scam", "buy_or_sell_diamonds", "gain_status",
    "understand_punishment", "restore_visibility", "protect_community", "fix_product_flow", "customize_identity", "other",
]
EMOTIONS = ["neutral", "confused", "anxious", "angry", "desperate", "betrayed", "urgent", "hopeful", "unknown"]
JOB_ALIASES = {
    "investigate_fraud": "avoid_scam", "report_fraud": "avoid_scam", "fraud_report": "avoid_scam",
    "verify_ban_and_reason": "understand_punishment", "ban_verification": "understand_punishment",
    "unblock_account": "recover_access", "restore_account": "recover_access", "account_recovery": "recover_access",
}
EMOTION_ALIASES = {"stressed": "anxious"}
DESIRE_JOBS = {
    "recover_access": ["recover_access"],
    "clear_name_or_get_fairness": ["prove_innocence", "understand_punishment"],
    "earn_or_transact_money": ["buy_or_sell_diamonds", "restore_income"],
    "grow_audience_or_community": ["grow_channel", "restore_visibility"],
    "gain_status_or_privileges": ["gain_status"],
    "protect_from_abuse_or_scam": ["avoid_scam", "protect_community"],
    "fix_product_or_technical_flow": ["fix_product_flow"],
    "understand_rules_or_system_logic": ["understand_punishment"],
    "customize_identity_or_assets": ["customize_identity"],
}

# Weights of the context score: what is capped at its 95th percentile, and flags.
DEPTH_CAPPED = {"char_count": 18.0, "line_count": 10.0, "url_count": 10.0}
DEPTH_FLAGS = {
    "has_image_url": 10.0, "has_timestamp": 8.0, "has_room_or_group_id": 8.0, "has_long_uid_or_case_id": 8.0,
    "has_ban_reason_language": 10.0, "has_user_claim": 8.0, "has_money_terms": 5.0, "has_status_or_svip_terms": 5.0,
}
BANDS = [(15.0, "thin"), (35.0, "basic"), (60.0, "rich"), (None, "forensic")]
