"""The oracle's common table expressions, written out in its own dialect."""

from __future__ import annotations

from ..functions import patterns as p
from ..sources.tables import TICKETS_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def n(col: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({col}, {q(pattern)})) AS BIGINT)"


def m(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
DONE = f"(status_en IN ('Closed', 'Done') OR status_cn = {q(p.RESOLVED_CN)})"

CLEANED = f"""{TICKETS_SQL},
c0 AS (SELECT * REPLACE ({CLEAN.format('question')} AS question), coalesce(strftime(date, '%Y-%m'), '') AS month, {DONE} AS is_resolved, NOT {DONE} AS is_unresolved FROM tickets),
cleaned AS (SELECT *, {FLAT.format('question')} AS question_flat FROM c0)"""

_COUNTS = {
    "url_count": ("question", p.URL), "image_url_count": ("question", p.IMAGE_URL), "timestamp_count": ("question", p.TIMESTAMP), "date_mention_count": ("question", p.DATE),
    "room_id_count": ("question", p.ROOM_ID), "long_id_count": ("question", p.LONG_ID), "urgency_signal": ("question_flat", p.URGENCY), "word_count": ("question_flat", p.WORD),
}
_FLAGS = {"has_ban_reason_language": p.BAN_REASON, "has_user_claim": p.USER_CLAIM, "has_money_terms": p.MONEY, "has_status_or_svip_terms": p.STATUS} | {f"desire__{k}": v for k, v in p.DESIRES.items()}
ENRICHED = f"""{CLEANED},
e1 AS (SELECT *, CAST(length(question) AS BIGINT) AS char_count, CAST(len(list_filter(string_split(question, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS line_count,
  {', '.join(f'{n(*v)} AS {k}' for k, v in _COUNTS.items())} FROM cleaned),
e2 AS (SELECT *, url_count > 0 AS has_url, image_url_count > 0 AS has_image_url, timestamp_count > 0 AS has_timestamp, room_id_count > 0 AS has_room_or_group_id,
  long_id_count > 0 AS has_long_uid_or_case_id, line_count >= 3 AS has_multiline_note, image_url_count > 0 OR {m('question_flat', p.SCREEN)} AS has_screenshot_evidence,
  {', '.join(f'{m("question_flat", v)} AS {k}' for k, v in _FLAGS.items())} FROM e1),
e3 AS (SELECT *, {' + '.join(f'CAST(desire__{k} AS INT)' for k in p.DESIRES)} AS desire_count,
  CASE {' '.join(f"WHEN desire__{k} THEN '{k}'" for k in p.DESIRES)} ELSE '{p.UNCLEAR}' END AS primary_desire,
  {' + '.join(f'CAST({k} AS INT)' for k in p.EVIDENCE)} AS evidence_element_count,
  {FLAT.format(f"regexp_replace(question_flat, {q(p.URL)}, ' [URL] ', 'g')")} AS model_text FROM e2),
caps AS (SELECT {', '.join(f'greatest(quantile_cont({c}, 0.95), 1.0) AS cap_{c}' for c in p.DEPTH_CAPPED)} FROM e3),
e4 AS (SELECT e3.*, round({' + '.join(f'{w} * least(1.0, CAST({c} AS DOUBLE) / cap_{c})' for c, w in p.DEPTH_CAPPED.items())}
  + {' + '.join(f'CAST({w} AS DOUBLE) * CAST({c} AS INT)' for c, w in p.DEPTH_FLAGS.items())}, 2) AS context_depth_score FROM e3, caps),
enriched AS (SELECT *, CASE WHEN context_depth_score <= 15 THEN 'thin' WHEN context_depth_score <= 35 THEN 'basic' WHEN context_depth_score <= 60 THEN 'rich' ELSE 'forensic' END AS context_depth_band,
  primary_desire IN ({', '.join(map(q, p.RISK_DESIRES))}) OR has_money_terms OR has_status_or_svip_terms AS trust_money_flag,
  {' + '.join(f'CAST({c} AS INT)' for c in p.RISK_FLAGS)} + CAST(context_depth_score >= 24 AS INT) AS risk_signal_count FROM e4)"""
