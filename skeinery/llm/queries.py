"""Driver queries of the dealt operators, with their oracle SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, factors, merkle, mixing, ngramjoin, sharding, simhash, subtrees, tiling, toxicity, urls, variants
from .common import table

#: Fixed values of the conversation that every run formats besides the table.
PLANTED_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED_CHAT, "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(rows.unionByName(planted)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS shown,
    length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS named
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown + 13 + CASE WHEN before IS NULL OR before <> role THEN 7 + named ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_pruned_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op4_simhash_vp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles and three bits are this query's contract."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, radius=3)


def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream that 95 % of the greatest entropy over sources asks for, of as many tokens as there are, at most 4 epochs."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_tokens", "exponent", "weight", F.col("epoch").cast("int").alias("epoch"), "block", F.col("place").cast("long").alias("place"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id_, source AS src, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS BIGINT) AS n_tokens
  FROM documents GROUP BY ALL
), s AS (SELECT src, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY src),
p AS (SELECT src, tokens, tokens / (SELECT sum(tokens) FROM s) AS p FROM s WHERE tokens > 0),
n AS (SELECT ln(count(*)) * 0.95 AS goal, -sum(p * ln(p)) AS plain FROM p),
he AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM p) >= (SELECT goal FROM n) AS ok FROM he WHERE i < 40)
), hr AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT max(pow(p, (lo + hi) / 2 - 1)) / sum(pow(p, (lo + hi) / 2)) FROM p) > 4.0 AS ok FROM hr WHERE i < 40)
), a AS (
  SELECT round(greatest(
    CASE WHEN (SELECT plain >= goal FROM n) THEN 1.0 ELSE (SELECT lo FROM he WHERE i = 40) END,
    CASE WHEN (SELECT max(1.0 / p) / count(*) FROM p) <= 4.0 THEN 0.0 ELSE (SELECT lo FROM hr WHERE i = 40) END), 6) AS exponent
), w AS (
  SELECT src, tokens, exponent, round(pow(p, exponent) / (SELECT sum(pow(p, exponent)) FROM p, a), 9) AS weight FROM p, a
), b AS (
  SELECT src, tokens, exponent, weight, CAST(round(weight * (SELECT sum(tokens) FROM s)) AS BIGINT) AS budget FROM w
  UNION ALL SELECT src, tokens, 1.0, 0.0, 0 FROM s WHERE tokens = 0
), plan AS (
  SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole,
    greatest(1, CAST(ceil((SELECT sum(budget) FROM b) / 1000000) AS BIGINT)) AS blocks FROM b
), x AS (
  SELECT d.*, tokens, exponent, weight, budget, whole, blocks, e AS epoch, md5(concat_ws(':', id_, e, '7')) AS key
  FROM d JOIN plan ON d.src IS NOT DISTINCT FROM plan.src, LATERAL (SELECT unnest(range(0, whole + 1)) AS e)
), y AS (
  SELECT *, epoch * tokens + sum(n_tokens) OVER (PARTITION BY src, epoch ORDER BY key, id_ ROWS UNBOUNDED PRECEDING) AS upto FROM x
), z AS (
  SELECT *, least(CAST(floor((upto - n_tokens) * blocks / greatest(budget, 1)) AS BIGINT), blocks - 1) AS block
  FROM y WHERE epoch < whole OR (upto <= budget AND n_tokens > 0)
)
SELECT id_ AS doc_id, src AS source, n_tokens, exponent, weight, CAST(epoch AS INT) AS epoch, CAST(block AS BIGINT) AS block,
  row_number() OVER (PARTITION BY block ORDER BY key, id_, epoch) - 1 AS place
FROM z
"""


def op6_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtrees.drop_repeats(table(spark, sf_dir, "documents"), 35, kept=False)


def op9_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.drop_later_copies(table(spark, sf_dir, "documents"), 100, kept=False)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.RULES, urls.GLOBS).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH r AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), t AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host LIKE 'ads.%' OR path LIKE '%/ads/%' THEN 'block' ELSE 'allow' END AS verdict
FROM t
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


#: The table of the CRC-32, and with it the CRC of a list of bytes; and the bytes of a text of code points below 2048.
CRC = r"""
crc_steps(i, k, v) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""
CRC_OF = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"
BYTES = "flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(192 + (unicode(ch) >> 6) AS BIGINT), CAST(128 + (unicode(ch) & 63) AS BIGINT)] END))"
OP11_SQL = f"""
WITH RECURSIVE {CRC.strip()}, runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, {CRC_OF.format(bytes=BYTES.format(text="id || ':' || run"))} AS h FROM counted, crc),
noisy AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON c.rest = v.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, min(near) FILTER (m = top) AS near
  FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM pairs) GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM v LEFT JOIN best USING (word)
), walk(word, goal) AS (
  SELECT word, word FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON w.goal = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, form, goal AS root, n, n_near, form_n
FROM f JOIN (SELECT w.word, w.goal FROM walk w JOIN f ON w.goal = f.word WHERE f.form IS NULL) USING (word)
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _leaf_sql(n: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c=n if c == "n_chars" else c) for c in merkle.FIELDS) + ")"


OP12_SQL = f"""
WITH RECURSIVE {CRC.strip()}, hit AS (
  SELECT *, n_chars + CASE WHEN {CRC_OF.format(bytes=BYTES.format(text="CAST(doc_id AS VARCHAR)"))} % 7 = 0 THEN 1 ELSE 0 END AS more FROM documents, crc
), leaves AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("coalesce(more, n_chars)")} AS other FROM hit
), placed AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree(lang, level, pos, h, n) AS (
  SELECT lang, 0, pos, leaf, n FROM placed
  UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n
), sub AS (
  SELECT lang, h AS subroot, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), upper(level, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM sub
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
  SELECT id, t.level, (p.pos >> t.level) & 1 AS slot, s.h FROM placed p JOIN (SELECT DISTINCT lang, level, n FROM tree) t ON p.lang IS NOT DISTINCT FROM t.lang AND t.n > 1
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = t.level AND s.pos = xor(p.pos >> t.level, 1)
  UNION ALL
  SELECT id, depth + t.level, (sub.pos >> t.level) & 1, s.h FROM placed p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang, (SELECT DISTINCT level, n FROM upper WHERE n > 1) t
    LEFT JOIN upper s ON s.level = t.level AND s.pos = xor(sub.pos >> t.level, 1)
), proofs AS (
  SELECT id, string_agg(coalesce(h, ''), '' ORDER BY level) AS proof, list(slot || coalesce(h, '') ORDER BY level) AS steps FROM steps GROUP BY id
), folded AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend(other, coalesce(steps, [])), lambda h, x: sha256(CASE WHEN x[1] = '1' THEN substr(x, 2) || h ELSE h || substr(x, 2) END)) AS folded_root
  FROM placed p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN proofs USING (id)
)
SELECT *, folded_root = root AS verified FROM folded
"""


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles and a similarity of 0.85 are this query's contract."""
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


#: Every pair of documents that share a shingle is counted.
OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w
), sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
each AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM sized UNION SELECT l.b, r.root FROM reach r JOIN linked l ON l.a = r.doc_id
)
SELECT doc_id, n AS n_shingles, component_id FROM sized JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_toxicity_nnpu": op2_toxicity_nnpu,
    "op3_pruned_graph_ann": op3_pruned_graph_ann,
    "op4_simhash_vp": op4_simhash_vp,
    "op5_temperature_mix": op5_temperature_mix,
    "op6_greedy_tiling": op6_greedy_tiling,
    "op7_minimax_shards": op7_minimax_shards,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_previous_factors": op9_previous_factors,
    "op10_url_rules": op10_url_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}
SQL = {"op1_chat_format": OP1_SQL, "op5_temperature_mix": OP5_SQL, "op10_url_rules": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_ngram_jaccard": OP13_SQL}
