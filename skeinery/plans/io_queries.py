"""Queries that go through a file and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import sinks
from ..sources.tables import first_source, jsonl, raw_csv, table, tickets
from ..streaming import events, journeys
from .oracle import CLEANED, ENRICHED
from .registry import query
from .row_queries import cleaned, enriched

W = "WITH "


@query(f"{W}{CLEANED.split('c0 AS')[0].rstrip().rstrip(',')} SELECT source_row, question, coalesce(uid, '') AS uid, category FROM tickets".replace("SELECT source_row, question,", "SELECT source_row, replace(question, chr(13) || chr(10), chr(13) || chr(10)) AS question,"))
def a01_csv_scan(spark, d):
    path = sinks.scratch_path(spark, "csv")
    x = tickets(spark, d).select(F.col("source_row").alias(" source_row "), "question", "uid", "category", F.lit("").alias("Unnamed: 4"))
    sinks.export_csv(x, path)
    return raw_csv(spark, path)


@query(f"{W}{CLEANED} SELECT source_row, question, question_flat, is_resolved FROM cleaned")
def b07_canonical_from_csv(spark, d):
    path = sinks.scratch_path(spark, "export")
    t = tickets(spark, d)
    x = t.select(F.col("source_row").alias("#"), F.date_format("date", "dd.MM.yyyy").alias("date "), F.col("manager").alias("Manager"), F.col("uid").alias("UID"), F.col("question").alias("QUESTION"), F.col("status_en").alias("Status"), F.col("status_cn"), F.col("category").alias("分类"))
    sinks.export_csv(x, path)
    return ingest.canonical(ingest.drop_noise(raw_csv(spark, path))).select("source_row", "question", "question_flat", "is_resolved")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def a04_sql_csv_view(spark, d):
    path = sinks.scratch_path(spark, "view")
    sinks.export_csv(table(spark, d, "nation"), path)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW nation_csv USING csv OPTIONS (path '{path}', header 'true')")
    return spark.sql("SELECT n_nationkey, n_name FROM nation_csv WHERE n_regionkey = '2'")


@query("SELECT doc_id, quality FROM labels WHERE quality = 1")
def a05_priority_source(spark, d):
    root = sinks.scratch_path(spark, "runs")
    lab = table(spark, d, "labels")
    lab.select("doc_id", "quality", F.when(F.col("quality") == 1, "ok").otherwise("error").alias("_status")).write.parquet(f"{root}/second.parquet")
    return first_source(spark, [f"{root}/first.parquet", f"{root}/second.parquet"]).select("doc_id", "quality")


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS INT) AS round_ FROM labels")
def a15_jsonl_resume(spark, d):
    path, schema = sinks.scratch_path(spark, "jsonl"), "doc_id long, round_ int"
    ids = table(spark, d, "labels").select("doc_id")
    sinks.append_new(ids.filter("doc_id % 3 = 0").withColumn("round_", F.lit(1)), path, "doc_id", schema)
    sinks.append_new(ids.withColumn("round_", F.lit(2)), path, "doc_id", schema)
    return jsonl(spark, path, schema)


@query("SELECT 'nation' AS name, '{\"n_nationkey\":\"' || n_nationkey || '\",\"n_name\":\"' || n_name || '\"}' AS row FROM nation")
def a18_redacted_bundle(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", F.lit("somebody").alias("manager"))
    return sinks.bundle_rows({"nation": n})


CSVS = [(1, 'a,b'), (2, '"x, y","say ""hi"""'), (3, ',')]


@query("SELECT * FROM (VALUES (1, 'a', 'b'), (2, 'x, y', 'say \"hi\"'), (3, NULL, NULL)) v(id, a, b)")
def a22_csv_lines(spark, d):
    x = spark.createDataFrame(CSVS, "id int, line string").withColumn("s", F.from_csv("line", "a string, b string", {"escape": '"'}))
    return x.select("id", "s.a", "s.b")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def s01_windowed_counts(spark, d):
    """Extension: the batch form of the windowed stream."""
    return events.windowed(table(spark, d, "events"), "1 day")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def s02_sessions(spark, d):
    """Extension: sessions that end after six idle hours."""
    s = events.sessions(table(spark, d, "events"), "6 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("SELECT DISTINCT event_id, user_id FROM events")
def s03_stream_dedup(spark, d):
    """Extension: each event once, as a stream that remembers keys within its watermark."""
    e = table(spark, d, "events")
    stream = events.once(events.read(spark, f"{d}/events.parquet", e.schema))
    return events.drained(stream.select("event_id", "user_id"), sinks.scratch_path(spark, "dedup"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY user_id")
def s04_stream_state(spark, d):
    """Extension: a running count for each user, kept as state of a stream; its last state."""
    e = table(spark, d, "events")
    users = events.running_users(events.read(spark, f"{d}/events.parquet", e.schema))
    return events.latest(users, "user_id", "n", sinks.scratch_path(spark, "state")).select("user_id", "n", F.substring("last", 1, 10).alias("last_day"))


@query("""WITH e AS (SELECT user_id, ts, event_id, coalesce(event_type, '') AS kind FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR AS m FROM e),
g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS pause FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
j AS (SELECT *, sum(CAST(coalesce(pause >= 21600000000, true) AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr FROM g),
k AS (SELECT *, lag(kind) OVER w AS before, row_number() OVER w AS place FROM j WHERE kind <> '' WINDOW w AS (PARTITION BY user_id, nr ORDER BY ts, event_id)),
p AS (SELECT user_id, nr, string_agg(kind, ' -> ' ORDER BY r) FILTER (r <= 9) || CASE WHEN max(r) > 9 THEN ' -> ...' ELSE '' END AS path FROM (SELECT *, row_number() OVER (PARTITION BY user_id, nr ORDER BY place) AS r FROM k WHERE before IS NULL OR before <> kind) GROUP BY ALL),
s AS (SELECT user_id, nr, min(ts) AS start, max(ts) AS "end", CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT kind) AS BIGINT) AS kinds, CAST(count(*) FILTER (kind = 'error') AS BIGINT) AS errors,
  CAST(coalesce(max(CASE WHEN pause < 21600000000 THEN pause END), 0) // 1000000 AS BIGINT) AS longest_pause_s FROM j GROUP BY ALL)
SELECT user_id, start, "end", records, kinds, errors, longest_pause_s, coalesce(path, '') AS path FROM s LEFT JOIN p USING (user_id, nr), mark WHERE "end" + INTERVAL 6 HOUR <= m""")
def s05_stream_journeys(spark, d):
    """Extension: journeys that six idle hours end, kept as list, map and value state of a stream and closed by timers."""
    e = table(spark, d, "events")
    with journeys.rocks(spark):
        return events.drained(journeys.stream_journeys(events.read(spark, f"{d}/events.parquet", e.schema), 6 * 3600), sinks.scratch_path(spark, "journeys"))


@query("""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL), mark AS (SELECT max(ts) - INTERVAL 2 HOUR AS m FROM events),
x AS (SELECT event_type, day + to_days(CAST(i AS INT)) AS "end", CASE WHEN i <= 7 THEN n ELSE 0 END AS r, CASE WHEN i <= 7 THEN 0 ELSE n END AS p FROM d, range(1, 22) t(i)),
s AS (SELECT event_type, "end", CAST(sum(r) AS BIGINT) AS recent_n, CAST(sum(p) AS BIGINT) AS prior_n FROM x GROUP BY ALL)
SELECT event_type, CAST("end" AS TIMESTAMP) AS "end", recent_n, prior_n, round((recent_n / 7 + 0.5::DOUBLE) / (prior_n / 14 + 0.5::DOUBLE), 4) AS ratio FROM s, mark WHERE "end" <= m""")
def s06_stream_growth(spark, d):
    """Extension: the last 7 days against the 14 before them, day by day, as two stateful steps of one stream."""
    e = table(spark, d, "events")
    return events.drained(journeys.stream_growth(events.read(spark, f"{d}/events.parquet", e.schema), 7, 14), sinks.scratch_path(spark, "growth"))


@query(f"{W}{ENRICHED} SELECT context_depth_band, CAST(count(*) AS BIGINT) AS n FROM enriched GROUP BY 1")
def a11_parquet_sink(spark, d):
    path = sinks.scratch_path(spark, "enriched")
    enriched(spark, d).write.parquet(path)
    return spark.read.parquet(path).groupBy("context_depth_band").agg(F.count("*").alias("n"))


@query(f"{W}{CLEANED} SELECT source_row FROM cleaned WHERE status_en = 'Closed'")
def a12_sql_tables(spark, d):
    from .catalog import Run

    run = Run(spark, {"All Tickets!": cleaned(spark, d).select("source_row", "status_en")})
    return run.sql("SELECT source_row FROM all_tickets_ WHERE status_en = 'Closed'")


@query("SELECT 'nation' AS table_name, 3 AS n")
def o08_schema_browser(spark, d):
    from .catalog import Run

    return Run(spark, {"nation": table(spark, d, "nation")}).columns().groupBy("table_name").agg(F.count("*").cast("int").alias("n"))
