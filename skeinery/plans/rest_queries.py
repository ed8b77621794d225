"""Queries on what is left: noise columns, more joins, clustering choices, model sources, exports."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import density, ingest, lookup, mining, quantiles
from ..operators import grouping as g
from ..sources import models, records, sinks
from ..sources.tables import inventory, list_runs, metadata, raw_csv, table
from . import catalog
from .group_queries import CNT, ISSUE_ROWS, LABELS
from .model_queries import GRAMS, vectors
from .oracle import CLEANED, ENRICHED
from .registry import query
from .row_queries import cleaned, enriched

W = "WITH "
TOPICS = "topics AS (SELECT source_row, CAST(source_row AS BIGINT) % 5 - 1 AS topic, 'topic_' || (CAST(source_row AS BIGINT) % 5 - 1) AS name FROM cleaned WHERE CAST(source_row AS BIGINT) % 7 <> 0)"


def topics(x):
    t = (F.col("source_row").cast("long") % 5 - 1).cast("long")
    return x.filter(F.col("source_row").cast("long") % 7 != 0).select("source_row", t.alias("topic"), F.concat(F.lit("topic_"), t.cast("string")).alias("name"))


@query(f"{W}{CLEANED} SELECT source_row, uid FROM cleaned")
def b04_drop_noise_columns(spark, d):
    x = cleaned(spark, d).select("source_row", "uid", F.col("uid").alias("Статус"), F.lit("").alias("Role\ncohort"))
    return ingest.drop_noise(x)


@query("SELECT n_name, n_nationkey % 3 <> 0 AS dated, CASE n_nationkey % 3 WHEN 1 THEN ' Date ' WHEN 2 THEN 'DATE' END AS header FROM nation")
def b03_alias_resolution(spark, d):
    """The header that an export of each nation has for the date: none, or one by another spelling."""
    out = []
    for r in table(spark, d, "nation").select("n_name", "n_nationkey").collect():  # a code table
        header = ingest.resolve([["x"], ["x", " Date "], ["DATE", "x"]][r.n_nationkey % 3], ingest.ALIASES["date_raw"])
        out.append((r.n_name, header is not None, header))
    return spark.createDataFrame(out, "n_name string, dated boolean, header string")


@query(f"{W}{CLEANED}, {TOPICS} SELECT c.source_row, coalesce(topic, cluster_id, -999) AS issue_id, coalesce(name, 'cluster_' || coalesce(cluster_id, -999)) AS issue_label FROM cleaned c LEFT JOIN topics USING (source_row)")
def f02_topic_join(spark, d):
    x = cleaned(spark, d)
    issue = F.coalesce("topic", F.col("cluster_id").cast("long"), F.lit(-999).cast("long"))
    label = F.coalesce("name", F.concat(F.lit("cluster_"), F.coalesce("cluster_id", F.lit(-999)).cast("string")))
    return x.join(topics(x), "source_row", "left").select("source_row", issue.alias("issue_id"), label.alias("issue_label"))


@query(f"{W}{CLEANED}, {TOPICS}, info(id, label) AS (VALUES {LABELS}) SELECT source_row, topic, label FROM topics LEFT JOIN info ON topic = id")
def f03_topic_info_join(spark, d):
    info = F.broadcast(spark.createDataFrame(ISSUE_ROWS, "id int, label string"))
    return topics(cleaned(spark, d)).join(info, F.col("topic") == F.col("id"), "left").select("source_row", "topic", "label")


@query(f"{W}{CLEANED}, {TOPICS}, o AS (SELECT source_row, 'sub_' || want_id AS sub FROM cleaned WHERE cluster_id = -1) SELECT c.source_row, coalesce(sub, name, '') AS label FROM cleaned c LEFT JOIN o USING (source_row) LEFT JOIN topics USING (source_row) WHERE c.status_en <> 'Closed'")
def f06_candidate_labels(spark, d):
    x = cleaned(spark, d)
    sub = x.filter("cluster_id = -1").select("source_row", F.concat(F.lit("sub_"), F.col("want_id").cast("string")).alias("sub"))
    c = x.filter("status_en <> 'Closed'").select("source_row").join(sub, "source_row", "left").join(topics(x), "source_row", "left")
    return c.select("source_row", F.coalesce("sub", "name", F.lit("")).alias("label"))


@query(f"{W}{CLEANED}, {TOPICS} SELECT t.source_row, topic, category, status_en FROM topics t LEFT JOIN cleaned c USING (source_row)")
def f14_assignment_context(spark, d):
    x = cleaned(spark, d)
    return topics(x).join(x.select("source_row", "category", "status_en"), "source_row", "left").select("source_row", "topic", "category", "status_en")


@query(f"{W}{ENRICHED}, r AS (SELECT category, question_kind, context_depth_score - avg(context_depth_score) OVER (PARTITION BY category, question_kind) AS res FROM enriched) SELECT category, question_kind, {CNT} AS n, round(max(abs(res)), 4) AS widest FROM r GROUP BY ALL")
def k03_mix_residuals(spark, d):
    mean = F.avg("context_depth_score").over(Window.partitionBy("category", "question_kind"))
    x = enriched(spark, d).select("category", "question_kind", (F.col("context_depth_score") - mean).alias("res"))
    return x.groupBy("category", "question_kind").agg(F.count("*").alias("n"), g.r4(F.max(F.abs("res"))).alias("widest"))


@query()
def k09_density(spark, d):
    """Density clusters of the whole table, with a noise class and probabilities."""
    return density.density(vectors(spark, d), "vec_id", "v")


@query()
def k11_fallback(spark, d):
    """Density clusters, or k-means where they are no use."""
    return density.with_fallback(vectors(spark, d), "vec_id", "v")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CASE WHEN avg(CAST(label = 0 AS INT)) > 0.4 OR count(DISTINCT CASE WHEN label <> 0 THEN label END) < 8 THEN 'kmeans' ELSE 'density' END AS method FROM embeddings")
def k11_fallback_choice(spark, d):
    """Label 0 plays the noise class."""
    noise = F.avg((F.col("label") == 0).cast("int"))
    found = F.countDistinct(F.when(F.col("label") != 0, F.col("label")))
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.when((noise > 0.4) | (found < 8), "kmeans").otherwise("density").alias("method"))


@query(f"{W}{CLEANED} SELECT source_row, CAST(length(question_flat) AS VARCHAR) AS output, 'ok' AS status FROM cleaned")
def a21_model_client(spark, d):
    x = cleaned(spark, d).select("source_row", "question_flat")
    return models.call(x, "source_row", "question_flat", lambda texts: [str(len(t)) for t in texts]).select("source_row", "output", "status")


class Unsteady:
    """A service that fails each second request once; ``answer`` is what it says otherwise."""

    def __init__(self, answer):
        self.answer, self.calls = answer, 0

    def __call__(self, texts):
        self.calls += 1
        if self.calls % 2:
            raise ConnectionError("try again")
        return [self.answer(t) for t in texts]


def _replied(text):
    return json.dumps({"chars": len(text)} | ({"kind": "long" if len(text) > 40 else "short"} if len(text) % 5 else {}))


@query(f"""{W}{CLEANED} SELECT source_row, CASE WHEN length(question_flat) % 5 = 0 THEN 'bad_output' ELSE 'ok' END AS status, CASE WHEN length(question_flat) % 5 = 0 THEN 'lacks kind' END AS error,
  CAST(length(question_flat) AS BIGINT) AS chars, CAST(2 AS INT) AS attempts FROM cleaned""")
def a21_checked_replies(spark, d):
    """Replies of a service that fails and is asked again, checked for their fields."""
    x = models.call(cleaned(spark, d).select("source_row", "question_flat"), "source_row", "question_flat", Unsteady(_replied), wait=0.0, fields=["chars", "kind"])
    return x.select("source_row", "status", "error", F.get_json_object("output", "$.chars").cast("long").alias("chars"), "attempts")


@query(f"""{W}{CLEANED}, s AS (SELECT source_row, trim(question_flat) AS s FROM cleaned), v AS (SELECT source_row, s, length(s) AS a, length(s) - length(replace(s, 'e', '')) AS e FROM s)
SELECT source_row, CASE WHEN s <> '' THEN round(a / sqrt(a * a + e * e + 1), 9) END AS v1, CASE WHEN s <> '' THEN round(e / sqrt(a * a + e * e + 1), 9) END AS v2, length(s) > 32000 AS cut FROM v""")
def a20_embedding_source(spark, d):
    """Vectors of a service that fails and is asked again; equal texts are sent once."""
    x = models.embed(cleaned(spark, d), "source_row", "question_flat", Unsteady(lambda t: [float(len(t)), float(t.count("e")), 1.0]), wait=0.0)
    return x.select("source_row", F.round(F.col("vector")[0], 9).alias("v1"), F.round(F.col("vector")[1], 9).alias("v2"), "cut")


@query(f"{W}{CLEANED}, {GRAMS} SELECT source_row, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY source_row)), 9) AS x FROM gb")
def a20_hashed_embedding(spark, d):
    """Texts as 384 hashed 3- to 5-grams, the stand-in for an embedding service."""
    x = mining.hashed_grams(cleaned(spark, d), "source_row", "question_flat")
    return x.select("source_row", "bucket", F.round("x", 9).alias("x"))


@query(f"{W}{CLEANED} SELECT source_row, category FROM cleaned WHERE category = '2-HIGH'")
def a19_filtered_download(spark, d):
    path = sinks.scratch_path(spark, "download")
    sinks.export_csv(cleaned(spark, d).filter("category = '2-HIGH'").select("source_row", "category"), path)
    return raw_csv(spark, path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def a14_workbook(spark, d):
    path = sinks.scratch_path(spark, "book") + ".xlsx"
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    name, _ = sinks.export_workbook({"nations: [all]": nations, "nations? [all]": nations}, path)
    header, rows = sinks.read_workbook(spark, path, name)
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in header))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def a10_csv_sink(spark, d):
    path = sinks.scratch_path(spark, "csvsink")
    sinks.export_csv(table(spark, d, "region").select("r_regionkey", "r_name"), path)
    return raw_csv(spark, path)


@query("SELECT '| r_name |' AS line UNION ALL SELECT '|---|' UNION ALL SELECT '| ' || r_name || ' |' FROM region")
def a16_markdown(spark, d):
    path = sinks.scratch_path(spark, "report") + ".md"
    text = sinks.markdown_table(table(spark, d, "region").select("r_name").orderBy("r_name"))
    for _ in range(2):  # the second time changes nothing
        sinks.write_text(spark, path, sinks.marked(sinks.read_text(spark, path), "<!-- regions -->", text))
    return spark.read.text(path).withColumnRenamed("value", "line").filter("line <> '' AND line <> '<!-- regions -->'")


@query("SELECT 'run_' || r_regionkey AS run FROM region WHERE r_regionkey % 2 = 0")
def a08_run_discovery(spark, d):
    """A folder for each region, of which every other one holds the table that makes it a run."""
    root = sinks.scratch_path(spark, "runs")
    for r in table(spark, d, "region").select("r_regionkey").collect():  # a code table
        spark.range(1).write.parquet(f"{root}/run_{r.r_regionkey}/{'other' if r.r_regionkey % 2 else 'enriched'}")
    found = list_runs(spark, root, "run_", "enriched")
    assert found == sorted(found)
    return spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in found], "run string")


@query("SELECT count(*) AS rows_, max(n_name) AS last_name, CAST(NULL AS VARCHAR) AS absent FROM nation")
def a09_json_metadata(spark, d):
    path = sinks.scratch_path(spark, "meta") + ".json"
    r = table(spark, d, "nation").agg(F.count("*").alias("n"), F.max("n_name").alias("name")).first()
    sinks.write_text(spark, path, json.dumps({"rows_": r.n, "last_name": r.name, "more": [1]}, indent=1))
    return metadata(spark, path, "rows_ long, last_name string, absent string")


def _files(spark, d):
    """A folder with a file for each nation: its name, in two formats."""
    root = sinks.scratch_path(spark, "files")
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect():  # a code table
        sinks.write_text(spark, f"{root}/n{r.n_nationkey}.{'json' if r.n_nationkey % 2 else 'csv'}", r.n_name)
    return inventory(spark, root)


@query("SELECT 'n' || n_nationkey || '.' || CASE WHEN n_nationkey % 2 = 1 THEN 'json' ELSE 'csv' END AS name, CASE WHEN n_nationkey % 2 = 1 THEN 'json' ELSE 'csv' END AS extension, CAST(length(n_name) AS BIGINT) AS bytes FROM nation")
def o11_run_inventory(spark, d):
    return _files(spark, d).filter("NOT name LIKE '.%'").select("name", "extension", "bytes")


@query("SELECT count(*) AS files, count(*) > 0 AS live FROM nation")
def o09_live_run(spark, d):
    return _files(spark, d).filter("NOT name LIKE '.%'").agg(F.count("*").alias("files"), F.max("live").alias("live"))


# -- subtotals, exact quantiles, lookups, records, lasting tables --------------

def _subtotals():
    return [F.count("*").alias("tickets"), F.countDistinct(F.nullif(F.col("uid"), F.lit(""))).alias("unique_users"), F.count_if("is_unresolved").alias("unresolved")]


_SUBTOTALS_SQL = f"{CNT} AS tickets, CAST(count(DISTINCT nullif(uid, '')) AS BIGINT) AS unique_users, CAST(count(*) FILTER (is_unresolved) AS BIGINT) AS unresolved"


@query(f"{W}{CLEANED} SELECT manager, month, want_id, CAST(grouping(manager, month, want_id) AS BIGINT) AS grouping_id, {_SUBTOTALS_SQL} FROM cleaned GROUP BY CUBE (manager, month, want_id)")
def g33_cube(spark, d):
    return g.cube(cleaned(spark, d), ["manager", "month", "want_id"], _subtotals())


@query(f"{W}{CLEANED} SELECT category, question_kind, status_en, CAST(grouping(category, question_kind, status_en) AS BIGINT) AS grouping_id, {_SUBTOTALS_SQL} FROM cleaned GROUP BY ROLLUP (category, question_kind, status_en)")
def g33_rollup(spark, d):
    return g.rollup(cleaned(spark, d), ["category", "question_kind", "status_en"], _subtotals())


@query(f"{W}{CLEANED} SELECT manager, month, want_id, CAST(grouping(manager, month, want_id) AS BIGINT) AS grouping_id, {_SUBTOTALS_SQL} FROM cleaned GROUP BY GROUPING SETS ((manager, month), (want_id), ())")
def g33_grouping_sets(spark, d):
    return g.grouping_sets(cleaned(spark, d), [["manager", "month"], ["want_id"], []], _subtotals())


_PRICES = {"l_extendedprice": [0.05, 0.5, 0.95], "l_quantity": [0.25, 0.75], "l_discount": [0.9]}


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, CAST({s} AS DOUBLE) AS share, round(quantile_cont(CAST({c} AS DOUBLE), {s}), 6) AS value FROM lineitem" for c, ss in _PRICES.items() for s in ss))
def g25_exact_quantiles(spark, d):
    """Quantiles of many different values, by histograms that close in on them."""
    found = quantiles.quantiles(table(spark, d, "lineitem"), _PRICES)
    return spark.createDataFrame([(c, s, None if v is None else round(v, 6)) for (c, s), v in found.items()], "name string, share double, value double")


_NEEDLES = ["Diamonds", "x.io/a", "ss", "no such words"]


@query(f"{W}{CLEANED}, n(needle) AS (VALUES {', '.join(f'({n!r})' for n in _NEEDLES)}) SELECT needle, source_row FROM cleaned, n WHERE contains(lower(question), lower(needle))")
def c16_indexed_search(spark, d):
    """Texts that contain a needle, by an index of their three-letter pieces."""
    x = lookup.Index.build(cleaned(spark, d), "source_row", "question", sinks.scratch_path(spark, "pieces"))
    found = [x.contains(n).select(F.lit(n).alias("needle"), F.col("key").alias("source_row")) for n in _NEEDLES]
    return reduce(lambda a, b: a.unionByName(b), found)


@query(f"{W}{CLEANED} SELECT source_row, uid FROM cleaned WHERE contains(uid, '120')")
def o04_partial_uid_lookup(spark, d):
    x = lookup.Index.build(cleaned(spark, d), "source_row", "uid", sinks.scratch_path(spark, "uids"))
    return x.contains("120").select(F.col("key").alias("source_row"), F.col("text").alias("uid"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def a15_committed_records(spark, d):
    """Orders written as records, copied by a stream that is started twice, and read back."""
    records.register(spark)
    path, schema = sinks.scratch_path(spark, "records"), "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders.write.format("records").mode("append").save(f"{path}/in")
    for _ in range(2):
        stream = spark.readStream.format("records").schema(schema).load(f"{path}/in")
        stream.writeStream.format("records").option("path", f"{path}/out").option("name", "copy").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.format("records").schema(schema).load(f"{path}/out")


@query(f"{W}{CLEANED} SELECT category, month, CAST(count(*) AS BIGINT) AS n FROM cleaned WHERE category <> '' GROUP BY ALL")
def a13_lasting_views(spark, d):
    """A table and a view that one session stores and another reads."""
    path, name = sinks.scratch_path(spark, "store"), f"skeinery_{uuid.uuid4().hex[:12]}"
    store = catalog.Store(spark.newSession(), path, name)
    store.table("tickets", cleaned(spark, d).select("source_row", "category", "month"))
    store.view("by month", "SELECT category, month, count(*) AS n FROM tickets WHERE category <> '' GROUP BY category, month")
    return spark.table(f"{name}.by_month")
