"""Scans: Parquet tables, CSV exports, JSON lines, priority sources, vectors; and the ticket view of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All strings, null is empty, headers stripped, blank ``Unnamed`` columns dropped; one pass finds the blank ones.

    With line breaks inside fields (multi_line) a file is one task; without, large
    files are split.
    """
    df = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', inferSchema=False).na.fill("")
    df = df.toDF(*[c.strip() for c in df.columns])
    unnamed = [c for c in df.columns if c.lower().startswith("unnamed") or c.startswith("_c")]
    if unnamed:
        full = df.agg(*[F.max(F.trim(F.col(f"`{c}`")) != "").alias(str(i)) for i, c in enumerate(unnamed)]).first()
        df = df.drop(*[c for i, c in enumerate(unnamed) if not full[i]])
    return df


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't JSON of the schema are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def first_source(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first path that exists and has rows; of extraction records only those with status ok."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            continue
        df = spark.read.parquet(p) if p.endswith(".parquet") else spark.read.json(p)
        if "_status" in df.columns:
            df = df.filter(F.col("_status") == "ok")
        if not df.isEmpty():
            return df
    return None


def list_runs(spark: SparkSession, root: str, prefix: str, needs: str) -> list[str]:
    """Run folders under root that hold the needed table, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith(prefix)]
    return sorted(p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/{needs}")))


#: Invented ticket texts that the driver's tables lack.
PHRASES = [
    "I was banned without reason. https://x.io/a.png?k=1 2026-04-02 14:30 room_abcdef1 123456789012",
    "seller took my diamonds\nplease help now\nproof https://x.io/p",
    "topup failed",
    "ok",
    "lost password, cannot access account",
    "Albania album",
    "no_ban please",
    "open channel limit increase, group group-12ab34cd",
    "svip level points missing 12.04.2026",
    "scam fraud report with evidence https://y.org/shot.jpg https://y.org/log",
    "how does the new policy work?",
    "change my avatar frame and profile photo",
    "game win bonus lost",
    "app crash, screen loading error, urgent urgent asap",
    "dealer did not send 500 diamonds, 20$ paid to 87654321",
    "  spaced\t text  with   runs \r\n and lines ",
]
ISSUES = ["3_diamonds_dealer_seller", "-1_misc", "0_unban_ban_blocked", "1_account_restore", "2_channel_group_limit", "4_svip_points", "5_scam_money", "6_game_bonus"]


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw tickets: keys, days and statuses are the table's, texts are built from PHRASES by key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    phrase = lambda i: F.get(F.array(*map(F.lit, PHRASES)), (i % len(PHRASES)).cast("int"))
    return o.select(
        k.cast("string").alias("source_row"),
        F.when(k % 53 != 0, F.col("o_orderdate")).alias("date"),
        F.when(cust % 10 != 0, F.concat(F.lit("M"), (cust % 10).cast("string"))).otherwise("").alias("manager"),
        F.concat(F.lit("R"), (cust % 3).cast("string")).alias("role"),
        F.when(k % 41 != 0, (cust % 400).cast("string")).otherwise("").alias("uid"),
        F.concat(F.lit("K"), (k % 4).cast("string")).alias("question_kind"),
        F.col("o_orderpriority").alias("category"),
        t.lookup(F.col("o_orderstatus"), {"F": "Closed", "O": "In process", "P": "Failed"}).alias("status_en"),
        F.when(k % 29 == 0, "已解决").otherwise("").alias("status_cn"),
        F.concat_ws("\n", phrase(k), phrase(F.floor(k / 16)), F.when(k % 97 == 0, F.repeat(F.lit("long note "), 60))).alias("question"),
        F.when(k % 13 != 0, (cust % 8).cast("int") - 1).alias("cluster_id"),
        (k % 6).cast("int").alias("want_id"),
    )


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '") + "'"


#: The same view for the oracle.
TICKETS_SQL = f"""tickets AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS source_row, CASE WHEN o_orderkey % 53 <> 0 THEN o_orderdate END AS date,
    CASE WHEN o_custkey % 10 <> 0 THEN 'M' || (o_custkey % 10) ELSE '' END AS manager, 'R' || (o_custkey % 3) AS role,
    CASE WHEN o_orderkey % 41 <> 0 THEN CAST(o_custkey % 400 AS VARCHAR) ELSE '' END AS uid, 'K' || (o_orderkey % 4) AS question_kind,
    o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'In process' WHEN 'P' THEN 'Failed' ELSE o_orderstatus END AS status_en,
    CASE WHEN o_orderkey % 29 = 0 THEN '已解决' ELSE '' END AS status_cn,
    concat_ws(chr(10), ([{', '.join(map(_q, PHRASES))}])[o_orderkey % 16 + 1], ([{', '.join(map(_q, PHRASES))}])[(o_orderkey // 16) % 16 + 1],
      CASE WHEN o_orderkey % 97 = 0 THEN repeat('long note ', 60) END) AS question,
    CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_custkey % 8 AS INT) - 1 END AS cluster_id, CAST(o_orderkey % 6 AS INT) AS want_id
  FROM orders)"""


def inventory(spark: SparkSession, root: str, idle_s: int = 90) -> DataFrame:
    """name, extension, bytes, modified (epoch s), live: the files below a run's folder; live: written in the last ``idle_s`` seconds."""
    import time

    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows, files = [], fs.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        name, at = f.getPath().getName(), f.getModificationTime() / 1000
        rows.append((name, name.rsplit(".", 1)[-1] if "." in name else "", f.getLen(), int(at), time.time() - at < idle_s))
    return spark.createDataFrame(rows, "name string, extension string, bytes long, modified long, live boolean")


def metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of several lines as one row; what it lacks, or a broken one, is null."""
    return spark.read.schema(schema).json(path, multiLine=True)
