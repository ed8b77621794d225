"""Regression, extraction checks, sinks, catalog, streams and the driver entry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinery.operators import extraction, mining
from skeinery.plans import catalog
from skeinery.sources import sinks
from skeinery.streaming import events


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(float(rng.normal()), "ab"[i % 2], float(rng.normal())) for i in range(30)]
    got = {r.term: r for r in mining.ols(spark.createDataFrame(rows, "x double, g string, y double").repartition(3), "y", ["x"], ["g"]).collect()}
    x = np.array([[1, r[0], r[1] == "b"] for r in rows], float)
    y = np.array([r[2] for r in rows])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    e = (y - x @ b) / (1 - h)
    se = np.sqrt(np.diag(inv @ ((x * (e * e)[:, None]).T @ x) @ inv))
    assert np.allclose([got[k].coef for k in ("const", "x", "g=b")], b) and np.allclose([got[k].se for k in ("const", "x", "g=b")], se)
    assert np.isclose(got["x"].r2, 1 - ((y - x @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_merge_centroids(spark):
    c = spark.createDataFrame([(0, 5, [1.0, 0.0]), (1, 5, [0.99, 0.1]), (2, 5, [0.0, 1.0])], "id int, n int, c array<double>")
    assert {r.id: r.parent for r in mining.merge_centroids(c, "id", 0.2).collect()} == {0: 0, 1: 0, 2: 2}


def test_cluster_counts():
    assert [mining.topic_count(n) for n in (10, 800, 10**6)] == [8, 20, 35]
    assert mining.outlier_count(100, 50) == 8 and mining.want_count(10**4) == 24


def test_parse_in_prose(spark):
    x = spark.createDataFrame([("say {\"a\": 3} ok",), ("none",)], "raw string")
    assert [r.s and r.s.a for r in x.select(extraction.parse(F.col("raw"), "a int").alias("s")).collect()] == [3, None]


def test_marked_twice_is_the_same():
    once = sinks.marked("# Head\n", "<!-- x -->", "body")
    assert sinks.marked(once, "<!-- x -->", "body") == once and once.startswith("# Head\n\n<!-- x -->\nbody")


def test_resume_and_bundle(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert sinks.append_new(a, path, "id", "id long, v string").count() == 2
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string")
    sinks.append_new(b, path, "id", "id long, v string")
    assert sorted((r.id, r.v) for r in spark.read.schema("id long, v string").json(path).collect()) == [(1, "x"), (2, "y"), (3, "w")]
    sinks.write_bundle({"t": a.withColumn("manager", F.lit("who"))}, f"file://{tmp_path}/b.js")
    text = (tmp_path / "b.js").read_text()
    assert "who" not in text and '"id": "1"' in text
    assert sinks.sheet_name("a/b" * 20) == "a_ba_ba_ba_ba_ba_ba_ba_ba_ba_ba"


def test_run_catalog(spark, tmp_path):
    run = catalog.Run(spark, {"My Table!": spark.range(3)})
    assert run.sql("SELECT count(*) AS n FROM my_table_ WHERE id > ?", [0]).first().n == 2
    run.save(f"file://{tmp_path}/run")
    assert catalog.Run.load(spark, f"file://{tmp_path}/run", ["My Table!"]).columns().count() == 1


def test_streams_equal_batches(spark, tmp_path):
    e = spark.sql("SELECT id AS event_id, id % 5 AS user_id, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 7) AS ts, if(id % 3 = 0, 'a', 'b') AS event_type FROM range(500)")
    e.write.parquet(f"{tmp_path}/in")
    for name, f, mode in (
        ("w", lambda x: events.windowed(x, "1 hour"), "complete"),
        ("o", lambda x: events.once(x).select("event_id"), "append"),
        ("s", lambda x: events.sessions(x, "10 minutes").select("user_id", "start", "n"), "complete"),
    ):
        q = f(events.read(spark, f"{tmp_path}/in", e.schema)).writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, f(e).collect()))
    q = events.running_users(events.read(spark, f"{tmp_path}/in", e.schema)).writeStream.format("memory").queryName("u").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.user_id, r.n) for r in spark.table("u").collect()) == [(i, 100) for i in range(5)]


def test_driver_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert len(names) > 150 and set(entry.oracle_sql()) <= set(names)


def test_every_ticket_is_embedded(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    got = entry.queries()["a20_hashed_embedding"](spark, d)
    assert got.select("source_row").distinct().count() == spark.read.parquet(f"{d}/orders.parquet").count()


def test_workbook(spark, tmp_path, monkeypatch):
    import zipfile

    path = f"file://{tmp_path}/book.xlsx"
    df = spark.createDataFrame([(1, "a<&>\x01é", 1.5, True), (None, None, float("nan"), None)], "n long, t string, x double, ok boolean").coalesce(1)
    names = sinks.export_workbook({"all: rows": df, "ALL? rows": df, "": df.limit(0)}, path)
    assert names == ["all_ rows", "ALL_ rows_2", "sheet"]
    header, rows = sinks.read_workbook(spark, path, names[0])
    assert header == ["n", "t", "x", "ok"] and rows == [["1", "a<&>é", "1.5", "1"], ["", "", "nan", ""]]
    assert sinks.read_workbook(spark, path, "sheet") == (header, [])
    with zipfile.ZipFile(f"{tmp_path}/book.xlsx") as z:
        assert z.testzip() is None and "[Content_Types].xml" in z.namelist()
    monkeypatch.setattr(sinks, "SHEET_ROWS", 1)
    with pytest.raises(ValueError):
        sinks.export_workbook({"x": df}, path)


def test_chart_page(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/chart.html"
    df = spark.createDataFrame([("a<b", 3), (None, None), ("c", -1)], "k string, n int").coalesce(1)
    sinks.bar_chart(df, "k", "n", path, "A & B")
    page = sinks.read_text(spark, path)
    assert page.count("<rect") == 3 and "<td>a&lt;b</td><td>3</td>" in page and "<h1>A &amp; B</h1>" in page
    monkeypatch.setattr(sinks, "MOST_BARS", 2)
    with pytest.raises(ValueError):
        sinks.bar_chart(df, "k", "n", path, "x")


def test_entry_without_the_subpackage(tmp_path):
    """The other queries are there without the corpus operators; a missing dependency isn't hidden."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/skeinery", tmp_path / "skeinery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0 and int(out.stdout.split()[0]) > 200 and out.stdout.split()[1] == "False", out.stderr
    (tmp_path / "skeinery" / "llm").mkdir()
    (tmp_path / "skeinery" / "llm" / "__init__.py").write_text("")
    (tmp_path / "skeinery" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode != 0 and "a_module_that_is_not_there" in out.stderr


def test_embedding_source(spark, tmp_path):
    from skeinery.sources import models

    assert list(models.requests(["aaaa"] * 5, batch=2)) == [(0, 2), (2, 4), (4, 5)]
    assert list(models.requests(["a" * 400, "b" * 40, "c" * 40], budget=60)) == [(0, 1), (1, 3)]
    log = tmp_path / "log"
    rows = [(1, "abc"), (2, "abc"), (3, "fail"), (4, None), (5, " "), (6, "four"), (7, "flaky")]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)

    def client(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}:{','.join(texts)}\n")
        if "fail" in texts or ("flaky" in texts and open(log).read().count("flaky") < 2):
            raise OSError("no answer")
        return [[3.0, 4.0 * len(x)] for x in texts]

    cache = f"file://{tmp_path}/cache"
    got = {r.id: r for r in models.embed(df, "id", "t", client, cache, batch=1, retries=2, wait=0.01).collect()}
    assert got[1].vector == got[2].vector == pytest.approx([3 / 153**0.5, 12 / 153**0.5])
    assert got[3].vector is None and "no answer" in got[3].error and got[4].vector is got[5].vector is None
    assert got[7].vector is not None and got[7].error is None
    lines = log.read_text().split("\n")
    assert sum("abc" in x for x in lines) == 1 and sum("fail" in x for x in lines) == 3
    log.write_text("")
    again = models.embed(df.union(spark.createDataFrame([(8, "new")], "id long, t string")), "id", "t", client, cache, batch=1, retries=0).collect()
    assert {x.split(":")[1] for x in log.read_text().split()} == {"fail", "new"} and sum(r.vector is not None for r in again) == 5


def test_stream_tables(spark, tmp_path):
    e = spark.sql("SELECT id % 300 AS event_id, id % 5 AS user_id, timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts FROM range(400)")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    (file,) = [f for f in (tmp_path / "in").iterdir() if f.name.endswith(".parquet")]
    for path in (f"{tmp_path}/in", str(file)):
        tag = "a" if path.endswith("in") else "b"
        out = events.drained(events.once(events.read(spark, path, e.schema)).select("event_id"), f"{tmp_path}/once{tag}")
        assert sorted(r.event_id for r in out.collect()) == list(range(300))
        last = events.latest(events.running_users(events.read(spark, path, e.schema)), "user_id", "n", f"{tmp_path}/last{tag}")
        assert sorted((r.user_id, r.n) for r in last.collect()) == [(i, 80) for i in range(5)]
