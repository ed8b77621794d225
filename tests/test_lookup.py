"""Exact quantiles, indexed lookups, lasting tables and views, subtotals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinery.operators import grouping, lookup, quantiles
from skeinery.plans import catalog


@pytest.mark.parametrize("few", [2, 1_024])
def test_quantiles_equal_percentile(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(1)
    cols = {
        "even": rng.random(3000), "skew": np.exp(rng.normal(size=3000) * 20), "few": rng.integers(0, 4, 3000).astype(float), "one": np.full(3000, 2.5),
        "far": np.append(rng.normal(size=2998), [1e300, -1e300]),
    }
    rows = [tuple(float(v[i]) for v in cols.values()) for i in range(3000)] + [(None,) * 5, (float("nan"),) * 5]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0]
    got = quantiles.quantiles(df, dict.fromkeys(cols, shares))
    for c, v in cols.items():
        for s in shares:
            want = float(np.quantile(v, s))
            assert abs(got[c, s] - want) <= 1e-9 * max(1, abs(want)), (c, s)
    none = quantiles.quantiles(df.filter("even is null"), {"even": [0.5], "few": [0.1, 0.9]})
    assert set(none.values()) == {None}


def test_index_equals_scan(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abÉ ß1"), rng.integers(0, 40))) for _ in range(500)] + [None, "", "ab", "x" * 5000 + "needle" + "y" * 5000]
    rows = list(enumerate(texts)) + [(None, "ab needle"), (3, "another text needle")]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 as key", "2 as piece").repartition(4)
    index = lookup.Index.build(df, "id", "text", f"{tmp_path}/index")
    for needle in ("needle", "NEEDLE", "ab", "éß", "a b", "", "zzz", "ab1", "1ßa"):
        want = sorted(i for i, t in rows if i is not None and needle.lower() in (t or "").lower())
        assert sorted(r.key for r in index.contains(needle).collect()) == want, needle
    again = lookup.Index(spark, f"{tmp_path}/index", "bigint")
    assert again.candidates("needle").count() == 2 and again.candidates("ab") is None


def test_tables_and_views_last(spark, tmp_path):
    store = catalog.Store(spark.newSession(), f"file://{tmp_path}/s", "lasting one")
    store.table("t", spark.range(5))
    store.view("big ids", "SELECT id FROM t WHERE id > 2")
    assert spark.table("lasting_one.big_ids").count() == 2  # another session
    store.table("t", spark.range(9))  # a new version, which the view reads
    assert spark.table("lasting_one.big_ids").count() == 6
    store.drop()
    assert not spark.catalog.databaseExists("lasting_one")
    catalog.Store(spark, f"file://{tmp_path}/s", "opened_again")  # as another application does
    assert spark.table("opened_again.big_ids").count() == 6 and spark.catalog.currentDatabase() == "default"
    spark.sql("DROP DATABASE opened_again CASCADE")


def test_totals_and_null_groups_are_told_apart(spark):
    df = spark.createDataFrame([("a", 1, 2), (None, 1, 3), ("a", None, 5)], "x string, y int, v int")
    got = {(r.x, r.y, r.grouping_id): r.s for r in grouping.cube(df, ["x", "y"], [F.sum("v").alias("s")]).collect()}
    assert got[None, None, 3] == 10 and got[None, None, 1] == 3 and got["a", None, 0] == 5 and got["a", None, 1] == 7
    assert len(grouping.rollup(df, ["x", "y"], [F.sum("v").alias("s")]).collect()) == 3 + 2 + 1


def test_equal_texts_have_one_posting(spark, tmp_path):
    """Postings grow with the different texts, not with the rows; all rows are found."""
    df = spark.range(2000).selectExpr("id", "concat('ticket of kind ', id % 4, ' lost') AS text").repartition(3)
    index = lookup.Index.build(df, "id", "text", f"{tmp_path}/index")
    assert index.postings.count() == 4 * len({f"ticket of kind {0} lost"[i : i + 3] for i in range(19)})
    assert sorted(r.key for r in index.contains("KIND 2").collect()) == list(range(2, 2000, 4))
