"""Nearest neighbours against brute force."""

import os

import numpy as np
import pytest

from skeinery.llm import ann


def brute(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v)
    out = {}
    for q in (i for i in good if i % every == 0):
        d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        out[q] = d[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[500:900] = x[500]  # one common vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [None] * 24), (5400, []), (5500, [1.0, 2.0]), (5600, [1.0, 3.0]), (None, [1.0] * 24), rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as v").repartition(6)
    got = {}
    for r in ann.neighbours(df, 10, 100, shard=700).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = brute(rows, 10, 100)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, d in want.items():
        mine = [got[q][i] for i in range(1, len(d) + 1)]
        assert mine == sorted(mine) and len(got[q]) == len(d)
        hits += len({i for _, i in mine} & {i for _, i in d})
        total += len(d)
    assert hits / total >= 0.95
    assert [i for _, i in sorted(got[500].values(), key=lambda t: t[1])] == list(range(501, 511))
    assert [i for _, i in got[5500].values()] == [5600]
    assert ann.neighbours(df.limit(0)).count() == 0


def recall(spark, rows, every=50, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.neighbours(df, 10, every, **how).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows, 10, every)
    assert got.keys() == want.keys()
    for q, d in want.items():
        assert sorted(got[q]) == list(range(1, len(d) + 1))
    return sum(len({i for i, _ in got[q].values()} & {i for _, i in d}) for q, d in want.items()) / sum(len(d) for d in want.values())


@pytest.mark.parametrize("offset", [0.0, 100.0, 1000.0])
def test_recall_off_centre(spark, offset):
    x = np.random.default_rng(8).normal(scale=0.01, size=(2500, 24)).astype(np.float32) + np.float32(offset)
    assert recall(spark, [(i, v.tolist()) for i, v in enumerate(x.astype(np.float64))], shard=900) >= 0.9


@pytest.mark.parametrize("size", [1e20, 1e38, 1e250])
def test_large_components(spark, size):
    x = np.random.default_rng(9).normal(size=(400, 8))
    x[::2] *= size
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.neighbours(df, 10, 50, shard=150).collect()
    assert len(got) == 80 and all(np.isfinite(r.score) for r in got)
    if size < 1e100:
        assert recall(spark, [(i, v.tolist()) for i, v in enumerate(x)], shard=150) >= 0.9


@pytest.mark.parametrize("far", [1e12, 1e20, 1e250])
def test_one_far_vector_costs_the_others_nothing(spark, far):
    x = np.random.default_rng(10).normal(size=(3000, 24))
    x[7] *= far
    assert recall(spark, [(i, v.tolist()) for i, v in enumerate(x)], every=100) >= 0.97


def test_two_far_clusters(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(scale=0.01, size=(3000, 24)) + np.where(np.arange(3000) % 2, 1e7, -1e7)[:, None]
    x[100] = x[102] = x[104]  # copies of a query are its nearest
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall(spark, rows, every=100) >= 0.95
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id for r in ann.neighbours(df, 2, 100).collect() if r.query_id == 100} == {102, 104}


def test_recall_on_the_table(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not here")
    rows = [(r.vec_id, [float(c) for c in r.embedding] if r.embedding is not None else None) for r in spark.read.parquet(path).collect()]
    x, ids = np.array([v for _, v in rows if v and any(v)]), np.array([i for i, v in rows if v and any(v)])
    got = {}
    for r in ann.neighbours(spark.read.parquet(path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hits, total = hits + len(best & got[q]), total + len(best)
    assert hits / total >= 0.9
