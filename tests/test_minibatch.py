"""Mini-batch k-means against full passes, and centroids in blocks against one matrix."""

import numpy as np

from skeinery.operators import minibatch, vectors


def blobs(spark, seed=1, k=12, each=300, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, dim)) * 4
    x = centres[np.repeat(np.arange(k), each)] + rng.normal(size=(k * each, dim))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(6)


def lloyd(x, k):
    """The least inertia of several full runs."""
    best = np.inf
    for seed in range(8):
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(60):
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            c = np.array([x[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(k)])
        best = min(best, d.min(axis=1).sum())
    return best


def test_inertia_and_seed(spark, monkeypatch):
    monkeypatch.setattr(minibatch, "BATCH", 400)
    x, df = blobs(spark)
    run = lambda seed: sorted((r.id, r.cluster, round(r.far, 9)) for r in minibatch.minibatch_kmeans(df, "id", "v", 12, seed, cosine=False).collect())
    one = run(42)
    assert sum(r[2] for r in one) <= 1.05 * lloyd(x, 12)
    assert one == run(42) and len(one) == len(x)
    assert np.all(np.diff(np.bincount([r[1] for r in one])) <= 0)


def test_odd_tables(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(30, None), (31, [0.0, 2.0]), (None, [0.0, 3.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "1 as at", "2 as h", "3 as key")
    got = minibatch.minibatch_kmeans(df, "id", "v", 2).collect()
    assert len(got) == 33 and len({r.cluster for r in got if r.id in (None, 31)}) == 1
    assert minibatch.minibatch_kmeans(df.limit(0), "id", "v").count() == 0


def test_blocks_equal_one_matrix(spark, monkeypatch):
    rng = np.random.default_rng(4)
    c = rng.normal(size=(300, 6))
    c[7] = c[250] = c[100] * 3  # equal directions: the smallest id
    cents = spark.createDataFrame([(f"c{i:03}", v.tolist()) for i, v in enumerate(c)], "name string, c array<double>")
    x = [(i, v.tolist()) for i, v in enumerate(np.append(rng.normal(size=(400, 6)), c[[7, 100]], axis=0))] + [(900, None), (901, [0.0] * 6), (3, [1.0] * 6)]
    df = spark.createDataFrame(x, "id long, v array<double>").repartition(5)
    found = lambda: sorted(((r.id, r.best, None if r.score is None else round(r.score, 9), None if r.margin is None else round(r.margin, 9)) for r in vectors.nearest(df, cents, "name").collect()), key=repr)
    want = found()
    monkeypatch.setattr(vectors, "MOST_CENTROIDS", 40)
    monkeypatch.setattr(vectors, "MOST_VECTORS", 90)
    assert found() == want
    assert [r[1] for r in want if r[0] in (400, 401)] == ["c007", "c007"]


def test_fifty_thousand_centroids(spark):
    cents = spark.range(50_000).selectExpr("id as n", "array(cos(id * 0.0001), sin(id * 0.0001)) as c")
    df = spark.range(0, 50_000, 997).selectExpr("id", "array(cos(id * 0.0001), sin(id * 0.0001)) as v")
    assert all(abs(r.best - r.id) <= 1 for r in vectors.nearest(df, cents, "n").collect())
