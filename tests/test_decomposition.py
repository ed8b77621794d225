"""Sparse decomposition against a dense one."""

import numpy as np

from skeinery.operators import decomposition


def weights(spark, x):
    rows = [(int(i), f"t{j:04}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "id long, w string, x double").repartition(5)


def sparse(rng, n, m, share=0.08):
    return rng.random((n, m)) * (rng.random((n, m)) < share)


def test_values_and_vectors(spark):
    x = sparse(np.random.default_rng(1), 400, 700)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    coords, values = decomposition.decompose(weights(spark, x), "id", 20)
    want = np.linalg.svd(x, compute_uv=False)[:20]
    got = [r.value for r in values.orderBy("component").collect()]
    assert np.allclose(got, want, rtol=1e-6)
    v = {r.id: np.array(r.v) for r in coords.collect()}
    assert len(v) == (x.sum(axis=1) > 0).sum() and all(abs(np.linalg.norm(c) - 1) < 1e-9 for c in v.values())
    # rows keep the angles that they have in the space of the first components
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    z = x @ vt[:20].T
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    ids = sorted(v)[:50]
    a = np.array([v[i] for i in ids])
    assert np.allclose(a @ a.T, z[ids] @ z[ids].T, atol=1e-4)


def test_low_rank_and_small(spark):
    rng = np.random.default_rng(2)
    x = sparse(rng, 60, 4, 0.6) @ np.abs(rng.normal(size=(4, 30)))
    _, values = decomposition.decompose(weights(spark, x), "id", 10)
    got = [r.value for r in values.orderBy("component").collect()]
    assert np.allclose(got, np.linalg.svd(x, compute_uv=False)[: len(got)], atol=1e-6 * got[0])
    one, values = decomposition.decompose(weights(spark, np.array([[1.0, 2.0, 0.0]])), "id")
    assert [tuple(np.round(np.abs(r.v), 6)) for r in one.collect()] == [(1.0,)] and values.count() == 1
    none, values = decomposition.decompose(weights(spark, x).limit(0), "id")
    assert none.count() == 0 and values.count() == 0


def test_sums_of_a_pass_do_not_grow_with_the_files(spark):
    x = sparse(np.random.default_rng(3), 90, 40)
    rows, terms = decomposition.sparse_rows(weights(spark, x), "id")
    q = np.random.default_rng(4).normal(size=(len(terms), 5))
    many = rows.repartition(60)
    assert decomposition._tasks(many).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    x = x[:, (x > 0).any(axis=0)]
    assert np.allclose(decomposition.gram_times(many, q), x.T @ (x @ q))
