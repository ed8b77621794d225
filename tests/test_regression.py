"""Least squares with HC3 errors against a dense solution, with and without an absorbed factor."""

import numpy as np

from skeinery.operators import mining


def dense(rows, numeric, factors):
    """Coefficients and HC3 errors by name."""
    cols, names = [np.ones(len(rows))], ["const"]
    for c in numeric:
        cols.append(np.array([r[c] for r in rows], float))
        names.append(c)
    for c in factors:
        for v in sorted({r[c] for r in rows})[1:]:
            cols.append(np.array([r[c] == v for r in rows], float))
            names.append(f"{c}={v}")
    x, y = np.column_stack(cols), np.array([r["y"] for r in rows], float)
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ x.T @ y
    h = ((x @ inv) * x).sum(axis=1)
    e = (y - x @ b) / np.maximum(1 - h, 1e-9)
    cov = inv @ ((x * (e * e)[:, None]).T @ x) @ inv
    r2 = 1 - ((y - x @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    return {n: (c, s, r2) for n, c, s in zip(names, b, np.sqrt(np.diag(cov)), strict=True)}


def data(seed, n=600, levels=30):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a = int(levels * rng.random() ** 2)
        r = {"a": f"a{a:03}", "b": str(rng.choice(["x", "y", "z"])), "u": float(rng.normal()), "v": float(rng.random())}
        r["y"] = 2 * r["u"] - r["v"] + 0.1 * a + (r["b"] == "y") + float(rng.normal()) * (1 + r["v"])
        rows.append(r)
    return rows


def fit(spark, rows, numeric, factors):
    df = spark.createDataFrame([tuple(r[c] for c in ("y", "u", "v", "a", "b")) for r in rows], "y double, u double, v double, a string, b string").repartition(6)
    return {r.term: (r.coef, r.se, r.r2) for r in mining.ols(df, "y", numeric, factors).collect()}


def test_absorbed_equals_dense(spark, monkeypatch):
    for seed, numeric in ((1, ["u", "v"]), (2, [])):
        rows = data(seed)
        want = dense(rows, numeric, ["a", "b"])
        for most in (1_500, 10):  # with 10 the factor a is absorbed
            monkeypatch.setattr(mining, "MOST_LEVELS", most)
            got = fit(spark, rows, numeric, ["a", "b"])
            assert got.keys() == want.keys()
            assert max(abs(got[t][i] - want[t][i]) for t in want for i in range(3)) < 1e-8


def test_fifty_thousand_levels(spark):
    df = spark.range(150_000).selectExpr("concat('g', id % 50000) as g", "rand(3) as u", "if(id % 3 = 0, 'p', 'q') as k", "id % 50000 as level")
    df = df.selectExpr("3 * u + level + if(k = 'q', 0.5, 0) + 0.01 * randn(5) as y", "u", "k", "g")
    got = mining.ols(df, "y", ["u"], ["g", "k"])
    assert got.count() == 50_000 + 2
    c = {r.term: r.coef for r in got.filter("term in ('u', 'k=q', 'g=g49999', 'const')").collect()}
    assert abs(c["u"] - 3) < 0.01 and abs(c["k=q"] - 0.5) < 0.01 and abs(c["g=g49999"] - 49_999) < 0.2
