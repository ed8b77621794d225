"""Density clusters of whole tables against a hierarchy over all pairs."""

import numpy as np
import pytest

from skeinery.operators import density


def brute(x, least, many):
    """Labels by the definition: thresholds in order, groups as sets of points, whatever meets at one distance at once."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(many, n) - 1]
    m = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    i, j = np.triu_indices(n, 1)
    w = m[i, j]
    up = list(range(n))

    def root(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    group = {k: [k] for k in range(n)}
    node = dict.fromkeys(range(n))  # of each group its branch, once it is large
    branches, fell = [], {}
    order = np.argsort(w, kind="stable")
    k = 0
    while k < len(order) and len(group) > 1:
        now, meet = w[order[k]], {}
        while k < len(order) and w[order[k]] == now:
            a, b = root(i[order[k]]), root(j[order[k]])
            if a != b:
                up[a] = b
                meet[b] = meet.pop(b, [b]) + meet.pop(a, [a])
            k += 1
        for r, parts in meet.items():
            members = [p for c in parts for p in group[c]]
            large = [node[c] for c in parts if node[c] is not None]
            if len(members) >= least:
                if len(large) == 1:
                    to = large[0]
                else:
                    to = len(branches)
                    branches.append({"low": now, "high": np.inf, "parent": -1, "members": []})
                    for c in large:
                        branches[c]["high"], branches[c]["parent"] = now, to
                for c in parts:
                    if node[c] is None:
                        fell |= {p: (to, now) for p in group[c]}
                branches[to]["members"] = members
            else:
                to = None
            for c in parts:
                del group[c], node[c]
            group[r], node[r] = members, to
    level = lambda v: 1 / max(v, 1e-12)
    total, chosen = [], []
    for c, b in enumerate(branches):
        birth = 0 if np.isinf(b["high"]) else level(b["high"])
        under = [k for k, o in enumerate(branches) if o["parent"] == c]
        stable = sum(level(t) - birth for _, (to, t) in fell.items() if to == c) + sum(len(branches[k]["members"]) * (level(b["low"]) - birth) for k in under)
        below = sum(total[k] for k in under)
        chosen.append(b["parent"] >= 0 and (not under or stable >= below))
        total.append(max(stable, below))
    labels = np.full(n, -1)
    for c in range(len(branches)):
        p = branches[c]["parent"]
        while p >= 0 and not chosen[p]:
            p = branches[p]["parent"]
        if chosen[c] and p < 0:
            labels[branches[c]["members"]] = c
    return labels


def same(a, b):
    """Equal up to names."""
    return len({*zip(a, b, strict=True)}) == len({*a}) == len({*b}) and all((x == -1) == (y == -1) for x, y in zip(a, b, strict=True))


def blobs(rng, k=3, each=60, noise=30, dim=4):
    centres = rng.normal(size=(k, dim)) * 12
    x = np.concatenate([c + rng.normal(scale=rng.uniform(0.2, 1.5), size=(each, dim)) for c in centres] + [rng.uniform(-30, 30, size=(noise, dim))])
    return x, np.append(np.repeat(np.arange(k), each), np.full(noise, -1))


def clusters(spark, x, **how):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    got = {r.id: r for r in density.density(df, "id", "v", **how).collect()}
    assert len(got) == len(x)
    return np.array([got[i].cluster for i in range(len(x))]), np.array([got[i].probability for i in range(len(x))])


@pytest.mark.parametrize(("seed", "least", "many", "block"), [(2, 15, 5, 40), (3, 5, 5, 5000)])
def test_equal_to_all_pairs(spark, seed, least, many, block):
    x, _ = blobs(np.random.default_rng(seed), k=6, each=50, noise=60)
    got, p = clusters(spark, x, least=least, neighbours=many, block=block, pivots=7)
    want = brute(x, least, many)
    assert same(got.tolist(), want.tolist()) and len({*want}) > 4
    assert ((p > 0) == (got >= 0)).all() and p.max() == 1


def test_ties_and_copies(spark):
    """A grid, where most distances are equal, and vectors that many rows share."""
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 6, size=(160, 3)) + np.repeat([[0, 0, 0], [40, 0, 0]], 80, axis=0)
    x = np.concatenate([grid, np.repeat([[100.0, 0, 0], [7.0, 90, 1]], [30, 4], axis=0)])
    got, _ = clusters(spark, x, least=10, neighbours=4, block=50, pivots=5)
    assert same(got.tolist(), brute(x, 10, 4).tolist())


def test_two_thousand_rows(spark):
    x, truth = blobs(np.random.default_rng(9), k=10, each=180, noise=200, dim=8)
    got, _ = clusters(spark, x, least=30, neighbours=10, block=400, pivots=12)
    assert same(got.tolist(), brute(x, 30, 10).tolist())
    for k in range(10):
        own = got[truth == k]
        assert (own == np.bincount(own[own >= 0]).argmax()).mean() > 0.8


def test_spanning_tree_is_least():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(2, 30))
        x, core = rng.normal(size=(n, 2)), rng.random(n)
        m = np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.maximum(core[:, None], core[None, :]))
        inside, total = {0}, 0.0
        while len(inside) < n:
            w, k = min((m[a, b], b) for a in inside for b in set(range(n)) - inside)
            total += w
            inside.add(k)
        a, b, d = density._spanning(x, core)
        assert abs(d.sum() - total) < 1e-9 and np.allclose(m[a, b], d)
        way = density._minimax(m)
        assert all(way[a, b] <= m[a, b] + 1e-12 for a in range(n) for b in range(n) if a != b)


def test_odd_tables(spark):
    rows = [(None, [1.0, 2.0]), (1, None), (1, [float("nan"), 0.0]), (2, [1.0, None])]
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "1 as cluster", "2 as w")
    assert {(r.cluster, r.probability) for r in density.density(df, "id", "v").collect()} == {(-1, 0.0)}
    assert density.density(df.limit(0), "id", "v").count() == 0
    x = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(40)], "id long, v array<double>")
    assert density.density(x, "id", "v").count() == 40


def test_fallback(spark):
    x, _ = blobs(np.random.default_rng(3), k=9, each=40, noise=20)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, v array<double>").repartition(4)
    out = density.with_fallback(df, "id", "v", 8).collect()
    assert {r.method for r in out} == {"density"} and len(out) == len(x) + 1
    few = density.with_fallback(df.filter("id < 80"), "id", "v", 8)
    assert {r.method for r in few.collect()} == {"kmeans"} and few.count() == 80


def test_blocks_are_sent_once_for_many_pairs(spark, monkeypatch):
    """All pairs of 40 blocks: what a block is sent with grows with the blocks over TOGETHER."""
    pairs = [(i, j) for i in range(40) for j in range(i, 40)]
    groups = density._groups(pairs)
    assert sorted(p for ps in groups.values() for p in ps) == pairs
    sent = sum(len({b for p in ps for b in p}) for ps in groups.values())
    assert sent == 40 * 5 < sum(1 + (i != j) for i, j in pairs) / 7


def test_edges_do_not_grow_with_the_blocks(spark, monkeypatch):
    """30 blocks of vectors without structure: what connects them is little more than a tree, and labels are those over all pairs."""
    x = np.random.default_rng(4).normal(size=(900, 8))
    seen, real = [], density.groups

    def groups(nodes, e, least):
        seen.append(e.count())
        return real(nodes, e, least)

    monkeypatch.setattr(density, "groups", groups)
    got, _ = clusters(spark, x, least=8, neighbours=4, block=30, pivots=10)
    assert same(got.tolist(), brute(x, 8, 4).tolist()) and (got >= 0).sum() > 20
    assert len(x) - 1 <= seen[0] < 1.1 * len(x)


def test_clumps_whose_near_points_are_their_own(spark):
    """Near pairs alone leave the clumps apart; each is of several basins."""
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(scale=0.3, size=(40, 3)) for c in rng.normal(size=(8, 3)) * 15])
    got, _ = clusters(spark, x, least=6, neighbours=3, block=25, pivots=6)
    assert same(got.tolist(), brute(x, 6, 3).tolist()) and got.max() > 3


@pytest.mark.parametrize(("centre", "scale"), [(0, 1), (1e7, 1), (0, 1e-12), (0, 1e40), (1e3, 1e-3)])
def test_bounds_rule_out_nothing_that_counts(centre, scale):
    rng = np.random.default_rng(2)
    x, y = (centre + scale * rng.normal(size=(n, 64)) * rng.choice([1e-4, 1, 30], size=(n, 1)) for n in (70, 90))
    low, lose, miss = density._bounds(x, y)
    r, c = np.divmod(np.arange(70 * 90), 90)
    d = density._apart(x, y, r, c).reshape(70, 90) ** 2
    assert (low <= d).all() and (d <= low + lose[:, None] + miss[None, :]).all()
    assert (d - low).max() < 1e-4 * d.max()


def test_ways_are_least_greatest_steps():
    rng = np.random.default_rng(6)
    d = np.triu(rng.integers(1, 60, size=(40, 40)).astype(float), 1)
    d += d.T
    u, v = np.triu_indices(40, 1)
    kept = density._least(u, v, d[u, v])
    assert len(kept) == 39
    ways = density.Ways(np.arange(40) * 3, u[kept] * 3, v[kept] * 3, d[u, v][kept])
    want = density._minimax(d)
    assert (ways.meet(ways.place[u], ways.place[v]) == want[u, v]).all()
    assert (ways.meet(ways.place, ways.place) == -1).all() and (ways.order[ways.place] == np.arange(40) * 3).all()


def test_few_distances_are_worked_out_one_by_one(monkeypatch):
    """Of two blocks, with copies: the distances that count are right, and most are ruled out by products."""
    rng = np.random.default_rng(7)
    blocks, x, w, many = [], rng.normal(size=(800, 32)), rng.integers(1, 4, size=800), 9
    for k in (0, 400):
        lists = density.pa.ListArray.from_arrays(np.arange(0, 400 * 32 + 1, 32, dtype=np.int32), x[k : k + 400].ravel())
        blocks.append(density._Near(density.pa.table({"id": np.arange(k, k + 400), "v": lists, "w": w[k : k + 400]}), many))
    seen, real = [], density._rows
    monkeypatch.setattr(density, "_rows", lambda a, b: seen.append(len(a)) or real(a, b))
    p, q = blocks
    for b in blocks:
        low, lose, miss = density._bounds(b.x, b.x)
        b.limit = np.partition(low, many - 1, axis=1)[:, many - 1].astype(float) + lose + miss.max()
        b.add(low, lose, miss, b)
    low, lose, miss = density._bounds(p.x, q.x)
    p.add(low, lose, miss, q)
    q.add(low, lose, miss, p, by_column=True)
    got = [r for b in blocks for r in b.table(True).to_pylist()]
    for k, r in enumerate(got):
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        o = np.argsort(d, kind="stable")
        o = o[: np.searchsorted(np.cumsum(w[o]), many) + 1]
        assert r["who"] == o.tolist() and abs(r["bound"] - d[o[-1]]) < 1e-12
    assert sum(seen) < 0.05 * 800 * 800
