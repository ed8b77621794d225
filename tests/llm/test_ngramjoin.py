"""The join by n-grams against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skeinery.llm import ngramjoin


def grams(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    """doc_id, size, component of each row."""
    sets = [grams(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                linked += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr), linked


def families(seed, many, size):
    """Texts of common passages, each with near copies of near copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["Élan", "THE", "a", "ß"]) + str(rng.randrange(400))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(many):
        base = [word() for _ in range(rng.randrange(3, size))]
        if rng.random() < 0.5:
            base[len(base) // 2 :] = passage
        for _ in range(rng.choice([1, 2, 25])):
            for _ in range(rng.randrange(3)):
                base = list(base)
                base[rng.randrange(len(base))] = word()
            texts.append(rng.choice([" ", "\t ", "\n"]).join(base))
    rng.shuffle(texts)
    return texts


def result(df, n, num, den):
    return sorted((tuple(r) for r in ngramjoin.near_duplicates(df, n, num, den).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (2, 4, 5), (1, 1, 2)])
def test_join(spark, monkeypatch, n, num, den):
    monkeypatch.setattr(ngramjoin, "LOOKUP", 500)
    monkeypatch.setattr(ngramjoin, "LEADERS", 1)  # leaves links to the last step
    texts = families(n, 25, 150) + [None, "", " \n", "One", "one two", "ONE two", "x " * 3000, "x x x x x", passage()]
    rows = list(enumerate(texts)) + [(500, texts[9]), (3, "One"), (None, texts[2]), (None, "alone here"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'g' as gram", "0 as id", "1 as size").repartition(5)
    want, linked = brute(rows, n, num, den)
    assert result(df, n, num, den) == want
    assert linked > 200


def passage():
    return " ".join(f"long{i % 9000}" for i in range(30_000))


def test_hot_ngrams_are_found_across_batches(spark, monkeypatch):
    """An n-gram that most texts hold is sent once a batch, and counted as shared everywhere."""
    monkeypatch.setattr(ngramjoin, "LOOKUP", 2000)
    rng = random.Random(8)
    line = " ".join(f"line{i}" for i in range(30))
    rows = [(i, f"{line} {' '.join(str(rng.randrange(9)) for _ in range(4))}") for i in range(300)] + [(i, f"own{i} word{i} text{i}") for i in range(300, 320)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    want, linked = brute(rows, 4, 85, 100)
    assert result(df, 4, 85, 100) == want and linked > 100


def test_the_first_part_keeps_every_similar_pair():
    """What ``promising`` asks for holds for random similar sets at the border."""
    rng = np.random.default_rng(3)
    least = ngramjoin.least_overlap
    for num, den in ((85, 100), (4, 5), (1, 2), (9, 10)):
        for _ in range(400):
            n = int(rng.integers(1, 60))
            both = rng.choice(10**6, n, replace=False)
            extra = int(n * (den - num) // num)
            one = int(rng.integers(0, extra + 1))
            fresh = rng.choice(np.arange(10**6, 2 * 10**6), extra, replace=False) - rng.integers(0, 10**6)
            fresh = np.setdiff1d(fresh, both)
            a, b = np.union1d(both, fresh[:one]), np.union1d(both, fresh[one:])
            if den * len(np.intersect1d(a, b)) < num * len(np.union1d(a, b)):
                continue
            fa, fb = (x[: int(ngramjoin.first_part(len(x), num, den))] for x in (a, b))
            shared = len(np.intersect1d(fa, fb))
            for x in (a, b):
                small = least(len(x), num, den)
                assert shared >= min(least(small, num, den), small - least(small, num, den) + 1)


def test_a_part_answers_in_lists(spark):
    """What step 1 sends back is one row for each two parts, not one for each set and part."""
    rng = np.random.default_rng(4)
    ids = np.repeat(rng.integers(-(2**62), 2**62, 300), 20)
    grams = rng.integers(0, 3000, len(ids))
    want = {int(i): len({g for g in grams[ids == i] if len(set(ids[grams == g])) > 1}) for i in set(ids)}
    got, rows = [], 0
    for part in range(4):
        o = np.flatnonzero(grams % 4 == part)
        sent = {c: pa.array([x]) for c, x in (("grams", grams[o]), ("ids", ids[o]), ("kind", np.zeros(len(o), np.int8)))}
        got.append(ngramjoin._looked_up(pa.table(sent), 4))
        rows += got[-1].num_rows
    assert rows <= 16
    got = pa.concat_tables(got)
    seen = [ngramjoin._totals(got.filter(pa.compute.equal(got["part"], p))) for p in range(4)]
    found = {i: n for t in seen for i, n in zip(t["id"].to_pylist(), t["shared"].to_pylist(), strict=True)}
    assert found == {i: n for i, n in want.items() if n} and sum(t.num_rows for t in seen) == len(found)


@pytest.mark.parametrize("lookup", [64, 1 << 21])
def test_ordered_moves_lists(spark, monkeypatch, lookup):
    """N-grams are counted and put in order without a row for each; repeated sets count once."""
    monkeypatch.setattr(ngramjoin, "LOOKUP", lookup)
    rng = random.Random(5)
    sets = {i * 7 - 900: sorted(rng.sample(range(-40, 60), rng.randrange(1, 30))) for i in range(80)}
    sets[1000] = [10**9 + i for i in range(200)]  # nobody else has these
    rows = [(i, len(g), g) for i, g in sets.items()]
    full = spark.createDataFrame(rows + rows[:30], "id long, size long, grams array<long>").repartition(6)
    found = ngramjoin.ordered(full, sum(r[1] for r in rows), 4, 5)
    assert "explode" not in found._jdf.queryExecution().toString().lower()
    often = {g: sum(g in x for x in sets.values()) for x in sets.values() for g in x}
    want = {}
    for i, x in sets.items():
        shared = sorted((often[g].bit_length(), g) for g in x if often[g] > 1)
        if shared and 5 * len(shared) >= 4 * len(x):
            want[i] = (len(x), len(x) - len(shared), shared)
    got = found.collect()
    assert {r.id: (r["size"], r.lone, [tuple(g) for g in r.grams]) for r in got} == want and len(got) == len(want) > 50


def test_missing_links_compares_leaders_first(spark, monkeypatch):
    """Texts that were left out of a large group meet a few of it, not each of it."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(60), 3):
            w[j] = f"own{i % 40}x{j}"
        texts.append(" ".join(w))
    sets = [grams(t, 1) for t in texts]
    out = range(130, 150)
    assert all(any(5 * len(sets[i] & s) >= 4 * len(sets[i] | s) for s in sets[:130]) for i in out)
    known = spark.createDataFrame([(i, 0) for i in range(130)], "node long, root long")
    compared, similar = [], ngramjoin.similar

    def counted(pairs, *more):
        compared.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(ngramjoin, "similar", counted)
    found = [tuple(r) for r in ngramjoin.missing_links(spark.createDataFrame([*enumerate(texts)], "id long, text string"), known, 1, 4, 5).collect()]
    up = [0] * 130 + [*out]
    for _ in texts:
        for i, j in found:
            up[i] = up[j] = min(up[i], up[j])
    assert set(up) == {0}
    assert 0 < sum(compared) < 20 * 130 / 2, compared


def test_empty(spark):
    assert ngramjoin.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_missing_links(spark):
    rng = random.Random(31)
    texts = [*dict.fromkeys(families(5, 24, 60)), "", " \t", "One", "one", "one  "]
    sets = [grams(t, 5) for t in texts]
    alike = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b))]
    assert len(alike) > 100

    def roots(links):
        up = list(range(len(texts)))
        for _ in texts:
            for i, j in links:
                up[i] = up[j] = min(up[i], up[j])
        return up

    rows = [*enumerate(texts), *enumerate(texts[:9])] + [(texts.index(""), None)]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 AS size", "'x' AS grams").repartition(4)
    for share in (0, 0.5, 0.95):
        kept = [p for p in alike if rng.random() < share]
        known = [(i, r) for i, r in enumerate(roots(kept)) if any(i in p for p in kept)]
        found = [tuple(r) for r in ngramjoin.missing_links(df, spark.createDataFrame(known, "node long, root long")).select("a", "b").collect()]
        assert {(max(p), min(p)) for p in found} <= set(alike)
        assert roots(known + found) == roots(alike)
    everything = spark.createDataFrame([*enumerate(roots(alike))], "node long, root long")
    left = {(max(p), min(p)) for p in ngramjoin.missing_links(df, everything).collect()}
    assert all(sets[i] == sets[j] for i, j in left)  # what is connected isn't compared
    assert ngramjoin.missing_links(df.limit(0), everything).isEmpty()
