"""SimHash fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from skeinery.llm import ngramjoin, simhash
from skeinery.llm.components import components


def brute_fingerprint(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(nodes, linked):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in nodes}


def test_near_duplicates(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["Élan", "THE", "a"]) + str(rng.randrange(50))
    texts = [None, "", " \n", "One", "one two", "É é", "x " * 3000]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.randrange(1, 8)):
            x = list(base)
            for _ in range(rng.randrange(3)):
                x[rng.randrange(len(x))] = word()
            texts.append(rng.choice([" ", "\t ", "\n"]).join(x))
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, texts[9]), (3, "One")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as fp", "0 as root").repartition(5)
    got = simhash.near_duplicates(df, 3, 3, shard=20).collect()
    assert len(got) == len(rows)
    fp = {i: brute_fingerprint(t, 3) for i, t in rows}
    ids = sorted(fp)
    want = brute_roots(ids, [(a, b) for a in ids for b in ids if (fp[a] ^ fp[b]).bit_count() <= 3])
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", want[r.doc_id])
    assert len(set(want.values())) < len(ids) - 10
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_keep_all_connections(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 60, dtype=np.int64).view(np.uint64)
    x = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 62, (20, 2))]))
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = [(r.a, r.b) for r in simhash.links(fps, 3, shard=40, sample=100).collect()]
    vals = x.view(np.int64).tolist()
    close = np.argwhere(simhash.distance(x[:, None], x[None, :]) <= 3)
    want = brute_roots(vals, [(vals[a], vals[b]) for a, b in close if a < b])
    have = brute_roots(vals, got)
    assert have == want
    assert all((a ^ b) & (2**64 - 1) for a, b in got)


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)] + [(7000, 7000)]
    want = brute_roots({x for p in links for x in p}, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != 7000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_texts(spark):
    rng = random.Random(6)
    word = lambda: "w" + str(rng.randrange(4000))
    rows, want = [], []
    for c in range(25):
        base = [word() for _ in range(rng.randrange(150, 400))]
        want.append(len(rows))
        for k in range(rng.randrange(1, 6)):
            x = list(base)
            if k:
                x[rng.randrange(len(x))] = word()
            rows.append((len(rows), rng.choice([" ", "\n"]).join(x)))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, rows[0][1]), (0, rows[0][1]), (0, " ".join(word() for _ in range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as g", "1 as lead_").repartition(5)
    for shard in (10**6, 15):
        kept = simhash.keep_first(df, shard=shard)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted([0, *want, n, n + 3])
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_similar_texts_against_brute_force(spark):
    rng = random.Random(15)
    word = lambda: "v" + str(rng.randrange(900))
    shared, texts = [word() for _ in range(60)], []
    for c in range(60):
        base = [word() for _ in range(rng.randrange(8, 160))] + shared * (c % 3 == 0)
        texts.append(" ".join(base))
        for _ in range(4):
            x = list(base)
            for _ in range(rng.randrange(1, 2 + len(x) // 25)):
                x[rng.randrange(len(x))] = word()
            texts.append(" ".join(x))
        texts.append(" ".join(base + base[-20:] * rng.randrange(4)))  # repeats count once
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= x < 0.85 for x in alike) > 10 and sum(0.7 < x < 0.8 for x in alike) > 10
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)]
    want = brute_roots(range(len(texts)), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for how in ({}, {"shard": 200, "chunk": 40}):
        got = {r.doc_id: r.lead_id for r in simhash.similar_texts(df, **how).collect()}
        # no group joins what no chain of links joins
        groups = {}
        for i, lead in got.items():
            groups.setdefault(lead, set()).add(want[i])
        assert all(len(g) == 1 for g in groups.values())
        found = [got[i] == got[j] for i, j in pairs]
        edge = [got[i] == got[j] for i, j in pairs if len(sets[i] & sets[j]) < 0.85 * len(sets[i] | sets[j])]
        assert np.mean(found) >= 0.98 and np.mean(edge) >= 0.9
        # completed, no pair stays apart; a search that finds next to nothing is completed as well
        for less in ({}, {"radius": 0}):
            got = {r.doc_id: r.lead_id for r in simhash.similar_texts(df, complete=ngramjoin.missing_links, **how, **less).collect()}
            assert got == want


def test_jaccard_and_forests():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 40))).astype(np.uint32) for _ in range(60)]
    a, b = sets[:30] + sets[:1], sets[30:] + sets[:1]
    want = [len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y))) if len(x) + len(y) else 1.0 for x, y in zip(a, b, strict=True)]
    for most in (10, 1000):
        got = simhash.jaccard(*(pa.array([x.tobytes() for x in s], pa.binary()) for s in (a, b)), most)
        assert np.allclose(got, want)
    fp = rng.integers(0, 2**63, 700, dtype=np.uint64)
    fp[100:200] = fp[100] ^ (np.uint64(1) << rng.integers(0, 60, 100).astype(np.uint64))
    size = np.full(700, 9)
    x, y = simhash.spanning(fp, size, 6, 0.8, 1)
    near = np.argwhere(simhash.distance(fp[:, None], fp[None, :]) <= 6)
    assert brute_roots(range(700), [(int(i), int(j)) for i, j in zip(x, y, strict=True)]) == brute_roots(range(700), [(int(i), int(j)) for i, j in near if i < j])
    a, b = simhash.spanning(fp, size, 6, 0.8, 2)
    assert len({*zip(a.tolist(), b.tolist(), strict=True)}) == len(a) > len(x)
    assert len(x) == 700 - len(set(brute_roots(range(700), [(int(i), int(j)) for i, j in near if i < j]).values()))
