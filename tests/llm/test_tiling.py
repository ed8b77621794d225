"""Greedy string tiling against a plain version."""

import random

import numpy as np

from skeinery.llm import tiling


def brute_tile(a, b, least):
    ma, mb, tiles = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return tiles
        ma[i : i + n] = mb[j : j + n] = [True] * n
        tiles.append((i, j, n))


def test_tiles():
    rng = random.Random(1)
    for _ in range(150):
        a = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
        b = [rng.randrange(4) for _ in range(rng.randrange(1, 40))]
        least = rng.randrange(1, 5)
        got = tiling.tile(np.array(a, np.uint64), np.array(b, np.uint64), least)
        want = brute_tile(a, b, least)
        assert sum(t[2] for t in got) == sum(t[2] for t in want)
        assert [t[2] for t in got] == [t[2] for t in want]


def test_coverage(spark):
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(5000))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(20)] + [(50, "Two, words"), (51, ""), (52, None), (53, "... !")]
    fill = lambda n: [word() for _ in range(n)]
    w3 = items[3][1].split()
    texts = {
        0: None, 1: "", 2: " ".join(fill(200)), 3: " ".join(fill(50) + w3 + fill(50)), 4: " ".join(w3[20:] + fill(9) + w3[:10] + fill(3) + w3[10:20]),
        5: items[7][1].upper().replace(" ", " ,\n"), 6: " ".join(fill(9) + w3[:14] + fill(9)), 7: " ".join(fill(9) + w3[:16] + fill(9)), 8: "x TWO words y", 9: " ".join(fill(20000) + w3), 10: "two apart words",
    }
    df = spark.createDataFrame(list(texts.items()) + [(3, texts[3])], "doc_id long, text string").selectExpr("*", "1 as coverage", "2 as item_id")
    bench = spark.createDataFrame(items + [(None, "x")], "item_id long, text string")
    rows = tiling.coverage(df, bench).collect()
    assert len(rows) == 12
    got = {r.doc_id: (r.item_id, round(r.coverage, 3), r.contaminated) for r in rows}
    assert {k for k, v in got.items() if v[2]} == {3, 4, 5, 7, 8, 9}
    assert got[3] == (3, 1.0, True) and got[4] == (3, 1.0, True) and got[6] == (3, round(14 / 30, 3), False) and got[2][1] == 0
    in_blocks = tiling.coverage(df, bench, most=200).collect()
    assert {r.doc_id: (r.item_id, round(r.coverage, 3), r.contaminated) for r in in_blocks} == got
    for most in (10**6, 200):
        assert sorted(r.doc_id for r in tiling.clean(df, bench, most=most).collect()) == [0, 1, 2, 6, 10]
    assert tiling.coverage(df.limit(0), bench).count() == 0
    assert tiling.coverage(df, bench.limit(0)).filter("contaminated").count() == 0
