"""Term weights against plain counting, and what they shuffle."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from skeinery.operators import mining

TEXTS = [
    "Café latte, café noir and the café bar", "cafe latte costs more", "the bar costs less", "bar latte", "", None, "a b", "noir noir noir bar", "don't don't re-do it",
    "cafe noir costs more", "latte costs more than bar costs", "...", "more bar more latte more",
]


def by_hand(tok, least, most, features):
    """{(key, w): x} from a list of (key, w)."""
    tf = Counter(tok)
    n = len({k for k, _ in tf if k is not None})
    df, total = Counter(w for _, w in tf), Counter()
    for (_, w), c in tf.items():
        total[w] += c
    terms = sorted((w for w in df if least <= df[w] <= most * n), key=lambda w: (-total[w], w))[:features]
    x = {(k, w): c * (math.log((1 + n) / (1 + df[w])) + 1) for (k, w), c in tf.items() if w in terms}
    size = defaultdict(float)
    for (k, _), v in x.items():
        size[k] += v * v
    return {(k, w): v / math.sqrt(size[k]) for (k, w), v in x.items()}


@pytest.mark.parametrize("features", [1, 3, 5, 8, 1000])
@pytest.mark.parametrize("repeated", [False, True])
def test_weights(spark, features, repeated):
    rows = [(i % 9 if repeated else i if i != 7 else None, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    tok = [tuple(r) for r in mining.tokens(df, "id", "text", 2).collect()]
    got, terms = mining.tfidf_rows(df, "id", "text", 2, 2, 0.8, features)
    assert terms == sorted(terms)
    got = {(r.id, terms[i]): x for r in got.collect() for i, x in zip(r.i, r.x, strict=True)}
    want = by_hand(tok, 2, 0.8, features)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_texts(spark):
    rows, terms = mining.tfidf_rows(spark.createDataFrame([(1, None), (2, "")], "id long, text string"), "id", "text", 2, 1, 1.0)
    assert rows.count() == 0 and terms == []


def test_unique_keys_shuffle_no_terms(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, " ".join(f"word{w}" for w in rng.zipf(1.3, 40) % 500)) for i in range(300)], "id long, text string")
    rows, _ = mining.tfidf_rows(df, "id", "text", 2, 3, 0.82, 50)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_class_terms(spark):
    """Words and pairs as plain counting has them, for classes of few and of many terms and none."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i:03}" for i in range(60)]
    rows = [(i % 3 if i % 10 else None, " ".join(vocabulary[(w + i % 3 * 7) % 60] for w in rng.zipf(1.4, 25) % 60) + " red herring" * (i % 3 == 1)) for i in range(200)]
    rows += [(7, "one two"), (8, ""), (9, None)]
    df = spark.createDataFrame(rows, "c int, text string").repartition(3)
    tf = Counter(tuple(r) for r in mining.tokens(df, "c", "text", 2).collect())
    size, f = Counter(), Counter()
    for (c, w), k in tf.items():
        size[c] += k
        f[w] += k
    mean = sum(size.values()) / len(size)
    want = {}
    for c in size:
        x = sorted((-round(k / size[c] * math.log(1 + mean / f[w]), 8), w) for (b, w), k in tf.items() if b == c)
        want[c] = ", ".join(w for _, w in x[:10])
    out = mining.class_terms(df, "c", "text", 10)
    got = {r.c: r.representation for r in out.collect()}
    assert got == want
    assert "red herring" in got[1] and got[7] == "one, one two, two"
