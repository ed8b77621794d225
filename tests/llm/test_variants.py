"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from skeinery.llm import variants


def edits(a, b):
    """Is b one insertion, deletion or replacement away from a?"""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=97):
    n = Counter()
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: sorted((-n[x], x) for x in n if edits(w, x)) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 2 * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def result(df, every=97):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in variants.variants(df, every).collect())


def test_variants(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abéßñ÷") for _ in range(rng.randrange(4, 9))) for _ in range(40)]

    def word():
        w = stems[int(len(stems) * rng.random() ** 3)]
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", "a", "é" + w[i], "B"]) + w[i + 1 :]
        return w.upper() if w.isascii() and rng.random() < 0.3 else w

    rows = [(i, rng.choice([" ", "-", "1\n", "œ"]).join(word() for _ in range(rng.randrange(120)))) for i in range(60)]
    rows += [(None, rows[3][1]), (None, None), (5, ""), (7, "aaaaab " * 5000), (7, "aaaaab " * 5000), (8, "É" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as word", "1 as n", "0 as _key").repartition(4)
    for every in (97, 3):
        want = brute(rows, every)
        assert result(df, every) == want
        assert sum(x[4] for x in want) > 200 and any(x[1] and x[2] != x[1] for x in want)


def test_pairs_come_once(spark):
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "abaaa", "aabaaa", "baaaaa", "aaaaba"]
    vocab = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in variants.near_pairs(vocab).collect())
    assert got == sorted(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i] if edits(a, b))


def test_empty(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
