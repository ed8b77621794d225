"""Repeat removal against brute force."""

import hashlib
import random
import re

import pytest

from skeinery.llm import factors, subtrees


def brute_bytes(rows, w):
    docs = sorted(((-(2**63) if k is None else k), (t or "").encode()) for k, t in set(rows))
    seen, out = set(), {}
    for k, b in docs:
        gone = [False] * len(b)
        for i in range(len(b) - w + 1):
            s = b[i : i + w]
            if s in seen:
                gone[i : i + w] = [True] * w
            seen.add(s)
        out[k, b] = gone
    return out


def brute_words(rows, w):
    from collections import Counter

    docs = {(k, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in set(rows)}
    count = Counter(tuple(x[i : i + w]) for x in docs.values() for i in range(len(x) - w + 1))
    out = {}
    for d, x in docs.items():
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if count[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out[d] = (x, gone)
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abçé") for _ in range(rng.randrange(1, 5)))
    passages = [[word() for _ in range(rng.randrange(3, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        x = []
        for _ in range(rng.randrange(0, 6)):
            x += rng.choice(passages) if rng.random() < 0.4 else [word() for _ in range(rng.randrange(30))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(x)))
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 700), (n + 3, "a" * 300), (n + 4, "xy " * 200), (3, rows[3][1]), (None, rows[5][1]), (n + 5, rows[5][1])]
    return rows


@pytest.mark.parametrize(("w", "hot", "bucket"), [(20, 10**6, 3000), (20, 3, 3000), (9, 50, 10**6), (1, 2, 10**6)])
def test_later_copies(spark, w, hot, bucket):
    rows = corpus(w)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as db", "'x' as key").repartition(7)
    got = factors.drop_later_copies(df, w, hot=hot, bucket=bucket).collect()
    assert len(got) == len(rows)
    want = brute_bytes(rows, w)
    by_key = {}
    for (k, b), gone in want.items():
        by_key.setdefault(k, []).append((b, gone))
    for r in got:
        ((b, gone),) = by_key[-(2**63) if r.doc_id is None else r.doc_id]
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept) == (len(b), sum(gone), runs, kept)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("w", "hot", "bucket"), [(7, 10**6, 3000), (7, 3, 3000), (3, 20, 10**6)])
def test_repeated_passages(spark, w, hot, bucket):
    rows = corpus(w + 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = subtrees.drop_repeats(df, w, hot=hot, bucket=bucket).collect()
    assert len(got) == len(rows)
    want = {k: v for (k, _), v in brute_words(rows, w).items()}
    for r in got:
        x, gone = want[r.doc_id]
        kept = " ".join(a for a, g in zip(x, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept) == (len(x), sum(gone), kept)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_same_id_other_text(spark):
    rows = [(1, "abcdefghij" * 3), (1, "abcdefghij" * 2 + "x")]
    got = factors.drop_later_copies(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    assert sorted(r.n_removed for r in got) in ([0, 30], [10, 20], [20, 20])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert factors.drop_later_copies(empty).count() == 0 and subtrees.drop_repeats(empty).count() == 0


def check_bytes(spark, rows, w, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as th", "2 as own", "'x' as part").repartition(5)
    want = {}
    for (k, b), gone in brute_bytes(rows, w).items():
        want.setdefault(k, []).append((len(b), sum(gone)))
    got = {}
    for r in factors.drop_later_copies(df, w, **how).collect():
        got.setdefault(-(2**63) if r.doc_id is None else r.doc_id, set()).add((r.n_bytes, r.n_removed))
    assert got == {k: set(v) for k, v in want.items()}


def check_words(spark, rows, w, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as th", "2 as own", "'x' as n_words").repartition(5)
    want = sorted((-(2**63) if k is None else k, len(x), sum(g)) for (k, _), (x, g) in brute_words(rows, w).items())
    got = {((-(2**63) if r.doc_id is None else r.doc_id), r.n_words, r.n_removed) for r in subtrees.drop_repeats(df, w, **how).collect()}
    assert got == set(want)


def test_texts_longer_than_a_step(spark):
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = part(70_000)
    rows = [(1, part(60_000) + shared + part(9_000)), (2, shared[500:] + part(80_000)), (3, "ab" * 70_000), (4, part(300))]
    check_bytes(spark, rows, 100)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(4))
    words = lambda n: " ".join(word() for _ in range(n))
    shared = words(66_000)
    rows = [(1, words(5_000) + " " + shared), (2, shared + "\n" + words(67_000)), (3, "x " * 140_000), (4, words(40))]
    check_words(spark, rows, 35)


def test_skewed_ids_and_passages(spark):
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    common = line()
    rows = [(None if i % 3 == 0 else i if i % 3 == 1 else 7, f"{line()} {common} {line()}") for i in range(300)]
    seen = {k: t for k, t in rows}  # one text for an id, but for null and 7
    # rows that share an id stand in the order of a hash, so the check is on what all copies lose
    for hot in (10**6, 4):
        got = subtrees.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 12, hot=hot, bucket=2_000).collect()
        assert len(got) == len(rows) and all(r.n_removed == 12 for r in got)
        out = factors.drop_later_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 40, hot=hot, bucket=2_000).collect()
        assert len(out) == len(rows) and sum(r.n_removed == 0 for r in out) == 1
    assert len(seen) > 100


def test_subtrees_of_few_suffixes():
    import numpy as np

    rng = np.random.default_rng(2)
    n = rng.integers(1, 30, 200)
    size = n + 5 - 1
    words = [rng.choice([b"a", b"bb", b"c"]) for _ in range(size.sum())]
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    for most in (4, 100, 10**6):
        got = subtrees.deep_leaves(5, most)(n, data, np.arange(len(n)) << 32)
        ends = np.cumsum(size)
        windows = [tuple(words[e - s + i : e - s + i + 5]) for e, s, m in zip(ends, size, n, strict=True) for i in range(m)]
        assert got.tolist() == [windows.count(x) > 1 for x in windows]
