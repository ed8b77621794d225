"""Merkle manifests against trees built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from skeinery.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [v + more if c == "n_chars" and v is not None else v for c, v in zip(merkle.FIELDS, row, strict=True)]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def others(tree, i):
    """Side and hash of each sibling on the way up."""
    for level in tree[:-1]:
        yield i % 2, level[i ^ 1] if i ^ 1 < len(level) else ""
        i //= 2


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for k in names:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = levels([leaf(r) for r in groups[k]])
    top = levels([trees[k][-1][0] for k in names])
    for q, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            proof = [*others(trees[k], i), *others(top, q)]
            h = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for right, x in proof:
                h = sha(x, h) if right else sha(h, x)
            yield r[0], leaf(r), trees[k][-1][0], top[-1][0], sha(*[x for _, x in proof]), h, h == top[-1][0]


def rows(n):
    langs = [None, "", "é", "z", "en", "en", "en", "en", "de"]
    texts = [None, "", "É ß", "x " * 40_000, "a"]
    out = [(i, f"s{i % 3}" if i % 4 else None, langs[i % len(langs)], i if i % 5 else None, texts[i % len(texts)]) for i in range(n)]
    return out + [out[3]] * 7 + [(None, None, None, None, None)] * 2 + [(n, "", "alone", 2**63 - 1, "one"), (4, "s", "en", 1, "another text under an id")]


@pytest.mark.parametrize(("n", "bits"), [(0, 10), (4, 2), (150, 2), (150, 10), (40, 1)])
def test_manifest(spark, n, bits):
    x = rows(n) if n else [(5, None, None, None, None)]
    df = spark.createDataFrame(x, SCHEMA).selectExpr("*", "'x' as leaf", "1 as pos", "2 as key").repartition(3)
    got = sorted(map(repr, map(tuple, merkle.audit(df, bits).collect())))
    assert got == sorted(map(repr, brute(x)))


def test_empty(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_numbers_go_on_across_partitions(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "if(id < 400, 7, id) as v").repartition(9)
    got = merkle.numbered(df, "k", "v").collect()
    for k in range(3):
        own = sorted((r.pos, r.v) for r in got if r.k == k)
        assert [p for p, _ in own] == list(range(len(own)))
        assert [v for _, v in own] == sorted(v for _, v in own)
        assert {r.n for r in got if r.k == k} == {len(own)}


def test_a_proof_folds_to_the_root_and_another_leaf_does_not(spark):
    x = rows(60)
    leaves = spark.createDataFrame(x, SCHEMA).select("doc_id", "lang", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf"))
    proved = merkle.prove(leaves, "lang", "doc_id", 3)
    out = proved.select("root", merkle.fold(F.col("leaf"), F.col("path"), F.col("spot")).alias("own"), merkle.fold(F.sha2("leaf", 256), F.col("path"), F.col("spot")).alias("wrong"))
    assert all(r.own == r.root != r.wrong for r in out.collect())
