"""Inputs that are long in one dimension: turns of a conversation, rows under one id, blocks of a benchmark."""

import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from skeinery.llm import chat, repeats, tiling


def test_a_hundred_thousand_turns(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("say "), F.col("id").cast("string")).alias("text"))
    began = time.time()
    (got,) = chat.digest(chat.format_chats(df)).collect()
    assert time.time() - began < 60  # it took minutes when each turn copied those before
    role = lambda i: "user" if i % 3 == 0 else "assistant"
    assert got.n_turns == n
    assert got.turns_sha256 == hashlib.sha256("".join(f"{role(i)}\nsay {i}\n" for i in range(n)).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256("".join(f"say {i}" for i in range(n) if i % 3).encode()).hexdigest()


def test_many_rows_under_one_key():
    """200,000 documents whose ids are null stand under one key; each is found by its hash."""
    rng = np.random.default_rng(1)
    n = 200_000
    key, th = np.full(n, 2**63 - 1), rng.integers(0, n // 2, n)
    ask = rng.integers(0, n, 50_000)
    began = time.time()
    got = repeats.place(key, th, key[ask], th[ask])
    assert time.time() - began < 5
    first = {}
    for i, h in enumerate(th.tolist()):
        first.setdefault(h, i)
    assert got.tolist() == [first[h] for h in th[ask].tolist()]


def test_passes_over_a_large_benchmark(spark):
    """More blocks than a task holds: the same rows, pass after pass."""
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(0, 60)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in range(40)]
    docs = [(i, " ".join([*(word() for _ in range(20)), *items[i % 40][1].split()[5:28], *items[(i * 7) % 40][1].split()[:9]])) for i in range(120)] + [(500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda most: sorted(map(tuple, tiling.coverage(df, bench, most=most).collect()))
    assert rows(300) == rows(2_000_000)
    kept = lambda most: sorted(r.doc_id for r in tiling.clean(df, bench, most=most).collect())
    assert kept(300) == kept(2_000_000)
