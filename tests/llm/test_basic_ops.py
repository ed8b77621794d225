"""Chat formatting, URL rules, sharding and mixing on small cases."""

import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinery.llm import chat, mixing, sharding, urls

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    hard = ["", None, "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s> [\\INST]", "[/INST][INST]", "<", "s>\\", "ü" * 5000, "a\nb"]
    rows = [(1, i, random.Random(i).choice(["user", "assistant", "[INST]", None]), t) for i, t in enumerate(hard)]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, None, "user", "first"), (None, 1, "user", "lone")]
    out = {r.conv_id: r for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    for k in (1, 2, None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert out[k].n_turns == len(own)
        assert out[k].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (out[k].loss_chars, out[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_merges_and_masks(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as pieces", "2 as formatted")
    r = chat.format_chats(df).first()
    assert r.formatted == "<s>user[INST]a[/INST][INST]b[/INST]</s><s>assistant[INST]c[/INST]</s>"
    assert [p.piece for p in r.pieces if p.loss] == ["c"]
    assert chat.digest(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://Example.COM": ("example.com", "", None, "allow"),
        "http://a.example.com/en/x?q": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "x://evil.org/a.com/": ("evil.org", "/a.com/", None, "allow"),
        "x://n.net/es/?": ("n.net", "/es/", "net/es/", "block"),
        "x://ads.q.org#/fr/": ("ads.q.org", "", None, "block"),
        "x://net/fr/" + "y" * 3000: ("net", "/fr/" + "y" * 3000, "net/fr/", "block"),
    }
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df.union(df), urls.RULES, urls.GLOBS).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(df.limit(0), urls.RULES, urls.GLOBS).count() == 0


def test_automaton_against_brute_force():
    import fnmatch

    import numpy as np

    rng = random.Random(3)
    globs = ["".join(rng.choice("ab?*") for _ in range(rng.randrange(9))) for _ in range(40)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(8))) for _ in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int16)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    hits = urls.Automaton([urls._symbols(g) for g in globs]).run(data, off)
    for (i, t), (k, g) in itertools.product(enumerate(texts), enumerate(globs)):
        assert hits[i, k] == fnmatch.fnmatchcase(t, g)


def test_minimax_is_smallest():
    rng = random.Random(5)
    for _ in range(200):
        sizes = sorted((rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))), reverse=True)
        n = rng.randrange(1, 7)
        runs = [(s, len(list(g))) for s, g in itertools.groupby(sizes)]
        capacity, cuts = sharding.minimax(runs, n)

        def need(c, sizes=sizes):
            shards, used = 1, 0
            for s in sizes:
                if s > c:
                    return math.inf
                shards, used = (shards, used + s) if used + s <= c else (shards + 1, s)
            return shards

        assert capacity == min(c for c in range(1, sum(sizes) + 1) if need(c) <= n)
        assert len(cuts) < n


def test_shards(spark):
    rng = random.Random(1)
    texts = ["copy"] * 60 + [None] * 3 + [""] * 2 + ["t" * rng.randrange(40) + str(i % 150) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "5 as shard", "1 as g")
    rows = sharding.shard(df.repartition(5), 4).collect()
    assert len(rows) == len(texts)
    by_text, load = {}, [0] * 4
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == len(t or "") + 8 and r.grown_shard is None
        assert by_text.setdefault(t or "", r.shard) == r.shard or t is None
        load[r.shard] += r.size
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert max(load) - sum(load) / 4 <= 60 * 12
    assert sharding.shard(df.limit(0), 4).count() == 0


def test_mixing_meets_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "big" if i % 3 else "s%d" % (i % 4)) for i in range(400)]
    rows += [(900, "", "empty"), (901, None, None), (902, "one two", None), (902, "three", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0 as epoch")
    out = mixing.mix(df.repartition(4), block=100).collect()
    assert max(r.epoch for r in out) <= 4
    free = mixing.mix(df, repeats=1000.0).collect()
    weights = {r.source: r.weight for r in free if r.weight}
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert entropy >= 0.95 * math.log(len(weights)) - 1e-3
    total = sum(r.n_tokens for r in out)
    assert total <= sum(len((t or "").split()) for _, t, _ in rows)
    for b in {r.block for r in out}:
        assert sorted(r.place for r in out if r.block == b) == list(range(sum(r.block == b for r in out)))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_rows_shows_all(spark):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 3 else "small") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_rows(df, entropy=None, repeats=2.0, epochs=None)
    assert out.columns == df.columns
    seen = [r.doc_id for r in out.collect()]
    assert set(seen) == set(range(90)) and max(seen.count(i) for i in range(90)) <= 2


@pytest.mark.parametrize("sent", [50_000, 0])
@pytest.mark.parametrize("how", [{"entropy": None, "repeats": 2.0, "epochs": None}, {"entropy": 0.95, "repeats": 4.0, "epochs": 1.0}, {"entropy": 0.5, "repeats": 1.5, "epochs": 2.5}])
def test_mixing_rows_are_those_drawn(spark, monkeypatch, how, sent):
    """Rows told by one cut a source are those of the walk through all units."""
    monkeypatch.setattr(mixing, "MOST_SENT", sent)
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 11)), "big" if i % 3 else "s%d" % (i % 5), None) for i in range(300)]
    rows += [(900, "", "empty", 1), (901, None, None, 2), (902, "one two", None, 3), (902, "three", None, None), rows[5], rows[5], (None, None, None, None), (903, "long " * 50_000, "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row_ int").selectExpr("*", "1 AS salt_", "2 AS times_", "'x' AS source_").repartition(5)
    got = Counter(tuple(r) for r in mixing.mix_rows(df, **how).collect())
    told = df.withColumn("id_", F.xxhash64(*df.columns, *(F.col(c).isNull() for c in df.columns)))
    units = told.groupBy("id_", F.coalesce("source", F.lit("\0")).alias("source_2")).agg(F.sum(mixing.tokens(F.col("text"))).alias("n_tokens")).withColumnRenamed("source_2", "source_")
    drawn = Counter(r.id_ for r in mixing.draw(units, **how).collect())
    want = Counter()
    for r in told.collect():
        if drawn[r.id_]:
            want[tuple(r)[:-1]] += drawn[r.id_]
    assert got == want and len(got) > 100
    if how["epochs"] is None:
        assert len(got) == len({tuple(r) for r in df.collect()})
    assert mixing.mix_rows(df.limit(0), **how).count() == 0 and mixing.mix_rows(df, **how).columns == df.columns


def test_shards_take_very_long_texts(spark):
    rows = [(i, "x" * (10 + i % 3)) for i in range(60)] + [(100, "y" * 3_000_000), (101, "y" * 3_000_000), (102, None), (None, "z"), (100, "y" * 3_000_000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS shard", "1 AS size").repartition(4), 6).collect()
    assert len(out) == len(rows) and len({r.shard for r in out if r.size > 1_000_000}) == 1
    # the group that exceeds an even share stands alone, and the other shards are near equal
    alone = next(r.shard for r in out if r.size > 1_000_000)
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert sum(r.shard == alone for r in out) == 3
    rest = [load[s] for s in range(6) if s != alone]
    assert min(rest) > 0 and max(rest) - min(rest) <= 2 * 13 * 21


def test_minimax_is_least_with_groups_of_any_size():
    rng = random.Random(4)
    for _ in range(300):
        sizes = sorted((rng.choice([1, 2, 3, 5, 8, 40]) for _ in range(rng.randrange(1, 14))), reverse=True)
        n = rng.randrange(1, 6)
        runs = sorted(Counter(sizes).items(), reverse=True)
        capacity, cuts = sharding.minimax(runs, n)

        def fits(c):
            shards, room = 1, c
            for s in sizes:
                if s > c:
                    return False
                if s > room:
                    shards, room = shards + 1, c
                room -= s
            return shards <= n

        least = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
        assert capacity == least
        # the cuts that come back keep to it
        at, seen, load = [], Counter(), Counter()
        for s in sizes:
            at.append(sum(s < c or (s == c and seen[s] >= k) for c, k in cuts))
            seen[s] += 1
            load[at[-1]] += s
        assert at == sorted(at) and max(at) < n and max(load.values()) <= least
