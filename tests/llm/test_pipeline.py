"""The corpus pipeline on a small corpus, each stage against what it must and must not take."""

import random

import corpus_pipeline


def build(spark, root):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    docs, labels, bad = [], [], ["gnarfel", "blorpid", "zukkish"]
    for i in range(500):
        w, toxic = text(rng.randrange(60, 160)), i % 8 == 0
        if toxic:
            for k in bad:
                w[rng.randrange(len(w))] = k
        docs.append([i, w, "en", "big" if i % 3 else f"s{i % 5}"])
        labels.append((i, 1, int(toxic)))
    toxic = {i for i in range(500) if i % 8 == 0}
    items = [(k, " ".join(text(40))) for k in range(5)]
    leaks = {501: items[0][1].split(), 502: items[1][1].split()[20:] + items[1][1].split()[:20]}
    for i, w in leaks.items():
        docs.append([i, text(50) + w + text(50), "en", "s1"])
    docs += [[510, docs[1][1], "fr", "s2"], [511, [*docs[2][1][:-1], "changed"], "en", "s2"], [512, text(3), "en", "s3"]]
    rows = [(i, " ".join(w), lang, s, len(" ".join(w))) for i, w, lang, s in docs] + [(513, None, "en", "s3", 0), (514, "", None, None, 0)]
    path = f"file://{root}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0] for r in rows}, toxic, set(leaks)


def test_stages(spark, tmp_path):
    path, ids, toxic, leaks = build(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "sharding":
            assert docs.columns == columns
    assert set(kept["toxicity"]) == ids - toxic
    assert kept["simhash_near_dedup"] == sorted(ids - toxic - {510, 511, 514})
    assert kept["benchmark_decontamination"] == sorted(ids - toxic - {510, 511, 514} - leaks)
    mixed = kept["source_mixing"]
    assert set(mixed) == set(kept["benchmark_decontamination"]) and max(mixed.count(i) for i in set(mixed)) <= 2
    assert kept["sharding"] == mixed


def test_run(spark, tmp_path):
    path, *_ = build(spark, tmp_path)
    out = corpus_pipeline.run(spark, path)
    assert out.columns[:2] == ["doc_id", "size"] and out.count() > 300


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, a very long text, extra columns; and nothing at all."""
    path, *_ = build(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(40)
    schema = docs.schema
    odd = [(None, None, None, None, None), (None, "x y z", "en", None, 5), (None, "x y z", "en", None, 5), (7000, "ab cd " * 200_000, "en", "s1", 1), (7000, "ab cd " * 200_000, "en", "s1", 1), (7001, " \t\n", None, "s1", None), (7002, "é" * 70_000, "fr", "s2", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, schema)).selectExpr("*", "1 AS g_", "'a' AS lead_", "2 AS row_", "3 AS score", "4 AS shard")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = table.columns
            out = stage(spark, table, path)
            out.write.mode("overwrite").parquet(f"{path}/odd-{name}-{table.isEmpty()}")
            table = spark.read.parquet(f"{path}/odd-{name}-{table.isEmpty()}")
            if name != "sharding":
                assert table.columns == columns
                kept = {r.doc_id for r in table.select("doc_id").collect()}
                assert not kept or {None, 7000, 7002} <= kept, name
    assert table.isEmpty()
