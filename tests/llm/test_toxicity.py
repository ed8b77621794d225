"""Positive-unlabelled learning: held-out accuracy, the risk with its floor and gradient, and odd texts."""

import random

import numpy as np

from skeinery.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    bad = ["gnarfel", "gnarfix", "Blorpid", "zukkish"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        words = ["".join(rng.choice("aeioust") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(15, 80))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "!", "en"])
        docs.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500, 4)
    df = spark.createDataFrame(docs + [(9000, None), (9001, ""), (9002, docs[0][1]), (0, docs[0][1])], "doc_id long, text string").selectExpr("*", "1 as score", "0 as toxic")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df.repartition(5), lab)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 1504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    truth = dict(labels)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hits = np.mean([a == b for a, b in held])
    assert hits > 0.95 and np.mean([a for a, b in held if b]) > 0.9
    by = {r.doc_id: r.score for r in rows}
    assert by[9000] == by[9001] < 0.3
    kept = toxicity.reject(df, model, 0.5)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < 0.5}


def test_no_examples(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(df, toxicity.fit(df, lab)).collect()
    assert [r.predicted for r in rows] == [0, 0]
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), lab)).count() == 0


def test_long_text_counts_a_feature_once():
    model = toxicity.train([np.array([5, 9], np.uint32)] * 40, [np.array([5, 9], np.uint32)] * 10 + [np.array([7], np.uint32)] * 90, 0.1)
    # what toxic texts lack counts against
    assert 0 <= model.prior <= 1 and model.slots.tolist() == [5, 7, 9] and (np.sign(model.weights) == [1, -1, 1]).all()
    one, many = (toxicity.features(np.frombuffer(b, np.uint8), np.array([0, len(b)])) for b in (b"word", b"word " * 2000))
    table = np.zeros(1 << toxicity.BITS, np.float32)
    table[one[0][0]] = 1
    model.bias = 0.0
    a, b = (toxicity.scores(model, table, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (b"word", b"word " * 2000))
    assert a == b and len(many[0]) == 2000


def test_risk_and_its_gradient():
    rng = np.random.default_rng(3)
    docs = lambda n: [np.unique(rng.integers(0, 6, rng.integers(0, 5))).astype(np.uint32) for _ in range(n)]
    place = np.full(1 << toxicity.BITS, -1)
    place[:6] = np.arange(6)
    floors = 0
    for trial in range(60):
        pos, unl = docs(7), docs(11)
        w, b, prior = rng.normal(size=6) * 2, float(rng.normal()) - 2, rng.uniform(0.1, 0.9)
        if trial % 2:  # positives that stand far above the rest
            w[0] = 9
            pos, unl = [np.union1d(d, [0]).astype(np.uint32) for d in pos], [d[d > 0] for d in unl]
        loss = lambda x: np.log1p(np.exp(-x))

        def parts(w, b):
            fp = [b + sum(w[i] for i in d) for d in pos]
            fu = [b + sum(w[i] for i in d) for d in unl]
            minus = np.mean([loss(-f) for f in fu]) - prior * np.mean([loss(-f) for f in fp])
            return prior * np.mean([loss(f) for f in fp]), minus

        value, grad, floor = toxicity.risk(w, b, toxicity.sparse(pos, place), toxicity.sparse(unl, place), prior)
        plus, minus = parts(w, b)
        assert floor == (minus < 0) and abs(value - plus - max(0, minus)) < 1e-9
        floors += floor
        # above the floor the gradient is the risk's; at it, that of the corrected part turned round
        of = (lambda w, b: -parts(w, b)[1]) if floor else (lambda w, b: sum(parts(w, b)))
        x = np.append(w, b)
        for i in range(7):
            up, down = x.copy(), x.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert abs((of(up[:-1], up[-1]) - of(down[:-1], down[-1])) / 2e-5 - grad[i]) < 1e-4
    assert 5 < floors < 55


def test_few_positives_are_learnt_from():
    unl = [np.array([k % 50 + 100], np.uint32) for k in range(300)]
    model = toxicity.train([np.array([7, 8], np.uint32)] * 4, unl, 0.05)
    assert set(model.slots.tolist()) >= {7, 8}
    assert model.weights[np.isin(model.slots, [7, 8])].sum() > 2
