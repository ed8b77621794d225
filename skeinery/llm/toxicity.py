"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over hashed words and word beginnings are trained in numpy from
confirmed toxic documents (positive) and documents whose label is not looked at
(unlabelled).  With class prior p and logistic loss l the risk is

    p E_pos[l(f)] + max(0, E_unl[l(-f)] - p E_pos[l(-f)])

whose second part can't fall below zero, where plain unbiased estimates overfit.
Each classifier sees all positives and a part of the unlabelled; their mean scores.
Training uses labelled rows up to a documented number; scoring is one pass without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, words
from .rolling import BYTE, STEP, mix, powers, prefix

#: Feature slots are 2^BITS; classifiers.
BITS, CLASSIFIERS = 20, 3
#: Labelled rows to train from, at most: confirmed toxic ones, and any (their label hidden).
POSITIVES, UNLABELLED = 4_000, 12_000
#: Bytes of a word's beginning that make a feature beside the word.
BEGINNINGS = (4, 5, 6)
SLAB = 2_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: ASCII punctuation parts words.
_FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, 1 + beginnings) feature slots, and offsets of words by text; a word too short repeats its own slot."""
    data = _FOLD[data]
    starts, ends, at = words(data, off)
    out = np.empty((len(starts), 1 + len(BEGINNINGS)), np.uint32)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP)))
        g = prefix(BYTE[data[starts[i] : ends[j - 1]]])
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        inv = powers(len(g))[1][s]
        whole = mix((g[e] - g[s]) * inv)
        out[i:j, 0] = whole >> np.uint64(64 - BITS)
        for c, n in enumerate(BEGINNINGS, 1):
            long = e - s > n
            part = mix((g[np.minimum(s + n, len(g) - 1)] - g[s]) * inv + np.uint64(n))
            out[i:j, c] = np.where(long, part, whole) >> np.uint64(64 - BITS)
        i = j
    return out, at


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLAB, side="right")) - 1)
        yield i, j
        i = j


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = buffers(b.column("text"))
        out = []
        for i, j in _pieces(off):
            f, at = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            out += [np.unique(f[at[k] : at[k + 1]]).tobytes() for k in range(j - i)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("positive"), pa.array(out, pa.binary())], names=["id", "positive", "f"])


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.slots] = self.weights
        return out


def found_in(docs: list[np.ndarray]) -> np.ndarray:
    """Documents by slot; a document has each of its slots once."""
    out = np.zeros(1 << BITS, np.int32)
    for d in docs:
        out[d] += 1
    return out


def select(pos: list[np.ndarray], unl: list[np.ndarray]) -> np.ndarray:
    """Slots that toxic documents have clearly more often than documents at large, or clearly less often.

    Only slots that are found often enough on their side count: in five documents
    (all, if there are fewer) and in one of a hundred.
    """
    a, b = found_in(pos), found_in(unl)
    p, q = (a + 0.5) / (len(pos) + 1), (b + 0.5) / (len(unl) + 1)
    z = (p - q) / np.sqrt(q / len(pos))
    least = lambda n: max(min(5, n), 0.01 * n)
    more = (a >= least(len(pos))) & (p > 4 * q) & (z > 4)
    fewer = (b >= least(len(unl))) & (q > 4 * p) & (z < -4)
    return np.flatnonzero(more | fewer)


def sparse(docs: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and columns of the features in use, and the number of documents."""
    cols = [c[c >= 0] for c in (place[d] for d in docs)]
    return np.repeat(np.arange(len(docs)), [len(c) for c in cols]), np.concatenate(cols), len(docs)


def risk(w: np.ndarray, b: float, pos: tuple, unl: tuple, prior: float) -> tuple[float, np.ndarray, bool]:
    """The non-negative risk, the gradient to go down (weights, then bias), and is the corrected part negative.

    Where it is, the risk stands at its floor; the gradient is then that of the
    corrected part turned round, which leads back above it.
    """
    (pr, pc, n_p), (ur, uc, n_u) = pos, unl
    fp = b + np.bincount(pr, w[pc], n_p)
    fu = b + np.bincount(ur, w[uc], n_u)
    sp, su = (1 / (1 + np.exp(-np.clip(f, -30, 30))) for f in (fp, fu))
    corrected = np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp))
    if corrected >= 0:
        gp, gu = prior * (sp - 1) / n_p - prior * sp / n_p, su / n_u
    else:
        gp, gu = prior * sp / n_p, -su / n_u
    grad = np.append(np.bincount(pc, gp[pr], len(w)) + np.bincount(uc, gu[ur], len(w)), gp.sum() + gu.sum())
    return prior * np.mean(np.logaddexp(0, -fp)) + max(0.0, corrected), grad, corrected < 0


def descend(pos: tuple, unl: tuple, n: int, prior: float, steps: int, rate: float, l2: float) -> tuple[np.ndarray, float]:
    """Adam on the risk."""
    x = np.append(np.zeros(n), np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        grad = risk(x[:-1], x[-1], pos, unl, prior)[1]
        grad[:-1] += l2 * x[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x[:-1], float(x[-1])


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05, l2: float = 1e-4) -> Model:
    """The mean of CLASSIFIERS linear classifiers; without positives every score is near 0."""
    if not pos or not unl:
        return Model(np.zeros(0, np.int64), np.zeros(0), -20.0, prior)
    slots = select(pos, unl)
    place = np.full(1 << BITS, -1, np.int32)
    place[slots] = np.arange(len(slots))
    toxic = sparse(pos, place)
    found = [descend(toxic, sparse(part, place), len(slots), prior, steps, rate, l2) for c in range(CLASSIFIERS) if (part := unl[c::CLASSIFIERS])]
    return Model(slots, np.mean([w for w, _ in found], axis=0), float(np.mean([b for _, b in found])), prior)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Learns from labelled rows of the training folds; see ``held_out``.

    The prior is the toxic share of those rows.  Positives are up to POSITIVES toxic
    ones; up to UNLABELLED rows of either label are the unlabelled, so the prior is
    theirs; each those of least hash of doc_id.  Rows whose toxic is null are no
    labels; a doc_id that is labelled twice is toxic if either label says so.
    """
    ids = labels.filter(~held_out(F.col(key)) & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max("toxic").alias("toxic"))
    n, k = ids.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    prior = min(max((k or 0) / max(n, 1), 1e-3), 0.5)
    first = lambda rows, most: [r[0] for r in rows.orderBy(F.xxhash64("id"), "id").select("id").limit(most).collect()]
    pos, unl = first(ids.filter("toxic = 1"), POSITIVES), first(ids, UNLABELLED)
    chosen = docs.sparkSession.createDataFrame([(i, 1) for i in pos] + [(i, 0) for i in unl], "id long, positive int")
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.select("id", "positive", "text").mapInArrow(_collect, "id long, positive int, f binary").toArrow()
    rows = rows.sort_by([("id", "ascending"), ("f", "ascending")])  # views into the table, no copies
    both = [[np.frombuffer(x.as_buffer(), np.uint32) for x in rows.filter(pc.equal(rows["positive"], c))["f"]] for c in (1, 0)]
    return train(*both, prior)


def held_out(key: Column) -> Column:
    """Not to be learnt from: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(model, table, *buffers(b.column("text"))))], names=["doc_id", "score"])

    return run


def scores(model: Model, table: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1)
    for i, j in _pieces(off):
        f, at = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
        row, col = np.nonzero(table[f])
        doc = np.searchsorted(at, row, side="right") - 1
        one = np.unique(doc.astype(np.int64) << BITS | f[row, col])  # each feature counts once in a text
        out[i:j] = np.bincount(one >> BITS, table[one & ((1 << BITS) - 1)], j - i)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row.

    Null and empty texts get the score of a text without any evidence; repeated rows
    are scored each; other columns (labels too) are neither read nor returned; with no
    toxic example every score is near 0.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """docs' rows that score below the threshold, as they are."""

    @F.arrow_udf("double")
    def toxic(t: pa.Array) -> pa.Array:
        return pa.array(scores(model, model.table(), *buffers(t)))

    return docs.filter(toxic(F.coalesce(F.col(text), F.lit(""))) < threshold)
