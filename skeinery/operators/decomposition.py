"""Singular vectors of sparse rows, such as tf-idf weights, by a block Krylov space.

The matrix stays in the table.  A pass sends a narrow block to the tasks, each task
multiplies its rows with it and back, and sums by slice of the vocabulary come
together in as many groups.  What the driver holds has the size of the vocabulary
times the width of the space, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored

#: Fixed value: components that the survey's decomposition keeps, at most.
COMPONENTS = 80
#: Columns beyond the components that a block has; terms whose sums meet in one group; entries multiplied at a time.
EXTRA, SLICE, ENTRIES = 16, 512, 1 << 15
#: Columns of the vocabulary, at most: the space is dense on the driver.
MOST_TERMS = 50_000


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and value of every entry of a batch."""
    terms, values = b.column("i"), b.column("x")
    row = np.repeat(np.arange(b.num_rows), np.diff(terms.offsets.to_numpy()))
    return row, terms.flatten().to_numpy(), values.flatten().to_numpy()


def _times(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """The n rows times q; entries go by row."""
    out = np.zeros((n, q.shape[1]))
    for at in range(0, len(row), ENTRIES):
        r = row[at : at + ENTRIES]
        heads = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[heads]] += np.add.reduceat(q[term[at : at + ENTRIES]] * value[at : at + ENTRIES, None], heads, axis=0)
    return out


def sparse_rows(weights: DataFrame, key: str, term: str = "w", value: str = "x") -> tuple[DataFrame, list]:
    """Rows (key, i, x: places in the vocabulary ascending, and values) and the vocabulary in order; more than MOST_TERMS are refused."""
    terms = [r[0] for r in weights.select(term).distinct().orderBy(term).limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms")
    spark = weights.sparkSession
    places = spark.createDataFrame(list(zip(terms, range(len(terms)), strict=True)), f"{term} string, i_ int") if terms else spark.createDataFrame([], f"{term} string, i_ int")
    x = weights.join(F.broadcast(places), term).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("i_").alias("i"), F.col(value).cast("double").alias("x")))).alias("e"))
    return x.select(key, F.col("e.i").alias("i"), F.col("e.x").alias("x")), terms


def _tasks(rows: DataFrame) -> DataFrame:
    """rows in as many tasks as run at once: each task sends sums of the size of q, which more tasks would only repeat."""
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))


def gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X'X q in one pass over the rows of X; what is shuffled has the size of q for each core, whatever the number of rows."""
    sent = rows.sparkSession.sparkContext.broadcast(q)
    width = q.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        total, touched = np.zeros_like(q), np.zeros(len(q), bool)
        for b in batches:
            row, term, value = _rows(b)
            z = _times(row, term, value, b.num_rows, q)
            o = np.argsort(term, kind="stable")
            touched[term] = True
            total += _times(term[o], row[o], value[o], len(q), z)
        parts = np.flatnonzero(np.logical_or.reduceat(touched, np.arange(0, len(q), SLICE))) if len(q) else np.zeros(0, int)
        blocks = [total[p * SLICE : (p + 1) * SLICE].tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "block"])

    def summed(t: pa.Table) -> pa.Table:
        total = 0
        for block in t.column("block"):
            total = total + np.frombuffer(block.as_py())
        return pa.table({"part": t.column("part").slice(0, 1), "block": pa.array([total.tobytes()], pa.binary())})

    sums = _tasks(rows.select("i", "x")).mapInArrow(multiply, "part int, block binary").groupBy("part").applyInArrow(summed, "part int, block binary")
    out = np.zeros_like(q)
    for part, block in sums.collect():  # the size of q in all
        out[part * SLICE : (part + 1) * SLICE] = np.frombuffer(block).reshape(-1, width)
    sent.unpersist()
    return out


def right_vectors(rows: DataFrame, terms: int, k: int, seed: int = 42, tolerance: float = 1e-10, passes: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest singular values and their right vectors (terms, k), each with its largest entry positive.

    The space grows by a block in each pass and is kept orthogonal; passes end when
    the values stand still, or when the space is that of all terms.
    """
    width = min(terms, k + EXTRA)
    block, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, width)))
    basis, image, before = np.zeros((terms, 0)), np.zeros((terms, 0)), None
    for _ in range(passes):
        basis = np.hstack([basis, block])
        image = np.hstack([image, gram_times(rows, block)])
        square, turn = np.linalg.eigh(_even(basis.T @ image))
        values = np.sqrt(np.maximum(square[::-1][:k], 0))
        still = before is not None and np.all(np.abs(values - before) <= tolerance * max(values[0], 1e-300))
        before = values
        room = min(width, terms - basis.shape[1])
        if still or not room:
            break
        block = image[:, -block.shape[1] :]
        for _ in range(2):  # twice is enough
            block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, (s > 1e-12 * max(values[0] ** 2, 1e-300))][:, :room]
        if not block.shape[1]:
            break
        block = block - basis @ (basis.T @ block)
        block, _ = np.linalg.qr(block)
    v = basis @ turn[:, ::-1][:, :k]
    if v.size:
        v = v * np.where(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])] < 0, -1, 1)
    return values, v


def _even(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def decompose(weights: DataFrame, key: str, k: int = COMPONENTS, term: str = "w", value: str = "x", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(key, v) with the unit coordinates of each row, and (component, value, terms) with the singular values and strongest terms.

    weights: key, term, value; a term twice in a row counts twice.  At most as many
    components as there are rows or terms less one, two at least; a row that is
    orthogonal to all of them is a row of zeros; an empty table has neither.
    """
    return decomposed(*sparse_rows(weights, key, term, value), key, k, seed)


def decomposed(rows: DataFrame, terms: list[str], key: str, k: int = COMPONENTS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``decompose`` of rows (key, i, x: places among ``terms`` ascending, and values), which are stored once."""
    if len(terms) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms")
    rows = stored(rows, "sparse-rows")
    n = rows.count()
    k = min(k, max(2, len(terms) - 1), max(2, n - 1), len(terms), max(n, 0))
    spark = rows.sparkSession
    if not k:
        return rows.select(key, F.array().cast("array<double>").alias("v")), spark.createDataFrame([], "component int, value double, terms string")
    values, v = right_vectors(rows, len(terms), k, seed)
    sent = spark.sparkContext.broadcast(v)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _times(*_rows(b), b.num_rows, sent.value)
            size = np.linalg.norm(z, axis=1, keepdims=True)
            z = z / np.where(size == 0, 1.0, size)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=[key, "v"])

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(key, "i", "x").mapInArrow(project, f"`{key}` {kind}, v array<double>")
    strongest = [", ".join(terms[i] for i in np.lexsort((np.arange(len(terms)), -np.round(np.abs(v[:, c]), 9)))[:6]) for c in range(v.shape[1])]
    return out, spark.createDataFrame([(c + 1, float(s), w) for c, (s, w) in enumerate(zip(values, strongest, strict=True))], "component int, value double, terms string")
