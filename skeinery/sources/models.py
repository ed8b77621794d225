"""Model and embedding sources: a client is called batch by batch on the executors; rules and hashed grams stand in where there is none."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a request, tokens of a request and of a text (about four characters each).
BATCH, REQUEST_TOKENS, TEXT_TOKENS = 256, 100_000, 8_000


def requests(texts: list[str], batch: int = BATCH, budget: int = REQUEST_TOKENS) -> Iterator[tuple[int, int]]:
    """From, to: as many texts as a request takes, by number and by tokens; at least one."""
    i = 0
    while i < len(texts):
        j, used = i, 0
        while j < len(texts) and j - i < batch:
            used += len(texts[j]) // 4 + 1
            if j > i and used > budget:
                break
            j += 1
        yield i, j
        i = j


def embed(df: DataFrame, key: str, text: str, client: Callable[[list[str]], list[list[float]]], cache: str | None = None, batch: int = BATCH, budget: int = REQUEST_TOKENS, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """key, vector (unit length), error, cut of every row.

    Equal texts are sent once.  cache: a Parquet folder of vectors by fingerprint of
    the text; what it has isn't sent, and what is new is added.  A request that fails
    is repeated after 1, 2, 4 .. times ``wait`` seconds; after ``retries`` repeats its
    texts have an error and no vector, and stop nothing.  Longer texts are cut to
    TEXT_TOKENS, as the service does, and cut says so; null and blank ones have no vector.
    """
    spark = df.sparkSession
    whole = F.trim(F.col(text))
    x = df.select(F.col(key).alias("key"), F.substring(whole, 1, TEXT_TOKENS * 4).alias("text"), F.coalesce(F.length(whole) > TEXT_TOKENS * 4, F.lit(False)).alias("cut"))
    x = x.withColumn("fingerprint", F.when(F.coalesce("text", F.lit("")) != "", F.md5("text")))
    todo = x.filter("fingerprint IS NOT NULL").select("fingerprint", "text").dropDuplicates(["fingerprint"])
    schema = "fingerprint string, vector array<double>"
    known = None
    if cache:
        path = spark._jvm.org.apache.hadoop.fs.Path(cache)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.schema(schema).parquet(cache)
            todo = todo.join(known.select("fingerprint"), "fingerprint", "left_anti")

    def run(parts: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in parts:
            texts = pdf["text"].tolist()
            for i, j in requests(texts, batch, budget):
                error, out = None, [None] * (j - i)
                for attempt in range(retries + 1):
                    try:
                        got = np.asarray(client(texts[i:j]), float)
                        if got.ndim != 2 or len(got) != j - i:
                            raise ValueError(f"vectors of shape {got.shape} for {j - i} texts")
                        n = np.linalg.norm(got, axis=1, keepdims=True)
                        out, error = (got / np.where(n == 0, 1, n)).tolist(), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"[:200]
                        if attempt < retries:
                            time.sleep(wait * 2**attempt)
                yield pd.DataFrame({"fingerprint": pdf["fingerprint"].iloc[i:j].tolist(), "vector": out, "error": error})

    new = todo.mapInPandas(run, f"{schema}, error string")
    if cache:
        new = new.persist()  # sent once, though read twice
        new.filter("vector IS NOT NULL").select("fingerprint", "vector").write.mode("append").parquet(cache)
    found = new if known is None else new.unionByName(known, allowMissingColumns=True)
    return x.select("key", "fingerprint", "cut").join(found, "fingerprint", "left").select(F.col("key").alias(key), "vector", "error", "cut")


def call(df: DataFrame, key: str, prompt: str, client: Callable[[list[str]], list[str]], batch: int = BATCH, budget: int = REQUEST_TOKENS, retries: int = 3, wait: float = 1.0, fields: list[str] | None = None) -> DataFrame:
    """key, output, status, error, attempts of each row: ``client`` takes a list of prompts and gives as many texts.

    A request takes as many prompts as ``batch`` and the token ``budget`` allow, one
    at least.  A request that fails is repeated after 1, 2, 4 .. times ``wait``
    seconds; after ``retries`` repeats its rows have status error and stop nothing.
    fields: what each output must have as a JSON object; others have status
    bad_output and say what is wrong.  The client is sent to the executors, so it
    opens its connections when called; a row whose task is run again is asked again.
    """

    def fault(out: str) -> str | None:
        import json

        try:
            got = json.loads(out)
        except (TypeError, ValueError) as e:
            return f"no JSON: {e}"[:200]
        if not isinstance(got, dict):
            return "no JSON object"
        lacks = [f for f in fields or [] if got.get(f) is None]
        return f"lacks {', '.join(lacks)}" if lacks else None

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            texts = [t or "" for t in pdf[prompt].tolist()]
            for i, j in requests(texts, batch, budget):
                out, error, attempt = [None] * (j - i), None, 0
                for attempt in range(retries + 1):
                    try:
                        out, error = list(client(texts[i:j])), None
                        if len(out) != j - i:
                            raise ValueError(f"{len(out)} outputs for {j - i} prompts")
                        break
                    except Exception as e:
                        out, error = [None] * (j - i), f"{type(e).__name__}: {e}"[:200]
                        if attempt < retries:
                            time.sleep(wait * 2**attempt)
                faults = [fault(o) if fields and error is None else None for o in out]
                status = ["error" if error else "bad_output" if f else "ok" for f in faults]
                yield pd.DataFrame({"key": pdf[key].iloc[i:j].tolist(), "output": out, "status": status, "error": [error or f for f in faults], "attempts": attempt + 1})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt).mapInPandas(run, f"key {kind}, output string, status string, error string, attempts int").withColumnRenamed("key", key)
