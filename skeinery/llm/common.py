"""Helpers that several operators share: scratch tables, buckets, text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same class as a regular expression that Java, RE2 and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only where all executors are threads of the driver (tests) a temporary folder takes
    its place; a cluster without the setting is refused, as its machines share no
    temporary folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="skeinery-")
    return _local[sc.applicationId]


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: a later loss of executors recomputes nothing that
    stands before the table.  ``clear`` removes the tables of an application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skeinery-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all scratch tables of this application; results that weren't written yet are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/skeinery-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to the given ones that df does not hold yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text: equal texts, equal keys; null has its own."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b"").cast("binary"))


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and its n + 1 offsets; null: empty."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the buffer, and n + 1 offsets into them by text."""
    ink = ~SPACE[data]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    heads = off[:-1][np.diff(off) > 0]  # a text begins anew even if the text before ends in a letter
    start[heads] = ink[heads]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    tails = heads[heads > 0] - 1
    end[tails] = ink[tails]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)
