"""Extensions on the event stream; each works on a batch and on a stream alike."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files below a path, or of one file; event times without a zone are taken as the session's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        source, path = source.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return source.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(e: DataFrame, width: str, slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """event_type, start, n by time window; a stream waits ``late`` for late events."""
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def once(e: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each key once; a stream remembers keys for ``late``."""
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if e.isStreaming else e.dropDuplicates([key])


def sessions(e: DataFrame, gap: str, late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n of sessions that end after an idle ``gap``."""
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_users(e: DataFrame) -> DataFrame:
    """user_id, n, last: a running count for each user, kept as state."""

    def update(key: tuple, parts: Iterator, state) -> Iterator:
        import pandas as pd

        n, last = state.get if state.exists else (0, None)
        for pdf in parts:
            n += len(pdf)
            top = pdf["ts"].max().isoformat()
            last = top if last is None or top > last else last
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last": [last]})

    return e.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, last string", "n long, last string", "update", "NoTimeout")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over all that is there, into a table at path (output ``append``), and reads the table."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/table")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def latest(stream: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """Runs a stream of updates over all that is there; the last row of each key, which is that of the greatest ``order``."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    x = spark.read.schema(stream.schema).parquet(f"{path}/table").select(*stream.columns)
    return x.groupBy(key).agg(F.max_by(F.struct(*[c for c in x.columns if c != key]), order).alias("x")).select(key, "x.*")
