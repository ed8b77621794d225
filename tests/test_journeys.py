"""Journeys as state of a stream: any order within the watermark, late events, timers, and the chain of windows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from skeinery.streaming import journeys

SCHEMA = "user_id long, ts timestamp, event_id long, event_type string"
START = dt.datetime(2024, 1, 1)


def rows(seed, n=900):
    rng = random.Random(seed)
    out, at = [], START
    for i in range(n):
        at += dt.timedelta(seconds=rng.randrange(0, 400))
        out.append((rng.randrange(12), at, i, rng.choice(["click", "view", "error", "error", None])))
    return out


def run(spark, files, tmp_path, make):
    """The stream over files that come one by one, into a table, and the query's progress."""
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{src}/none")
    e = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/part-*")
    with journeys.rocks(spark):
        out = make(e)
        for k, f in enumerate(files):
            spark.createDataFrame(f, SCHEMA).coalesce(1).write.parquet(f"{src}/part-{k:03}")
            q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
            q.awaitTermination()
            yield q.recentProgress
    yield sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()), key=repr)


def test_any_order_within_the_watermark(spark, tmp_path):
    """Each file holds events of its time out of order; the stream is stopped and started between files and keeps its state."""
    e = rows(1)
    rng = random.Random(2)
    files, k = [], 0
    while k < len(e):
        part = e[k : k + 300]
        rng.shuffle(part)
        files.append(part)
        k += 300
    *progress, got = run(spark, files, tmp_path, lambda s: journeys.stream_journeys(s, 5400, "3 hours"))
    want = journeys.batch_journeys(spark.createDataFrame(e, SCHEMA), 5400, 3 * 3600)
    assert got == sorted(map(tuple, want.collect()), key=repr)
    assert len(got) > 50 and any(r[7].endswith("...") for r in got)
    assert sum(map(journeys.late_rows, progress)) == 0


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    e = rows(3, 600)
    late = [(3, START + dt.timedelta(minutes=1), 10_001, "click"), (99, START, 10_002, "view")]
    end = [(50, e[-1][1] + dt.timedelta(days=2), 10_003, "end")]
    *progress, got = run(spark, [e[:300], [*e[300:], *late], end], tmp_path, lambda s: journeys.stream_journeys(s, 900, "1 hour"))
    want = journeys.batch_journeys(spark.createDataFrame(e + end, SCHEMA), 900, 3600)
    assert got == sorted(map(tuple, want.collect()), key=repr)
    assert sum(map(journeys.late_rows, progress)) == 2


def test_growth_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    e = [(1, START + dt.timedelta(hours=rng.randrange(24 * 30)), i, rng.choice("ab")) for i in range(800)]
    e.sort(key=lambda r: r[1])
    files = [e[:400], e[400:]]
    *progress, got = run(spark, files, tmp_path, lambda s: journeys.stream_growth(s, 3, 6, "1 hour"))
    batch = journeys.stream_growth(spark.createDataFrame(e, SCHEMA), 3, 6)
    closed = batch.filter(F.col("end") <= F.lit(e[-1][1] - dt.timedelta(hours=1)))
    assert got == sorted(map(tuple, closed.collect()), key=repr) and len(got) > 40
    assert sum(map(journeys.late_rows, progress)) == 0
