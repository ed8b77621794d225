"""Journeys as state of a stream: events in any order within the watermark, closed by timers.

A journey is a user's events with no idle ``gap`` between them.  What the watermark has
not passed yet waits in a list; what it has passed is final and is folded, in order,
into a summary, a map of counts and a short path, so the state of a user doesn't grow
with the length of a journey.  A timer at the end of the gap closes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a closed journey is.
JOURNEY = "user_id long, start timestamp, end timestamp, records long, kinds long, errors long, longest_pause_s long, path string"
#: Steps of a path that are named.
STEPS = 9
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Journeys(StatefulProcessor):
    """Folds a user's events and emits journeys that are over."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, event_id long, event_type string")
        self.kinds = handle.getMapState("kinds", "event_type string", "n long")
        self.open = handle.getValueState("open", "start long, last long, records long, pause long, step string, steps int, path string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        new = []
        for pdf in rows:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            new += list(zip(us.tolist(), pdf["event_id"].tolist(), pdf["event_type"].tolist(), strict=True))
        now = timerValues.getCurrentWatermarkInMs()
        yield pd.DataFrame(self._advance(key, new, now), columns=[c.split()[0] for c in JOURNEY.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        yield pd.DataFrame(self._advance(key, [], timerValues.getCurrentWatermarkInMs()), columns=[c.split()[0] for c in JOURNEY.split(", ")])

    def close(self) -> None:
        pass

    def _advance(self, key: tuple, new: list, now: int) -> list[tuple]:
        """Folds what is final by the watermark ``now`` (ms; events are in microseconds), closes what is over, sets the next timer."""
        now *= 1000
        waiting = sorted([*(tuple(r) for r in self.waiting.get()), *new])
        final, rest = [e for e in waiting if e[0] < now], [e for e in waiting if e[0] >= now]
        out, at = [], tuple(self.open.get()) if self.open.exists() else None
        for ts, _, kind in final:
            if at and ts - at[1] >= self.gap:
                out.append(self._closed(key, at))
                at = None
            at = self._folded(at, ts, kind)
        if at and at[1] + self.gap <= now:  # events from now on are a journey of their own
            out.append(self._closed(key, at))
            at = None
        if at:
            self.open.update(at)
        else:
            self.open.clear()
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # the open journey is over one gap after its last event; what waits is looked at once the first of it is final
        due = [at[1] + self.gap] if at else []
        due += [rest[0][0] + 1] if rest else []
        if due:
            self.handle.registerTimer(max(min(due), now) // 1000 + 1)
        return out

    def _folded(self, at: tuple | None, ts: int, kind: str | None) -> tuple:
        kind = kind or ""
        n = self.kinds.getValue((kind,)) if self.kinds.containsKey((kind,)) else (0,)
        self.kinds.updateValue((kind,), (n[0] + 1,))
        start, last, records, pause, step, steps, path = at or (ts, ts, 0, 0, None, 0, "")
        if kind and kind != step:
            steps += 1
            if steps <= STEPS:
                path = kind if steps == 1 else f"{path} -> {kind}"
            elif steps == STEPS + 1:
                path = f"{path} -> ..."
            step = kind
        return start, ts, records + 1, max(pause, ts - last), step, min(steps, STEPS + 1), path

    def _closed(self, key: tuple, at: tuple) -> tuple:
        import pandas as pd

        counts = {tuple(k)[0]: tuple(v)[0] for k, v in self.kinds.iterator()}
        self.kinds.clear()
        when = lambda us: pd.Timestamp(us, unit="us")
        return (int(key[0]), when(at[0]), when(at[1]), at[2], len(counts), counts.get("error", 0), at[3] // 1_000_000, at[6])


@contextmanager
def rocks(spark: SparkSession):
    """The state store that list, map and timer state need, for the time a stream is started and run."""
    name, value = _ROCKS
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def stream_journeys(e: DataFrame, gap_s: int, late: str = "2 hours") -> DataFrame:
    """Closed journeys of a stream of user_id, ts, event_id, event_type; run it under ``rocks``.

    Rows without a user or a time are left out; rows more than ``late`` behind the
    newest are dropped (``late_rows`` counts them).
    """
    e = e.filter("user_id is not null and ts is not null").select("user_id", "ts", "event_id", "event_type").withWatermark("ts", late)
    return e.groupBy("user_id").transformWithStateInPandas(Journeys(1_000_000 * gap_s), JOURNEY, "Append", "EventTime")


def batch_journeys(e: DataFrame, gap_s: int, late_s: int | None = None) -> DataFrame:
    """The same journeys of a table; with ``late_s`` those that a stream over all of it has closed: over by its last watermark."""
    e = e.filter("user_id is not null and ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.coalesce("event_type", F.lit("")).alias("kind"))
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lit(1_000_000 * gap_s)
    e = e.withColumn("us", F.unix_micros("ts"))
    e = e.withColumn("pause", F.col("us") - F.lag("us").over(by))
    e = e.withColumn("nr", F.sum((F.coalesce("pause", gap) >= gap).cast("int")).over(by))
    own = W.partitionBy("user_id", "nr").orderBy("ts", "event_id")
    named = F.when(F.col("kind") != "", F.col("kind"))
    e = e.withColumn("before", F.last(named, ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, -1)))
    e = e.withColumn("step", F.sum(((F.col("kind") != "") & ~F.col("kind").eqNullSafe(F.col("before"))).cast("int")).over(own))
    first = (F.col("kind") != "") & ~F.col("kind").eqNullSafe(F.col("before")) & (F.col("step") <= STEPS)
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(first, F.struct("step", "kind")))), lambda s: s["kind"]), " -> ")
    inner = F.when(F.col("ts") > F.min("ts").over(W.partitionBy("user_id", "nr")), F.col("pause"))
    s = e.withColumn("inner", inner).groupBy("user_id", "nr").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("records"), F.countDistinct("kind").alias("kinds"), F.count_if(F.col("kind") == "error").alias("errors"),
        F.floor(F.coalesce(F.max("inner"), F.lit(0)) / 1_000_000).cast("long").alias("longest_pause_s"), path.alias("p"), F.max("step").alias("steps"), F.max("us").alias("last"),
    )
    s = s.withColumn("path", F.when(F.col("steps") > STEPS, F.concat("p", F.lit(" -> ..."))).otherwise(F.col("p")))
    if late_s is not None:
        top = F.broadcast(e.agg(((F.floor(F.max("us") / 1000) - 1000 * late_s) * 1000).alias("mark")))  # one row
        s = s.crossJoin(top).filter(F.col("last") + gap <= F.col("mark"))
    return s.select(*[c.split()[0] for c in JOURNEY.split(", ")])


# -- recent against prior, as a chain of stateful steps ------------------------


def stream_growth(e: DataFrame, recent: int, prior: int, late: str = "2 hours") -> DataFrame:
    """event_type, end, recent_n, prior_n, ratio: for each day the counts of the last ``recent`` days against the ``prior`` ones before them.

    Two stateful steps in a chain: counts by day, whose windows' times carry the
    watermark on, then windows of days that slide by one.  Works on a batch as well.
    """
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    daily = e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.window_time("w").alias("day"), "n")
    span = F.window("day", f"{recent + prior} days", "1 day").alias("s")
    new = F.col("day") >= F.col("s.end") - F.expr(f"INTERVAL {recent} DAYS")
    marked = daily.select("event_type", "day", "n", span)
    two = marked.groupBy("event_type", "s").agg(F.sum(F.when(new, F.col("n")).otherwise(0)).alias("recent_n"), F.sum(F.when(new, 0).otherwise(F.col("n"))).alias("prior_n"))
    ratio = F.round((F.col("recent_n") / recent + 0.5) / (F.col("prior_n") / prior + 0.5), 4)
    return two.select("event_type", F.col("s.end").alias("end"), "recent_n", "prior_n", ratio.alias("ratio"))


def late_rows(progress: list) -> int:
    """Rows that came behind the watermark, over all batches and stateful steps of a query's recentProgress."""
    return sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
