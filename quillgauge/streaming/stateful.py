"""Stateful streams: sequence gaps and silent sources by timers, live KPIs in windows, stage lags in sessions.

State lives in the state store and is bounded by time: a source that stays
silent is forgotten, windows and sessions close behind the
watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.session import fresh_path
from .events import follow_gaps

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Timers, list state and TTL need this state store; a query keeps the one it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def millis(t: pd.Series) -> np.ndarray:
    return t.astype("datetime64[us]").astype("int64").to_numpy() // 1000


def as_frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as a frame; keys stay plain objects, as the transfer takes no chunked strings."""
    return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})


class Sequences(StatefulProcessor):
    """The range of sequence numbers a source has sent and its open gaps."""

    def __init__(self, source: str, idle_ms: int, ttl_ms: int | None):
        self.names, self.idle_ms, self.ttl_ms = [source, "kind", "first", "last", "seen", "resync"], idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "low long, high long", self.ttl_ms)
        self.gaps = handle.getListState("gaps", "first long, last long", self.ttl_ms)

    def open_gaps(self) -> list[tuple[int, int]]:
        return [(int(a), int(b)) for a, b in self.gaps.get()] if self.gaps.exists() else []

    def status(self, key: tuple, kind: str, low: int, high: int, gaps: list[tuple[int, int]]) -> tuple:
        missing = sum(b - a + 1 for a, b in gaps)
        return (key[0], kind, low, high, high - low + 1 - missing, missing > 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        seen = np.unique(np.concatenate([f["seq"].dropna().to_numpy(dtype=np.int64) for f in frames]))
        out = []
        if len(seen):
            low, high = self.span.get() if self.span.exists() else (int(seen[0]), int(seen[0]))
            low, high, gaps, told = follow_gaps(int(low), int(high), self.open_gaps(), seen)
            self.span.update((low, high))
            self.gaps.put(gaps) if gaps else self.gaps.clear()
            status = self.status(key, "status", low, high, gaps)
            out = [(key[0], kind, a, b, status[4], kind == "gap") for a, b, kind in told] + [status]
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else max(int(millis(f["timestamp"]).max()) for f in frames if len(f))
            self.handle.registerTimer(now + self.idle_ms)
        yield as_frame(out, self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.span.exists():
            low, high = self.span.get()
            out = [self.status(key, "expired", int(low), int(high), self.open_gaps())]
            self.span.clear()
            self.gaps.clear()
        yield as_frame(out, self.names)

    def close(self) -> None:
        pass


def follow_sequences(events: DataFrame, source: str = "source", idle_seconds: int = 600, late: str = "10 minutes", ttl_seconds: int | None = None) -> DataFrame:
    """source, kind, first, last, seen, resync from a stream of source, seq, timestamp.

    Kinds are ``gap`` (numbers found missing; the reader should fetch them
    again: resync), ``filled`` (a missing number that came later), ``status``
    (range and count of the numbers seen so far, once a batch; resync while any
    is missing) and ``expired``: nothing came for ``idle_seconds`` of event time
    behind the watermark, and the source is forgotten.  With ``ttl_seconds``
    time is that of processing, for sources whose clocks cannot be trusted, and
    the state store drops what was not written for so long.  Null numbers and
    repeated ones tell nothing.
    """
    kind = dict(events.dtypes)[source]
    rows = events.select(source, "seq", "timestamp")
    processor = Sequences(source, idle_seconds * 1000, None if ttl_seconds is None else ttl_seconds * 1000)
    schema = f"`{source}` {kind}, kind string, first long, last long, seen long, resync boolean"
    if ttl_seconds is None:
        return rows.withWatermark("timestamp", late).groupBy(source).transformWithStateInPandas(processor, schema, "Append", "eventTime")
    return rows.groupBy(source).transformWithStateInPandas(processor, schema, "Append", "processingTime")


class Heartbeats(StatefulProcessor):
    """The last signs of life of the sources of a bucket, and a timer for the first of them that is due."""

    def __init__(self, source: str, silence_ms: int, event_time: bool):
        self.source, self.silence_ms, self.event_time = source, silence_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "source array<string>, at_us array<long>")

    def known(self) -> tuple[np.ndarray, np.ndarray]:
        names, at = self.last.get() if self.last.exists() else ([], [])
        return np.array([*names], object), np.array([*at], np.int64)

    def remember(self, names: np.ndarray, at: np.ndarray) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if not len(at):
            self.last.clear()
            return
        self.last.update(([None if n != n else n for n in names.tolist()], at.tolist()))
        self.handle.registerTimer(int(at.min()) // 1000 + self.silence_ms)

    def stale(self, names: np.ndarray, last_us: np.ndarray) -> pd.DataFrame:
        at = pd.Series(last_us).astype("datetime64[us]")
        return pd.DataFrame({self.source: pd.Series(names, dtype=object), "last_seen": at, "stale_from": at + pd.Timedelta(milliseconds=self.silence_ms)}, columns=[self.source, "last_seen", "stale_from"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, known = self.known()
        n, more, at = len(known), [names], [known]
        for f in rows:
            f = f[f["timestamp"].notna()] if self.event_time else f
            more.append(f[self.source].to_numpy(object))
            at.append(f["timestamp"].astype("datetime64[us]").astype("int64").to_numpy() if self.event_time else np.full(len(f), timerValues.getCurrentProcessingTimeInMs() * 1000))
        code, names = pd.factorize(np.concatenate(more), use_na_sentinel=False)  # known sources keep their places; a null one is a source too
        at = np.concatenate(at)
        if len(at) == n:
            return
        last = np.full(len(names), np.iinfo(np.int64).min)
        last[:n] = known
        new = np.append(np.full(n, True), at[n:] > last[code[n:]])
        order = np.lexsort((at[new], code[new]))
        code, at = code[new][order], at[new][order]
        ends = np.append(code[1:] != code[:-1], True)
        gap = np.flatnonzero(~ends[:-1] & (np.diff(at) >= self.silence_ms * 1000))
        self.remember(names, at[ends])
        if len(gap):
            yield self.stale(names[code[gap]], at[gap])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        names, at = self.known()
        due = at // 1000 + self.silence_ms
        gone = (due < now) | (due <= expiredTimerInfo.getExpiryTimeInMs())
        self.remember(names[~gone], at[~gone])  # a source that comes back begins anew
        if gone.any():
            yield self.stale(names[gone], at[gone])

    def close(self) -> None:
        pass


def watch_sources(events: DataFrame, source: str = "source", beat_seconds: int = 15, missed: int = 2, late: str = "1 minute", event_time: bool = True, buckets: int = 256) -> DataFrame:
    """source, last_seen, stale_from of each silence of ``missed`` beats, told by a timer that needs no input of its source.

    In event time it fires when the watermark, which all sources move, passes
    ``stale_from``; in processing time also when every source is silent.
    Events older than the last one of their source tell nothing.  State is kept
    and timers are set by buckets of sources, which take their names as strings:
    a batch costs a call a bucket, not one a source.  With some hundred thousand
    sources a bucket, take more of them.
    """
    kind = dict(events.dtypes)[source]
    rows = events.select(F.pmod(F.xxhash64(source), F.lit(buckets)).alias("__bucket"), F.col(source).cast("string").alias(source), "timestamp")
    rows = rows.withWatermark("timestamp", late) if event_time else rows
    processor = Heartbeats(source, beat_seconds * missed * 1000, event_time)
    told = rows.groupBy("__bucket").transformWithStateInPandas(processor, f"`{source}` string, last_seen timestamp, stale_from timestamp", "Append", "eventTime" if event_time else "processingTime")
    return told.withColumn(source, F.col(source).cast(kind))


def live_kpis(values: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """run_id, metric, window_start, window_end, n, mean, min, max of sliding windows, each given out once the watermark has passed it.

    values: run_id, metric, value, timestamp.  NaN and null values are rows
    without a value; rows that come after their windows are closed are dropped.
    """
    v = F.when(~F.isnan("value"), F.col("value"))
    marked = values.withWatermark("timestamp", late)
    g = marked.groupBy("run_id", "metric", F.window("timestamp", window, slide or window).alias("w")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    return g.select("run_id", "metric", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean", "min", "max")


def fed(spark: SparkSession, batches: list[DataFrame], run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The output of a stream that is fed batch by batch, each in a run of its own that takes up the checkpoint of the one before."""
    source, sink, checkpoint = (fresh_path(spark, f"{name}-{part}") for part in ("source", "sink", "state"))
    with rocksdb(spark):
        for batch in batches:
            batch.write.mode("append").parquet(source)
            out = run(spark.readStream.schema(batch.schema).parquet(source))
            out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def stage_lags(events: DataFrame, stages: tuple[str, ...], within: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """stage, id, at_before, at_after of all neighbouring stages, in one stream; the first stage comes with the second.

    Two events of an id belong together where they are at most ``within``
    apart; others are given alone.  Such events lie in one session of their id,
    so state is a row for each session, which the watermark closes, and not the
    two sides of a join for each pair of stages.  events: id, event, timestamp;
    a null id is like no other.
    """
    place = F.coalesce(*[F.when(F.col("event") == s, F.lit(k)) for k, s in enumerate(stages)])
    rows = events.select("id", place.alias("stage"), "timestamp").where("stage is not null").withWatermark("timestamp", late)
    gap = f"{within} 1 microsecond"  # a session ends before its gap does
    session = rows.groupBy("id", F.session_window("timestamp", gap)).agg(F.collect_list(F.struct("stage", "timestamp")).alias("e"))
    at = lambda k: F.transform(F.filter("e", lambda x: x.stage == k), lambda x: x.timestamp)
    near = lambda a, b: F.col("id").isNotNull() & (b >= a - F.expr(f"interval {within}")) & (b <= a + F.expr(f"interval {within}"))
    none = F.lit(None).cast("timestamp")

    def pairs(k: int) -> Column:
        row = lambda a, b: F.struct(F.lit(stages[k + 1]).alias("stage"), a.alias("at_before"), b.alias("at_after"))
        a, b = F.col(f"t{k}"), F.col(f"t{k + 1}")
        both = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: near(x, y)), lambda y: row(x, y))))
        alone = F.transform(F.filter(a, lambda x: ~F.exists(b, lambda y: near(x, y))), lambda x: row(x, none))
        return F.concat(both, alone, F.transform(F.filter(b, lambda y: ~F.exists(a, lambda x: near(x, y))), lambda y: row(none, y)))

    timed = session.select("id", *[at(k).alias(f"t{k}") for k in range(len(stages))])
    return timed.select("id", F.explode(F.concat(*[pairs(k) for k in range(len(stages) - 1)])).alias("p")).select("p.stage", "id", "p.at_before", "p.at_after")


def lag_funnel(lags: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """stage, n, mean_lag from what ``stage_lags`` gave out: ids that reached a stage, and the seconds since the stage before where both lie within the bound."""
    lag = (F.unix_micros("at_after") - F.unix_micros("at_before")) / 1e6
    rest = lags.groupBy("stage").agg(F.count("at_after").alias("n"), F.avg(lag).alias("mean_lag"))
    first = lags.where(F.col("stage") == stages[1]).agg(F.count("at_before").alias("n")).select(F.lit(stages[0]).alias("stage"), "n", F.lit(None).cast("double").alias("mean_lag"))
    return first.unionByName(rest)
