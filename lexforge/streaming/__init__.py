"""Streams: incremental query log, change feed, windowed counts and a sliding-window limiter."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and window; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def accepted(times: list[float], kept: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which hits a limiter lets through: at most `most` accepted ones in any last `seconds`; refused hits don't count."""
    kept, out = list(kept), []
    for t in times:
        kept = [k for k in kept if k > t - seconds]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out, kept


def limited(events: DataFrame, key: str, ts: str, event: str, most: int, seconds: float) -> DataFrame:
    """(key, event, allowed) of a stream: state per key is at most `most` times."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["_s", event])
        allowed, kept = accepted(rows["_s"].tolist(), kept, most, seconds)
        state.update((kept,))
        yield pd.DataFrame({key: k[0], event: rows[event].to_numpy(), "allowed": allowed})

    timed = events.select(key, event, F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("_m")).select(key, event, (F.col("_m") / 1e6).alias("_s"))
    kinds = dict(events.dtypes)
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {event} {kinds[event]}, allowed boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


class _Limiter(StatefulProcessor):
    """Times of a key's accepted hits, which a timer takes out when the window has passed them."""

    def __init__(self, key: str, event: str, most: int, seconds: float):
        self.key, self.event, self.most, self.seconds = key, event, most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "at double")

    def _times(self) -> list[float]:
        return [r[0] for r in self.kept.get()] if self.kept.exists() else []

    def _hold(self, kept: list[float]) -> None:
        """What is kept, and one timer for when the last of it has passed; nothing kept: no state."""
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if kept:
            self.kept.put([(t,) for t in kept])
            self.handle.registerTimer(int((kept[-1] + self.seconds) * 1000) + 1)
        else:
            self.kept.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [p for p in rows if len(p)]
        if not parts:  # called for a timer only
            return
        batch = pd.concat(parts).sort_values(["hit_seconds", self.event])  # a key's rows of one micro-batch
        allowed, kept = accepted(batch["hit_seconds"].tolist(), self._times(), self.most, self.seconds)
        self._hold(kept)
        yield pd.DataFrame({self.key: key[0], self.event: batch[self.event].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        self._hold([t for t in self._times() if t > now - self.seconds])
        return iter(())

    def close(self) -> None:
        """Nothing is open."""


#: The store of states that timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limited_with_end(events: DataFrame, key: str, ts: str, event: str, most: int, seconds: float, late: str = "1 minute") -> DataFrame:
    """limited(), with a state that ends: when the watermark has passed a key's last accepted hit by `seconds`, nothing of the key is left.

    Hits later than the watermark are judged by what is still kept. It sets the session's state store to RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = dict(events.dtypes)
    timed = events.withColumn("hit_time", F.col(ts).cast("timestamp")).withWatermark("hit_time", late).select(key, event, "hit_time", (F.unix_micros("hit_time") / 1e6).alias("hit_seconds"))
    schema = f"{key} {kinds[key]}, {event} {kinds[event]}, allowed boolean"
    return timed.groupBy(key).transformWithStateInPandas(_Limiter(key, event, most, seconds), schema, "append", "EventTime")


def limited_batch(events: DataFrame, key: str, ts: str, event: str, most: int, seconds: float) -> DataFrame:
    """limited() over a table: accepting feeds back, so a key's hits go in time order through one task, which holds `most` times a key."""
    s = F.unix_micros(F.col(ts).cast("timestamp")).cast("double") / 1e6
    kinds = dict(events.dtypes)
    rows = events.select(key, event, s.alias("_s")).repartition(key).sortWithinPartitions(key, "_s", event)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, deque()
        for part in parts:
            allowed = []
            for k, t in zip(part[key].tolist(), part["_s"].tolist(), strict=True):
                if k != now:
                    now, kept = k, deque()
                while kept and kept[0] <= t - seconds:
                    kept.popleft()
                allowed.append(len(kept) < most)
                if allowed[-1]:
                    kept.append(t)
            yield pd.DataFrame({key: part[key], event: part[event], "allowed": allowed})

    return rows.mapInPandas(run, f"{key} {kinds[key]}, {event} {kinds[event]}, allowed boolean")


def upsert_query_log(stream: DataFrame, fold, path: str, checkpoint: str):
    """Folds each batch and adds it to the log at `path`, a folder a batch, of available data only.

    A batch writes only its own rows, and the same batch written again replaces itself; `query_log` folds them together.
    """

    def write(batch: DataFrame, number: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """One row a query over all batches: occurrences added up, the last and the best number of results."""
    parts = spark.read.parquet(path)
    return parts.groupBy("query_hash").agg(F.sum("occurrences").alias("occurrences"), F.max_by("last_result_count", "batch").alias("last_result_count"), F.max("best_result_count").alias("best_result_count"))
