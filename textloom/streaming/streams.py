"""Incremental state as Structured Streaming (STR-*).

State is dropped by watermarks, timers or a time to live, so none grows for ever. Stateful processors need the RocksDB state
store: ``spark.sql.streaming.stateStore.providerClass`` is STORE.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def json_stream(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def intake(items: DataFrame, closings: DataFrame, delay: str = "1 hour", horizon: str = "7 days") -> DataFrame:
    """STR-01: items (session_id, ts, ..) with status, "received", or "rejected" if their session was closed before.

    closings: (session_id, closed_at), a stream too. Both have watermarks, so an item is decided once no closing that comes before it can
    arrive any more; sessions take items for ``horizon`` at most, and closings are kept that long.
    """
    once = closings.withWatermark("closed_at", delay).dropDuplicatesWithinWatermark(["session_id"]).select(F.col("session_id").alias("__session"), "closed_at")
    before = (F.col("session_id") == F.col("__session")) & (F.col("closed_at") <= F.col("ts")) & (F.col("closed_at") >= F.col("ts") - F.expr(f"INTERVAL {horizon}"))
    out = items.withWatermark("ts", delay).join(once, before, "left")
    return out.withColumn("status", F.when(F.col("closed_at").isNull(), "received").otherwise("rejected")).drop("__session", "closed_at")


def counters(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """STR-02, by day: events by user, kind and day."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


class UserEvents(StatefulProcessor):
    """STR-02: a counter and the newest events of a user, both dropped when nothing came for the time to live."""

    def __init__(self, most: int, keep: timedelta):
        self.most, self.ttl = most, int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long", self.ttl)
        self.events = handle.getListState("events", "ts long, event_id long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        own = [tuple(x) for x in self.events.get()] if self.events.exists() else []
        for b in rows:
            n += len(b)
            own = sorted([*own, *zip(b["ts"].astype("int64").tolist(), b["event_id"].tolist())])[-self.most :]
        self.count.update((n,))
        self.events.put(own)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "kept": [len(own)], "newest": [own[-1][1]]})

    def close(self) -> None:
        pass


def user_events(events: DataFrame, most: int = 50, keep: timedelta = timedelta(days=30)) -> DataFrame:
    """STR-02: (user_id, n, kept, newest) after each batch: all of a user's events, and how many of the newest are kept, ``most`` at most."""
    return events.select("user_id", "ts", "event_id").groupBy("user_id").transformWithStateInPandas(UserEvents(most, keep), "user_id long, n long, kept long, newest long", "update", "processingTime")


class ExpiryWarning(StatefulProcessor):
    """STR-03: a timer ``within`` before a user's access ends; expiry_warned is state, so the warning comes once."""

    def __init__(self, within: timedelta):
        self.within = int(within.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.user = handle.getValueState("user", "expires long, expiry_warned boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expires, warned = self.user.get() if self.user.exists() else (None, False)
        latest = max(int(b["expires_at"].max().timestamp() * 1000) for b in rows)
        if expires is None or latest > expires:
            if expires is not None:
                self.handle.deleteTimer(expires - self.within)
            self.user.update((latest, warned))
            if not warned:
                self.handle.registerTimer(latest - self.within)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expires, warned = self.user.get()
        now = timerValues.getCurrentWatermarkInMs()
        if not warned and 0 < expires - now <= self.within:
            self.user.update((expires, True))
            yield pd.DataFrame({"user_id": [key[0]], "expires_at": [pd.Timestamp(expires, unit="ms")], "hours_left": [(expires - now) / 3_600_000]})

    def close(self) -> None:
        pass


def expiry_warnings(access: DataFrame, delay: str = "1 minute", within: timedelta = timedelta(hours=25)) -> DataFrame:
    """STR-03: (user_id, expires_at, hours_left), a warning for each user whose access ends soon; access: (user_id, ts, expires_at).

    The watermark over ts is the clock: a poll warns of what ends within ``within`` of it and hasn't ended. A later
    expires_at moves the timer; who was warned isn't warned again.
    """
    own = access.withWatermark("ts", delay).select("user_id", "ts", "expires_at")
    return own.groupBy("user_id").transformWithStateInPandas(ExpiryWarning(within), "user_id long, expires_at timestamp, hours_left double", "append", "eventTime")


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str, ts: str = "ts", delay: str = "1 day") -> StreamingQuery:
    """STR-05, STR-06: each key that comes again within the delay is appended once, over restarts too.

    Keys are state, bounded by the watermark, so no batch reads what was written. A batch has a folder of its own, which a replay of the batch
    overwrites; readers see it as a column ``batch``.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    fresh = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digest(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """STR-04: a tumbling day, closed by the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("day")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
