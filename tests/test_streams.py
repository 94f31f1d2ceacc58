"""Streams, each over a restart from its checkpoint."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.operators import usage
from textloom.streaming import streams

EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(day, hour=0, minute=0):
    return datetime(2024, 1, day, hour, minute)


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def run(df, tmp_path, name, mode="append", **trigger):
    """All that there is, in one query that ends; what it has written so far."""
    trigger = trigger or {"availableNow": True}
    out = f"{tmp_path}/{name}"
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(**trigger).foreachBatch(lambda b, k: b.write.mode("append").parquet(out)).start().awaitTermination(60)
    return df.sparkSession.read.parquet(out)


def test_items_behind_a_closing_are_rejected(spark, tmp_path):
    items, closings = "session_id string, item_id long, ts timestamp", "session_id string, closed_at timestamp"
    add(spark, tmp_path / "items", [("a", 1, at(1, 8)), ("b", 2, at(1, 9)), ("a", 3, at(1, 12))], items)
    add(spark, tmp_path / "closings", [("a", at(1, 10)), ("a", at(1, 10))], closings)

    def once():
        i = spark.readStream.schema(items).parquet(str(tmp_path / "items"))
        c = spark.readStream.schema(closings).parquet(str(tmp_path / "closings"))
        return sorted((r["item_id"], r["status"]) for r in run(streams.intake(i, c), tmp_path, "out").collect())

    assert (3, "rejected") in once()
    add(spark, tmp_path / "items", [("a", 4, at(2)), ("b", 5, at(2)), ("c", 6, at(5))], items)
    add(spark, tmp_path / "closings", [("z", at(5))], closings)
    assert once() == [(1, "received"), (2, "received"), (3, "rejected"), (4, "rejected"), (5, "received")]  # 6 waits for the watermark


def test_warnings_come_once_and_equal_the_batch(spark, tmp_path, rocks):
    schema = "user_id long, ts timestamp, expires_at timestamp"
    rows = [(k, at(1), at(3) + timedelta(hours=6 * k)) for k in range(12)] + [(99, at(2, 23), at(20))]
    add(spark, tmp_path / "in", rows, schema)

    def once():
        return run(streams.expiry_warnings(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path, "out").collect()

    got = once()
    users = spark.createDataFrame([(k, e, False) for k, _, e in rows], "user_id long, expires_at timestamp, expiry_warned boolean")
    due = usage.warn_once(users, F.lit(at(2, 22, 59)).cast("timestamp")).filter("warn").collect()
    assert {r["user_id"] for r in got} == {r["user_id"] for r in due} == {0, 1, 2, 3, 4} - {4} and len(got) == len(due)
    add(spark, tmp_path / "in", [(1, at(3), at(4, 20)), (98, at(3), at(21))], schema)  # 1 was warned; a later end doesn't warn again
    again = once()
    assert len({r["user_id"] for r in again}) == len(again)
    assert {r["user_id"] for r in again} - {r["user_id"] for r in got} == {4}


def test_counter_and_newest_events_are_dropped_after_their_time(spark, tmp_path, rocks):
    add(spark, tmp_path / "in", [(k, k % 2, at(1, 0, k), "x", 1.0) for k in range(20)], EVENTS)

    def once(keep):
        s = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        return run(streams.user_events(s, 5, keep), tmp_path, "out", "update", once=True).collect()  # processing time asks for batch after batch

    assert sorted(map(tuple, once(timedelta(seconds=20)))) == [(0, 10, 5, 18), (1, 10, 5, 19)]
    add(spark, tmp_path / "in", [(50, 1, at(2), "x", 1.0)], EVENTS)
    assert (1, 11, 5, 50) in map(tuple, once(timedelta(seconds=20)))
    time.sleep(21)
    add(spark, tmp_path / "in", [(60, 0, at(3), "x", 1.0)], EVENTS)
    assert (0, 1, 1, 60) in map(tuple, once(timedelta(seconds=20)))


def test_replayed_batches_add_nothing(spark, tmp_path):
    add(spark, tmp_path / "in", [(k % 7, k, at(1, 0, k), "x", 1.0) for k in range(20)], EVENTS)
    write = lambda checkpoint: streams.append_once(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / checkpoint), "event_id")
    ids = lambda: sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    write("a").awaitTermination()
    assert ids() == list(range(7))
    add(spark, tmp_path / "in", [(6, 1, at(1, 1), "x", 1.0), (7, 1, at(1, 1), "x", 1.0)], EVENTS)
    query = write("a")
    query.awaitTermination()
    assert ids() == list(range(8))
    assert all("out" not in s["description"].split("in]")[0] for p in query.recentProgress for s in p["sources"])
    write("b").awaitTermination()  # a query that lost its checkpoint replays batch 0 into its folder
    assert sorted(set(ids())) == list(range(8))
