"""Deadlines and sessions as streams, with a restart between, against their batch forms over the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memspark.streaming import timers

T0 = dt.datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, tmp_path, parts, schema, build):
    """What ``build`` of a stream of ``parts`` (lists of rows) gives, each part by a query of its own from the same checkpoint."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        query = build(spark.readStream.schema(schema).json(str(source))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "point")).option("path", str(out)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None, i
    return spark.read.parquet(str(out))


ROWS = "key string, kind string, ts timestamp"


@pytest.mark.parametrize("build,minutes,start,end,outcome", [
    (timers.timed_out_traces, timers.OPEN, "recalled", "completed", "timed_out"), (timers.stuck_screening, timers.SCREENING, "screening", "distilled", "failed"),
    (timers.unobserved, timers.SHOWN, "shown", "observed", "unknown"), (timers.expired_episodes, timers.EPISODE, "new", "ruled", "expired"),
])
def test_deadlines_equal_the_batch_form(spark, tmp_path, build, minutes, start, end, outcome):
    r = random.Random(minutes)
    at = lambda share: T0 + dt.timedelta(seconds=int(60 * minutes * share))
    rows = [(f"k{i}", start, at(r.random() / 2)) for i in range(12)] + [(f"k{i}", end, at(0.5 + r.random() / 3)) for i in range(0, 12, 3)] + [("late", start, at(0.1)), ("late", start, at(0.95)), ("ended", end, at(0.4)), (None, start, at(0))]
    r.shuffle(rows)
    # The clock goes on by rows of other keys; the last part only moves the watermark.
    parts = [rows[:9], rows[9:], [("tick", end, at(1.9))], [("tick", end, at(6))], [("tock", end, at(6.1))]]
    got = {(x.key, x.outcome, x.at) for x in streamed(spark, tmp_path, parts, ROWS, lambda s: build(s, f"{minutes} minutes")).collect()}
    every = spark.createDataFrame([x for p in parts for x in p], ROWS)
    expected = {(x.key, x.outcome, x.at) for x in timers.overdue(every, minutes, [start], outcome, F.lit(at(5)).cast("timestamp")).collect()}
    assert got == expected and {k for k, _, _ in got} == {"late", *[f"k{i}" for i in range(12) if i % 3]}


EVENTS = "session_id string, kind string, name string, failed boolean, ts timestamp"


def test_sessions_equal_the_batch_form(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", "user", None, None, at(0)), ("a", "tool", "Bash", True, at(4)), ("a", "tool", "Read", False, at(9)), ("a", "end", None, None, at(12)), ("b", "tool", "Bash", False, at(1)), ("b", "tool", "Bash", None, at(20)), (None, "tool", "x", True, at(3))]
    later = [("b", "tool", "Edit", True, at(90)), ("c", "user", None, None, at(91))]
    random.Random(1).shuffle(rows)
    parts = [rows[:4], rows[4:], later, [("tick", "user", None, None, at(300))], [("tock", "user", None, None, at(301))]]
    got = {tuple(x) for x in streamed(spark, tmp_path, parts, EVENTS, lambda s: timers.sessions(s, 30, "30 minutes")).collect()}
    every = spark.createDataFrame([x for p in parts for x in p if x[0] not in ("tick", "tock")], EVENTS)
    assert got == {tuple(x) for x in timers.session_table(every, 30).collect()}
    assert {(x[0], x[-1]) for x in got} == {("a", "end"), ("b", "timeout"), ("c", "timeout")} and len(got) == 4
