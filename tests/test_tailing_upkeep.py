"""The tailing source over growing and rotated files, and incremental upkeep against the batch result."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators.episodes import reduced_traces
from memspark.sources import tailing
from memspark.streaming import events, upkeep


def drain(spark, pattern, tmp_path):
    tailing.register(spark)
    lines = spark.readStream.format("memspark_tail").option("path", pattern).load()
    query = lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "point")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return [r.value for r in spark.read.parquet(str(tmp_path / "out")).orderBy("path", "offset").collect()]


def test_tail_follows_growth_rotation_and_restarts(spark, tmp_path):
    log = tmp_path / "a.log"
    pattern = str(tmp_path / "*.log*")
    log.write_text("one\ntwo\nhal")
    (tmp_path / "b.log").write_text("no line yet")
    assert sorted(drain(spark, pattern, tmp_path)) == ["one", "two"]
    with log.open("a") as f:
        f.write("f a line\n\nthree\n")
    assert sorted(drain(spark, pattern, tmp_path)) == ["half a line", "one", "three", "two"]
    assert len(drain(spark, pattern, tmp_path)) == 4
    # Rotated with a line that was not read yet: the old file is followed under its new name.
    with log.open("a") as f:
        f.write("last of the old\n")
    os.rename(log, tmp_path / "a.log.1")
    log.write_text("first of the new\n")
    assert sorted(drain(spark, pattern, tmp_path))[:3] == ["first of the new", "half a line", "last of the old"]
    # Cut short in place: read from the start again.
    log.write_text("x\n")
    got = drain(spark, pattern, tmp_path)
    assert sorted(got) == sorted(["one", "two", "half a line", "three", "last of the old", "first of the new", "x"])


def test_offsets_and_long_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tailing, "BLOCK", 4)
    path = tmp_path / "f"
    path.write_bytes(b"abcdefghijk\nlmnopqrs")
    assert tailing.complete(str(path), 20) == 12 and tailing.complete(str(path), 11) == 0 and tailing.complete(str(path), 0) == 0
    reader = tailing.TailReader(str(tmp_path / "*"))
    inode = os.stat(path).st_ino
    assert reader.latestOffset() == {str(path): [inode, 12]}
    (part,) = reader.partitions({}, reader.latestOffset())
    assert [x[0] for x in reader.read(part)] == ["abcdefghijk"]
    assert reader.partitions({str(path): [inode, 12]}, reader.latestOffset()) == []


T0 = dt.datetime(2024, 1, 1)
SHAPE = upkeep.REPORT


def reports(seed):
    r = random.Random(seed)
    return [(f"r{i:03d}", f"t{r.randrange(14)}", T0 + dt.timedelta(minutes=r.randrange(500)), r.random() < 0.3, r.choice([None, "", "c1,c2", "c3", "c2,c4,c5", "c6"]), r.choice(["explicit", "cited", "inferred"]), r.choice(["ok", "fail", None, "unknown"])) for i in range(80)]


def rows(df):
    return sorted(tuple(x) for x in df.collect())


def whole(spark, every):
    traces = reduced_traces(Library(spark, "").replaced(reports=spark.createDataFrame(every, SHAPE)))
    evidence = upkeep.evidence_of(traces)
    return rows(traces), rows(evidence), rows(upkeep.confidence_of(evidence))


def test_upkeep_equals_the_whole_and_touches_only_what_changes(spark, tmp_path):
    every = reports(1)
    keep = upkeep.Upkeep(spark, str(tmp_path / "kept"))
    order = every[:]
    random.Random(2).shuffle(order)
    for at in range(0, 80, 40):
        # Repeated rows, and a batch that comes twice.
        batch = spark.createDataFrame(order[at : at + 40] + order[:3], SHAPE)
        keep.apply(batch)
    keep.apply(spark.createDataFrame(order[40:], SHAPE))
    columns = ("trace_id", "used", "attributions", "complete", "outcome", "usage_state"), ("trace_id", "chunk_id", "target", "alpha"), ("chunk_id", "n", "confidence")
    state = lambda: tuple(rows(t.table().select(*c)) for t, c in zip((keep.traces, keep.evidence, keep.confidence), columns, strict=True))
    assert state() == whole(spark, every)
    # A correction of one trace: a later complete report takes all earlier uses back.
    stamps = lambda: {p: os.stat(p).st_mtime_ns for t in ("traces", "confidence") for p in [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "kept" / t) for f in fs if f.endswith(".parquet")]}
    before = stamps()
    late = ("z", "t3", T0 + dt.timedelta(days=1), True, "c9", "explicit", "ok")
    touched = keep.apply(spark.createDataFrame([late], SHAPE))
    assert touched["traces"] == 1 and 1 <= touched["chunks"] <= 7
    assert state() == whole(spark, [*every, late])
    after = stamps()
    assert sum("traces" in p for p in after.keys() - before.keys()) <= 2 and len(before.keys() & after.keys()) >= len(before) - 12
    assert keep.apply(spark.createDataFrame([], SHAPE)) == {"traces": 0, "chunks": 0}


def test_only_ends_close_traces(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"event_id": "1", "event_type": "session_end", "trace_id": "t1", "ts": "2024-01-01T00:00:00Z"}', '{"event_id": "2", "event_type": "session_start", "trace_id": "t2", "ts": "2024-01-01T00:00:00Z"}', '{"event_id": "3", "event_type": "session_end", "trace_id": "t1", "ts": "2024-01-02T00:00:00Z"}', "Tests passed"]
    (tmp_path / "in" / "x.txt").write_text("\n".join(lines))
    closed, grown = [], []
    stream = events.parsed(spark.readStream.text(str(tmp_path / "in")))
    writer = upkeep.close_on_end(stream, lambda df, n: closed.extend((r.trace_id, r.ts.day) for r in df.collect()), grown.append)
    query = writer.option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and closed == [("t1", 2)] and len(grown) == 1
    assert events.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).filter(F.col("event_type") == "end").count() == 2
