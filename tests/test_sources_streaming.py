import json

from pyspark.sql import functions as F

from memspark.sources import jsonl
from memspark.streaming import events

LINES = [json.dumps({"event_id": f"e{i % 8}", "event_type": "tool_success", "ts": f"2024-01-0{1 + i % 3}T10:00:00Z", "duration_ms": i * 10, "op": "recall"}) for i in range(12)] + ["Session ended with error", "nothing here"]


def test_import_reports_and_is_idempotent(spark):
    rows = ['{"content": "a"}', '{"content": " a "}', '{"content": ""}', "no json", '{"content": "b", "skill_name": "s"}', '{"content": "gone"}']
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    none = spark.createDataFrame([], "content_hash string")
    gone = spark.createDataFrame([("gone",)], "c string").select(F.sha2("c", 256).alias("content_hash"))
    first = jsonl.imported(lines, none, gone)
    assert {r.status: r["count"] for r in first.groupBy("status").count().collect()} == {"new": 2, "skipped": 2, "failed": 2}
    again = jsonl.imported(lines, first.filter("status = 'new'"), gone)
    assert again.filter("status = 'new'").isEmpty()


def test_labels_calls_and_federation(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"query": "q", "relevant_ids": ["a", "b"]}\n{"x": 1}\n')
    assert [tuple(r) for r in jsonl.labels(spark, str(tmp_path / "l.jsonl")).collect()] == [("q", ["a", "b"])]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"ts": f"2024-01-0{i}", "kind": "chat" if i % 2 else "embed", "status": "ok"}) for i in range(1, 6)))
    assert [r.ts for r in jsonl.calls(spark, str(tmp_path / "c.jsonl"), 2, kind="chat").collect()] == ["2024-01-05", "2024-01-03"]
    both = jsonl.federated({"x": spark.createDataFrame([(1,)], "a int"), "y": spark.createDataFrame([(2, 3)], "a int, b int")})
    assert sorted((r.lib_id, r.a, r.b) for r in both.collect()) == [("x", 1, None), ("y", 2, 3)]


def test_runs_are_appended(spark, tmp_path):
    averages = spark.createDataFrame([(10, 0.9)], "queries long, rr double")
    for day in ("2024-01-01", "2024-01-02"):
        jsonl.append_run(averages, str(tmp_path / "runs"), F.lit(day))
    rows = spark.read.json(str(tmp_path / "runs")).orderBy("ts").collect()
    assert [(r.ts[:10], r.queries, r.rr) for r in rows] == [("2024-01-01", 10, 0.9), ("2024-01-02", 10, 0.9)]


def test_lines_are_classified_in_order(spark):
    got = events.parsed(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert got.count() == 13
    assert got.filter("event_type = 'end'").count() == 1
    said = ["Task started", "12 passed", "test result: FAILED", "an error", "Error: x", "IDE exited; Error:", '{"event_type": "user_feedback"}', '{"event_type": "other"}', ""]
    got = events.parsed(spark.createDataFrame([(x,) for x in said], "value string"))
    assert sorted(r.event_type for r in got.collect()) == ["end", "fail", "fail", "feedback", "ok", "start"]


def test_export_leaves_out_sparks_and_is_ordered(spark, tmp_path):
    chunks = spark.sql("SELECT * FROM VALUES ('b', 'captured', 'active', TIMESTAMP'2024-01-02'), ('a', 'captured', 'archived', TIMESTAMP'2024-01-01'), ('s', 'spark', 'active', TIMESTAMP'2024-01-01') v(id, origin, state, created_at)").selectExpr("*", "id AS content", "'' AS trigger_desc", "'' AS skill_name")
    assert [r.id for r in jsonl.exported(chunks).collect()] == ["b"]
    assert [r.id for r in jsonl.exported(chunks, True).collect()] == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LINES[:7]))
    (tmp_path / "in" / "b.log").write_text("\n".join(LINES[7:]))
    flow = events.once(events.parsed(spark.readStream.text(str(tmp_path / "in"))))
    query = flow.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = events.once(events.parsed(spark.read.text(str(tmp_path / "in"))))
    assert sorted(r.event_id for r in spark.table("once").filter("op IS NOT NULL").collect()) == sorted(r.event_id for r in batch.filter("op IS NOT NULL").collect())
    days = events.daily(events.parsed(spark.read.text(str(tmp_path / "in"))).filter("op IS NOT NULL"))
    assert days.agg(F.sum("runs")).first()[0] == 12


def test_reports_in_any_order_reduce_as_in_batch(spark, tmp_path):
    import random

    from memspark.library import Library
    from memspark.operators.episodes import reduced_traces

    rng = random.Random(4)
    rows = [
        {"id": f"r{i}", "trace_id": f"t{i % 7}", "ts": f"2024-01-{1 + i % 5:02d}T0{i % 9}:00:00Z", "complete": i % 4 == 0, "used": rng.choice([None, "", "a,b", "b,c", "d"]), "attribution": rng.choice(["explicit", "cited", "inferred", None]), "outcome": rng.choice([None, "ok", "fail", "unknown"])}
        for i in range(60)
    ]
    shape = "id string, trace_id string, ts timestamp, complete boolean, used string, attribution string, outcome string"
    rng.shuffle(rows)
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows[n * 20 : n * 20 + 25]))
    flow = events.reduced(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    latest = {}

    def take(batch, number):
        latest.update({r.trace_id: tuple(r) for r in batch.collect()})

    flow.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    lib = Library(spark, "")
    lib.__dict__["reports"] = spark.read.schema(shape).json(str(tmp_path / "in")).distinct()
    assert sorted(latest.values()) == sorted(tuple(r) for r in reduced_traces(lib).collect())
