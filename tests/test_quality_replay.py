"""Quality floors of recall on the labelled texts, packed and hashed vectors, stored figures, replay of gates."""

import datetime as dt
import hashlib
import math
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators import embedding, replay, retrieval

# Texts and queries that the quality floors are stated for.
TEXTS = [
    ("rust_build", "Build the release binary using cargo build release profile", "compile rust release binary cargo"), ("rust_test", "Run the rust test suite with the cargo test command", "run rust tests cargo suite"),
    ("git_branch", "Create a new git branch before committing your changes", "git branch commit workflow"), ("git_merge", "Resolve git merge conflicts by editing the conflicted files", "git merge conflict resolution"),
    ("sqlite_tx", "Use begin immediate for exclusive write transactions in sqlite", "sqlite transaction locking immediate"), ("sql_index", "Add a database index to speed up slow sql queries", "sql query performance index optimization"),
    ("async_block", "Avoid blocking the async runtime with synchronous blocking io", "async runtime blocking io"), ("tokio_spawn", "Spawn background tasks using tokio spawn for concurrency", "tokio spawn background task concurrency"),
    ("unit_test", "Write unit tests asserting the expected behavior of functions", "unit test assertion behavior"), ("env_config", "Configure environment variables through the settings file", "environment variable configuration settings"),
    ("api_docs", "Document public apis with rust doc comments and examples", "api documentation doc comments"), ("mem_profile", "Profile memory usage to find and fix memory leaks", "memory profiling leak detection"),
]
ASKED = [
    ("cargo build release binary", "rust_build"), ("run rust test suite cargo", "rust_test"), ("git merge conflict resolution", "git_merge"), ("git branch commit workflow", "git_branch"), ("sqlite transaction locking", "sqlite_tx"),
    ("sql query performance index", "sql_index"), ("async runtime blocking io", "async_block"), ("tokio spawn background task", "tokio_spawn"), ("environment variable configuration", "env_config"), ("memory leak profiling detection", "mem_profile"),
]
CHUNK = "id string, skill_name string, content string, trigger_desc string, anti_trigger_desc string, token_count long, origin string, maturity string, state string, confidence_base double, embed_version int, created_at timestamp, evidence_cutoff_at timestamp"
NONE = {
    "usage": "id long, trace_id string, chunk_id string, event string, attribution string, source string, rank long, similarity double, ts timestamp", "feedback": "id string, trace_id string, chunk_id string, signal string, strength double, actor string, context_key string, ts timestamp",
    "log": "trace_id string, ts timestamp, context_key string, outcome string, task_state string, usage_state string", "deps": "src string, dst string, kind string",
}


def test_recall_meets_the_quality_floors(spark):
    lib = Library(spark, "")
    day = dt.datetime(2024, 1, 1)
    lib.chunks = spark.createDataFrame([(n, "skill", c, t, None, 20, "captured", None, "active", 0.6, 1, day, None) for n, c, t in TEXTS], CHUNK)
    for name, shape in NONE.items():
        lib.__dict__[name] = spark.createDataFrame([], shape)
    asked = spark.createDataFrame([(i, q, "ctx") for i, (q, _) in enumerate(ASKED)], "query_id long, query string, context_key string")
    bags = lambda df, key, text, size: embedding.bag_vectors(df, key, text, size)
    lib.vec_content = bags(lib.chunks, "id", "content", 512).withColumnRenamed("id", "chunk_id")
    lib.vec_trigger = bags(lib.chunks, "id", "trigger_desc", 256).withColumnRenamed("id", "chunk_id")
    both = [asked.join(bags(asked, "query_id", "query", n).withColumnRenamed("embedding", "vec"), "query_id") for n in (512, 256)]
    # The spaces have sizes of their own: a query row for each, which meets the vectors of its length.
    lib.queries = both[0].unionByName(both[1])
    place = {}
    for r in retrieval.recall(lib).collect():
        place.setdefault(r.query_id, []).append((-r.score, r.rank, r.chunk_id))
    ranks = []
    for i, (_, good) in enumerate(ASKED):
        names = list(dict.fromkeys(c for _, _, c in sorted(place[i])))
        ranks.append(names.index(good) + 1 if good in names else None)
    mean = lambda f: sum(f(r) if r else 0.0 for r in ranks) / len(ranks)
    figures = {"p1": mean(lambda r: r == 1), "mrr": mean(lambda r: 1 / r), "r3": mean(lambda r: r <= 3), "ndcg5": mean(lambda r: 1 / math.log2(r + 1) if r <= 5 else 0)}
    print(figures)
    assert figures["p1"] >= 0.80 and figures["mrr"] >= 0.85 and figures["r3"] >= 0.90 and figures["ndcg5"] >= 0.85


def plain_bag(text, size):
    out, word = [0.0] * size, ""
    for c in (text or "") + " ":
        if c.isalnum():
            word += c
        elif word:
            out[int(hashlib.sha256(word.lower().encode()).hexdigest()[:8], 16) % size] += 1
            word = ""
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm if norm else 0.0 for x in out]


def test_hashed_vectors_equal_a_plain_count(spark):
    rows = [("a", "The cat, the hat; THE end"), ("b", ""), ("c", None), ("d", "münchen x1 x1-y2"), ("e", "?!")]
    got = {r.id: r.embedding for r in embedding.bag_vectors(spark.createDataFrame(rows, "id string, t string"), "id", "t", 64).collect()}
    for key, text in rows:
        assert got[key] == pytest.approx(plain_bag(text, 64))


def test_packed_vectors(spark):
    rows = [("a", struct.pack("<3f", 1.5, -2.0, 0.25)), ("b", None)]
    df = spark.createDataFrame([(k, bytearray(v) if v else None) for k, v in rows], "id string, v binary")
    assert {r.id: r.v for r in embedding.unpacked(df, "v").collect()} == {"a": [1.5, -2.0, 0.25], "b": None}
    for bad in (b"", b"abc"):
        with pytest.raises(PySparkException, match="no packed vector"):
            embedding.unpacked(spark.createDataFrame([("x", bytearray(bad))], "id string, v binary"), "v").collect()


def test_projects_are_the_nearest_repository(spark):
    rows = [("a", "/w/shop/src/x"), ("b", "/w/shop"), ("c", "/w/other/deep"), ("d", "/"), ("e", "/home/me"), ("f", "/w/shop/vendor/lib/"), ("g", None)]
    roots = spark.createDataFrame([("/w/shop",), ("/w/shop/vendor/lib",), ("/w/sho",)], "path string")
    got = {r.id: r.project for r in embedding.projects(spark.createDataFrame(rows, "id string, cwd string"), roots, "/home/me").collect()}
    assert got == {"a": "shop", "b": "shop", "c": "deep", "d": None, "e": None, "f": "lib", "g": None}


def test_signatures_without_values_say_nothing(spark):
    df = spark.createDataFrame([("stage=|err=|file=",), ("stage=|err=E0425|file=",), (None,)], "s string")
    assert [r[0] for r in df.select(embedding.asked_text(F.lit("q"), F.col("s"))).collect()] == ["q", "stage=|err=E0425|file=\nq", "q"]


T = dt.datetime(2024, 1, 10)


def test_deltas_need_an_old_enough_snapshot(spark, tmp_path):
    now = lambda days: F.lit(str(T + dt.timedelta(days=days))).cast("timestamp")
    figures = lambda v: spark.createDataFrame([("debt", v)], "name string, value double")
    path = str(tmp_path / "snaps")
    assert replay.keep_snapshot(spark, path, figures(1.0), now(0))
    assert not replay.keep_snapshot(spark, path, figures(9.0), now(0.8))
    assert replay.keep_snapshot(spark, path, figures(3.0), now(8))
    kept = spark.read.schema("ts timestamp, name string, value double").parquet(path)
    assert [tuple(r) for r in replay.deltas(kept, now(8), 7).collect()] == [("debt", 3.0, 1.0, 2.0)]
    assert [tuple(r) for r in replay.deltas(kept, now(8), 30).collect()] == [("debt", 3.0, None, None)]


def test_as_of_takes_the_latest_before(spark):
    snaps = spark.createDataFrame([(T,), (T + dt.timedelta(hours=30),), (T + dt.timedelta(days=4),)], "ts timestamp")
    times = [("a", T - dt.timedelta(hours=1)), ("b", T), ("c", T + dt.timedelta(hours=29)), ("d", T + dt.timedelta(hours=30)), ("e", T + dt.timedelta(days=3)), ("f", T + dt.timedelta(days=9)), ("g", None)]
    got = {r.k: r.ts for r in replay.as_of(spark.createDataFrame(times, "k string, at timestamp"), "k", "at", snaps).collect()}
    assert got == {"a": None, "b": T, "c": T, "d": T + dt.timedelta(hours=30), "e": T + dt.timedelta(hours=30), "f": T + dt.timedelta(days=4), "g": None}


def test_replay_counts_each_gate(spark):
    lib = Library(spark, "")
    usage = [(1, "t1", "a", "selected", None, "sdk", 1, 0.9, T), (2, "t1", "b", "selected", None, "sdk", 2, 0.2, T), (3, "t0", "a", "used", "cited", "sdk", 1, None, T - dt.timedelta(days=2)), (4, "t0", None, "task_ok", None, "sdk", None, None, T - dt.timedelta(days=1)), (5, "t2", "c", "selected", None, "sdk", 1, 0.5, T)]
    lib.usage = spark.createDataFrame(usage, NONE["usage"])
    lib.log = spark.createDataFrame([("t1", T, "x", "fail", "completed", "unknown"), ("t2", T, "x", "ok", "completed", "unknown")], NONE["log"])
    shape = "verdict_id string, trace_id string, emitted_valence string, emitted_strength double, emitted_at timestamp"
    lib.verdicts = spark.createDataFrame([("v1", "t1", "affirm", 0.7, T), ("v2", "t2", "affirm", 0.7, T), ("v3", "t2", "caution", 0.1, T), ("v4", "t9", None, 0.9, T), ("v5", "t1", "affirm", 0.7, T - dt.timedelta(days=3))], shape)
    seen = {r.verdict_id: (r.dispersion, r.evident, r.directional, r.wrong) for r in replay.appraisals(lib).collect()}
    assert seen == {"v1": (0.7, 1, True, True), "v2": (0.0, 0, True, False), "v3": (0.0, 0, True, True), "v4": (0.0, 0, False, None), "v5": (0.7, 0, True, True)}
    (r,) = replay.replayed(lib, (0.5,), (1,), (0.2,)).collect()
    assert (r.abstained, r.weak_resonance, r.sparse_evidence, r.conflicted, r.prevented, r.suppressed, r.precision) == (5, 1, 3, 1, 3, 1, 0.75)
    assert (r.wrong_rate_before, r.wrong_rate_after) == (0.75, None)
