"""JSONL sources and sinks: bulk import with a report, export, labels, call traces (SRC3, SRC4, SRC7, SRC8, SRC10, SRC11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators.texts import sanitized

CHUNK = "content string, trigger_desc string, skill_name string"
LABEL = "query string, relevant_ids array<string>"
CALL = "ts string, kind string, label string, model string, status string, attempts int, latency_ms long, error string"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: value, file, and offset of the block and line that order them in a file."""
    x = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return x.select("value", F.struct("file", "block", "line").alias("place"))


def imported(lines: DataFrame, known: DataFrame, invalidated: DataFrame) -> DataFrame:
    """``lines`` (value, and place where there is an order) as chunks with status: failed (bad JSON, no content), discarded (an injection), skipped (known, invalidated or repeated), new.

    Contents are sanitised first: what would steer a model is left out, secrets
    are replaced, and the hash is that of the text that stays.  ``known`` and
    ``invalidated`` hold content_hash.  Of lines with one content the first by
    place (else by text) is new.  Running it again with its new rows in ``known``
    imports nothing.
    """
    place = F.col("place") if "place" in lines.columns else F.col("value")
    x = lines.select("value", place.alias("place"), F.from_json("value", CHUNK, {"mode": "PERMISSIVE"}).alias("c")).select("value", "place", "c.*")
    clean, action = sanitized(F.trim(F.coalesce("content", F.lit(""))))
    x = x.select("place", clean.alias("content"), action.alias("action"), "trigger_desc", "skill_name").withColumn("content_hash", F.sha2("content", 256))
    bad = x.filter("content = ''").withColumn("status", F.lit("failed")).unionByName(x.filter("content <> '' AND action = 'discard'").withColumn("status", F.lit("discarded")))
    good = x.filter("content <> '' AND action <> 'discard'")
    seen = known.select("content_hash").unionByName(invalidated.select("content_hash")).distinct().withColumn("seen", F.lit(True))
    row = F.struct("content", "trigger_desc", "skill_name")
    first = good.groupBy("content_hash").agg(F.min_by(row, "place").alias("r"), F.count(F.lit(1)).alias("times")).join(seen, "content_hash", "left")
    columns = ["content_hash", "content", "trigger_desc", "skill_name", "status"]
    new = first.select("content_hash", "r.*", F.when(F.col("seen"), "skipped").otherwise("new").alias("status"))
    none = F.lit(None).cast("string")
    again = first.filter("times > 1").select("content_hash", F.explode(F.sequence(F.lit(2), F.col("times").cast("int")))).select(
        "content_hash", none.alias("content"), none.alias("trigger_desc"), none.alias("skill_name"), F.lit("skipped").alias("status"))
    return new.select(columns).unionByName(again).unionByName(bad.select(columns))


def exported(chunks: DataFrame, include_archived: bool = False) -> DataFrame:
    """Chunks for export, oldest first, without sparks; write with ``df.write.json``."""
    keep: Column = F.col("origin") != "spark"
    keep = keep if include_archived else keep & (F.col("state") != "archived")
    return chunks.filter(keep).select("id", "content", "trigger_desc", "skill_name", "state", "created_at").orderBy("created_at", "id")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation labels; lines that are no labels are left out."""
    return spark.read.schema(LABEL).json(path).filter("query IS NOT NULL AND relevant_ids IS NOT NULL")


def calls(spark: SparkSession, path: str, limit: int, kind: str | None = None, status: str | None = None) -> DataFrame:
    """Call traces newest first; of one time by kind, label, model and the rest."""
    x = spark.read.schema(CALL).json(path).filter("ts IS NOT NULL")
    x = x.filter(F.col("kind") == kind) if kind else x
    return (x.filter(F.col("status") == status) if status else x).orderBy(F.desc("ts"), *[c for c in x.columns if c != "ts"]).limit(limit)


def append_run(summary: DataFrame, path: str, at: Column) -> None:
    """Adds the row of an evaluation run (averages, misses) to the JSONL runs under ``path``, with its time as ts."""
    summary.select(at.cast("timestamp").alias("ts"), "*").coalesce(1).write.mode("append").json(path)


def federated(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of several libraries under one, with lib_id."""
    named = [df.withColumn("lib_id", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
