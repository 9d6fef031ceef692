"""Requests about chunks and sparks, taking in of contents, and repair of what older releases wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators.evidence import counter_baseline, trace_lifecycle
from memspark.operators.texts import sanitized, sanitizing
from memspark.tables import stored

# Kinds and sources that are taken in, confidence of skills, of other contents and of those with keys replaced.
KINDS, SOURCES = ["note", "skill"], ["chat", "manual", "doc", "agent"]
SKILL, OTHER, REDACTED = 0.85, 0.60, 0.40


def _gone(lib: Library) -> DataFrame:
    """Hashes of archived chunks."""
    return lib.chunks.filter("state = 'archived'").select(F.col("content_hash").alias("hash")).distinct().withColumn("gone", F.lit(True))


def _present(lib: Library) -> DataFrame:
    """The oldest chunk in use (ties: smaller id) of each hash; sparks do not count."""
    x = lib.chunks.filter("origin <> 'spark' AND state IN ('active', 'pending')").groupBy(F.col("content_hash").alias("hash"))
    return x.agg(F.min_by("id", F.struct("created_at", "id")).alias("existing"))


def spark_transitions(lib: Library) -> DataFrame:
    """id, failure, becomes, chunk_id and confidence of each request about a spark.

    mature: seed to sprouting to incubating.  promote: to a note or skill; a
    chunk in use with the content stands in for a new one.  drop: not after
    promotion.
    """
    c = F.col
    own = lib.chunks.filter("origin = 'spark'").select(c("id").alias("spark_id"), F.coalesce("maturity", F.lit("seed")).alias("maturity"), "content")
    clean, action = sanitized(c("content"))
    x = lib.spark_requests.withColumnRenamed("action", "request").join(own, "spark_id", "left").withColumns({"verdict": action, "hash": F.sha2(clean, 256)})
    x = x.join(_gone(lib), "hash", "left").join(_present(lib), "hash", "left")
    closed = F.concat(F.lit("already_"), "maturity")
    following = F.when(c("maturity") == "seed", "sprouting").when(c("maturity") == "sprouting", "incubating")
    mature = F.when(following.isNull(), closed).when((c("target") != c("maturity")) & (c("target") != following), "invalid_transition")
    promote = F.when(c("maturity").isin("promoted", "dropped"), closed).when(~c("target").isin(KINDS), "invalid_target").when(c("verdict") == "discard", "discarded").when(c("gone"), "hash_invalidated")
    drop = F.when(c("maturity") == "promoted", closed)
    failure = F.when(c("maturity").isNull(), "chunk_not_found").when(c("request") == "mature", mature).when(c("request") == "promote", promote).when(c("request") == "drop", drop).otherwise("unknown_action")
    becomes = F.when(c("request") == "mature", c("target")).when(c("request") == "promote", "promoted").otherwise("dropped")
    y = x.withColumns({"failure": failure, "becomes": F.when(failure.isNull(), becomes)})
    new = (c("becomes") == "promoted") & (c("request") == "promote")
    confidence = F.when(c("verdict") == "redact", REDACTED).when(c("target") == "skill", SKILL).otherwise(OTHER)
    return y.select("id", "failure", "becomes", F.when(new, c("existing")).alias("chunk_id"), F.when(new & c("existing").isNull(), confidence).alias("confidence"))


def ingested(lib: Library) -> DataFrame:
    """id, status, chunk_id, origin, state and confidence of each content to take in.

    Status: invalid_kind, invalid_source, empty_content, discarded (injection),
    hash_invalidated, existing (with the chunk in use, or the first row of the
    batch with that content), else added.  Contents of agents wait as pending.
    """
    c = F.col
    each = lib.ingest.withColumn("s", sanitizing(c("content")))
    empty = F.coalesce(F.trim("content"), F.lit("")) == ""
    read = stored(each.select("id", "kind", "source", "ts", empty.alias("empty"), "s.action", F.sha2("s.clean", 256).alias("hash")), "ingest")
    x = read.join(_gone(lib), "hash", "left").join(_present(lib), "hash", "left")
    refused = (
        F.when(~F.coalesce(c("kind").isin(KINDS), F.lit(False)), "invalid_kind").when(~F.coalesce(c("source").isin(SOURCES), F.lit(False)), "invalid_source")
        .when(c("empty"), "empty_content").when(c("action") == "discard", "discarded").when(c("gone"), "hash_invalidated")
    )
    x = x.withColumn("refused", refused)
    first = x.filter("refused IS NULL").groupBy("hash").agg(F.min_by("id", F.struct("ts", "id")).alias("first"))
    y = x.join(first, "hash", "left")
    chunk = F.coalesce("existing", F.when(c("first") != c("id"), c("first")))
    status = F.when(c("refused").isNotNull(), c("refused")).when(chunk.isNotNull(), "existing").otherwise("added")
    y = y.withColumns({"status": status, "chunk": F.when(c("refused").isNull(), chunk)})
    new = lambda value: F.when(c("status") == "added", value)
    agent, skill = c("source") == "agent", c("kind") == "skill"
    confidence = F.when(c("action") == "redact", REDACTED).when(skill & ~agent, SKILL).otherwise(OTHER)
    return y.select("id", "status", c("chunk").alias("chunk_id"), new(F.when(skill & ~agent, "installed").otherwise("captured")).alias("origin"), new(F.when(agent, "pending").otherwise("active")).alias("state"), new(confidence).alias("confidence"))


def repaired_traces(lib: Library) -> DataFrame:
    """One row: the daemon's retrieved and selected events that go, open traces that are retired, selections before and after.

    Selections before are the stored counters, after them their base and the
    events that stay after a chunk's cutoff; sparks do not count.  Open traces of
    the daemon, or without a selection, are retired.
    """
    c, zero = F.col, lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    false = (c("source") == "daemon") & c("event").isin("selected", "retrieved")
    chosen = lib.usage.filter("event = 'selected'")
    deleted = lib.usage.agg(F.count_if(false).alias("events_deleted"))
    idle = trace_lifecycle(lib).filter("distill_state = 'open'").join(lib.log.select("trace_id", "event_source"), "trace_id").join(chosen.select("trace_id", F.lit(True).alias("chose")).distinct(), "trace_id", "left")
    retired = idle.agg(F.count_if((c("event_source") == "daemon") | c("chose").isNull()).alias("traces_retired"))
    real = lib.chunks.filter("origin <> 'spark'").select("id", "evidence_cutoff_at")
    before = lib.counters.join(real, "id", "left_semi").agg(zero("selected_count").alias("selected_before"))
    base = counter_baseline(lib).join(real, "id", "left_semi").agg(zero("base").alias("base"))
    live = chosen.filter(~false).join(real, c("chunk_id") == real.id).filter("evidence_cutoff_at IS NULL OR ts > evidence_cutoff_at").agg(F.count(F.lit(1)).alias("live"))
    return deleted.join(retired).join(before).join(base).join(live).select("events_deleted", "traces_retired", "selected_before", (c("base") + c("live")).alias("selected_after"))


def iso_time(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` as ISO with milliseconds; other texts as they are."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.concat(F.translate(text, " ", "T"), F.lit(".000Z"))).otherwise(text)


def backfilled(lib: Library) -> DataFrame:
    """Rows of older releases as they are written now: ISO times, source sdk where it is missing, explicit use, state by outcome."""
    used = F.when(F.col("used"), F.coalesce("attribution", F.lit("explicit")))
    return lib.old_rows.select("id", iso_time(F.col("ts")).alias("ts"), F.coalesce("source", F.lit("sdk")).alias("source"), used.alias("attribution"), F.when(F.col("outcome").isNotNull(), "completed").otherwise("recalled").alias("task_state"))
