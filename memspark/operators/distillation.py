"""Distilling of logs into chunks without a model, its queue and its token account (D, F9, F10, C14, N12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators.texts import REPORTS, any_of, sanitizing

# Lengths of trigger and counter-trigger, confidence of new chunks, attempts, waits in minutes, related logs.
TRIGGER, COUNTER = 80, 60
SEED, SEED_REDACTED = 0.55, 0.40
ATTEMPTS, RETRY_MINUTES, SCREENING_MINUTES, RELATED = 3, 5, 30, 4


def stripped(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _tokens(text: Column) -> Column:
    """Tokens of a text by its bytes; 0 for null."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def _before(lib: Library, minutes: int) -> Column:
    return lib.as_of - F.make_dt_interval(mins=F.lit(minutes))


def work_queue(lib: Library, most: int | None = None) -> DataFrame:
    """id, priority and ts of the logs to distil: urgent first, then old, then by id; all, or the ``most`` first."""
    x = lib.distill.filter("distill_state = 'new'").select("id", "priority", "ts")
    return x if most is None else x.orderBy(F.desc("priority"), "ts", "id").limit(most)


def retries(lib: Library) -> DataFrame:
    """id and attempts of failed logs to try again: fewer than ATTEMPTS tries, the last (else the log) over RETRY_MINUTES ago."""
    ready = (F.col("attempts") < ATTEMPTS) & (F.coalesce("last_failed_at", "ts") < _before(lib, RETRY_MINUTES))
    return lib.distill.filter("distill_state = 'failed'").filter(ready).select("id", "attempts")


def recovered_screening(lib: Library) -> DataFrame:
    """Logs locked for over SCREENING_MINUTES become failed: id, attempts after that and note."""
    stuck = lib.distill.filter("distill_state = 'screening'").filter(F.col("locked_at") < _before(lib, SCREENING_MINUTES))
    return stuck.select("id", (F.col("attempts") + 1).alias("attempts"), F.concat(F.lit("screening_timeout:"), F.coalesce("run_id", F.lit("unknown"))).alias("note"))


def distilled(lib: Library) -> DataFrame:
    """One chunk of each log that says something: source_id, content, trigger_desc, anti_trigger_desc and skill_name.

    The nomination is kept as it is; else the summary, unless it is a mere status
    report, with "Avoid: " before it for a failure.  Trigger: the query, else the
    first line of over 10 bytes.  Counter-trigger: the query of a failure.
    Label: three words of the trigger.  Logs with neither text give no row.
    """
    text, query = stripped(F.coalesce("nomination", "output_summary")), stripped(F.coalesce("query", F.lit("")))
    x = lib.distill.withColumns({"t": text, "q": query}).filter("t <> ''").filter(F.col("nomination").isNotNull() | ~any_of(F.lower("t"), REPORTS))
    line = F.get(F.filter(F.transform(F.split("t", "\n"), stripped), lambda one: F.octet_length(one) > 10), 0)
    failed = F.coalesce(F.col("outcome") == "fail", F.lit(False))
    x = x.withColumn("trigger_desc", F.substring(F.when(F.col("q") != "", F.col("q")).otherwise(line), 1, TRIGGER))
    content = F.when(F.col("nomination").isNull() & failed, F.concat(F.lit("Avoid: "), "t")).otherwise(F.col("t"))
    words = F.array_join(F.slice(F.filter(F.split("trigger_desc", r"\s+"), lambda w: w != ""), 1, 3), " ")
    return x.select(F.col("id").alias("source_id"), content.alias("content"), "trigger_desc", F.when(failed & (F.col("q") != ""), F.substring("q", 1, COUNTER)).alias("anti_trigger_desc"), F.when(words != "", words).alias("skill_name"))


def distilled_chunks(lib: Library) -> DataFrame:
    """``distilled`` as digests: source_id, hash of the content, trigger_desc, anti_trigger_desc and skill_name."""
    return distilled(lib).select("source_id", F.sha2("content", 256).alias("hash"), "trigger_desc", "anti_trigger_desc", "skill_name")


def prompt_tokens(lib: Library) -> DataFrame:
    """id and tokens of the prompt of each log: its own texts, and up to RELATED other logs of its context.

    Others come in the order of the queue.  Only the first RELATED + 1 logs of a
    context are ever related, so they alone are gathered, however many it has.
    """
    own = _tokens(F.col("query")) + _tokens(F.col("output_summary")) + _tokens(F.col("nomination"))
    shown = _tokens(F.col("query")) + _tokens(F.col("output_summary")) + _tokens(F.col("outcome"))
    x = lib.distill.select("id", "context_key", "priority", "ts", own.alias("own"), shown.alias("shown"))
    order = Window.partitionBy("context_key").orderBy(F.desc("priority"), "ts", "id")
    first = x.filter("context_key IS NOT NULL").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= RELATED + 1)
    sums = first.groupBy("context_key").agg(F.sum(F.when(F.col("nth") <= RELATED, F.col("shown")).otherwise(0)).alias("four"), F.sum("shown").alias("five"))
    mine = first.filter(F.col("nth") <= RELATED).select("id", F.col("shown").alias("mine"))
    y = x.join(sums, "context_key", "left").join(mine, "id", "left")
    related = F.when(F.col("mine").isNotNull(), F.col("five") - F.col("mine")).otherwise(F.coalesce("four", F.lit(0)))
    return y.select("id", (F.col("own") + related).cast("long").alias("prompt_tokens"))


def distilled_batch(lib: Library) -> DataFrame:
    """What becomes of each log to distil: id, state, note, and hash and confidence of its chunk.

    No chunk: discarded as insufficient_material.  A chunk with an injection, or
    with the hash of an archived one: discarded as all_chunks_filtered.  Else
    distilled, less trusted where keys were replaced.
    """
    gone = lib.chunks.filter("state = 'archived'").select(F.col("content_hash").alias("hash")).distinct().withColumn("gone", F.lit(True))
    new = lib.distill.filter("distill_state = 'new'")
    made = distilled(lib.replaced(distill=new)).select(F.col("source_id").alias("id"), sanitizing(F.col("content")).alias("s"))
    made = made.select("id", F.sha2("s.clean", 256).alias("hash"), "s.action").join(gone, "hash", "left")
    x = new.select("id").join(made, "id", "left")
    note = F.when(F.col("action").isNull(), "insufficient_material").when((F.col("action") == "discard") | F.col("gone").isNotNull(), "all_chunks_filtered")
    kept = lambda c: F.when(F.col("note").isNull(), c)
    confidence = F.when(F.col("action") == "redact", SEED_REDACTED).otherwise(SEED)
    return x.withColumn("note", note).select("id", F.when(F.col("note").isNull(), "distilled").otherwise("discarded").alias("state"), "note", kept(F.col("hash")).alias("hash"), kept(confidence).alias("confidence"))


def token_usage(lib: Library, days: int = 7, limit: int = 100_000) -> DataFrame:
    """One row: logs of the last ``days``, their prompt and completion tokens, and whether they reach the limit; zeros without any."""
    recent = lib.distill.filter(F.col("ts") >= lib.as_of - F.make_dt_interval(days=F.lit(days))).select("id")
    done = distilled(lib).select(F.col("source_id").alias("id"), (_tokens(F.col("content")) + _tokens(F.col("trigger_desc")) + _tokens(F.col("anti_trigger_desc"))).alias("completion"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    x = recent.join(prompt_tokens(lib), "id").join(done, "id", "left").agg(F.count(F.lit(1)).alias("logs"), zero("prompt_tokens").alias("prompt_tokens"), zero("completion").alias("completion_tokens"))
    return x.withColumn("exceeded", F.col("prompt_tokens") + F.col("completion_tokens") >= limit)
