"""Observability: rates, performance, calibration and summaries (O, P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library, ratio
from memspark.operators.distillation import recovered_screening, work_queue
from memspark.operators.evidence import folded, outcome_evidence, proposals, usage_counts
from memspark.operators.listing import stale_embeddings


def window_rates(lib: Library) -> DataFrame:
    """Traces of the last 1, 7 and 30 days and their rates, in one pass over traces and one over events.

    Rates: recalls without a selection, completed, timed out, with annotation
    (a known usage state), selected to used, success among outcomes, feedback
    coverage (traces with feedback among those with a selection).
    """
    span = F.explode(F.array(*[F.lit(d) for d in (1, 7, 30)])).alias("days")
    recent = lambda df: df.select("*", span).filter(F.col("ts") >= lib.as_of - F.make_dt_interval(days=F.col("days")))
    n = lambda event: F.count_if(F.col("event") == event)
    spoken = lib.feedback.select("trace_id").distinct().withColumn("spoken", F.lit(1))
    each = recent(lib.events).groupBy("days", "trace_id").agg(n("retrieved").alias("r"), n("selected").alias("s"), n("used").alias("u")).join(spoken, "trace_id", "left")
    events = each.groupBy("days").agg(F.sum("s").alias("selected"), F.sum("u").alias("used"), F.count_if((F.col("r") > 0) & (F.col("s") == 0)).alias("empty"), F.count_if(F.col("r") > 0).alias("recalls"), F.count_if((F.col("s") > 0) & F.col("spoken").isNotNull()).alias("spoken"), F.count_if(F.col("s") > 0).alias("choosing"))
    logs = recent(lib.log).groupBy("days").agg(F.count(F.lit(1)).alias("traces"), F.count_if(F.col("task_state") == "completed").alias("completed"), F.count_if(F.col("task_state") == "timed_out").alias("late"), F.count_if(F.col("usage_state") != "unknown").alias("known"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count("outcome").alias("ended"))
    x, c = logs.join(events, "days", "left"), F.col
    return x.select("days", "traces", ratio(c("empty"), c("recalls")).alias("empty_recall_rate"), ratio(c("completed"), c("traces")).alias("completed_rate"), ratio(c("late"), c("traces")).alias("timeout_rate"), ratio(c("known"), c("traces")).alias("annotation_rate"),
                    ratio(c("used"), c("selected")).alias("use_rate"), ratio(c("ok"), c("ended")).alias("success_rate"), ratio(c("spoken"), c("choosing")).alias("feedback_coverage"))


def dimension_rates(lib: Library) -> DataFrame:
    """Traces and rates by source, agent and the ten largest contexts, in one pass of grouping sets."""
    flags = lib.events.groupBy("trace_id").agg(F.count_if(F.col("event") == "selected").alias("s"), F.count_if(F.col("event") == "used").alias("u"))
    spoken = lib.feedback.select("trace_id").distinct().withColumn("spoken", F.lit(1))
    x = lib.log.withColumns({"agent": F.coalesce("agent", F.lit("(null)"))}).join(flags, "trace_id", "left").join(spoken, "trace_id", "left")
    c = F.col
    y = x.groupingSets([["event_source"], ["agent"], ["context_key"]], "event_source", "agent", "context_key").agg(
        F.count(F.lit(1)).alias("traces"), F.count_if(c("outcome") == "ok").alias("ok"), F.count("outcome").alias("ended"), F.count_if(c("task_state") == "timed_out").alias("late"), F.sum("s").alias("s"), F.sum("u").alias("u"),
        F.count_if(c("usage_state") != "unknown").alias("known"), F.count_if((c("s") > 0) & c("spoken").isNotNull()).alias("spoken"), F.count_if(c("s") > 0).alias("choosing"))
    kind = F.when(c("event_source").isNotNull(), "source").when(c("agent").isNotNull(), "agent").otherwise("context")
    y = y.select(kind.alias("dimension"), F.coalesce("event_source", "agent", "context_key").alias("value"), "traces", ratio(c("ok"), c("ended")).alias("success_rate"), ratio(c("late"), c("traces")).alias("timeout_rate"),
                 ratio(c("u"), c("s")).alias("use_rate"), ratio(c("known"), c("traces")).alias("annotation_rate"), ratio(c("spoken"), c("choosing")).alias("feedback_coverage"))
    order = Window.partitionBy("dimension").orderBy(F.desc("traces"), "value")
    return y.withColumn("nth", F.row_number().over(order)).filter("dimension <> 'context' OR nth <= 10").drop("nth")


def agent_coverage(lib: Library) -> DataFrame:
    """Share of traces with a known agent, by source."""
    return lib.log.groupBy("event_source").agg(F.count(F.lit(1)).alias("traces"), F.count("agent").alias("with_agent")).withColumn("coverage", ratio(F.col("with_agent"), F.col("traces")))


def rank_histogram(lib: Library) -> DataFrame:
    """Selected and used events by the rank they were retrieved at; null ranks form a group."""
    x = lib.events.filter("event IN ('selected', 'used')")
    return x.groupBy("rank").agg(F.count_if(F.col("event") == "selected").alias("selected"), F.count_if(F.col("event") == "used").alias("used"))


def operation_performance(lib: Library) -> DataFrame:
    """Runs, status, percentiles and success of each operation, and of each operation and agent (null agents by name)."""
    each = lib.oplog.withColumn("agent", F.coalesce("agent", F.lit("(null)")))
    x = each.groupingSets([["op"], ["op", "agent"]], "op", "agent").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "timeout").alias("timeouts"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms)").cast("double").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").cast("double").alias("p95"))
    return x.withColumn("success_rate", ratio(F.col("ok"), F.col("runs")))


def top_errors(lib: Library) -> DataFrame:
    """Errors of each operation by kind, with the last one."""
    return lib.oplog.filter("error_kind IS NOT NULL").groupBy("op", "error_kind").agg(F.count(F.lit(1)).alias("n"), F.max("started_at").alias("last_at"))


def daily_operations(lib: Library) -> DataFrame:
    """Runs and mean duration by day: tumbling windows, as the stream job gives them."""
    x = lib.oplog.groupBy(F.window("started_at", "1 day").alias("w"), "op").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"))
    return x.select(F.col("w.start").alias("day"), "op", "runs", "mean_ms")


def daily_kpis(lib: Library, back: int = 7) -> DataFrame:
    """Traces, success and time-out rate of each day, and their change against the latest day at least ``back`` days earlier.

    Days without such an earlier one have null changes.  One row a day passes
    through one window.
    """
    c = F.col
    x = lib.log.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("traces"), ratio(F.count_if(c("outcome") == "ok"), F.count("outcome")).alias("success_rate"), ratio(F.count_if(c("task_state") == "timed_out"), F.count(F.lit(1))).alias("timeout_rate"))
    earlier = Window.orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, -back)
    change = lambda name: F.round(c(name) - F.last(name).over(earlier), 3)
    return x.select(c("day").cast("timestamp").alias("day"), "traces", "success_rate", "timeout_rate", change("success_rate").alias("success_change"), change("timeout_rate").alias("timeout_change"))


def recurring_sparks(lib: Library) -> DataFrame:
    """Sparks retrieved at least recurring_min times."""
    sparks = lib.chunks.filter("origin = 'spark'").select(F.col("id").alias("chunk_id"))
    x = lib.usage.filter("event = 'retrieved'").join(sparks, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("retrievals"))
    return x.filter(F.col("retrievals") >= lib.params.recurring_min)


def library_summary(lib: Library) -> DataFrame:
    """Chunks, tokens and mean confidence by origin and state."""
    return lib.chunks.groupBy("origin", "state").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.round(F.avg("confidence_base"), 6).alias("mean_confidence"), F.count_if(F.col("confidence_base").between(0.4, 0.6)).alias("undecided"))


def rule_counts(lib: Library) -> DataFrame:
    """Validations, rules and sessions by verdict."""
    return lib.validations.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("rules"), F.count_distinct("session_id").alias("sessions"))


def provenance(lib: Library, most: int = 5) -> DataFrame:
    """The newest outcomes and feedback of each chunk; ties by time go to the smaller id."""
    a = outcome_evidence(lib).select("chunk_id", "ts", F.col("id").cast("string").alias("id"), F.when(F.col("target") == 1, "ok").otherwise("fail").alias("what"))
    b = lib.feedback.select("chunk_id", "ts", "id", F.col("signal").alias("what"))
    order = Window.partitionBy("chunk_id").orderBy(F.desc("ts"), "id")
    return a.unionByName(b).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select("chunk_id", "nth", "id", "what")


def verdict_calibration(lib: Library) -> DataFrame:
    """Claimed confidence against hit rate, by tenth."""
    x = lib.verdicts.filter("emitted_conf IS NOT NULL AND observed_outcome IS NOT NULL AND emitted_valence <> 'neutral'")
    hit = F.when(F.col("emitted_valence") == "affirm", F.col("observed_outcome") < 0).otherwise(F.col("observed_outcome") > 0).cast("double")
    y = x.groupBy(F.least(F.lit(9), F.floor(F.col("emitted_conf") * 10)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("emitted_conf"), 6).alias("claimed"), F.round(F.avg(hit), 6).alias("hit_rate"))
    return y.withColumn("gap", F.round(F.abs(F.col("claimed") - F.col("hit_rate")), 5))


def tier_calibration(lib: Library) -> DataFrame:
    """Verdicts by tier of strength: number, abstentions and failures among the observed."""
    tier = F.when(F.col("emitted_strength") >= 0.65, "strong").when(F.col("emitted_strength") >= 0.30, "medium").otherwise("weak")
    x = lib.verdicts.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("observed_outcome") > 0).alias("failed"), F.count("abstain_reason").alias("abstained"), F.count("observed_outcome").alias("observed"))
    return x.select("tier", "n", "abstained", ratio(F.col("failed"), F.col("observed")).alias("fail_rate"))


def lifecycle_block(lib: Library, days: int = 7) -> DataFrame:
    """One row: promotions and evictions of the last ``days``, the oldest pending chunk and proposal.

    ``promotions`` counts approvals, successes and restorals, ``all_promotions``
    those by validation too; sparks do not count.
    """
    c = F.col
    recent = (c("origin") != "spark") & (c("state_updated_at") >= lib.as_of - F.make_dt_interval(days=F.lit(days)))
    up = recent & (c("state") == "active")
    old = c("state_reason").isin("repeated_success", "approved", "restore")
    a = lib.states.agg(F.count_if(up & old).alias("promotions"), F.count_if(up & (old | c("state_reason").startswith("validated:"))).alias("all_promotions"), F.count_if(recent & (c("state") == "archived")).alias("evictions"))
    b = lib.chunks.filter("state = 'pending' AND origin <> 'spark'").agg(F.min("created_at").alias("oldest_pending_at"))
    d = proposals(lib).filter("becomes = 'pending'").agg(F.min("created_at").alias("oldest_proposal_at"))
    return a.join(b).join(d)


def suggestions(lib: Library) -> DataFrame:
    """action and n: what the counts call for; a count of 0 suggests nothing."""
    recent = lib.as_of - F.make_dt_interval(days=F.lit(7))
    nameless = lib.log.filter("event_source IN ('mcp', 'cli') AND agent IS NULL").filter(F.col("ts") >= recent)
    parts = [
        (stale_embeddings(lib), "rebuild_embeddings"), (work_queue(lib), "distill_new_logs"), (recurring_sparks(lib), "promote_recurring_sparks"),
        (recovered_screening(lib), "recover_screening"), (proposals(lib).filter("becomes = 'pending'"), "review_proposals"), (nameless, "name_agents"),
    ]
    out = None
    for df, action in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(action).alias("action"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def endpoint_health(lib: Library, hours: int = 24) -> DataFrame:
    """Calls of each kind in the last ``hours``: number, success, p50 and p95, commonest error; last success and error at any time.

    Percentiles take the value at the rounded index (n - 1) * p of the sorted
    latencies; they are read off counts by value, so no list of calls is built.
    Degraded: under half succeed.  Kinds without calls in the window have nulls.
    """
    c = F.col
    last = lib.calls.groupBy("kind").agg(F.max(F.when(c("status") == "ok", c("ts"))).alias("last_ok_at"), F.max(F.when(c("status") != "ok", c("ts"))).alias("last_error_at"))
    x = lib.calls.filter(c("ts") >= lib.as_of - F.make_dt_interval(hours=F.lit(hours)))
    n = x.groupBy("kind").agg(F.count(F.lit(1)).alias("calls"), F.count_if(c("status") == "ok").alias("ok"), F.count("latency_ms").alias("timed"))
    by = x.filter("latency_ms IS NOT NULL").groupBy("kind", "latency_ms").agg(F.count(F.lit(1)).alias("m")).join(n.select("kind", "timed"), "kind")
    upto = F.sum("m").over(Window.partitionBy("kind").orderBy("latency_ms"))
    at = lambda p: F.min(F.when(c("upto") > F.round((c("timed") - 1) * p), c("latency_ms")))
    mid = by.withColumn("upto", upto).groupBy("kind").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    errors = x.filter("status <> 'ok'").groupBy("kind", "status").agg(F.count(F.lit(1)).alias("e")).groupBy("kind").agg(F.min(F.struct((-c("e")).alias("e"), "status")).getField("status").alias("top_error"))
    y = last.join(n, "kind", "left").join(mid, "kind", "left").join(errors, "kind", "left")
    return y.select("kind", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.when(c("calls") > 0, ratio(c("ok"), c("calls"))).alias("success_rate"), "p50", "p95", "top_error", "last_ok_at", "last_error_at", F.coalesce(c("ok") * 2 < c("calls"), F.lit(False)).alias("degraded"))


def error_report(lib: Library) -> DataFrame:
    """Errors of each operation in the last day and week, and the last one at any time."""
    since = lambda days: F.count_if(F.col("started_at") >= lib.as_of - F.make_dt_interval(days=F.lit(days)))
    return lib.oplog.filter("status <> 'ok'").groupBy("op").agg(since(1).alias("day"), since(7).alias("week"), F.max("started_at").alias("last_at"))


def table_sizes(lib: Library) -> DataFrame:
    """name and rows of each table that grows with use."""
    out = None
    for name in ("chunks", "usage", "feedback", "log", "deps", "episodes", "validations", "verdicts", "oplog"):
        one = getattr(lib, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def explanations(lib: Library) -> DataFrame:
    """chunk_id and a sentence: successes, failures, confidence, and how long ago the last negative feedback was."""
    c = F.col
    n = outcome_evidence(lib).groupBy("chunk_id").agg(F.count_if(c("target") == 1).alias("ok"), F.count_if(c("target") == 0).alias("bad"))
    down = lib.feedback.filter("signal = 'down'").groupBy("chunk_id").agg(F.max("ts").alias("last"))
    x = n.join(folded(lib).select("chunk_id", "confidence"), "chunk_id", "left").join(down, "chunk_id", "left")
    s = F.floor((F.unix_micros(lib.as_of) - F.unix_micros(c("last").cast("timestamp"))) / 1e6).cast("long")
    unit = lambda seconds, sign: F.concat(F.floor(s / seconds).cast("string"), F.lit(f"{sign} ago"))
    ago = F.when(s < 60, "just now").when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))
    named = lambda k, one, many: F.concat(k.cast("string"), F.when(k == 1, f" {one}").otherwise(f" {many}"))
    shown = F.when(c("confidence").isNull(), "n/a").otherwise(F.format_string("%.2f", F.round("confidence", 2)))
    text = F.concat(named(c("ok"), "success", "successes"), F.lit(", "), named(c("bad"), "failure", "failures"), F.lit(" → EMA "), shown, F.when(c("last").isNull(), "").otherwise(F.concat(F.lit("; last negative feedback "), ago)))
    return x.select("chunk_id", text.alias("explanation"))


def recall_pack(lib: Library, days: int = 7) -> DataFrame:
    """One row on what recalls of the last ``days`` gave: zombies, means by trace, unused share, reciprocal rank of used chunks, silent hooks, ranks."""
    c, recent = F.col, F.col("ts") >= lib.as_of - F.make_dt_interval(days=F.lit(days))
    real = lib.chunks.filter("origin <> 'spark'").select("id", "state").join(usage_counts(lib).select("id", "selected", "used"), "id")
    a = real.agg(
        F.count_if((c("state") != "archived") & (c("selected") >= lib.params.repeat_select_min) & (c("used") == 0)).alias("zombies"),
        ratio(F.count_if((c("selected") > 0) & (c("used") == 0)), F.count_if(c("selected") > 0)).alias("selected_unused_rate"))
    by = lib.usage.filter(recent).groupBy("trace_id").agg(F.count_if(c("event") == "retrieved").alias("r"), F.count_if(c("event") == "selected").alias("s"))
    b = by.agg(F.round(F.coalesce(F.avg("r"), F.lit(0.0)), 2).alias("avg_retrieved"), F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 2).alias("avg_selected"))
    used = usage_counts(lib).filter("used > 0").select(c("id").alias("chunk_id"), F.lit(True).alias("is_used"))
    chosen = lib.usage.filter("event = 'selected' AND rank IS NOT NULL").filter(recent).join(used, "chunk_id", "left")
    within = lambda lo, hi: F.count_if(c("rank").between(lo, hi))
    d = chosen.agg(F.round(F.coalesce(F.avg(F.when(c("is_used") & (c("rank") > 0), 1 / c("rank"))), F.lit(0.0)), 3).alias("used_rank_mrr"), within(1, 1).alias("rank_1"), within(2, 3).alias("rank_2_3"), within(4, 10).alias("rank_4_10"), F.count_if(c("rank") > 10).alias("rank_over_10"))
    e = lib.log.filter("event_source = 'hook'").filter(recent).agg(ratio(F.count_if(c("usage_state") == "known_none"), F.count(F.lit(1))).alias("hook_silence_rate"))
    return a.join(b).join(d).join(e)


def rank_anomalies(lib: Library, days: int = 7, most: int = 5) -> DataFrame:
    """kind, chunk_id and best_rank of the ``most`` clearest chunks that rank high and are never used, or low and are; ties by id."""
    c, recent = F.col, F.col("ts") >= lib.as_of - F.make_dt_interval(days=F.lit(days))
    n = usage_counts(lib).select(c("id").alias("chunk_id"), "used")
    x = lib.usage.filter("event = 'selected'").filter(recent).join(n, "chunk_id")
    high = x.filter("rank <= 3 AND used = 0").groupBy("chunk_id").agg(F.min("rank").alias("best_rank")).orderBy("best_rank", "chunk_id").limit(most)
    low = x.filter("rank > 10 AND used > 0").groupBy("chunk_id").agg(F.min("rank").alias("best_rank")).orderBy(F.desc("best_rank"), "chunk_id").limit(most)
    return high.withColumn("kind", F.lit("high_rank_unused")).unionByName(low.withColumn("kind", F.lit("low_rank_used"))).select("kind", "chunk_id", "best_rank")


def intuition(lib: Library) -> DataFrame:
    """One row on verdicts whose trace is known: number, gap of success between strong and weak, ECE, false alarms, silence.

    Abstentions count as neutral and weak.
    """
    p, c = lib.params, F.col
    strength = F.coalesce("emitted_strength", F.lit(0.0))
    valence = F.when(c("abstain_reason").isNotNull(), "neutral").otherwise(F.coalesce("emitted_valence", F.lit("neutral")))
    tier = F.when(c("abstain_reason").isNotNull(), "weak").when(strength >= p.tier_strong, "strong").when(strength >= p.tier_weak, "medium").otherwise("weak")
    x = lib.verdicts.join(lib.log.select("trace_id", "outcome"), "trace_id").withColumns({"tier": tier, "valence": valence, "strength": strength})
    ended, good = c("outcome").isin("ok", "fail"), c("outcome") == "ok"
    alarm = (c("valence") == "caution") & (c("tier") == "strong") & ended
    t = x.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(ended).alias("e"), F.count_if(good).alias("ok"), F.sum(F.when(ended, c("strength"))).alias("s"),
                              F.count_if((c("tier") == "weak") | (c("valence") == "neutral")).alias("silent"), F.count_if(alarm).alias("alarms"), F.count_if(alarm & good).alias("false"))
    t = t.withColumn("hit", F.when(c("e") > 0, c("ok") / c("e")).otherwise(0.0))
    of = lambda name: F.coalesce(F.max(F.when(c("tier") == name, c("hit"))), F.lit(0.0))
    ece = F.coalesce(F.sum(F.when(c("e") > 0, c("e") * F.abs(c("s") / c("e") - c("hit")))) / F.nullif(F.sum("e"), F.lit(0)), F.lit(0.0))
    return t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("appraisals"), F.round(of("strong") - of("weak"), 3).alias("monotonicity_gap"), F.round(ece, 3).alias("ece"), ratio(F.sum("false"), F.sum("alarms")).alias("false_alarm_rate"), ratio(F.sum("silent"), F.sum("n")).alias("silence_rate"))


def kpi_snapshot(lib: Library) -> DataFrame:
    """name and value of the figures of a snapshot at the clock; -1 for the success of chat calls without any."""
    p, c = lib.params, F.col
    real = lib.chunks.filter("origin <> 'spark'").select("id", "state").join(usage_counts(lib).select("id", "selected", "used"), "id")
    a = real.agg(F.count_if(c("state") == "active").alias("active"), F.count_if(c("state") == "pending").alias("pending"), F.count_if((c("state") != "archived") & (c("selected") >= p.repeat_select_min) & (c("used") == 0)).alias("zombie_chunks"))
    a = a.withColumn("knowledge_debt_ratio", F.when(c("active") > 0, F.round(c("pending") / c("active"), 2)).otherwise(c("pending").cast("double")))
    rates = {"success_rate": "task_success_rate_7d", "empty_recall_rate": "empty_recall_rate_7d", "timeout_rate": "trace_timeout_rate_7d", "completed_rate": "completed_rate_7d", "use_rate": "selected_to_used_rate_7d", "feedback_coverage": "feedback_coverage_7d"}
    w = window_rates(lib).filter("days = 7").agg(*[F.coalesce(F.max(name), F.lit(0.0)).alias(said) for name, said in rates.items()])
    since = lambda days: c("started_at") >= lib.as_of - F.make_dt_interval(days=F.lit(days))
    day = lib.oplog.filter(since(1))
    runs = lambda op: F.count_if(c("op") == op).alias(f"{op}_runs_24h")
    o = day.agg(ratio(F.count_if((c("op") == "record") & (c("status") != "ok")), F.count_if(c("op") == "record")).alias("record_error_rate_24h"), runs("evolve"), runs("curate"), runs("hook_recall"), F.count_if(c("status") != "ok").alias("errors_24h"))
    hooks = lib.oplog.filter(since(7)).filter("op = 'hook_recall' AND duration_ms IS NOT NULL")
    by = hooks.groupBy("duration_ms").agg(F.count(F.lit(1)).alias("m"))
    # One row a distinct duration in milliseconds passes through this window.
    by = by.withColumns({"upto": F.sum("m").over(Window.orderBy("duration_ms")), "all": F.sum("m").over(Window.partitionBy())})
    h = by.agg(F.coalesce(F.min(F.when(c("upto") > F.round((c("all") - 1) * 0.95), c("duration_ms"))), F.lit(0)).alias("hook_recall_p95_ms_7d"))
    chat = endpoint_health(lib).filter("kind = 'chat'").agg(F.coalesce(F.max("success_rate"), F.lit(-1.0)).alias("llm_chat_success_rate_24h"))
    one = a.join(w).join(o).join(h).join(chat)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c(n).cast("double").alias("value")) for n in one.columns])).alias("k")).select("k.*")
