"""Replay of the critic's gates over what was appraised, and stored figures as they were at a time (P9, J13, SRC9, O8)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.tables import stored

#: Settings of the gates that are replayed: floor of strength, contributors with evidence, ceiling of dispersion.
FLOORS, EVIDENCE, CEILINGS = (0.2, 0.5), (0, 1), (0.2, 1.0)
#: Fixed value: hours between two stored snapshots at least.
THROTTLE = 20


def appraisals(lib: Library) -> DataFrame:
    """verdict_id, strength, dispersion, evident, directional and wrong of each verdict, as it stood when it was given.

    A verdict's contributors are the chunks that its trace selected; dispersion
    is how far their similarities lie apart; ``evident`` counts those of which an
    outcome was known before the verdict: only the first one's time matters, so
    each chunk brings one row.  wrong is null without an outcome of the trace.
    """
    ends = lib.facts.filter("event IN ('task_ok', 'task_fail')").select("trace_id", F.col("ts").alias("ended_at"))
    known = lib.facts.filter("event = 'used'").select("trace_id", "chunk_id").join(ends, "trace_id").groupBy("chunk_id").agg(F.min("ended_at").alias("known_at"))
    chosen = lib.facts.filter("event = 'selected'").select("trace_id", "chunk_id", "similarity").join(known, "chunk_id", "left")
    v = lib.verdicts.select("verdict_id", "trace_id", "emitted_at", F.col("emitted_strength").alias("strength"), F.coalesce("emitted_valence", F.lit("neutral")).alias("valence"))
    seen = v.select("verdict_id", "trace_id", "emitted_at").join(chosen, "trace_id").groupBy("verdict_id").agg(F.round(F.max("similarity") - F.min("similarity"), 6).alias("dispersion"), F.count_if(F.col("known_at") < F.col("emitted_at")).alias("evident"))
    x = v.join(lib.log.select("trace_id", "outcome"), "trace_id", "left").join(seen, "verdict_id", "left")
    wrong = F.when(F.col("outcome").isin("ok", "fail"), ((F.col("valence") == "affirm") & (F.col("outcome") == "fail")) | ((F.col("valence") == "caution") & (F.col("outcome") == "ok")))
    return x.select("verdict_id", "strength", F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"), F.coalesce("evident", F.lit(0)).cast("long").alias("evident"), F.col("valence").isin("affirm", "caution").alias("directional"), wrong.alias("wrong"))


def replayed(lib: Library, floors: tuple = FLOORS, evidence: tuple = EVIDENCE, ceilings: tuple = CEILINGS) -> DataFrame:
    """A row for each setting of the gates: how many verdicts would have been held back, by which gate, and what of the directional ones.

    Gates in order: strength below the floor, too few contributors with evidence,
    dispersion above the ceiling.  prevented: held back and wrong; suppressed:
    held back and right; precision: the share of prevented ones.  Wrong rates
    are those of directional verdicts with an outcome, without and with gates.
    All settings are counted in one pass.
    """
    grid = [F.struct(F.lit(float(f)).alias("floor"), F.lit(int(e)).alias("least"), F.lit(float(c)).alias("ceiling")) for f, e, c in itertools.product(floors, evidence, ceilings)]
    x = appraisals(lib).withColumn("s", F.explode(F.array(*grid))).select("*", "s.*")
    gate = F.when(F.col("strength") < F.col("floor"), "weak_resonance").when(F.col("evident") < F.col("least"), "sparse_evidence").when(F.col("dispersion") > F.col("ceiling"), "conflicted")
    x = x.withColumn("gate", gate)
    judged, held = F.col("directional") & F.col("wrong").isNotNull(), F.col("gate").isNotNull()
    n = lambda cond, name: F.count_if(cond).alias(name)
    y = x.groupBy("floor", "least", "ceiling").agg(
        F.count(F.lit(1)).alias("appraisals"), n(held, "abstained"), n(F.col("gate") == "weak_resonance", "weak_resonance"), n(F.col("gate") == "sparse_evidence", "sparse_evidence"), n(F.col("gate") == "conflicted", "conflicted"),
        n(held & judged & F.col("wrong"), "prevented"), n(held & judged & ~F.col("wrong"), "suppressed"), n(judged, "judged"), n(judged & F.col("wrong"), "wrong_before"), n(judged & ~held, "kept"), n(judged & ~held & F.col("wrong"), "wrong_after"),
    )
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    c = F.col
    return y.select(
        "floor", "least", "ceiling", "appraisals", "abstained", rate(c("abstained"), c("appraisals")).alias("abstain_rate"), "weak_resonance", "sparse_evidence", "conflicted", "prevented", "suppressed",
        rate(c("prevented"), c("prevented") + c("suppressed")).alias("precision"), rate(c("wrong_before"), c("judged")).alias("wrong_rate_before"), rate(c("wrong_after"), c("kept")).alias("wrong_rate_after"),
    )


# --- stored figures ---


def keep_snapshot(spark: SparkSession, path: str, figures: DataFrame, now: Column) -> bool:
    """Appends ``figures`` (name, value) under the time ``now``, unless the last snapshot is less than THROTTLE hours old; whether it did."""
    at = spark.range(1).select(now.cast("timestamp").alias("t")).first().t
    try:
        last = spark.read.schema("ts timestamp, name string, value double").parquet(path).agg(F.max("ts")).first()[0]
    except Exception as x:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(x):
            raise
        last = None
    if last is not None and (at - last).total_seconds() < THROTTLE * 3600:
        return False
    figures.select(F.lit(at).alias("ts"), "name", F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)
    return True


def throttled(rows: DataFrame) -> DataFrame:
    """``rows`` (ts, name, value) without snapshots that follow a kept one by less than THROTTLE hours.

    Times are one short list: a snapshot is one time, with a row for each figure.
    """
    times = rows.select("ts").distinct().agg(F.array_sort(F.collect_list("ts")).alias("t"))
    start = F.array().cast("array<timestamp>")
    ok = lambda kept, t: (F.size(kept) == 0) | (F.unix_micros(t) - F.unix_micros(F.try_element_at(kept, F.lit(-1))) >= THROTTLE * 3_600_000_000)
    kept = times.select(F.explode(F.aggregate("t", start, lambda acc, t: F.when(ok(acc, t), F.concat(acc, F.array(t))).otherwise(acc))).alias("ts"))
    return rows.join(kept, "ts", "left_semi")


def as_of(left: DataFrame, key: str, at: str, snapshots: DataFrame) -> DataFrame:
    """``left`` (key, at) with ts of the latest of ``snapshots`` (ts) at or before ``at``; null without one.

    Both sides are dealt by day.  In a day the rows are sorted together and each
    takes the last snapshot before it; the last one of earlier days is carried
    over from a list that has a row for each day with snapshots.
    """
    times = snapshots.select("ts").distinct()
    day = lambda c: F.to_date(c).alias("day")
    rows = left.select(F.col(key).alias("k"), F.col(at).alias("at")).withColumn("day", F.to_date("at"))
    marks = times.select(F.lit(None).cast(left.schema[key].dataType).alias("k"), F.col("ts").alias("at"), day("ts"), F.lit(0).alias("o"), F.col("ts").alias("s"))
    both = rows.withColumns({"o": F.lit(1), "s": F.lit(None).cast("timestamp")}).unionByName(marks)
    own = F.last("s", ignorenulls=True).over(Window.partitionBy("day").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = both.withColumn("own", own).filter("o = 1").select("k", "at", "day", "own")
    days = rows.select("day").distinct()
    lasts = times.groupBy(day("ts")).agg(F.max("ts").alias("last"))
    line = days.join(lasts, "day", "full_outer")
    carry = line.withColumn("carried", F.max("last").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "carried")
    return inside.join(carry, "day", "left").select(F.col("k").alias(key), F.col("at").alias(at), F.coalesce("own", "carried").alias("ts"))


def deltas(snapshots: DataFrame, now: Column, days: int) -> DataFrame:
    """name, value, before and delta of each figure: the latest snapshot up to ``now`` against the latest that is ``days`` old at least.

    Without so old a snapshot before and delta are null.
    """
    old = F.col("ts") <= now - F.make_dt_interval(days=F.lit(days))
    x = snapshots.filter(F.col("ts") <= now).groupBy("name").agg(F.max_by("value", "ts").alias("value"), F.max_by("value", F.when(old, F.col("ts"))).alias("before"), F.count_if(old).alias("n"))
    before = F.when(F.col("n") > 0, F.col("before"))
    return x.select("name", "value", before.alias("before"), F.round(F.col("value") - before, 6).alias("delta"))


def daily_snapshots(lib: Library) -> DataFrame:
    """ts, name and value of figures at the last event of each day: runs, errors and mean duration so far, at most one in THROTTLE hours."""
    each = lib.oplog.groupBy(F.to_date("started_at").alias("day")).agg(F.max("started_at").cast("timestamp").alias("ts"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") != "ok").alias("errors"), F.sum("duration_ms").alias("ms"))
    so_far = Window.partitionBy(F.lit(0)).orderBy("day")  # a row for each day
    x = each.select("ts", F.sum("runs").over(so_far).alias("runs"), F.sum("errors").over(so_far).alias("errors"), F.sum("ms").over(so_far).alias("ms"))
    named = F.array(F.struct(F.lit("runs").alias("name"), F.col("runs").cast("double").alias("value")), F.struct(F.lit("errors").alias("name"), F.col("errors").cast("double").alias("value")), F.struct(F.lit("mean_ms").alias("name"), F.round(F.col("ms") / F.col("runs"), 3).alias("value")))
    return throttled(x.select("ts", F.explode(named).alias("v")).select("ts", "v.*"))


def snapshot_deltas(lib: Library) -> DataFrame:
    """days, name, value, before and delta over 1, 7 and 60 days."""
    s, out = stored(daily_snapshots(lib), "snapshots"), None
    for days in (1, 7, 60):
        part = deltas(s, lib.as_of, days).select(F.lit(days).alias("days"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def verdict_snapshots(lib: Library) -> DataFrame:
    """verdict_id, ts and runs of the snapshot that was the latest when each verdict was given."""
    s = stored(daily_snapshots(lib), "snapshots")
    met = as_of(lib.verdicts.select("verdict_id", F.col("emitted_at").cast("timestamp").alias("emitted_at")), "verdict_id", "emitted_at", s)
    runs = s.filter("name = 'runs'").select("ts", F.col("value").alias("runs"))
    return met.join(runs, "ts", "left").select("verdict_id", "ts", "runs")
