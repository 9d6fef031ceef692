"""Log lines to events, idempotent delivery, daily windows, first display and traces from reports in any order (SRC6, ST2, ST4, ST8, R22)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from memspark.operators.episodes import STRENGTH

#: Phrases by kind, tried in this order, and kinds of JSON events.
PATTERNS = [
    ("end", ["Session ended", "Session End", "Conversation closed", "IDE exited"]), ("start", ["Starting ", "Running ", "Executing ", "BEGIN ", "Task started"]),
    ("ok", ["Build successful", "Tests passed", "✓ ", " passed"]), ("fail", ["SyntaxError", "Error:", "FAILED", "test result: FAILED"]),
]
KINDS = {"session_start": "start", "tool_success": "ok", "tool_error": "fail", "session_end": "end", "user_feedback": "feedback"}
EVENT = "event_id string, event_type string, trace_id string, ts timestamp, duration_ms long, op string"
#: Days that a trace stays open for reports.
OPEN_DAYS = 14
REDUCED = "trace_id string, used string, attributions string, complete boolean, outcome string, usage_state string"


def kind_of(line: Column) -> Column:
    """Kind of a text line by the first phrase that it holds, in order; null without one."""
    out = None
    for kind, phrases in PATTERNS:
        holds = F.lit(False)
        for phrase in phrases:
            holds = holds | F.contains(line, F.lit(phrase))
        out = F.when(holds, kind) if out is None else out.when(holds, kind)
    return out


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` (value), batch or stream, as events: JSON by its type, other lines by their phrases; the rest goes."""
    x = lines.select("value", F.from_json("value", EVENT).alias("e")).select("value", "e.*")
    named = F.lit(None).cast("string")
    for told, kind in KINDS.items():
        named = F.when(F.col("event_type") == told, kind).otherwise(named)
    said = F.when(F.col("event_type").isNotNull(), named).otherwise(kind_of(F.col("value")))
    ident = F.coalesce("event_id", F.sha2("value", 256))
    return x.select(ident.alias("event_id"), said.alias("event_type"), "trace_id", "ts", "duration_ms", "op").filter("event_type IS NOT NULL")


def once(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each event id once; a stream forgets ids after ``delay``."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def shown_once(shown: DataFrame, delay: str = "1 day") -> DataFrame:
    """``shown`` (chunk_id, session_id, ts) with each rule once in a session; a stream forgets a session ``delay`` after its last event."""
    if not shown.isStreaming:
        return shown.groupBy("chunk_id", "session_id").agg(F.min("ts").alias("ts"))
    return shown.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["chunk_id", "session_id"])


def daily(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Runs and mean duration of each operation and day."""
    x = events.withWatermark("ts", delay) if events.isStreaming else events
    y = x.groupBy(F.window("ts", "1 day").alias("w"), "op").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"))
    return y.select(F.col("w.start").alias("day"), "op", "runs", "mean_ms")


def _pruned(reports: list[dict]) -> list[dict]:
    """``reports`` in order, from the last complete one on, and the last with a known outcome."""
    reports = sorted({(r["ts"], r["id"]): r for r in reports}.values(), key=lambda r: (r["ts"], r["id"]))
    resets = [i for i, r in enumerate(reports) if r["complete"] and r["used"] is not None]
    known = [i for i, r in enumerate(reports) if r["outcome"] in ("ok", "fail")]
    return [r for i, r in enumerate(reports) if (not resets or i >= resets[-1]) or (known and i == known[-1])]


def _reduction(trace_id: str, reports: list[dict]) -> dict:
    """What pruned ``reports`` come to, as ``episodes.reduced_traces`` gives it."""
    resets = [i for i, r in enumerate(reports) if r["complete"] and r["used"] is not None]
    said = [r for r in reports[resets[-1] if resets else 0 :] if r["used"] is not None]
    best: dict[str, str] = {}
    for r in said:
        for chunk in filter(None, r["used"].split(",")):
            best[chunk] = max(best.get(chunk, ""), r["attribution"] or "", key=lambda a: STRENGTH.get(a, 0))
    known = [r["outcome"] for r in reports if r["outcome"] in ("ok", "fail")]
    state = "unknown" if not said else "known_some" if best else "known_none"
    return {"trace_id": trace_id, "used": ",".join(best), "attributions": ",".join(best.values()), "complete": bool(resets), "outcome": known[-1] if known else None, "usage_state": state}


def reduced(reports: DataFrame) -> DataFrame:
    """A stream of ``reports`` (trace_id, ts, id, complete, used, attribution, outcome) as traces, in update mode.

    Reports may come in any order and more than once: a trace's latest row is
    what the batch form gives for all that has come.  The state holds what came
    after the last complete report, and goes OPEN_DAYS after the last report.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        for frame in frames:
            for r in frame.itertuples(index=False):
                text = lambda v: None if pd.isna(v) else str(v)
                held.append({"ts": r.ts.value // 1000, "id": str(r.id), "complete": bool(r.complete), "used": text(r.used), "attribution": text(r.attribution), "outcome": text(r.outcome)})
        held = _pruned(held)
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, max(r["ts"] for r in held) // 1000 + OPEN_DAYS * 86_400_000))
        yield pd.DataFrame([_reduction(key[0], held)])

    return reports.withWatermark("ts", f"{OPEN_DAYS} days").groupBy("trace_id").applyInPandasWithState(step, REDUCED, "reports string", "update", "EventTimeTimeout")
