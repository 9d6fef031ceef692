"""Deadlines and sessions of a stream: keyed state with event-time timers (ST5, ST7)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DUE = "key string, outcome string, at timestamp"
SESSION = "session_id string, started timestamp, ended timestamp, calls long, failures long, tools string, ended_by string"
#: Minutes of each deadline.
SCREENING, SHOWN, OPEN, EPISODE = 30, 2 * 1440, 14 * 1440, 60 * 1440


def _millis(frames: pd.Series) -> list[int]:
    return (frames.astype("int64") // 10 ** (3 if "us" in str(frames.dtype) else 6)).tolist()


class Deadline(StatefulProcessor):
    """A key that has begun and not ended by its deadline is given out, once.

    The latest beginning counts.  An end of the same or a later time takes the
    deadline back, whichever of them arrives first; an end without a beginning
    is remembered as long as a deadline would run.
    """

    def __init__(self, minutes: int, starts: list[str], outcome: str) -> None:
        self.wait, self.starts, self.outcome = minutes * 60_000, starts, outcome

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "began long, over long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        began, over = self.held.get() if self.held.exists() else (-1, -1)
        for frame in rows:
            for kind, at in zip(frame["kind"], _millis(frame["ts"]), strict=True):
                if kind in self.starts:
                    began = max(began, at)
                else:
                    over = max(over, at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.update((began, over))
        self.handle.registerTimer(max(began, over) + self.wait)
        yield pd.DataFrame({"key": pd.Series(dtype=str), "outcome": pd.Series(dtype=str), "at": pd.Series(dtype="datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        began, over = self.held.get()
        self.held.clear()
        if began > over:
            yield pd.DataFrame({"key": [key[0]], "outcome": [self.outcome], "at": [pd.Timestamp(began + self.wait, unit="ms")]})

    def close(self) -> None:
        pass


def _due(rows: DataFrame, minutes: int, starts: list[str], outcome: str, delay: str) -> DataFrame:
    """key, outcome and at of each key of ``rows`` (key, kind, ts) that is not over ``minutes`` after it began; a stream in append mode."""
    x = rows.select("key", "kind", "ts").filter("key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    return x.groupBy("key").transformWithStateInPandas(Deadline(minutes, starts, outcome), DUE, "Append", "EventTime")


def overdue(rows: DataFrame, minutes: int, starts: list[str], outcome: str, until) -> DataFrame:
    """The batch form of the same, as of ``until``."""
    last = lambda is_start: F.max(F.when(F.col("kind").isin(starts) == is_start, F.col("ts")))
    x = rows.filter("key IS NOT NULL AND ts IS NOT NULL").groupBy("key").agg(last(True).alias("began"), last(False).alias("over"))
    at = F.col("began") + F.make_dt_interval(mins=F.lit(minutes))
    return x.filter((F.col("over").isNull() | (F.col("over") < F.col("began"))) & (at < until)).select("key", F.lit(outcome).alias("outcome"), at.alias("at"))


def timed_out_traces(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Traces (kind recalled or completed) that are still open after 14 days."""
    return _due(rows, OPEN, ["recalled"], "timed_out", delay)


def stuck_screening(rows: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Logs (kind screening, or anything after it) that are screened for over 30 minutes."""
    return _due(rows, SCREENING, ["screening"], "failed", delay)


def unobserved(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Shown rules (kind shown or observed) that nothing was observed of for 2 days."""
    return _due(rows, SHOWN, ["shown"], "unknown", delay)


def expired_episodes(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Episodes (kind new, or anything after it) that gave no rule for 60 days."""
    return _due(rows, EPISODE, ["new"], "expired", delay)


class Session(StatefulProcessor):
    """A session's counts until its end is told, or until ``gap`` minutes pass without an event; rows that arrive after that begin a new one.

    Events that lie ``gap`` apart are sessions of their own, in whatever order
    they come: the state holds one entry of counts for each that is still open.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "open string")

    def _due(self, entry: dict) -> int:
        # An end waits for the watermark too, so that late rows of the session still count.
        return entry["last"] + (1 if entry["over"] else self.gap)

    def _keep(self, entries: list[dict]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if entries:
            self.held.update((json.dumps(entries),))
            self.handle.registerTimer(min(map(self._due, entries)))
        else:
            self.held.clear()

    def _open(self) -> list[dict]:
        return json.loads(self.held.get()[0]) if self.held.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries = self._open()
        for frame in rows:
            for kind, name, failed, at in zip(frame["kind"], frame["name"], frame["failed"], _millis(frame["ts"]), strict=True):
                tool = kind == "tool"
                new = {"first": at, "last": at, "calls": int(tool), "failures": int(tool and failed is not None and bool(failed == True)), "tools": [name] if tool and isinstance(name, str) else [], "over": kind == "end"}  # noqa: E712
                apart = []
                for e in entries:
                    if e["first"] - self.gap < new["last"] and new["first"] < e["last"] + self.gap:
                        new = {"first": min(e["first"], new["first"]), "last": max(e["last"], new["last"]), "calls": e["calls"] + new["calls"], "failures": e["failures"] + new["failures"], "tools": sorted({*e["tools"], *new["tools"]}), "over": e["over"] or new["over"]}
                    else:
                        apart.append(e)
                entries = [*apart, new]
        self._keep(entries)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, entries = expiredTimerInfo.getExpiryTimeInMs(), self._open()
        over = [e for e in entries if self._due(e) <= now]
        self._keep([e for e in entries if self._due(e) > now])
        yield self._rows(key, over)

    def _rows(self, key: tuple, entries: list[dict]) -> pd.DataFrame:
        stamps = lambda name: pd.to_datetime(pd.Series([e[name] for e in entries], dtype="int64"), unit="ms").astype("datetime64[us]")
        return pd.DataFrame({
            "session_id": pd.Series([key[0]] * len(entries), dtype=str), "started": stamps("first"), "ended": stamps("last"), "calls": pd.Series([e["calls"] for e in entries], dtype="int64"), "failures": pd.Series([e["failures"] for e in entries], dtype="int64"),
            "tools": pd.Series([",".join(e["tools"]) for e in entries], dtype=str), "ended_by": pd.Series(["end" if e["over"] else "timeout" for e in entries], dtype=str),
        })

    def close(self) -> None:
        pass


def sessions(rows: DataFrame, gap: int = 30, delay: str = "5 minutes") -> DataFrame:
    """One row (SESSION) of each session of ``rows`` (session_id, kind, name, failed, ts) when it is over; a stream in append mode.

    kind is tool, end, or anything else, which only keeps the session alive.
    """
    x = rows.select("session_id", "kind", "name", "failed", "ts").filter("session_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    return x.groupBy("session_id").transformWithStateInPandas(Session(gap), SESSION, "Append", "EventTime")


def session_table(rows: DataFrame, gap: int = 30) -> DataFrame:
    """The batch form: rows of a session that lie less than ``gap`` minutes apart, by built-in session windows."""
    x = rows.filter("session_id IS NOT NULL AND ts IS NOT NULL").groupBy("session_id", F.session_window("ts", f"{gap} minutes").alias("w"))
    tool = F.col("kind") == "tool"
    y = x.agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if(tool).alias("calls"), F.count_if(tool & F.coalesce("failed", F.lit(False))).alias("failures"), F.array_join(F.array_sort(F.collect_set(F.when(tool, F.col("name")))), ",").alias("tools"), F.max((F.col("kind") == "end").cast("int")).alias("e"))
    return y.select("session_id", "started", "ended", "calls", "failures", "tools", F.when(F.col("e") == 1, "end").otherwise("timeout").alias("ended_by"))
