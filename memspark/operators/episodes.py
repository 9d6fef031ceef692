"""Sessions of tool calls: programs, error signatures, struggles, observations, and reports about traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators.distillation import stripped
from memspark.operators.texts import is_noise, redacted

# Words of an error, programs that say nothing, words before the real program, lengths and windows.
ERROR_WORDS = ["error", "failed", "failure", "exception", "panicked", "not found", "denied", "refused", "cannot", "can't", "invalid", "unable", "timeout", "timed out", "失败", "错误", "异常"]
GENERIC_PROGRAMS = [
    "cd", "echo", "cat", "ls", "head", "tail", "true", "false", "set", "export", "sleep", "printf", "wc", "sort", "uniq", "cut", "tr", "grep", "sed", "awk", "xargs", "tee", "rm", "cp", "mv", "mkdir", "touch", "pwd",
    "which", "test", "for", "while", "do", "done", "if", "then", "fi", "else", "bash", "sh", "source", "until", "let", "read", "find", "ps", "kill", "pgrep",
]
WRAPPERS = ["sudo", "timeout", "env", "nohup", "time", "exec", "command"]
SIGNATURE, SIGNATURE_LEAST, COMMAND, RESULT = 80, 8, 300, 300
RECOVERY, ATTEMPTS, OBSERVED = 15, 6, 3
#: Weight of an attribution: the strongest report about a chunk counts.
STRENGTH = {"explicit": 3, "cited": 2, "inferred": 1}


def clip(text: Column, most: int) -> Column:
    """``text`` trimmed, without keys, cut after ``most`` characters with an ellipsis."""
    clean = redacted(stripped(text))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.substring(clean, 1, most), F.lit("…")))


def programs(command: Column) -> Column:
    """The distinct programs that a shell command runs, without generic ones; one at most of each segment.

    Assignments, options, numbers and wrappers before a program are passed over.
    """
    real = lambda w: (w != "") & (~F.contains(w, F.lit("=")) | w.startswith("-")) & ~w.startswith("-") & ~w.rlike("^[0-9]+$")
    base = lambda w: F.lower(F.regexp_extract(w, "([^/]*)$", 1))

    def first(segment: Column) -> Column:
        words = F.transform(F.filter(F.split(segment, r"\s+"), real), base)
        return F.get(F.filter(words, lambda w: ~w.isin(WRAPPERS)), 0)

    found = F.transform(F.split(command, r"[&|;\n()]"), first)
    return F.array_distinct(F.filter(found, lambda p: p.rlike("^[a-z0-9_.-]+$") & ~p.isin(GENERIC_PROGRAMS)))


def error_signature(result: Column) -> Column:
    """sig: and the first line that names an error, without paths, quoted text and bare numbers; null if too little is left.

    A quote that is never closed runs to the end of the line.
    """
    names_error = lambda line: (line != "") & ~line.startswith("Exit code") & F.lower(line).rlike("|".join(ERROR_WORDS))
    line = F.get(F.filter(F.transform(F.split(result, "\n"), stripped), names_error), 0)
    joined = F.array_join(F.filter(F.split(line, r"\s+"), lambda w: ~w.rlike(r"[/\\]")), " ")
    quoted = "|".join(rf"{q}[^{q}\s]*(\s?)[^{q}]*(?:{q}|$)" for q in ("\"", "'", "`"))
    plain = F.translate(F.regexp_replace(joined, quoted, "$1$2$3"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    mask = lambda w: F.when(w.rlike("^[a-z].*[0-9]"), w).otherwise(F.regexp_replace(w, "[0-9]", "#"))
    out = F.substring(F.array_join(F.transform(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), mask), " "), 1, SIGNATURE)
    return F.when(F.length(out) >= SIGNATURE_LEAST, F.concat(F.lit("sig:"), out))


def call_features(lib: Library) -> DataFrame:
    """id, programs and error signature of each tool call; calls that did not fail have no signature."""
    x = lib.transcript.filter("kind = 'tool'")
    return x.select("id", F.array_join(programs(F.col("input")), ",").alias("programs"), F.when(F.col("failed"), error_signature(F.col("result"))).alias("signature"))


def struggles(lib: Library) -> DataFrame:
    """session_id, id, recovery_id, attempts and signature: a failed call and the next success of one of its programs.

    The success must come within RECOVERY calls; failures that say nothing, or of
    generic programs only, do not count.  The search goes on after the recovery.
    ``attempts`` counts the calls between, ATTEMPTS at most.  Calls are ordered by
    time, then id.  A session's recovered failures are walked as one list.
    """
    order = Window.partitionBy("session_id").orderBy("ts", "id")
    calls = lib.transcript.filter("kind = 'tool'").select("session_id", "ts", "id", "failed", "result", programs(F.col("input")).alias("family"))
    ahead = F.collect_list(F.struct("id", "failed", "family")).over(order.rowsBetween(1, RECOVERY))
    x = calls.withColumns({"at": F.row_number().over(order), "ahead": ahead})
    x = x.filter("failed AND size(family) > 0").filter(~is_noise(F.col("result")))
    good = F.transform("ahead", lambda e: ~e["failed"] & F.arrays_overlap(e["family"], F.col("family")))
    x = x.withColumn("r", F.array_position(good, True)).filter("r > 0")
    item = F.struct(F.col("at"), (F.col("at") + F.col("r") + 1).cast("int").alias("resume"), F.col("id"), F.element_at("ahead", F.col("r").cast("int"))["id"].alias("recovery_id"), F.least(F.col("r") - 1, F.lit(ATTEMPTS)).cast("long").alias("attempts"), error_signature(F.col("result")).alias("signature"))
    lists = x.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    kind = "array<struct<at:int,resume:int,id:bigint,recovery_id:bigint,attempts:bigint,signature:string>>"
    start = F.struct(F.lit(0).alias("resume"), F.array().cast(kind).alias("kept"))
    step = lambda acc, e: F.when(e["at"] >= acc["resume"], F.struct(e["resume"].alias("resume"), F.concat(acc["kept"], F.array(e)).alias("kept"))).otherwise(acc)
    kept = lists.select("session_id", F.explode(F.aggregate("l", start, step)["kept"]).alias("e"))
    return kept.select("session_id", "e.id", "e.recovery_id", "e.attempts", "e.signature")


def observations(lib: Library) -> DataFrame:
    """id, calls, failures and hash of the text of what followed each shown rule: the next OBSERVED calls of the session.

    A human message after the first of them ends the observation; a rule that no
    call follows has no row.  Calls are numbered in a session, so that a shown
    rule meets only those it needs.
    """
    order = Window.partitionBy("session_id").orderBy("ts", "last", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lib.transcript.select("session_id", "ts", F.lit(0).alias("last"), F.col("id").cast("string").alias("id"), "kind", "input", "result", "failed")
    none = lambda kind: F.lit(None).cast(kind)
    marks = lib.shown.select("session_id", F.col("shown_at").alias("ts"), F.lit(1).alias("last"), "id", F.lit("shown").alias("kind"), none("string").alias("input"), none("string").alias("result"), none("boolean").alias("failed"))
    x = seen.unionByName(marks).withColumns({"n": F.count_if(F.col("kind") == "tool").over(order), "u": F.count_if(F.col("kind") == "user").over(order)})
    said = F.concat(F.when(F.col("failed"), F.lit("[失败] ")).otherwise(F.lit("[成功] ")), clip(F.col("input"), COMMAND), F.lit("\n"), clip(F.col("result"), RESULT))
    calls = x.filter("kind = 'tool'").select("session_id", "n", "u", "failed", said.alias("said"))
    asked = x.filter("kind = 'shown'").select("id", "session_id", F.explode(F.transform(F.array(*[F.lit(i) for i in range(1, OBSERVED + 1)]), lambda i: F.col("n") + i)).alias("n"))
    met = asked.join(calls, ["session_id", "n"]).withColumn("first_u", F.first("u").over(Window.partitionBy("id").orderBy("n"))).filter("u = first_u")
    y = met.groupBy("id").agg(F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("failures"), F.array_sort(F.collect_list(F.struct("n", "said"))).alias("l"))
    return y.select("id", "calls", "failures", F.sha2(F.array_join(F.transform("l", lambda e: e["said"]), "\n---\n"), 256).alias("hash"))


def reduced_traces(lib: Library) -> DataFrame:
    """trace_id, used (in the order of first report), attributions, complete, outcome and usage_state of each trace's reports.

    A complete report replaces what was said before it, partial ones add; a chunk
    keeps its strongest attribution since then.  The last outcome that is known
    counts.  No report of use: unknown; none used: known_none.  Only a trace's
    chunks are gathered, never its reports.
    """
    c = F.col
    order = F.struct("ts", "id")
    x = lib.reports.withColumn("o", order)
    heads = x.groupBy("trace_id").agg(F.max(F.when(c("complete") & c("used").isNotNull(), c("o"))).alias("reset"), F.max_by("outcome", F.when(c("outcome").isin("ok", "fail"), c("o"))).alias("outcome"), F.count("used").alias("said"))
    since = x.filter("used IS NOT NULL").join(heads.select("trace_id", "reset"), "trace_id").filter("reset IS NULL OR o >= reset")
    each = since.select("trace_id", "o", "attribution", F.posexplode(F.split("used", ",")).alias("pos", "chunk_id")).filter("chunk_id <> ''")
    rank = F.lit(0)
    for name, value in STRENGTH.items():
        rank = F.when(c("attribution") == name, value).otherwise(rank)
    chunks = each.groupBy("trace_id", "chunk_id").agg(F.min(F.struct("o", "pos")).alias("at"), F.max_by(F.coalesce("attribution", F.lit("")), rank).alias("attribution"))
    lists = chunks.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "attribution"))).alias("l"))
    y = heads.join(lists, "trace_id", "left")
    joined = lambda name: F.coalesce(F.array_join(F.transform("l", lambda e: e[name]), ","), F.lit(""))
    state = F.when(c("said") == 0, "unknown").when(c("l").isNull(), "known_none").otherwise("known_some")
    return y.select("trace_id", joined("chunk_id").alias("used"), joined("attribution").alias("attributions"), c("reset").isNotNull().alias("complete"), F.when(c("outcome").isin("ok", "fail"), c("outcome")).alias("outcome"), state.alias("usage_state"))


def embed_texts(lib: Library) -> DataFrame:
    """id and hash of the text that is embedded for each situation: its labelled parts, one a line."""
    part = lambda label, name: F.when(stripped(F.col(name)) != "", F.concat(F.lit(f"[{label}] "), stripped(F.col(name))))
    return lib.situations.select("id", F.sha2(F.concat_ws("\n", part("error", "last_error"), part("stage", "stage"), part("files", "file_context")), 256).alias("hash"))
