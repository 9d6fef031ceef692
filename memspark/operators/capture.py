"""What a session leaves: episodes of struggle and correction, observations of shown rules, digests (L1-L4, L15, T17, SRC5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators.entities import entities
from memspark.operators.episodes import RECOVERY, clip, error_signature, programs
from memspark.operators.texts import is_correction, is_noise
from memspark.sources.transcripts import events
from memspark.tables import stored

# Lengths of the parts of an episode, calls that an observation holds by channel, signals of an episode.
TRIGGER, RESULT, COMMAND, ATTEMPT, ATTEMPTS, SAID, BEFORE = 900, 300, 300, 200, 6, 400, 300
CALLS, OTHER_CALLS, SIGNALS = {"pre_tool": 3, "tool_error": 4}, 6, 12

EPISODE = ["file", "session_id", "cwd", "id", "kind", "ts", "trigger", "attempts", "resolution"]


def signals(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, signal and nth: what names one specific thing in a text, its error signature first, SIGNALS at most.

    Error codes, long options, and code symbols with a digit, underscore, dot or
    double colon count; paths name a project and do not.
    """
    name = F.col("entity")
    symbol = (F.col("etype") == "symbol") & ~(name.startswith("__") & name.endswith("__")) & (F.length("entity") >= 4) & name.rlike(r"[0-9_.]|::")
    flag = (F.col("etype") == "flag") & name.startswith("--") & (F.length("entity") >= 6)
    found = entities(df.select(key, text), key, text, placed=True).filter((F.col("etype") == "error") | symbol | flag).select(key, name.alias("signal"), "nth")
    head = df.select(key, error_signature(F.col(text)).alias("signal"), F.lit(0).alias("nth")).filter("signal IS NOT NULL").distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy("nth", "signal"))
    return head.unionByName(found).withColumn("nth", place).filter(F.col("nth") <= SIGNALS)


def _id(kind: str, name: Column) -> Column:
    return F.sha2(F.concat(F.coalesce("session_id", F.lit("")), F.lit(f"|{kind}|"), name), 256)


def struggles(found: DataFrame) -> DataFrame:
    """Episodes of failed shell commands that a later command of the same program got right within RECOVERY calls.

    Of the calls between, the first ATTEMPTS shell commands are kept.  A session
    is searched on after the recovery.  Failures that say nothing, of generic
    programs only, or without recovery give none.  ``error`` is the failure's
    whole result.  No more of the calls ahead than their clipped texts is held.
    """
    order = Window.partitionBy("file").orderBy("seq")
    calls = found.filter("kind = 'tool'").withColumns({"at": F.row_number().over(order), "family": programs(F.col("input"))})
    ahead = F.collect_list(F.struct("seq", (F.col("name") == "Bash").alias("bash"), "failed", "family")).over(order.rowsBetween(1, RECOVERY))
    x = calls.withColumn("ahead", ahead).filter("name = 'Bash' AND failed AND size(family) > 0").filter(~is_noise(F.col("result")))
    x = x.withColumn("r", F.array_position(F.transform("ahead", lambda e: e["bash"] & ~e["failed"] & F.arrays_overlap(e["family"], F.col("family"))), True)).filter("r > 0")
    item = F.struct("at", (F.col("at") + F.col("r") + 1).cast("int").alias("resume"), "seq")
    kind = "array<struct<at:int,resume:int,seq:int>>"
    start = F.struct(F.lit(0).alias("resume"), F.array().cast(kind).alias("kept"))
    step = lambda acc, e: F.when(e["at"] >= acc["resume"], F.struct(e["resume"].alias("resume"), F.concat(acc["kept"], F.array(e)).alias("kept"))).otherwise(acc)
    kept = x.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("l")).select("file", F.explode(F.aggregate("l", start, step)["kept"]).alias("e")).select("file", "e.seq")
    x = x.join(kept, ["file", "seq"], "left_semi")
    between = F.slice(F.filter(F.slice("ahead", F.lit(1), (F.col("r") - 1).cast("int")), lambda e: e["bash"]), 1, ATTEMPTS)
    needed = x.select("file", F.col("seq").alias("head"), F.explode(F.concat(F.transform(between, lambda e: F.struct(e["seq"].alias("seq"), F.lit(False).alias("last"))), F.array(F.struct(F.element_at("ahead", F.col("r").cast("int"))["seq"].alias("seq"), F.lit(True).alias("last"))))).alias("n")).select("file", "head", "n.*")
    texts = needed.join(calls.select("file", "seq", "input", "result"), ["file", "seq"])
    tried = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("last"), F.struct("seq", clip(F.col("input"), ATTEMPT).alias("t"))))), lambda e: e["t"]), "\n")
    solved = clip(F.concat(F.lit("命令: "), clip(F.col("input"), COMMAND), F.lit("\n结果: "), clip(F.col("result"), RESULT)), TRIGGER)
    parts = texts.groupBy("file", F.col("head").alias("seq")).agg(F.count_if(~F.col("last")).alias("tries"), tried.alias("tried"), F.max(F.when(F.col("last"), solved)).alias("resolution"))
    y = x.join(parts, ["file", "seq"])
    trigger = clip(F.concat(F.lit("命令: "), clip(F.col("input"), COMMAND), F.lit("\n报错: "), F.col("result")), TRIGGER)
    return y.select("file", "session_id", "cwd", _id("struggle", F.col("call_id")).alias("id"), F.lit("struggle").alias("kind"), "ts", trigger.alias("trigger"), F.when(F.col("tries") > 0, F.col("tried")).alias("attempts"), "resolution", F.col("result").alias("error"))


def corrections(found: DataFrame) -> DataFrame:
    """Episodes of users telling the agent it was wrong, with the end of what it had said and the start of what it said next; ``error`` is the user's text."""
    order = Window.partitionBy("file").orderBy("seq")
    spoken = F.when(F.col("kind") == "assistant", F.struct(F.col("text").alias("t")))
    x = found.filter("kind IN ('user', 'assistant')").withColumns({"before": F.last(spoken, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "after": F.first(spoken, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    x = x.filter((F.col("kind") == "user") & F.col("before").isNotNull() & is_correction(F.col("text")))
    tail = F.substring("before.t", F.greatest(F.lit(1), F.length("before.t") - BEFORE + 1), F.lit(BEFORE))
    trigger = clip(F.concat(F.lit("用户纠正: "), clip(F.col("text"), SAID), F.lit("\n之前: "), tail), TRIGGER)
    return x.select("file", "session_id", "cwd", _id("correction", F.col("uuid")).alias("id"), F.lit("correction").alias("kind"), "ts", trigger.alias("trigger"), F.lit(None).cast("string").alias("attempts"), clip(F.col("after.t"), RESULT).alias("resolution"), F.col("text").alias("error"))


def episodes(found: DataFrame) -> DataFrame:
    """Both kinds of episodes of ``found`` (events of transcripts) with their signals; the same transcript gives the same ids again."""
    each = stored(struggles(found).unionByName(corrections(found)).dropDuplicates(["id"]), "episodes")
    marks = signals(each, "id", "error").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "signal"))).alias("s"))
    held = F.coalesce(F.transform("s", lambda e: e["signal"]), F.array().cast("array<string>"))
    return each.join(marks, "id", "left").select(*EPISODE, held.alias("signals"))


def observed(found: DataFrame, shown: DataFrame) -> DataFrame:
    """id and observation of ``shown`` rules (id, session_id, channel, tool_use_id, created_at): the calls that followed each.

    At action time the calls begin with that of tool_use_id; else with the first
    after created_at, and end at the next human message.  The channel says how
    many: 3 before a tool, 4 after an error, else 6.  A rule that no call follows
    has no row.  Calls are numbered in a session, so a rule meets only its own.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    x = found.filter("kind IN ('tool', 'user') AND session_id IS NOT NULL").withColumns({"n": F.count_if(F.col("kind") == "tool").over(order), "u": F.count_if(F.col("kind") == "user").over(order)})
    said = F.concat(F.when(F.col("failed"), F.lit("[失败] ")).otherwise(F.lit("[成功] ")), clip(F.col("input"), COMMAND), F.lit("\n"), clip(F.col("result"), RESULT))
    calls = x.filter("kind = 'tool'").select("session_id", "n", "u", "ts", "call_id", said.alias("said"))
    most = F.lit(OTHER_CALLS)
    for channel, count in CALLS.items():
        most = F.when(F.col("channel") == channel, count).otherwise(most)
    asked = shown.select("id", "session_id", "tool_use_id", "created_at", most.alias("most"))
    by_call = asked.filter("tool_use_id IS NOT NULL").join(calls.groupBy("session_id", F.col("call_id").alias("tool_use_id")).agg(F.min("n").alias("first")), ["session_id", "tool_use_id"]).select("id", "session_id", "most", "first", F.lit(True).alias("anchored"))
    # By time: both in one order of time, each rule takes the first call after it.
    marks = asked.filter("tool_use_id IS NULL AND created_at IS NOT NULL").select("session_id", F.col("created_at").alias("ts"), F.lit(1).alias("mark"), "id", "most", F.lit(None).cast("long").alias("n"))
    timed = calls.filter("ts IS NOT NULL").select("session_id", "ts", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("most"), "n").unionByName(marks)
    next_n = F.min("n").over(Window.partitionBy("session_id").orderBy("ts", "mark").rowsBetween(1, Window.unboundedFollowing))
    by_time = timed.withColumn("first", next_n).filter("mark = 1 AND first IS NOT NULL").select("id", "session_id", "most", "first", F.lit(False).alias("anchored"))
    wanted = by_call.unionByName(by_time).withColumn("n", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("most") - 1)))
    met = wanted.join(calls.select("session_id", "n", "u", "said"), ["session_id", "n"])
    first_u = F.first("u").over(Window.partitionBy("id").orderBy("n"))
    met = met.withColumn("first_u", first_u).filter(F.col("anchored") | (F.col("u") == F.col("first_u")))
    return met.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda e: e["said"]), "\n---\n").alias("observation"))


def captured(found: DataFrame, known: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New episodes of ``found``, those that ``known`` (id) lacks, and observations of rules still ``shown`` (verdict).

    Doing it again with the new rows among the known ones adds nothing.
    """
    return episodes(found).join(known.select("id"), "id", "left_anti"), observed(found, shown.filter("verdict = 'shown'"))


def digests(found: DataFrame) -> DataFrame:
    """session_id, newest user and assistant text (200 characters), tools called (distinct, by name) and failures of each session."""
    newest = lambda kind: F.substring(F.max_by("text", F.when(F.col("kind") == kind, F.col("seq"))), 1, 200)
    tools = F.array_join(F.array_sort(F.collect_set(F.when((F.col("kind") == "tool") & (F.col("name") != ""), F.col("name")))), ",")
    return found.groupBy("session_id").agg(newest("user").alias("asked"), newest("assistant").alias("answered"), tools.alias("tools"), F.count_if(F.col("kind") == "tool").alias("calls"), F.count_if("failed").alias("failures"))


def conversation_lines(lib: Library) -> DataFrame:
    """The library's messages as transcript lines (file, place, value): every assistant turn calls a tool whose result, its own text, is the next line."""
    m = lib.messages.select(F.concat(F.lit("conv"), "conv_id").alias("file"), "id", "conv_id", "turn", "role", "text")
    place = lambda k: F.struct("turn", F.lit(k).alias("k"))
    stamp = F.concat(F.lit("2024-01-0"), F.col("turn") % 9 + 1, F.lit("T00:00:00Z"))
    head = [F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.concat(F.lit("/w/p"), F.col("conv_id") % 7).alias("cwd"), stamp.alias("timestamp")]
    text = F.struct(F.lit("text").alias("type"), "text")
    call = F.concat(F.lit("call"), "id")
    command = F.concat(F.lit("cd app && make t"), F.col("turn"))
    plain = m.filter("role = 'user' AND turn % 4 <> 2").select("file", place(0).alias("place"), F.to_json(F.struct(F.col("id").alias("uuid"), *head, F.struct("role", F.col("text").alias("content")).alias("message"))).alias("value"))
    listed = m.filter("role = 'user' AND turn % 4 = 2").select("file", place(0).alias("place"), F.to_json(F.struct(F.col("id").alias("uuid"), *head, F.struct("role", F.array(text).alias("content")).alias("message"))).alias("value"))
    use = F.struct(F.lit("tool_use").alias("type"), call.alias("id"), F.when(F.col("turn") % 3 == 0, "Read").otherwise("Bash").alias("name"), F.when(F.col("turn") % 3 == 0, F.struct(F.lit(None).cast("string").alias("command"), F.concat(F.lit("src/m"), F.col("turn"), F.lit(".rs")).alias("file_path"))).otherwise(F.struct(command.alias("command"), F.lit(None).cast("string").alias("file_path"))).alias("input"), F.lit(None).cast("string").alias("text"))
    spoken = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string,file_path:string>").alias("input"), "text")
    asked = m.filter("role = 'assistant'").select("file", place(0).alias("place"), F.to_json(F.struct(*head, F.struct("role", F.array(spoken, use).alias("content")).alias("message"))).alias("value"))
    told = F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), ((F.col("conv_id") + F.col("turn")) % 3 != 0).alias("is_error"), F.array(text).alias("content"))
    answered = m.filter("role = 'assistant'").select("file", place(1).alias("place"), F.to_json(F.struct(F.lit("user").alias("type"), *head, F.struct(F.lit("user").alias("role"), F.array(told).alias("content")).alias("message"))).alias("value"))
    return plain.unionByName(listed).unionByName(asked).unionByName(answered)


def transcript_events(lib: Library) -> DataFrame:
    """Events of the library's messages read as transcripts."""
    return lib.kept("events", lambda: stored(events(conversation_lines(lib)), "events"))


def event_rows(lib: Library) -> DataFrame:
    """session_id, seq, kind, name, input, failed and hash of what was said or came out, of each event."""
    return transcript_events(lib).select("session_id", "seq", "kind", "uuid", "name", "input", "failed", F.sha2(F.coalesce("text", "result"), 256).alias("hash"))


def captured_episodes(lib: Library) -> DataFrame:
    """id, kind, session_id, attempts, signals, and hashes of trigger and resolution of each episode of the library's messages."""
    x = episodes(transcript_events(lib))
    return x.select("id", "kind", "session_id", "attempts", F.array_join("signals", "|").alias("signals"), F.sha2("trigger", 256).alias("trigger"), F.sha2("resolution", 256).alias("resolution"))


def session_digests(lib: Library) -> DataFrame:
    """Digest of each session of the library's messages."""
    return digests(transcript_events(lib))
