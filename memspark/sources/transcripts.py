"""Agent transcripts as JSONL: nested lines to ordered events, tool calls paired with their results (SRC5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "type string, id string, name string, input string, tool_use_id string, content {}, is_error boolean, text string"
_LINE = "sessionId string, session_id string, cwd string, timestamp string, uuid string, isSidechain boolean, message struct<role: string, content: {}>"
#: The same line with content as text, as blocks, and as blocks whose own content is a list of blocks.
PLAIN = _LINE.format("string")
BLOCKS = _LINE.format("array<struct<" + _BLOCK.format("string").replace(" string", ": string").replace(" boolean", ": boolean") + ">>")
NESTED = _LINE.format("array<struct<content: array<struct<type: string, text: string>>>>")
#: Characters of an input that names neither a command nor a file.
INPUT = 120

EVENT = "file string, session_id string, cwd string, seq int, kind string, uuid string, ts string, text string, call_id string, name string, input string, result string, failed boolean"


def without_colours(text: Column) -> Column:
    """``text`` without escape sequences: ESC and, after a bracket, all up to the next letter."""
    return F.regexp_replace(text, "\x1b(?:\\[[^A-Za-z]*[A-Za-z]?)?", "")


def is_human(text: Column) -> Column:
    """Whether text in the user's role was typed: hook output, reminders and notices come in tags, interruptions in brackets."""
    t = F.regexp_replace(text, r"^\s+", "")
    return (t != "") & ~t.startswith("<") & ~t.startswith("[Request interrupted")


def _rendered(name: Column, given: Column) -> Column:
    """A tool's input in short: its command, or the tool and the file, or the tool and the first characters of the JSON."""
    held = lambda key: F.get_json_object(given, f"$.{key}")
    return F.coalesce(held("command"), F.concat(name, F.lit(" "), held("file_path")), F.concat(name, F.lit(" "), F.substring(F.coalesce(given, F.lit("null")), 1, INPUT)))


def events(lines: DataFrame, sidechains: bool = True) -> DataFrame:
    """Ordered events (EVENT) of transcript ``lines`` (file, place, value): what users typed, what assistants said, finished tool calls.

    A file is a session; ``place`` orders its lines.  Lines that are no JSON, or
    have no message, give nothing.  Contents are text or lists of blocks.  A tool
    call is an event where its result stands: the n-th result under an id belongs
    to the n-th call under it, if that came before; without such a call it is an
    event with the id alone.  The time is that of the call.  A user's line with
    results is no typed text.  session_id and cwd are the file's first ones.
    Without ``sidechains`` lines of side conversations are left out.
    """
    parsed = lines.select("file", "place", F.from_json("value", PLAIN).alias("p"), F.from_json("value", BLOCKS).alias("b"), F.from_json("value", NESTED).alias("n"))
    x = parsed.select("file", "place", F.col("p.sessionId").alias("sid"), F.col("p.session_id").alias("sid2"), "p.cwd", F.col("p.timestamp").alias("ts"), F.coalesce("p.uuid", F.lit("")).alias("uuid"), F.col("p.message.role").alias("role"), F.col("b.message.content").alias("blocks"), F.col("n.message.content").alias("inner"), F.when(F.col("b.message.content").isNull(), F.col("p.message.content")).alias("plain"), F.coalesce("p.isSidechain", F.lit(False)).alias("side"))
    heads = x.groupBy("file").agg(F.min_by(F.coalesce("sid", "sid2"), F.when(F.coalesce("sid", "sid2").isNotNull(), F.col("place"))).alias("session_id"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("place"))).alias("cwd"))
    x = x if sidechains else x.filter("NOT side")
    none = lambda kind: F.lit(None).cast(kind)
    each = x.filter("role IN ('assistant', 'user') AND blocks IS NOT NULL").select("file", "place", "ts", "role", F.posexplode("blocks").alias("pos", "block"), "inner")
    place = [F.col("place"), F.col("pos")]
    said = each.filter("role = 'assistant' AND block.type = 'text' AND block.text IS NOT NULL").select("file", F.struct(*place).alias("at"), F.lit("assistant").alias("kind"), F.lit("").alias("uuid"), none("string").alias("ts"), F.col("block.text").alias("text"), *[none("string").alias(c) for c in ("call_id", "name", "input", "result")], none("boolean").alias("failed"))
    nth = F.row_number().over(Window.partitionBy("file", "call_id").orderBy("at"))
    calls = each.filter("role = 'assistant' AND block.type = 'tool_use'").select("file", F.struct(*place).alias("at"), F.coalesce("block.id", F.lit("")).alias("call_id"), F.coalesce("block.name", F.lit("")).alias("name"), F.col("block.input").alias("given"), "ts").withColumn("nth", nth)
    calls = calls.select("file", "call_id", "nth", F.col("at").alias("called"), "name", _rendered(F.col("name"), F.col("given")).alias("input"), F.col("ts").alias("call_ts"))
    nested = F.get("inner", F.col("pos"))["content"]
    texts = F.array_join(F.transform(F.filter(nested, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    told = F.when(nested.isNotNull(), texts).otherwise(F.coalesce("block.content", F.lit("")))
    results = each.filter("role = 'user' AND block.type = 'tool_result'").select("file", F.struct(*place).alias("at"), F.coalesce("block.tool_use_id", F.lit("")).alias("call_id"), without_colours(told).alias("result"), F.coalesce("block.is_error", F.lit(False)).alias("failed"), "ts").withColumn("nth", nth)
    met = results.join(calls, ["file", "call_id", "nth"], "left").withColumn("own", F.col("called") < F.col("at"))
    of = lambda c: F.when(F.col("own"), F.col(c))
    done = met.select("file", "at", F.lit("tool").alias("kind"), F.lit("").alias("uuid"), F.when(F.col("own"), F.col("call_ts")).otherwise(F.col("ts")).alias("ts"), none("string").alias("text"), "call_id", F.coalesce(of("name"), F.lit("")).alias("name"), F.coalesce(of("input"), F.lit("")).alias("input"), "result", "failed")
    blocks = F.array_join(F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    human = x.filter("role = 'user'").filter(F.col("blocks").isNull() | ~F.exists("blocks", lambda b: F.coalesce(b["type"], F.lit("")) == "tool_result")).select("file", "place", "uuid", "ts", F.coalesce(blocks, "plain", F.lit("")).alias("text"))
    typed = human.filter(is_human(F.col("text"))).select("file", F.struct("place", F.lit(0).alias("pos")).alias("at"), F.lit("user").alias("kind"), "uuid", "ts", "text", *[none("string").alias(c) for c in ("call_id", "name", "input", "result")], none("boolean").alias("failed"))
    every = said.unionByName(done).unionByName(typed)
    seq = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    return every.withColumn("seq", seq).join(heads, "file", "left").select("file", "session_id", "cwd", "seq", "kind", "uuid", "ts", "text", "call_id", "name", "input", "result", "failed")
