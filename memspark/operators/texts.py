"""Text jobs over messages, urls and contents: signatures, redaction, predicates, classes (T)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library, bound

# Phrases and patterns that the results depend on.
INJECTIONS = ["ignore all previous instructions", "ignore previous instructions", "ignore previous instruction", "system prompt:", "system prompt：", "you are now a different", "you are now a new"]
PREFIXED = [("sk-", 20), ("AKIA", 16), ("ghp_", 36)]
NOISE = ["doesn't want to proceed", "was rejected", "user denied", "Permission for this action was denied", "auto mode classifier"]
CORRECTIONS = [
    "不对", "不是这样", "错了", "搞错", "理解错", "不应该", "应该是", "不要这样", "别这样", "重新来", "重做", "还是不行", "还是报错", "没有用", "不是我要的",
    "that's wrong", "that is wrong", "not what i", "you misunderstood", "doesn't work", "still broken", "still failing", "incorrect",
]
CORRECTION_MOST, CONTINUED = 800, "This session is being continued"
REPORTS = ["未做任何代码改动", "未做代码改动", "没有做任何代码改动", "无代码改动", "no code changes were made", "no code was changed", "made no changes"]
REDACTED = "[REDACTED]"


def any_of(text: Column, phrases: list[str]) -> Column:
    """Whether one of ``phrases`` occurs in ``text``."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(phrase))
    return out


# Labels of secrets with the least length of their value and whether a value of letters alone is no secret, and what separates them.
LABELS = [
    ("password", 1, False), ("passwd", 1, False), ("pwd", 4, False), ("client_secret", 8, True), ("secret_key", 8, True), ("access_key", 8, True), ("api_key", 8, True), ("api-key", 8, True),
    ("apikey", 8, True), ("secret", 8, True), ("token", 8, True),
]
CJK_LABELS = [("密码", 4, False), ("口令", 4, False), ("密钥", 8, True), ("秘钥", 8, True), ("私钥", 8, True), ("令牌", 8, True)]
SEPARATORS, CJK_SEPARATORS = ":=：", "是为:：="
QUOTES = "`\"'“”‘’"
_BLANK = r"\s\x85\p{Z}"
#: A character of a value: no white space, quote, CJK sign, comma or semicolon.
_VALUE = rf"[^{_BLANK}{QUOTES}\x{{3000}}-\x{{303f}}\x{{4e00}}-\x{{9fff}}\x{{ff00}}-\x{{ffef}},;]"


def _labelled(labels: list[tuple[str, int, bool]], separators: str, before: str) -> str:
    """Pattern of a label, one or two separators, a quote (group 1), and a value that looks like a secret: no placeholder, no path, long enough."""
    ways = []
    for label, least, mixed in labels:
        odd = rf"(?=[A-Za-z]*+(?![A-Za-z]){_VALUE})" if mixed else ""
        ways.append(rf"({label}[ \t]*+[{separators}][ \t]*+(?:[{separators}][ \t]*+)?+[{QUOTES}]?+)(?![$\x7b<%\[])(?!{_VALUE}*/)(?={_VALUE}{{{least}}}){odd}{_VALUE}++")
    return "(?i)" + before + "(?:" + "|".join(ways) + ")"


def redacted(text: Column) -> Column:
    """``text`` without keys of a known prefix and length at the start of a token, bearer tokens, and values of labels that name a secret.

    Labels, separators and quotes stay, so the text still reads.  Labels are
    scanned from left to right, at one place in the order above; doing it again
    changes nothing.
    """
    plain = REDACTED.replace("[", "\\[").replace("]", "\\]")
    groups = lambda n: "".join(f"${i}" for i in range(1, n + 1))

    def replaced(text: Column, pattern: str, by: str, signs: list[str], folded: bool) -> Column:
        """``text`` with ``pattern`` replaced; only texts that hold one of ``signs``, without which nothing matches, are searched for it."""
        return bound(text, lambda t: F.when(any_of(F.lower(t) if folded else t, signs), F.regexp_replace(t, pattern, by)).otherwise(t))

    for prefix, least in PREFIXED:
        text = replaced(text, f"(^|[^A-Za-z0-9_-]){prefix}[A-Za-z0-9_-]{{{least},}}", f"$1{plain}", [prefix], False)
    text = replaced(text, rf"(?i)(bearer )(?!\[REDACTED\](?:[{_BLANK}{QUOTES}]|$))[^{_BLANK}{QUOTES}]++", f"$1{plain}", ["bearer "], True)
    text = replaced(text, _labelled(LABELS, SEPARATORS, "(?<![A-Za-z0-9])"), groups(len(LABELS)) + plain, [label for label, _, _ in LABELS], True)
    return replaced(text, _labelled(CJK_LABELS, CJK_SEPARATORS, ""), groups(len(CJK_LABELS)) + plain, [label for label, _, _ in CJK_LABELS], False)


def sanitized(text: Column) -> tuple[Column, Column]:
    """(text without keys, action): discard where an injection phrase occurs, redact where a key was replaced, else allow; null stays null."""
    both = sanitizing(text)
    return both["clean"], both["action"]


def sanitizing(text: Column) -> Column:
    """A struct of clean and action as ``sanitized`` gives them; as a column of its own, it is computed once for both."""

    def judged(clean: Column, t: Column) -> Column:
        injected = any_of(F.lower(t), INJECTIONS)
        action = F.when(injected, "discard").when(clean != t, "redact").when(t.isNotNull(), "allow")
        return F.struct(F.when(injected, t).otherwise(clean).alias("clean"), action.alias("action"))

    return bound(text, lambda t: bound(redacted(t), lambda clean: judged(clean, t)))


def sanitized_chunks(lib: Library) -> DataFrame:
    """id, action and hash of the text that stays, of every chunk, with keys planted by the fixture."""
    x = lib.secrets.select("id", sanitizing(F.col("content")).alias("s"))
    return x.select("id", "s.action", F.sha2("s.clean", 256).alias("hash"))


def error_class(error: Column) -> Column:
    """A compiler code, else a name that ends in Error or Exception, else panic, else the first word (24 characters); empty without any."""
    text = F.trim(F.coalesce(error, F.lit("")))
    code = F.regexp_extract(text, "[Ee]([0-9]{3,})", 1)
    name = F.regexp_extract(text, r"(?:^|[^\p{L}\p{N}_])([\p{L}\p{N}_]*(?:Error|Exception))(?:$|[^\p{L}\p{N}_])", 1)
    low = F.lower(text)
    word = F.substring(F.regexp_extract(low, r"(\p{L}+)", 1), 1, 24)
    return F.when(code != "", F.concat(F.lit("E"), code)).when(name != "", name).when(F.contains(low, F.lit("panic")), "panic").otherwise(word)


def file_type(context: Column) -> Column:
    """Extension (up to 8 bytes) of the first path named, else its base name; empty without any."""
    token = F.regexp_extract(F.coalesce(context, F.lit("")), r"([^ ,\t\n\r]+)", 1)
    ext = F.regexp_extract(token, r"\.([^.]*)$", 1)
    base = F.regexp_extract(token, r"([^/\\]*)$", 1)
    return F.lower(F.when((ext != "") & (F.octet_length(ext) <= 8), ext).otherwise(base))


def coarse_signature(stage: Column, error: Column, context: Column) -> Column:
    """stage=, err= and file= parts joined by bars."""
    return F.concat_ws("|", F.concat(F.lit("stage="), F.lower(F.trim(F.coalesce(stage, F.lit(""))))), F.concat(F.lit("err="), error_class(error)), F.concat(F.lit("file="), file_type(context)))


def situations(lib: Library) -> DataFrame:
    """page_id, signature, context key and whether the signature says anything, of each situation (stage, error, file)."""
    sig = coarse_signature(F.col("stage"), F.col("last_error"), F.col("file_context"))
    return lib.situations.select("id", sig.alias("signature"), F.sha2(sig, 256).alias("context_key"), F.exists(F.split(sig, r"\|"), lambda p: ~p.endswith("=")).alias("has_signal"))


def without_ansi(text: Column) -> Column:
    """``text`` without terminal colour and cursor codes."""
    return F.regexp_replace(text, "\u001b\\[[^A-Za-z]*[A-Za-z]", "")


def is_noise(result: Column) -> Column:
    """Failures that say nothing about the command: a bare exit code, or a refusal."""
    return (F.trim(result) == "Exit code 1") | any_of(result, NOISE)


def is_correction(text: Column) -> Column:
    """Short human text with a correcting phrase; a two-sign Chinese phrase must not run on into another sign."""
    low, said = F.lower(text), F.lit(False)
    for phrase in CORRECTIONS:
        short = len(phrase) <= 2
        said = said | (low.rlike(f"{phrase}(?:[^\u4e00-\u9fff]|$)") if short else F.contains(low, F.lit(phrase)))
    return said & (F.length(text) <= CORRECTION_MOST) & ~F.ltrim(text).startswith(CONTINUED)


def error_kind(message: Column) -> Column:
    """One of a closed set of kinds."""
    low = F.lower(message)
    return (
        F.when(any_of(low, ["arrearage", "欠费"]), "embedding_arrearage").when(any_of(low, ["no such file", "text file busy"]), "spawn_failed").when(any_of(low, ["timeout", "deadline"]), "llm_timeout")
        .when(any_of(low, ["status: 4", "status: 5", "http error"]), "llm_http_error").when(any_of(low, ["locked", "busy"]), "db_locked").otherwise("other")
    )


def http_bucket(message: Column) -> Column:
    """rate_limited, http_4xx, http_5xx, transport or error: by the first three digits within 100 to 599, else by words."""
    low = F.lower(message)
    code = F.regexp_extract(low, "([1-5][0-9][0-9])", 1)
    return (
        F.when(any_of(low, ["status: 429", "429 "]), "rate_limited").when(code >= "500", "http_5xx").when(code >= "400", "http_4xx").when(code != "", "error")
        .when(any_of(low, ["transport", "connection", "tls"]), "transport").otherwise("error")
    )


def message_flags(lib: Library) -> DataFrame:
    """id, cleaned length, predicates and classes of each message."""
    t = F.col("text")
    return lib.messages.select(
        "id", F.length(without_ansi(t)).alias("clean_length"), is_noise(t).alias("noise"), is_correction(t).alias("correction"), any_of(F.lower(t), REPORTS).alias("status_report"),
        error_kind(t).alias("error_kind"), http_bucket(t).alias("http_bucket"), F.sha2(F.concat_ws(":", "id", F.lit("0"), F.length(t).cast("string"), t), 256).alias("event_id"),
    )


def cited_ids(text: Column, marker: str) -> Column:
    """Distinct UUIDs that follow ``marker`` in a text, in order."""
    uuid = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"{marker}({uuid})"), F.lit(1)))


def citations(lib: Library) -> DataFrame:
    """id and cited chunk ids of each message that cites any."""
    x = lib.messages.select("id", cited_ids(F.col("text"), "chunk:").alias("cited"))
    return x.filter(F.size("cited") > 0).select("id", F.array_join("cited", ",").alias("cited"))


def grounded_signals(lib: Library) -> DataFrame:
    """id and those of a rule's signals that its own text holds; words of the trigger that are no words of the text count as invented."""
    signals = F.split(F.lower("trigger_desc"), " ")
    said = F.filter(signals, lambda s: (F.length(s) >= 4) & F.contains(F.lower("content"), s))
    return lib.chunks.select("id", F.array_join(F.array_distinct(said), " ").alias("signals"))


def corrections(lib: Library) -> DataFrame:
    """id, previous and next assistant text (200 characters) of each correcting user message of a conversation.

    A conversation is one window; rows that repeat a turn are ordered by text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    said = F.when(F.col("role") == "assistant", F.substring("text", 1, 200))
    x = lib.messages.withColumns({
        "previous": F.last(said, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "next": F.first(said, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
    })
    return x.filter((F.col("role") == "user") & is_correction(F.col("text"))).select("id", "previous", "next")


def session_summaries(lib: Library) -> DataFrame:
    """conv_id, number of messages, and its newest user and assistant text (200 characters)."""
    newest = lambda role: F.substring(F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.struct("turn", "text"))), 1, 200)
    return lib.messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), newest("user").alias("asked"), newest("assistant").alias("answered"))
