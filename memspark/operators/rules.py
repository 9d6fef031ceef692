"""Rules in use: reported verdicts, signals matched against actions, groups of episodes that recur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators.distillation import stripped
from memspark.operators.graph import components
from memspark.operators.texts import redacted
from memspark.operators.vector_links import links
from memspark.tables import stored

# Verdicts that agents report, words and commands that say nothing, least length of what matches.
VERDICTS = ["applied", "supported", "contradicted", "irrelevant"]
GENERIC = [
    "error", "errors", "failed", "failure", "warning", "build", "test", "tests", "run", "git", "npm", "cargo", "node", "python", "python3", "bash", "sudo", "curl",
    "docker", "make", "http", "https", "file", "files", "path", "code", "true", "false", "null", "错误", "失败", "报错", "问题",
]
GENERIC_COMMANDS = [
    "cargo test", "cargo build", "cargo run", "cargo clippy", "pytest", "npm test", "npm run build", "npm run dev", "npm install", "npm ci", "yarn build", "pnpm build", "git status", "git diff",
    "git commit", "git push", "git pull", "git log", "tsc", "python -m pytest", "go test", "go build", "make test",
]
LEAST_SCORE = 6
#: Lengths of the beginnings by which signals and texts meet.
ANCHORS = (3, 4, 6, 8, 12, 16, 24, 32)
FAN, MEMBERS, MEANING = 8, 6, 0.82


def validated_verdicts(lib: Library) -> DataFrame:
    """id and problem of each reported verdict, null if it is accepted, with the observation as kept.

    Problems in order: no such verdict, an observation is required, no such
    chunk, a spark is no rule.  Observations are trimmed, keys replaced; empty
    ones count as none.
    """
    known = lib.chunks.select(F.col("id").alias("chunk_id"), "origin")
    said = redacted(stripped(F.col("observation")))
    x = lib.submitted.withColumn("said", F.when(said != "", said)).join(known, "chunk_id", "left")
    problem = (
        F.when(~F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False)), "invalid_verdict").when(F.col("verdict").isin("supported", "contradicted") & F.col("said").isNull(), "observation_required")
        .when(F.col("origin").isNull(), "unknown_chunk").when(F.col("origin") == "spark", "spark_not_a_rule")
    )
    return x.select("id", problem.alias("problem"), F.when(problem.isNull(), F.col("said")).alias("observation"))


def _usable(signal: Column) -> Column:
    """A signal in lower case without its mark; null where it is too short or says nothing."""
    s = F.lower(stripped(F.regexp_replace(stripped(signal), "^(sig:)+", "")))
    cjk = s.rlike("[一-鿿]")
    return F.when((F.length(s) >= F.when(cjk, 3).otherwise(4)) & ~s.isin(GENERIC + GENERIC_COMMANDS), s)


def usable_signals(lib: Library) -> DataFrame:
    """id, state and signal: the distinct signals of each rule (split at bars) that can be matched."""
    x = lib.rules.select("id", "state", F.explode(F.array_distinct(F.transform(F.split("signals", r"\|"), _usable))).alias("signal"))
    return x.filter("signal IS NOT NULL")


def _grams(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, n))


def _held(texts: DataFrame, signals: DataFrame) -> DataFrame:
    """text_id and signal of each of ``signals`` (signal) that a text (text_id, text) holds.

    Texts and signals meet by the longest of ANCHORS that fits into the signal,
    so few meet that do not match.
    """
    n = F.lit(ANCHORS[0])
    for length in ANCHORS[1:]:
        n = F.when(F.length("signal") >= length, length).otherwise(n)
    keys = signals.select("signal").distinct().withColumn("n", n).select("signal", "n", F.xxhash64(F.substring("signal", F.lit(1), F.col("n"))).alias("gram"))
    # At most one row for each of ANCHORS.
    lengths = [r["n"] for r in keys.select("n").distinct().collect()] or [ANCHORS[0]]
    grams = F.concat(*[F.transform(_grams(F.col("text"), n), lambda g: F.xxhash64(g)) for n in lengths])
    met = texts.select("text_id", F.explode(F.array_distinct(grams)).alias("gram")).join(keys.select("signal", "gram"), "gram").select("text_id", "signal")
    return met.join(texts, "text_id").filter(F.contains("text", "signal")).select("text_id", "signal")


def _pairs(names: str) -> Column:
    """Hashes of all pairs of an array, the earlier one first."""
    return F.flatten(F.transform(names, lambda x, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda y: F.xxhash64(x, y))))


def best_rules(texts: DataFrame, signals: DataFrame) -> DataFrame:
    """text_id, chunk_id, score and signals: the best rule of each text (text_id, text) by the ``signals`` (id, state, signal) it holds.

    Rules are as many as differ in the signals that occur in any text; of equal
    ones the best stands for all.  A rule that matches by one signal only is the
    best of all that have it, so a text needs one rule for each of its signals;
    rules that match by more are met by pairs of signals.
    """
    found = stored(_held(texts, signals), "held")
    used = signals.join(found.select("signal").distinct(), "signal", "left_semi")
    rule = F.struct(F.when(F.col("state") == "active", 0).otherwise(1).alias("idle"), F.col("id").alias("chunk_id"), "state")
    sets = used.groupBy("id", "state").agg(F.array_sort(F.collect_set("signal")).alias("names"))
    sets = stored(sets.groupBy("names").agg(F.min(rule).alias("rule")), "sets")
    top = sets.select("rule", F.explode("names").alias("signal")).groupBy("signal").agg(F.min("rule").alias("rule"))
    one = found.join(top, "signal").select("text_id", "rule", F.array("signal").alias("both"))
    several = sets.filter(F.size("names") > 1)
    sharing = several.select(F.explode("names").alias("signal")).distinct()
    held = found.join(sharing, "signal", "left_semi").groupBy("text_id").agg(F.array_sort(F.collect_list("signal")).alias("held")).filter(F.size("held") > 1)
    met = held.select("text_id", F.explode(_pairs("held")).alias("pair")).join(several.select("rule", F.explode(_pairs("names")).alias("pair")), "pair").select("text_id", "rule").distinct()
    more = met.join(held, "text_id").join(several, "rule").select("text_id", "rule", F.array_intersect("names", "held").alias("both"))
    score = F.aggregate("both", F.lit(0).cast("long"), lambda acc, s: acc + F.length(s))
    x = one.unionByName(more).withColumn("score", score).filter(F.col("score") >= LEAST_SCORE)
    best = x.groupBy("text_id").agg(F.min(F.struct((-F.col("score")).alias("score"), "rule", "both")).alias("b"))
    return best.select("text_id", "b.rule.chunk_id", (-F.col("b.score")).alias("score"), F.array_join("b.both", "|").alias("signals"))


def matched_actions(lib: Library) -> DataFrame:
    """id, chunk_id, score, signals and shown: the best rule of each action's text whose signals it holds.

    Score: characters of the matched signals, at least LEAST_SCORE; ties go to
    active rules, then to the smaller id.  A rule is shown once in a session, at
    its first action (time, id).  Equal texts are matched once.  Archived rules
    do not match.
    """
    signals = usable_signals(lib).filter("state <> 'archived'").distinct()
    actions = lib.actions.select(F.col("id").alias("action"), "session_id", "ts", F.lower("text").alias("text")).filter("text IS NOT NULL")
    texts = stored(actions.groupBy("text").agg(F.min("action").alias("text_id")), "texts")
    y = actions.join(texts, "text").join(best_rules(texts, signals), "text_id")
    first = F.row_number().over(Window.partitionBy("chunk_id", "session_id").orderBy("ts", "action")) == 1
    return y.select(F.col("action").alias("id"), "chunk_id", "score", "signals", first.alias("shown"))


def episode_links(lib: Library) -> DataFrame:
    """Edges (a, b) of episodes with one signal, of 2 to FAN and two sessions at least, as a star around the smallest id, and of episodes close in meaning."""
    x = lib.episodes.filter("signal IS NOT NULL AND session_id IS NOT NULL")
    fan = x.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session_id").alias("s"), F.min("id").alias("centre"))
    by_signal = x.join(fan.filter(f"n BETWEEN 2 AND {FAN} AND s >= 2"), "signal").filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"))
    meant = lib.episodes.select("id", F.col("session_id").alias("session")).distinct().join(lib.episode_vectors.select("id", F.col("embedding").alias("vec")), "id")
    return by_signal.unionByName(links(meant, MEANING))


def episode_clusters(lib: Library) -> DataFrame:
    """id, cluster, nth and members of episodes that recur over sessions: the MEMBERS first (time, id) of each group, largest groups first.

    Episodes are linked by a signal or, across sessions, by a cosine of MEANING;
    groups of linked ones that span two sessions stay.
    """
    of = components(episode_links(lib)).withColumnRenamed("node", "id")
    grouped = lib.episodes.filter("session_id IS NOT NULL").select("id", "session_id", "ts").distinct().join(of, "id")
    wide = grouped.groupBy("component").agg(F.count_distinct("session_id").alias("s"), F.least(F.count(F.lit(1)), F.lit(MEMBERS)).cast("long").alias("members"), F.min(F.struct("ts", "id")).alias("first")).filter("s >= 2")
    order = Window.partitionBy("component").orderBy("ts", "id")
    x = grouped.join(wide, "component").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= MEMBERS)
    return x.orderBy(F.desc("members"), "first", "nth").select("id", F.col("component").alias("cluster"), "nth", "members")


def episodes_to_embed(lib: Library, per_run: int = 12) -> DataFrame:
    """The oldest episodes that lack a vector, as many as one run embeds."""
    x = lib.episodes.select("id", "session_id", "ts").distinct().join(lib.episode_vectors.filter("embedding IS NOT NULL").select("id"), "id", "left_anti")
    return x.orderBy("ts", "id").limit(per_run).select("id", "session_id")


def consumed_episodes(lib: Library) -> DataFrame:
    """id, state and rule_id of every episode after a run over the clusters: ``ruled`` with the rule that its cluster gave, ``no_rule`` in a cluster that gave none, else ``new``.

    A cluster's rule is the one born of a session of its members; of several the smallest.
    """
    shown = episode_clusters(lib).select("id", "cluster").join(lib.episodes.select("id", "session_id").distinct(), "id")
    gave = shown.join(lib.births.select("session_id", "rule_id").distinct(), "session_id").groupBy("cluster").agg(F.min("rule_id").alias("rule_id"))
    of = shown.select("id", "cluster").join(gave, "cluster", "left")
    x = lib.episodes.select("id").distinct().join(of, "id", "left")
    return x.select("id", F.when(F.col("cluster").isNull(), "new").when(F.col("rule_id").isNull(), "no_rule").otherwise("ruled").alias("state"), "rule_id")


def shown_rows(lib: Library, channel: str = "pre_tool") -> DataFrame:
    """A row ``shown`` for each rule at its first action in a session: id, chunk_id, session_id, channel, tool_use_id, verdict and created_at."""
    x = matched_actions(lib).filter("shown").join(lib.actions.select("id", "session_id", "ts"), "id")
    ident = F.sha2(F.concat_ws("|", "chunk_id", "session_id", F.lit(channel)), 256)
    return x.select(ident.alias("id"), "chunk_id", "session_id", F.lit(channel).alias("channel"), F.col("id").alias("tool_use_id"), F.lit("shown").alias("verdict"), F.col("ts").alias("created_at"))


def missing_signals(lib: Library) -> DataFrame:
    """id and state of the rules in use that have no signal that can be matched: those whose signals are to be written anew."""
    return lib.rules.filter("state <> 'archived'").join(usable_signals(lib).select("id"), "id", "left_anti").select("id", "state")


def backfilled_signals(rules: DataFrame, replies: DataFrame, texts: DataFrame) -> DataFrame:
    """id and signals of ``rules`` (id) after ``replies`` (id, signals: array) about them: only usable signals that the rule's own text (``texts``: id, text) holds, at most eight."""
    each = replies.join(rules.select("id"), "id", "left_semi").select("id", F.posexplode("signals").alias("at", "said")).select("id", "at", _usable(F.col("said")).alias("signal")).filter("signal IS NOT NULL")
    held = each.join(texts, "id").filter(F.contains(F.lower("text"), F.col("signal"))).groupBy("id", "signal").agg(F.min("at").alias("at"))
    listed = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "signal"))), lambda e: e["signal"]), 1, 8)
    return held.groupBy("id").agg(F.array_join(listed, "|").alias("signals"))
