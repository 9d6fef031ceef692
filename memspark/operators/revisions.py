"""Model replies about rules: parsing with guards, judged verdicts, births and revisions.

A model is not called here.  Prompts are tables that a caller sends to a model of
its own; replies come back as tables (key, raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.library import Library, bound
from memspark.operators.distillation import stripped
from memspark.operators.rules import episode_clusters
from memspark.operators.texts import sanitized
from memspark.tables import stored

# Drafts of a reply, signals of a draft, words of a skill's name, least length of a quote, confidence of a new rule.
DRAFTS, SIGNALS, NAME_WORDS, QUOTE, SEED = 2, 8, 3, 3, 0.55
DRAFT = "skill_name string, content string, signals array<string>, trigger_desc string, anti_trigger_desc string"
_DRAFT = "struct<" + DRAFT.replace(" string", ": string").replace("signals array", "signals: array") + ">"


def first_json(raw: Column) -> Column:
    """From the first bracket of a reply to the last one that closes its kind; the whole reply without such a pair."""

    def cut(t: Column, start: Column) -> Column:
        close = F.when(F.substring(t, start, F.lit(1)) == "{", "}").otherwise("]")
        end = bound(F.call_function("locate", close, F.reverse(t)), lambda back: F.when(back > 0, F.length(t) - back + 1).otherwise(F.length(t)))
        return bound(end, lambda e: F.when(e >= start, F.substring(t, start, e - start + 1)).otherwise(t))

    return bound(stripped(raw), lambda t: bound(F.greatest(F.regexp_instr(t, F.lit(r"[\[{]")), F.lit(1)), lambda start: cut(t, start)))


def _text(value: Column) -> Column:
    """A trimmed text; null for empty ones and the word null."""
    return bound(stripped(value), lambda t: F.when((t != "") & (F.lower(t) != "null"), t))


def _draft(d: Column) -> Column:
    """A draft with its texts trimmed, a name of few words and few signals; null without content."""
    words = F.array_join(F.slice(F.filter(F.split(_text(d["skill_name"]), r"\s+"), lambda w: w != ""), 1, NAME_WORDS), " ")
    marks = F.slice(F.filter(F.transform(F.coalesce(d["signals"], F.array().cast("array<string>")), lambda s: stripped(s)), lambda s: s.isNotNull() & (s != "")), 1, SIGNALS)
    clean = lambda content: F.struct(words.alias("skill_name"), content.alias("content"), marks.alias("signals"), _text(d["trigger_desc"]).alias("trigger_desc"), _text(d["anti_trigger_desc"]).alias("anti_trigger_desc"))
    return bound(_text(d["content"]), lambda content: F.when(content.isNotNull(), clean(content)))


def drafts(raw: Column) -> Column:
    """The first DRAFTS drafts with content of a reply, a list of them or one alone; null for a reply that is neither."""

    def read(j: Column) -> Column:
        listed = F.from_json(j, f"array<{_DRAFT}>")
        alone = F.from_json(j, DRAFT)
        found = F.when(j.startswith("["), listed).when(j.startswith("{"), F.array(alone))
        # A reply that is no JSON parses to nulls throughout, as does an object without any known key.
        return F.when(F.try_parse_json(j).isNotNull(), F.slice(F.filter(F.transform(found, _draft), lambda d: d.isNotNull()), 1, DRAFTS))

    return bound(first_json(raw), read)


def judgement(raw: Column, observation: Column) -> Column:
    """Verdict of a judge's reply: supported and contradicted need a quote that the observation holds word for word, a support that was not applied is irrelevant."""

    def verdict(r: Column, quote: Column) -> Column:
        grounded = F.coalesce((F.length(quote) >= QUOTE) & F.contains(observation, quote), F.lit(False))
        said = F.when(F.coalesce(r["verdict"], F.lit("")).isin("supported", "contradicted", "irrelevant"), r["verdict"]).otherwise("unknown")
        return F.when(said.isin("supported", "contradicted") & ~grounded, "unknown").when((said == "supported") & (F.coalesce(r["applied"], F.lit(True)) == False), "irrelevant").otherwise(said)  # noqa: E712

    return bound(F.from_json(first_json(raw), "verdict string, quote string, applied boolean"), lambda r: bound(_text(r["quote"]), lambda quote: verdict(r, quote)))


def judge_prompts(lib: Library, observations: DataFrame) -> DataFrame:
    """id and prompt of ``observations`` (id, chunk_id, verdict, observation) that wait for a judge: of rules that are not archived, each with the rule's text."""
    rule = lib.chunks.filter("state <> 'archived'").select(F.col("id").alias("chunk_id"), "content")
    text = F.concat(F.lit("Rule:\n"), "content", F.lit("\n\nWhat followed:\n"), "observation", F.lit('\n\nReply as {"verdict": "supported|contradicted|irrelevant", "applied": bool, "quote": words of what followed}.'))
    return observations.filter("verdict = 'observed' AND observation IS NOT NULL").join(rule, "chunk_id").select("id", text.alias("prompt"))


def judged(lib: Library, observations: DataFrame, replies: DataFrame) -> DataFrame:
    """id, chunk_id and verdict of waiting ``observations`` that a reply (key, raw) is there for."""
    ok = lib.chunks.filter("state <> 'archived'").select(F.col("id").alias("chunk_id"))
    waiting = observations.filter("verdict = 'observed'").select("id", "chunk_id", "observation")
    x = waiting.join(ok, "chunk_id", "left_semi").join(replies.select(F.col("key").alias("id"), "raw"), "id")
    return x.select("id", "chunk_id", judgement(F.col("raw"), F.coalesce("observation", F.lit(""))).alias("verdict"))


def birth_seeds(lib: Library) -> DataFrame:
    """key, id and project of the episodes that may give birth to rules: the clusters, then corrections outside them, one alone each."""
    clusters = stored(episode_clusters(lib).select("id", F.col("cluster").alias("key")), "seeds")
    each = lib.episodes.select("id", "project").distinct()
    if "kind" in lib.episodes.columns:
        alone = lib.episodes.filter("kind = 'correction'").select("id").distinct().join(clusters.select("id"), "id", "left_anti").select("id", F.col("id").alias("key"))
        clusters = clusters.unionByName(alone)
    return clusters.join(each, "id").select("key", "id", "project")


def birth_prompts(seeds: DataFrame, texts: DataFrame) -> DataFrame:
    """key and prompt of each seed group: the texts (id, text) of its episodes under the names P1, P2 ... of their projects, so that none is told."""
    named = seeds.join(texts, "id")
    names = F.array_sort(F.collect_set("project"))
    listed = F.array_sort(F.collect_list(F.struct("id", "project", "text")))
    x = named.groupBy("key").agg(names.alias("names"), listed.alias("l"))
    line = lambda e: F.concat(F.lit("["), F.coalesce(F.concat(F.lit("P"), F.array_position("names", e["project"])), F.lit("?")), F.lit("] "), e["text"])
    body = F.array_join(F.transform("l", line), "\n")
    return x.select("key", F.concat(F.lit("Write at most two rules that would have helped in all of these, as a JSON list of {skill_name, content, signals, trigger_desc, anti_trigger_desc}:\n"), body).alias("prompt"))


def _rules(x: DataFrame, lib: Library) -> DataFrame:
    """Drafts ``d`` of ``x`` (key, nth) as rules: sanitised, with id and hash; those that would steer a model or were invalidated are left out."""
    clean, action = sanitized(F.col("d.content"))
    gone = lib.chunks.filter("state = 'archived'").select(F.col("content_hash").alias("hash")).distinct()
    y = x.withColumns({"content": clean, "action": action}).filter("action <> 'discard'").withColumn("hash", F.sha2("content", 256)).join(gone, "hash", "left_anti")
    trigger = F.coalesce("d.trigger_desc", F.when(F.size("d.signals") > 0, F.array_join("d.signals", " | ")))
    return y.withColumns({"id": F.sha2(F.concat_ws("|", "key", "nth", "hash"), 256), "trigger_desc": trigger, "skill_name": F.coalesce(F.nullif("d.skill_name", F.lit("")), trigger), "anti_trigger_desc": F.col("d.anti_trigger_desc"), "signals": F.array_join("d.signals", "|")})


def births(lib: Library, seeds: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, episodes) that ``replies`` (key, raw) about ``seeds`` (key, id, project) come to.

    Rules are pending, of version 1, with the projects of their episodes and
    confidence SEED.  Episodes are ``ruled`` with the group's first rule, or
    ``no_rule`` where the reply gave none that may stay; those without a reply
    that can be read stay open and are not listed.
    """
    read = replies.select("key", drafts(F.col("raw")).alias("ds")).filter("ds IS NOT NULL")
    projects = seeds.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("project")), ",").alias("source_projects"))
    each = read.select("key", F.posexplode("ds").alias("nth", "d"))
    made = stored(_rules(each, lib).join(projects, "key"), "born")
    rules = made.select("id", "key", "skill_name", "content", "trigger_desc", "anti_trigger_desc", "signals", "source_projects", F.lit(1).alias("version"), F.lit("pending").alias("state"), F.lit("init:episodes").alias("state_reason"), F.lit(SEED).alias("confidence"))
    first = made.groupBy("key").agg(F.min_by("id", "nth").alias("rule_id"))
    marks = seeds.join(read.select("key"), "key", "left_semi").join(first, "key", "left").select("id", F.when(F.col("rule_id").isNull(), "no_rule").otherwise("ruled").alias("state"), "rule_id")
    return rules, marks.distinct()


def revisions(lib: Library, contradictions: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rules) of ``replies`` (key: chunk_id, raw) about rules with open ``contradictions`` (chunk_id, project).

    A rule that the user gave is not touched.  ``revise`` with a rule that may
    stay archives the old one as superseded by a new version, whose projects are
    the old ones and those of the contradictions; ``retire`` archives; ``keep``
    leaves it.  In each case the contradictions are resolved; a reply that
    cannot be read changes nothing.
    """
    meta = lib.rule_meta.select(F.col("id").alias("key"), "version", "source_projects", "directive")
    against = contradictions.groupBy(F.col("chunk_id").alias("key")).agg(F.collect_set("project").alias("more"))
    j = first_json(F.col("raw"))
    x = replies.join(against, "key").join(lib.chunks.select(F.col("id").alias("key")), "key", "left_semi").join(meta, "key", "left").filter("NOT coalesce(directive, false)")
    x = x.select("key", "more", F.coalesce("version", F.lit(1)).alias("version"), "source_projects", F.from_json(j, f"action string, rule {_DRAFT}, reason string").alias("r"))
    draft = _draft(F.col("r.rule"))
    action = F.when((F.col("r.action") == "revise") & draft.isNotNull(), "revise").when(F.col("r.action").isin("retire", "keep"), F.col("r.action"))
    x = stored(x.select("key", "more", "version", "source_projects", action.alias("action"), draft.alias("d"), F.lit(0).alias("nth")).filter("action IS NOT NULL"), "replies")
    known = F.when(F.coalesce("source_projects", F.lit("")) != "", F.split("source_projects", ",")).otherwise(F.array().cast("array<string>"))
    made = stored(_rules(x.filter("action = 'revise'"), lib), "revised")
    rules = made.select("id", F.col("key").alias("parent_id"), (F.col("version") + 1).alias("version"), "skill_name", "content", "trigger_desc", "anti_trigger_desc", "signals", F.array_join(F.array_union(known, F.array_sort("more")), ",").alias("source_projects"), F.lit("pending").alias("state"), F.concat(F.lit("revision_of:"), "key").alias("state_reason"))
    new = made.select("key", F.col("id").alias("new_id"))
    y = x.join(new, "key", "left")
    becomes = F.when(F.col("new_id").isNotNull() | (F.col("action") == "retire"), "archived")
    why = F.when(F.col("new_id").isNotNull(), F.concat(F.lit("superseded:"), "new_id")).when(F.col("action") == "retire", "retired:counterexample")
    return y.select(F.col("key").alias("chunk_id"), "action", becomes.alias("becomes"), why.alias("state_reason"), F.lit(True).alias("resolved")), rules


# --- registered forms, with the fixtures' replies ---


def judged_observations(lib: Library) -> DataFrame:
    """id, chunk_id and verdict of the fixture's observations and replies."""
    return judged(lib, lib.observations, lib.observations.select(F.col("id").alias("key"), "raw"))


def born_rules(lib: Library) -> DataFrame:
    """key, content, signals, skill_name, trigger_desc and source_projects of rules born of the fixture's replies."""
    seeds = birth_seeds(lib)
    rules, _ = births(lib, seeds, lib.replies.select(F.concat(F.lit("e"), "n").alias("key"), F.col("birth").alias("raw")))
    return rules.select("key", "content", "signals", "skill_name", "trigger_desc", "source_projects", "confidence")


def revised_rules(lib: Library) -> DataFrame:
    """chunk_id, action, becomes, why, content, version and source_projects of the fixture's replies about contradicted rules."""
    open_ = lib.validations.filter("verdict = 'contradicted' AND resolved_at IS NULL")
    told, rules = revisions(lib, open_, lib.replies.select(F.concat(F.lit("c"), "n").alias("key"), F.col("revision").alias("raw")))
    new = rules.select(F.col("parent_id").alias("chunk_id"), "content", "version", "source_projects")
    return told.join(new, "chunk_id", "left").select("chunk_id", "action", "becomes", F.split("state_reason", ":")[0].alias("why"), "content", "version", "source_projects")
