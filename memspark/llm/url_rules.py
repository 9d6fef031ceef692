"""URL filtering by fixed host rules and mined association rules.

Fixed rules (a host with all its subdomains, and the start of a path) decide
first, the longest of those that fit.  Other urls are judged by association
rules: FP-growth mines combinations of url tokens that go with a label, rules
below a support (relative, and in rows), lift or certainty are pruned, as are
those that chance could give and those whose extra tokens add nothing, and the
rest are found through an inverted index on each rule's rarest token.  Certainty
is the share of the way from a label's base rate to 1 that a rule goes, so rules
for rare labels have their chance.  Tokens that the same labelled urls hold stand
as one in mining: 25 shared path segments are one item, not 2^25 itemsets.
DataFrame and Spark ML operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ALL = r"(?s)^.*?://(.*)$"
#: Labels are items of the transactions beside the url tokens; no token has this prefix.
_LABEL = "label="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct url tokens: scheme, host labels and suffixes, path segments with digits masked, query names."""
    text = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.regexp_extract(text, _ALL, 1), r"\?([^#]*)", 1)
    some = lambda items: F.filter(items, lambda x: x != "")
    prefixed = lambda p, items: F.transform(some(items), lambda x: F.concat(F.lit(p), x))
    labels = prefixed("h:", F.split(host, r"\."))
    segments = prefixed("p:", F.split(F.regexp_replace(path, r"\d+", "0"), "/"))
    names = prefixed("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)))
    scheme = prefixed("s:", F.array(F.regexp_extract(text, r"(?s)^(.*?)://", 1)))
    mark = prefixed("f:", F.array(F.when(text.contains("#"), "fragment").otherwise("")))
    return F.array_distinct(F.concat(scheme, labels, segments, names, mark))


def fixed_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host, path) that fits, else nulls."""
    rule = verdict = None
    for said, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _merged(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``items`` (tokens, label) without tokens that others stand for, and token and also: the tokens that each left one stands for, itself first.

    Tokens with the same rows have the same count and sums of two hashes of the
    rows' contents.  A group has no more tokens than a url.
    """
    each = items.select(F.explode("tokens").alias("token"), F.xxhash64("tokens", "label").alias("h"), F.hash("label", "tokens").alias("g"))
    marks = [F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hs"), F.sum(F.col("g").cast("decimal(38,0)")).alias("gs")]
    groups = each.groupBy("token").agg(*marks).groupBy("n", "hs", "gs").agg(F.array_sort(F.collect_list("token")).alias("also"))
    groups = written(groups.select(F.element_at("also", 1).alias("token"), "also"), "url-tokens")
    dropped = groups.filter(F.size("also") > 1).select(F.explode(F.slice("also", 2, F.size("also"))).alias("token"))
    gone = items.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(dropped, "token").groupBy("tokens").agg(F.collect_list("token").alias("gone"))
    left = F.array_except("tokens", F.coalesce("gone", F.array().cast("array<string>")))
    return items.join(gone, "tokens", "left").select(left.alias("tokens"), "label"), groups


def mine(
    labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.0, min_lift: float = 1.05, min_rows: int = 5, min_gain: float = 0.02, min_certainty: float = 0.25, min_z: float = 3.0
) -> DataFrame:
    """Association rules of ``labelled`` (url, verdict): rule_tokens, verdict, confidence, lift, certainty, support, ways, rarest.

    A rule holds in at least ``min_rows`` rows and ``min_support`` of all rows,
    goes ``min_certainty`` of the way from its label's base rate to 1, stands
    ``min_z`` deviations above that rate, and its confidence passes that of each
    kept rule with one token less by ``min_gain``.  Rows without url, verdict or
    token are left out.  ``ways`` holds for each token those that it stands for:
    a url needs one of each.  ``rarest`` is that of the token with the least
    support (ties: the smaller token).
    """
    items = (
        labelled.filter("url IS NOT NULL AND verdict IS NOT NULL")
        .select(tokens_of(F.col("url")).alias("tokens"), F.concat(F.lit(_LABEL), "verdict").alias("label"))
        .filter(F.size("tokens") > 0)
    )
    items = written(items, "url-items")
    n = items.count()
    narrow, groups = _merged(items)
    support = max(min_support, (min_rows - 0.5) / max(n, min_rows))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(narrow.select(F.concat("tokens", F.array("label")).alias("items")))
    base = F.col("confidence") / F.col("lift")
    deviation = F.sqrt(base * (1 - base) * F.col("confidence") / (F.col("support") * max(n, 1)))
    rules = (
        model.associationRules.filter(F.element_at("consequent", 1).startswith(_LABEL))
        .filter(~F.exists("antecedent", lambda t: t.startswith(_LABEL)))
        .filter((F.col("lift") >= min_lift) & (F.col("confidence") >= min_confidence))
        .withColumn("certainty", (F.col("confidence") - base) / F.greatest(1 - base, F.lit(1e-12)))
        .filter((F.col("certainty") >= min_certainty - 1e-9) & (F.col("confidence") - base >= min_z * deviation - 1e-9))
        .select(
            F.array_sort("antecedent").alias("rule_tokens"),
            F.substring(F.element_at("consequent", 1), len(_LABEL) + 1, 1000).alias("verdict"),
            "confidence", "lift", "certainty", "support",
        )
    )
    rules = written(rules, "url-rules")
    wider = rules.select("rule_tokens", "verdict", "confidence", F.explode("rule_tokens").alias("token")).withColumn("less", F.array_remove("rule_tokens", F.col("token")))
    lesser = rules.select(F.col("rule_tokens").alias("less"), "verdict", F.col("confidence").alias("before"))
    idle = wider.join(lesser, ["less", "verdict"]).filter(F.col("confidence") < F.col("before") + min_gain)
    rules = rules.join(idle.select("rule_tokens", "verdict").distinct(), ["rule_tokens", "verdict"], "left_anti")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    parts = rules.select("rule_tokens", F.explode("rule_tokens").alias("token")).distinct().join(single, "token").join(groups, "token")
    found = parts.groupBy("rule_tokens").agg(F.array_sort(F.collect_list(F.struct("freq", "token", "also"))).alias("parts"))
    named = found.select("rule_tokens", F.transform("parts", lambda p: p["also"]).alias("ways"), F.element_at("parts", 1)["also"].alias("rarest"))
    return written(rules.join(named, "rule_tokens"), "url-kept")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdict of the best mined rule for each url that one fits: url, mined.

    Each distinct url is judged once.  A rule is a candidate for urls that hold
    its rarest token and fits if they hold all its tokens, or others that these
    stand for.  Best: highest certainty, then confidence, support, fewer and
    smaller tokens.
    """
    each = urls.select("url").filter(F.col("url").isNotNull()).distinct().withColumn("tokens", tokens_of(F.col("url")))
    candidates = each.select("url", "tokens", F.explode("tokens").alias("token")).join(rules.withColumn("token", F.explode("rarest")), "token")
    fitting = candidates.filter(F.forall("ways", lambda w: F.arrays_overlap(w, F.col("tokens"))))
    key = F.struct(-F.round("certainty", 9), -F.col("confidence"), -F.col("support"), F.array_join("rule_tokens", " "), "verdict")
    return fitting.groupBy("url").agg(F.min(key).getField("verdict").alias("mined"))


def judge(
    pages: DataFrame, labelled: DataFrame, fixed: Sequence[tuple[str, str, str]], default: str = "allow", **mining: float
) -> DataFrame:
    """``pages`` (page_id, url, any others) with host, path, rule and verdict.

    One output row per input row, repeated and null ids included; only page_id
    and url are read.  Null urls, and those without ``://``, have an empty host
    and path, fit no fixed rule and get ``default``, as does any url that no
    rule fits.  Without labelled rows nothing is mined.
    """
    own = pages.select("page_id", "url")
    found = matched(own, mine(labelled, **mining))
    rule, verdict = fixed_verdict(F.col("host"), F.col("path"), fixed)
    return (
        own.join(found, "url", "left")
        .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "mined")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "mined", F.lit(default)).alias("verdict"))
    )
