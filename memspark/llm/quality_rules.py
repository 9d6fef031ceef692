"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams (each word, and each two words in a
row) are estimated: one of the raw corpus, from every document, and one of
trusted text.  A document's score is the log-likelihood ratio of trusted against raw,
divided by its number of n-grams; every document under the threshold goes.
Only DataFrame operations are used.  The table of log ratios has a fixed number
of buckets, so it travels as a constant.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import WORD_SPACE

#: Buckets (a power of two), pseudo-counts shared by all buckets.
BUCKETS, PRIOR = 1 << 16, 1 << 16
#: Trusted documents at most, by hash.
TRUSTED = 4096
#: Least score per n-gram of a kept document.
THRESHOLD = -0.12
_SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Ratios:
    """log(trusted / raw) of each bucket."""

    log: tuple[float, ...]

    def column(self) -> Column:
        text = ",".join(f"{x:.5f}" for x in self.log)
        return F.split(F.lit(text), ",").cast("array<double>")


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WORD_SPACE}]+"), "")


def hashed(words: Column) -> Column:
    """64-bit hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(hashes: Column) -> Column:
    """Buckets of a text's words, then of each word with the one before it."""
    bucket = lambda *parts: F.xxhash64(*parts).bitwiseAND(BUCKETS - 1).cast("int")
    one = F.transform(hashes, lambda h: bucket(h))
    two = F.transform(hashes, lambda h, i: F.when(i > 0, bucket(F.get(hashes, i - 1), h)))
    return F.concat(one, F.slice(two, 2, F.greatest(F.size(two) - 1, F.lit(0))))


def trusted_hashes(labels: DataFrame) -> list[int]:
    """Id hashes of at most TRUSTED rows with quality 1: the least in each of as many slots."""
    h = F.xxhash64("doc_id")
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL")
    return [r.h for r in good.groupBy(F.pmod(h, F.lit(TRUSTED))).agg(F.min(h).alias("h")).collect()]


def fit(docs: DataFrame, trusted: list[int]) -> Ratios:
    """Bucket counts of all documents and of the trusted ones; flat without either."""
    mine = F.xxhash64("doc_id").isin(trusted) if trusted else F.lit(False)
    words = docs.select(mine.alias("mine"), hashed(words_of(F.col("text"))).alias("_h"))
    # Through a generator, so that the hashes are made once and not at each of their uses.
    each = words.select("mine", F.explode(F.array("_h")).alias("_h")).select("mine", F.explode(grams(F.col("_h"))).alias("b"))
    rows = each.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("mine"), 1)).alias("good")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in rows:
        raw[r.b], good[r.b] = r.raw, r.good
    if not sum(good):
        return Ratios((0.0,) * BUCKETS)
    share = lambda counts, n: [(c + p) / (n + PRIOR) for c, p in zip(counts, prior, strict=True)]
    total = sum(raw)
    # Both are smoothed towards the raw shares: a bucket that the trusted text could not show counts little.
    prior = [PRIOR * (r + 1) / (total + BUCKETS) for r in raw]
    return Ratios(tuple(math.log(g / r) for g, r in zip(share(good, sum(good)), share(raw, total), strict=True)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Output columns that replace those of the same names.
_MADE = {*COUNTS, "llr", "kept"}


def _counted(docs: DataFrame) -> DataFrame:
    """_row (the row without columns of the names made here), the COUNTS and _h, the hashes of its words."""
    own = [c for c in docs.columns if c not in _MADE]
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{WORD_SPACE}]"))
    x = docs.select(F.struct(*own).alias("_row"), words_of(F.col("text")).alias("_w"), lines.alias("_l"), F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"))
    x = x.select(
        "_row", "n_symbols", hashed(F.col("_w")).alias("_h"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
    )
    held = ["_row", "_h", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    windows = F.transform(F.sequence(F.lit(0), F.size("_h") - 3), lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)))
    x = x.select(*held, F.when(F.size("_h") >= 3, windows).otherwise(F.array().cast("array<long>")).alias("_t"))
    some = F.size(F.array_distinct("_t")) < F.size("_t")
    placed = F.array_sort(F.transform("_t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    x = x.select(*held, F.when(some, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"))
    alike = lambda e, j: (e["h"] == F.get("_s", j - 1)["h"]) | (e["h"] == F.get("_s", j + 1)["h"])
    twice = F.filter("_s", lambda e, j: F.coalesce(alike(e, j), F.lit(False)) | F.coalesce(e["h"] == F.get("_s", j + 1)["h"], F.lit(False)))
    covered = F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
    x = x.select(*held, F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    # Through a generator: a filter on the counts would else be pushed below the projections and
    # evaluate them again for each of their uses.
    return x.select(F.inline(F.array(F.struct("_row", "_h", *COUNTS[:-1], failed.alias("base_failed")))))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null texts count as empty: all counts are 0 and base_failed holds.  Repeated
    rows and null ids keep their rows.  No cost grows faster than n log n in the
    length of a text.  The counts replace columns of the same names.
    """
    return _counted(docs).select("_row.*", *COUNTS)


def judged(docs: DataFrame, ratios: Ratios, threshold: float = THRESHOLD) -> DataFrame:
    """``base_counts`` with llr (per n-gram; 0 without words) and kept, which replace columns of the same names."""
    x = _counted(docs)
    table = ratios.column()
    total = F.aggregate(grams(F.col("_h")), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    llr = F.when(F.col("n_words") > 0, total / (F.col("n_words") * 2 - 1)).otherwise(F.lit(0.0))
    x = x.select("_row.*", *COUNTS, llr.alias("llr"))
    return x.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def kept_rows(docs: DataFrame, ratios: Ratios, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_kept"))
    return judged(packed, ratios, threshold).filter("kept").select("_kept.*")
