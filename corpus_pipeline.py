"""Corpus preparation: quality rules, near duplicates, personal data, source mix, tokens.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and returns a DataFrame; all but the last return the columns of
``docs``.  Columns beyond doc_id, text, source and n_chars pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import bpe, minhash, mixing, pii, quality_rules
from memspark.llm.common import table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Similarity of shingle sets, in percent, from which documents are near duplicates.
NEAR_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio; trusted text is what ``labels`` calls good."""
    trusted = quality_rules.trusted_hashes(table(spark, sf_dir, "labels"))
    return quality_rules.kept_rows(docs, quality_rules.fit(docs, trusted))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; rows with a null id stay.

    Of rows that repeat an id the one whose columns come first as JSON stays.
    """
    gone = written(minhash.clustered(docs, NEAR_PERCENT).filter("NOT kept").select("doc_id").distinct(), "gone")
    small = gone.count() <= minhash.SMALL
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)
    again = written(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    row = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("row")
    once = kept.join(again, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(row).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    masked = pii.masked(docs, pii.fit(docs))
    if "n_chars" not in docs.columns:
        return masked
    length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy."""
    return mixing.repeated(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    return bpe.encoded(docs, VOCABULARY, public_tokenizers.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
    ("tokens", to_tokens),
]

#: Learned models and hash thresholds decide in several stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
