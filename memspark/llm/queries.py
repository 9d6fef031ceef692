"""Registered queries of the operators: each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import bpe, hard_negatives, jaccard_join, langid, minhash, mixing, pii, pu_quality, quality_rules, spelling, suffix_dedup, topk, url_rules
from memspark.llm.common import fold, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Verdict, host and start of the path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality_rules.judged(docs.select("doc_id", "text"), quality_rules.fit(docs, quality_rules.trusted_hashes(labels)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predicted(docs, langid.fit(docs, fold(F.col("doc_id"), 5) != 0))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.clustered(table(spark, sf_dir, "documents"), 85)


def op7_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detected(docs, pii.fit(docs))


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = pu_quality.scored(docs, pu_quality.fit(docs, labels, fold(F.col("doc_id"), 3) != 1))
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.stripped(table(spark, sf_dir, "documents"), digest=True)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    verdict = F.when(F.col("quality") == 0, "block").when(F.col("quality") == 1, "allow")
    labelled = labels.select(F.col("doc_id").alias("page_id"), verdict.alias("verdict")).join(pages.select("page_id", "url"), "page_id")
    return url_rules.judge(pages, labelled, URL_RULES)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.clustered(table(spark, sf_dir, "documents"), 80)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", moved, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_topk, op2_byte_bpe, op3_source_mix, op4_quality_rules, op5_cross_parsing, op6_minhash, op7_semi_markov_pii, op8_pu_quality, op9_suffix_array, op10_url_rules, op11_jaccard_join, op12_spelling_variants, op13_hard_negatives)}


#: Words, lower-cased in A-Z only: DuckDB's lower() would change other letters too.
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
def _similar(percent: int, also: str) -> str:
    """SQL of the components of documents whose sets are at least ``percent`` similar, over all pairs that share a shingle."""
    return f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        sets AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(list(sh))) AS rep FROM s GROUP BY doc_id),
        u AS (SELECT s.doc_id, s.sh FROM s JOIN sets ON s.doc_id = sets.doc_id AND sets.doc_id = sets.rep),
        inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
        ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        reach(a, b) AS (SELECT rep, rep FROM sets WHERE doc_id = rep UNION SELECT r.a, x.b FROM reach r JOIN ways x ON x.a = r.b),
        root AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root.root, d.doc_id) AS component_id{also}
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN sets ON sets.doc_id = d.doc_id LEFT JOIN root ON root.a = sets.rep"""


ORACLES = {
    "op11_jaccard_join": _similar(80, ""),
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
        r AS (
            SELECT s.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY s.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
            FROM s JOIN p ON p.anchor_id = s.anchor_id AND p.place <= 5
            WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10""",
    "op6_minhash": _similar(85, ", d.doc_id = coalesce(root.root, d.doc_id) AS kept"),
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
