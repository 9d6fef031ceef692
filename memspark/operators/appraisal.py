"""The critic: points for and against a situation, and its verdict with gates of abstention."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators.evidence import calibration, context_stats, outcome_evidence
from memspark.operators.retrieval import scored
from memspark.tables import stored


def contributors(lib: Library) -> DataFrame:
    """query_id, chunk_id, valence, strength, and whether the query's context knows the chunk (``signed``) or outcomes do (``seen``).

    Strength is the fused score of recall without its length term, within [0, 1];
    rows below appraise_strength do not count, and of the rest the appraise_top
    strongest, ties to the smaller chunk.  Caution: an anti-trigger hits, the
    chunk stems from a failure, or its context speaks against it.  Affirm: the
    trigger is near and its record positive.
    """
    p = lib.params
    near = F.col("w_content") + F.col("w_trigger") + F.col("w_lexical")
    record = F.col("w_confidence") + F.col("w_context") + F.col("w_activation")
    fused = (near + record) * F.when(F.col("state") == "pending", p.pending_penalty).otherwise(1.0) * F.when(F.col("anti"), p.anti_penalty).otherwise(1.0)
    # Sums of numbers of six places often end on a half at the seventh: the nudge takes those up, whatever the last bit says.
    strength = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fused + 1e-9)), 6)
    caution = F.col("anti") | F.col("fail_origin") | (F.col("w_context") < 0)
    affirm = (F.col("t") >= p.appraise_trigger) & (F.round(record, 6) > 0)
    order = Window.partitionBy("query_id").orderBy(F.desc("strength"), "chunk_id")
    # The critic gathers its candidates by resonance alone: nothing comes in along entities.
    heard = scored(lib if p.w_spread == 0 else Library(lib.spark, lib.sf_dir, params=replace(p, w_spread=0.0)))
    x = heard.select("query_id", "chunk_id", F.when(caution, "caution").when(affirm, "affirm").otherwise("neutral").alias("valence"), strength.alias("strength"))
    x = x.filter(F.col("strength") >= p.appraise_strength).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= p.appraise_top).drop("nth")
    x = stored(x, "heard")
    only = stored(x.select("chunk_id").distinct(), "named")
    near = lib.about(only)
    signs = context_stats(near, only).join(lib.queries.select("query_id", "context_key"), "context_key").select("query_id", "chunk_id", F.lit(True).alias("signed")).distinct()
    seen = outcome_evidence(near, only).select("chunk_id", F.lit(True).alias("seen")).distinct()
    y = x.join(signs, ["query_id", "chunk_id"], "left").join(seen, "chunk_id", "left")
    return y.select("query_id", "chunk_id", "valence", "strength", F.coalesce("signed", F.lit(False)).alias("signed"), F.coalesce("seen", F.lit(False)).alias("seen"))


def verdicts(lib: Library) -> DataFrame:
    """One verdict of each query: valence, tier, strength, dispersion, confidence, the gate that made it abstain, flagged cautions.

    Gates in order: nothing resonates; too small a share known in the context;
    too few with outcomes; too widely spread.  An abstention is neutral and weak
    with confidence 0.  Confidence: the calibrated strength, less the dispersion.
    """
    p, c = lib.params, F.col
    of = lambda kind: F.count_if(c("valence") == kind)
    x = contributors(lib).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("strength").alias("s"), F.round(F.max("strength") - F.min("strength"), 6).alias("d"), of("affirm").alias("n_affirm"), of("caution").alias("n_caution"),
        F.count_if("signed").alias("n_signed"), F.count_if("seen").alias("n_seen"), F.array_join(F.array_sort(F.collect_list(F.when(c("valence") == "caution", c("chunk_id")))), ",").alias("flags"))
    x = lib.queries.select("query_id").join(x, "query_id", "left")
    x = x.withColumns({"n": F.coalesce("n", F.lit(0)), "s": F.coalesce("s", F.lit(0.0)), "d": F.coalesce("d", F.lit(0.0))})
    gate = F.when(c("n") == 0, "weak_resonance").when((p.signature_floor > 0) & (c("n_signed") < p.signature_floor * c("n")), "false_resonance")
    gate = gate.when((p.min_evidence > 0) & (c("n_seen") < p.min_evidence), "sparse_evidence").when(c("d") > p.conflict_ceiling, "conflicted")
    last = p.calibration_bins - 1
    bucket = F.least(F.lit(last), F.floor(c("s") * p.calibration_bins)).cast("long")
    y = x.withColumns({"gate": gate, "bucket": bucket}).join(F.broadcast(calibration(lib).select("bucket", "rate")), "bucket", "left")
    valence = F.when((c("n_affirm") > 0) & (c("n_caution") > 0), "mixed").when(c("n_caution") > 0, "caution").when(c("n_affirm") > 0, "affirm").otherwise("neutral")
    tier = F.when(c("s") >= p.tier_strong, "strong").when(c("s") >= p.tier_weak, "medium").otherwise("weak")
    confidence = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("rate", "s") * (1 - c("d")))), 6)
    said = lambda value, otherwise: F.when(c("gate").isNull(), value).otherwise(F.lit(otherwise))
    return y.select("query_id", said(valence, "neutral").alias("valence"), said(tier, "weak").alias("tier"), c("s").alias("strength"), c("d").alias("dispersion"), said(confidence, 0.0).alias("confidence"), c("gate").alias("abstain_reason"), said(F.coalesce("flags", F.lit("")), "").alias("flagged"))
