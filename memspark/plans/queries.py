"""Queries by the survey's operator ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memspark.library import THIN, Library
from memspark.operators import appraisal, capture, curate, distillation, embedding, entities, episodes, evidence, graph, health, lifecycle, listing, packing, replay, retrieval, revisions, rules, texts

OPERATORS: dict[str, Callable[[Library], DataFrame]] = {
    "f1_listing": listing.listing, "f2_recallable": listing.valid_for_recall, "f3_valid_sparks": listing.valid_sparks,
    "f8_recent_traces": listing.recent_traces, "f11_stale_embeddings": listing.stale_embeddings, "f13_reverse_deps": listing.reverse_deps,
    "f14_trace_outcomes": listing.trace_outcomes, "v1_domain_violations": listing.domain_violations, "v5_orphans": listing.orphans,
    "t1_t2_hash_tokens": listing.hashes_and_tokens, "t3_t4_normalized_queries": listing.normalized_queries, "t11_anti_hits": listing.anti_hits,
    "n2_activation": listing.activations, "n4_length_penalty": listing.length_penalties,
    "a1_success_facts": evidence.success_facts, "a2_success_counts": evidence.success_counts, "a3_usage_counts": evidence.usage_counts,
    "a4_purged_usage": evidence.purged_usage, "a7_outcome_evidence": evidence.outcome_evidence, "a9_latest_feedback": evidence.latest_feedback,
    "a10_confidence": evidence.folded, "a12_governance": evidence.governance, "a15_usage_states": evidence.usage_states,
    "a16_observed_outcomes": evidence.observed_outcomes, "a18_counter_baseline": evidence.counter_baseline, "a20_deduped": evidence.deduped,
    "c1_c8_archive_rules": evidence.archive_candidates, "c9_duplicates": evidence.duplicate_losers, "c10_decay": evidence.decayed,
    "c12_l9_l10_supports": evidence.supports, "l10_contradictions": evidence.open_contradictions, "c15_trace_lifecycle": evidence.trace_lifecycle, "c18_calibration": evidence.calibration, "l8_expiries": evidence.expiries,
    "r1_content_hits": retrieval.content_hits, "r2_lexical_hits": retrieval.lexical_top, "r6_recall": retrieval.recall, "r14_spark_hits": retrieval.spark_hits,
    "t5_t7_situations": texts.situations, "t10_lexical_tokens": retrieval.lexical_tokens, "t12_t13_sanitized": texts.sanitized_chunks, "t15_t27_message_flags": texts.message_flags,
    "t24_citations": texts.citations, "t30_grounded_signals": texts.grounded_signals,
    "a7_a8_evidence": evidence.evidence, "a11_context_stats": evidence.context_stats, "a14_verdict_outcomes": evidence.verdict_outcomes,
    "c5_c7_proposals": evidence.proposals, "c16_compacted": evidence.compacted, "c17_retained_operations": evidence.retained_operations, "c19_dry_run": evidence.curate_dry_run, "n9_calibrated": evidence.calibrated,
    "r9_packed": retrieval.packed, "r10_blocks": packing.block_table, "r11_trimmed": retrieval.trimmed, "r15_snapshots": retrieval.recall_snapshots, "r16_lexical_recall": retrieval.lexical_recall, "r19_hook_recall": retrieval.hook_recall,
    "f12_blacklisted": listing.blacklisted, "v2_conflicting_feedback": listing.conflicting_feedback, "v3_attributed": listing.attributed, "a19_evolve_readiness": evidence.evolve_readiness,
    "l2_corrections": texts.corrections, "l15_session_summaries": texts.session_summaries, "o7_o8_daily_kpis": health.daily_kpis,
    "e1_ranking_metrics": retrieval.ranking_metrics, "e1_averages": retrieval.ranking_averages, "e2_self_labels": retrieval.self_labels, "e3_weight_sweep": retrieval.weight_sweep, "r15_trace_events": retrieval.trace_events,
    "src5_events": capture.event_rows, "l4_captured": capture.captured_episodes, "l15_digests": capture.session_digests,
    "t16_t18_call_features": episodes.call_features, "l1_struggles": episodes.struggles, "l3_observations": episodes.observations, "a5_reduced_traces": episodes.reduced_traces, "t8_embed_texts": episodes.embed_texts,
    "o4_recall_pack": health.recall_pack, "o4_rank_anomalies": health.rank_anomalies, "p7_intuition": health.intuition, "o7_kpi_snapshot": health.kpi_snapshot, "r8_reranked": retrieval.reranked, "r17_search": retrieval.search_results,
    "t14_c11_entity_index": entities.entity_index, "r5_spread": retrieval.spread_hits,
    "p1_p3_contributors": appraisal.contributors, "p4_p5_verdicts": appraisal.verdicts,
    "f9_work_queue": distillation.work_queue, "f10_retries": distillation.retries, "c14_screening": distillation.recovered_screening, "d1_distilled": distillation.distilled_chunks, "d2_n12_prompt_tokens": distillation.prompt_tokens,
    "d3_batch": distillation.distilled_batch, "d5_token_usage": distillation.token_usage,
    "v4_verdicts": rules.validated_verdicts, "t23_usable_signals": rules.usable_signals, "r21_r22_actions": rules.matched_actions, "l13_shown": rules.shown_rows, "l5_clusters": rules.episode_clusters, "l16_to_embed": rules.episodes_to_embed, "l16_consumed": rules.consumed_episodes, "c13_cycles": graph.hard_cycles, "p9_replay": replay.replayed, "l7_judged": revisions.judged_observations, "l6_births": revisions.born_rules, "l11_revisions": revisions.revised_rules, "o8_deltas": replay.snapshot_deltas, "j13_verdict_snapshots": replay.verdict_snapshots, "t29_bags": embedding.chunk_bags, "t28_projects": embedding.session_projects,
    "c20_curated": curate.curated_chunks, "c20_report": curate.curated_report, "c20_logs": curate.curated_logs, "c21_actions": curate.governed, "c21_chunks": curate.governed_chunks, "c22_spark_transitions": lifecycle.spark_transitions, "c23_ingested": lifecycle.ingested, "a17_repair": lifecycle.repaired_traces, "a21_a22_backfilled": lifecycle.backfilled,
    "o5_lifecycle": health.lifecycle_block, "o11_suggestions": health.suggestions, "o15_endpoints": health.endpoint_health, "o16_errors": health.error_report, "o17_table_sizes": health.table_sizes, "n11_explanations": health.explanations,
    "o1_window_rates": health.window_rates, "o2_dimension_rates": health.dimension_rates, "o3_agent_coverage": health.agent_coverage,
    "o4_rank_histogram": health.rank_histogram, "o6_operation_performance": health.operation_performance, "o6_top_errors": health.top_errors,
    "st8_daily_operations": health.daily_operations, "o9_library_summary": health.library_summary, "o10_recurring_sparks": health.recurring_sparks,
    "o12_rule_counts": health.rule_counts, "o13_provenance": health.provenance, "p7_tier_calibration": health.tier_calibration, "p8_verdict_calibration": health.verdict_calibration,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Library(spark, sf_dir, params=THIN))) for name, f in OPERATORS.items()}
