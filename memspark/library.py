"""The library's tables as DataFrames, and the clock and parameters of an analysis."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.fixtures import view
from memspark.tables import stored


@dataclass(frozen=True)
class Params:
    """Tunable numbers.  Fixed values: the defaults are those of the engine whose results these must equal."""

    embed_version: int = 1
    low_confidence: float = 0.25
    low_confidence_days: int = 60
    repeat_select_min: int = 10
    repeat_confidence: float = 0.60
    hub_days: int = 30
    hub_select_min: int = 50
    hub_use_rate: float = 0.01
    never_used_days: int = 30
    propose_score: float = 2.0
    proposal_score: float = 3.0
    proposal_actors: int = 2
    negative_score: float = 5.0
    negative_actors: int = 2
    proposal_days: int = 30
    feedback_half_life: float = 90.0
    failure_min_uses: int = 5
    failure_rate: float = 0.2
    failure_confidence: float = 0.35
    decay_half_life: float = 90.0
    decay_floor: float = 0.20
    decay_least: float = 0.001
    calibration_bins: int = 10
    length_free: int = 800
    length_weight: float = 0.15
    w_content: float = 0.55
    w_trigger: float = 0.25
    w_lexical: float = 0.25
    w_confidence: float = 0.10
    w_context: float = 0.15
    w_spread: float = 0.0
    w_activation: float = 0.08
    pending_penalty: float = 0.60
    anti_penalty: float = 0.60
    soft_bonus: float = 0.05
    top_k: int = 20
    min_score: float | None = None
    prior_m: float = 2.0
    base_rate: float = 0.5
    episode_days: int = 60
    shown_days: int = 2
    open_days: int = 14
    recurring_min: int = 5
    compact_days: int = 30
    retain_days: int = 30
    appraise_strength: float = 0.40
    appraise_top: int = 8
    appraise_trigger: float = 0.50
    tier_weak: float = 0.30
    tier_strong: float = 0.65
    signature_floor: float = 0.0
    min_evidence: int = 0
    conflict_ceiling: float = 1.0
    spread_seeds: int = 5
    spread_fan: int = 50


#: Lower bounds for the registered queries: the fixtures' events are spread too thin for the defaults.
THIN = Params(w_spread=0.10, repeat_select_min=3, hub_select_min=3, failure_min_uses=2, recurring_min=2, proposal_score=2.0, negative_score=2.5, episode_days=20, compact_days=20, retain_days=20, appraise_strength=0.25, min_evidence=1, conflict_ceiling=0.2)


class Library:
    """Lazily read tables; every operator takes one and an explicit clock."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = "2024-01-31 00:00:00", params: Params | None = None) -> None:
        self.spark, self.sf_dir, self.params = spark, sf_dir, params or Params()
        self.as_of: Column = F.lit(as_of).cast("timestamp")
        self._kept: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    chunks = cached_property(lambda self: self._read("fx_chunks"))
    usage = cached_property(lambda self: self._read("fx_usage"))
    feedback = cached_property(lambda self: self._read("fx_feedback"))
    deps = cached_property(lambda self: self._read("fx_deps"))
    vec_content = cached_property(lambda self: self._read("fx_vec_content"))
    vec_trigger = cached_property(lambda self: self._read("fx_vec_trigger"))
    queries = cached_property(lambda self: self._read("fx_queries"))
    relevant = cached_property(lambda self: self._read("fx_relevant"))
    oplog = cached_property(lambda self: self._read("fx_oplog"))
    log = cached_property(lambda self: self._read("fx_log"))
    episodes = cached_property(lambda self: self._read("fx_episodes"))
    episode_vectors = cached_property(lambda self: self._read("fx_episode_vectors"))
    validations = cached_property(lambda self: self._read("fx_validations"))
    #: Version, birthplaces and whether the user gave the rule (id, version, source_projects joined by commas, directive).
    rule_meta = cached_property(lambda self: self._read("fx_rule_meta"))
    #: Stored counters of selections (id, selected_count) and episodes that gave birth to rules (rule_id, session_id).
    counters = cached_property(lambda self: self._read("fx_counters"))
    births = cached_property(lambda self: self._read("fx_births"))
    #: Texts that the jobs of ``texts`` read: chunks with keys among their words, situations (stage, error, file), messages.
    secrets = cached_property(lambda self: self._read("fx_secrets"))
    situations = cached_property(lambda self: self._read("fx_situations"))
    messages = cached_property(lambda self: self._read("fx_messages"))
    #: Observations of shown rules with a judge's reply, and replies about births and revisions by number.
    observations = cached_property(lambda self: self._read("fx_observations"))
    replies = cached_property(lambda self: self._read("fx_replies"))
    verdicts = cached_property(lambda self: self._read("fx_verdicts"))
    #: Logs to distil, contents with code words, signals of rules and texts of actions, verdicts as agents report them.
    distill = cached_property(lambda self: self._read("fx_distill"))
    code = cached_property(lambda self: self._read("fx_code"))
    rules = cached_property(lambda self: self._read("fx_rules"))
    actions = cached_property(lambda self: self._read("fx_actions"))
    submitted = cached_property(lambda self: self._read("fx_submitted"))
    #: Model calls, requests of users about chunks and about sparks, contents to take in.
    calls = cached_property(lambda self: self._read("fx_calls"))
    requests = cached_property(lambda self: self._read("fx_requests"))
    spark_requests = cached_property(lambda self: self._read("fx_spark_requests"))
    ingest = cached_property(lambda self: self._read("fx_ingest"))
    #: When and why chunks took their state, and rows as older releases wrote them.
    states = cached_property(lambda self: self._read("fx_states"))
    #: Calls of a session in order, rules shown in it, and reports about a trace.
    transcript = cached_property(lambda self: self._read("fx_transcript"))
    shown = cached_property(lambda self: self._read("fx_shown"))
    reports = cached_property(lambda self: self._read("fx_reports"))
    old_rows = cached_property(lambda self: self._read("fx_old_rows"))

    @cached_property
    def facts(self) -> DataFrame:
        """Used, selected and outcome events without repeats: the earliest used and selected of a trace and chunk, a trace's latest outcome."""
        row = F.struct(*[c for c in self.usage.columns])
        once = self.usage.filter("event IN ('used', 'selected')").groupBy("trace_id", "event", "chunk_id").agg(F.min_by(row, F.struct("ts", "id")).alias("r"))
        last = self.usage.filter("event IN ('task_ok', 'task_fail')").groupBy("trace_id").agg(F.max_by(row, F.struct("ts", "id")).alias("r"))
        return once.select("r.*").unionByName(last.select("r.*"))

    @property
    def events(self) -> DataFrame:
        """Usage without repeats; events of other kinds pass as they are."""
        return self.facts.unionByName(self.usage.filter("NOT coalesce(event IN ('used', 'selected', 'task_ok', 'task_fail'), false)"))

    def replaced(self, **tables: DataFrame) -> Library:
        """This library with other ``tables`` in place of its own."""
        other = copy.copy(self)
        other._kept = {}
        other.__dict__.update(tables)
        return other

    def settle(self) -> None:
        """Writes the facts once, for a job that folds them several times."""
        self.facts = self.kept("facts", lambda: stored(self.facts, "facts"))

    def about(self, only: DataFrame) -> Library:
        """This library with the usage and log of those traces alone that selected or used one of the chunks ``only`` (chunk_id), its facts written once.

        A trace is there with all its events, so whatever is folded for these
        chunks is as it is for the whole library.
        """
        met = self.usage.filter("event IN ('used', 'selected')").join(only, "chunk_id", "left_semi")
        traces = stored(met.select("trace_id").distinct(), "traces")
        among = lambda df: df.join(traces, "trace_id", "left_semi").select(*df.columns)
        other = self.replaced(usage=among(self.usage), log=among(self.log))
        other.__dict__.pop("facts", None)
        other.settle()
        return other

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What ``build`` gives, built once for this library."""
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, at least 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400e6))


def whole_days_between(later: Column, earlier: Column) -> Column:
    """Whole days, at least 0."""
    return F.floor(days_between(later, earlier)).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a ``value`` that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def ratio(n: Column, d: Column) -> Column:
    """n / d rounded to three places, 0 for an empty denominator."""
    return F.when(d > 0, F.round(n / d, 3)).otherwise(F.lit(0.0))
