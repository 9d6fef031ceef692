"""Incremental upkeep: what new reports change is computed anew for the traces and chunks that they touch, and merged (ST3, ST6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators.episodes import reduced_traces
from memspark.tables import stored

#: Parts that a kept table is cut into by key: a merge writes the touched ones only.
PARTS = 64
REPORT = "id string, trace_id string, ts timestamp, complete boolean, used string, attribution string, outcome string"
#: Step of evidence, its share by attribution, and that of a failure.
STEP, WEIGHT, FAILED = 0.2, {"explicit": 0.30, "cited": 0.25, "inferred": 0.15}, 0.5


class Kept:
    """A table by key in a folder, in PARTS parts; rows are replaced by whole keys."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str) -> None:
        self.spark, self.path, self.key, self.schema = spark, path, key, schema

    def read(self) -> DataFrame:
        shape = f"{self.schema}, part int"
        try:
            return self.spark.read.schema(shape).parquet(self.path)
        except Exception as x:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(x):
                raise
            return self.spark.createDataFrame([], shape)

    def among(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys``; only the parts that hold these are read."""
        parts = [r.part for r in keys.select(self._part()).distinct().collect()]  # at most PARTS rows
        return self.read().filter(F.col("part").isin(parts)).join(keys, self.key, "left_semi")

    def merge(self, rows: DataFrame, keys: DataFrame) -> None:
        """Takes all rows of ``keys`` out and ``rows`` in.  The same merge again changes nothing."""
        new = rows.withColumn("part", self._part())
        parts = [r.part for r in keys.select(self._part()).distinct().collect()]
        rest = self.read().filter(F.col("part").isin(parts)).join(keys, self.key, "left_anti")
        # The touched parts are read, and written elsewhere, before they are replaced.
        out = stored(rest.unionByName(new.select(*rest.columns)), "merge").repartition(max(1, len(parts)), "part")
        seen = [r.part for r in out.select("part").distinct().collect()]
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        gone = set(parts) - set(seen)
        if gone:
            # A part that lost its last row is left to be emptied by a row without a key.
            empty = self.spark.createDataFrame([(p,) for p in sorted(gone)], "part int")
            for name in (f.name for f in self.read().schema.fields if f.name != "part"):
                empty = empty.withColumn(name, F.lit(None).cast(self.read().schema[name].dataType))
            empty.select(*rest.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def table(self) -> DataFrame:
        return self.read().filter(F.col(self.key).isNotNull()).drop("part")

    def _part(self):
        return F.pmod(F.xxhash64(self.key), F.lit(PARTS)).cast("int").alias("part")


def evidence_of(traces: DataFrame) -> DataFrame:
    """trace_id, chunk_id, target and alpha of each chunk that a reduced trace with an outcome used; the step is shared by its uses."""
    x = traces.filter("outcome IS NOT NULL AND used <> ''").select("trace_id", "outcome", F.split("used", ",").alias("u"), F.split("attributions", ",").alias("a"))
    each = x.select("trace_id", "outcome", F.size("u").alias("n"), F.explode(F.arrays_zip("u", "a")).alias("e"))
    weight = F.lit(WEIGHT["inferred"])
    for name, value in WEIGHT.items():
        weight = F.when(F.col("e.a") == name, value).otherwise(weight)
    good = F.col("outcome") == "ok"
    return each.select("trace_id", F.col("e.u").alias("chunk_id"), F.when(good, 1.0).otherwise(0.0).alias("target"), F.least(F.lit(1.0), STEP * (weight / F.col("n")) * F.when(good, 1.0).otherwise(FAILED)).alias("alpha"))


def confidence_of(evidence: DataFrame, base: float = 0.5) -> DataFrame:
    """chunk_id, n and confidence: evidence folded from ``base`` in order of trace."""
    listed = F.array_sort(F.collect_list(F.struct("trace_id", "target", "alpha")))
    x = evidence.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), listed.alias("l"))
    return x.select("chunk_id", "n", F.round(F.aggregate("l", F.lit(base), lambda c, e: c + e["alpha"] * (e["target"] - c)), 8).alias("confidence"))


class Upkeep:
    """Reports, reduced traces, evidence and confidence as kept tables under one folder.

    ``apply`` takes a micro-batch of reports in any order, repeated or corrected:
    it adds them, reduces the traces that they name from all their reports, takes
    the evidence of those traces out and the new in, and folds the chunks again
    that lose or gain evidence.  Nothing else is read or written but the parts
    that hold these keys.  A batch that is applied again changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        table = lambda name, key, schema: Kept(spark, f"{folder}/{name}", key, schema)
        self.spark = spark
        self.reports = table("reports", "trace_id", REPORT)
        self.traces = table("traces", "trace_id", "trace_id string, used string, attributions string, complete boolean, outcome string, usage_state string")
        self.evidence = table("evidence", "chunk_id", "trace_id string, chunk_id string, target double, alpha double")
        self.by_trace = table("uses", "trace_id", "trace_id string, chunk_id string")
        self.confidence = table("confidence", "chunk_id", "chunk_id string, n long, confidence double")

    def apply(self, batch: DataFrame, batch_id: int = 0) -> dict[str, int]:
        """Merges a batch; the numbers of traces and chunks that it touched."""
        batch = stored(batch.filter("trace_id IS NOT NULL").select(*[f.split()[0] for f in REPORT.split(", ")]), "batch")
        keys = batch.select("trace_id").distinct()
        traces = keys.count()
        if not traces:
            return {"traces": 0, "chunks": 0}
        every = stored(self.reports.among(keys).drop("part").unionByName(batch).dropDuplicates(["trace_id", "id"]), "reports")
        reduced = stored(reduced_traces(Library(self.spark, "").replaced(reports=every)), "reduced")
        new = stored(evidence_of(reduced), "evidence")
        chunks = stored(self.by_trace.among(keys).select("chunk_id").unionByName(new.select("chunk_id")).distinct(), "touched")
        now = stored(self.evidence.among(chunks).drop("part").join(keys, "trace_id", "left_anti").unionByName(new), "now")
        self.reports.merge(every, keys)
        self.traces.merge(reduced, keys)
        self.evidence.merge(now, chunks)
        self.confidence.merge(confidence_of(now), chunks)
        # Last: until it is written, a batch that is tried again still finds the chunks that lose evidence.
        self.by_trace.merge(new.select("trace_id", "chunk_id"), keys)
        return {"traces": traces, "chunks": chunks.count()}


def close_on_end(events: DataFrame, close: Callable[[DataFrame, int], None], grow: Callable[[int], None] | None = None):
    """A stream writer that hands the traces ended in each micro-batch (trace_id, ts: the last end) to ``close`` and then calls ``grow``, once a batch that has any.

    Starts, successes, failures and feedback only ride along in the log and do
    nothing here.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        ended = batch.filter("event_type = 'end' AND trace_id IS NOT NULL").groupBy("trace_id").agg(F.max("ts").alias("ts")).persist()
        try:
            if not ended.isEmpty():
                close(ended, batch_id)
                if grow is not None:
                    grow(batch_id)
        finally:
            ended.unpersist()

    return events.writeStream.foreachBatch(each)
