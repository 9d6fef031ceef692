"""Filters, checks and per-row text work over chunks and logs (F, V, T, N)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library, days_between

# Words that carry no meaning in a query.
QUERY_STOP = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "with"]


def listing(lib: Library) -> DataFrame:
    """Chunks newest first with a preview of 280 characters."""
    x = lib.chunks.filter("state = 'active'").select("id", "origin", "state", F.substring("content", 1, 280).alias("preview"), "created_at")
    return x.orderBy(F.desc("created_at"), "id").offset(10).limit(50)


def recallable(chunks: DataFrame, embed_version: int) -> DataFrame:
    """Not archived, no spark, embedded under the current version."""
    return chunks.filter((F.col("state") != "archived") & (F.col("origin") != "spark") & (F.col("embed_version") >= embed_version))


def valid_for_recall(lib: Library) -> DataFrame:
    """id, state and origin of the chunks that recall may show."""
    return recallable(lib.chunks, lib.params.embed_version).select("id", "state", "origin")


def valid_sparks(lib: Library) -> DataFrame:
    """id and maturity of open sparks; a null maturity is not open."""
    open_ = F.col("maturity").isin("promoted", "dropped")
    return lib.chunks.filter((F.col("origin") == "spark") & (F.col("state") != "archived") & ~open_ & (F.col("embed_version") >= lib.params.embed_version)).select("id", "maturity")


def recent_traces(lib: Library) -> DataFrame:
    """The 100 newest traces; ties by id."""
    return lib.log.select("trace_id", "ts", "outcome", "task_state").orderBy(F.desc("ts"), "trace_id").limit(100)


def stale_embeddings(lib: Library, cap: int | None = None) -> DataFrame:
    """id of the chunks to embed anew (at most ``cap``, by id) beside how many there are in all."""
    stale = lib.chunks.filter((F.col("embed_version") == 0) | (F.col("embed_version") < lib.params.embed_version)).select("id")
    x = stale if cap is None else stale.orderBy("id").limit(cap)
    return x.join(F.broadcast(stale.agg(F.count(F.lit(1)).alias("remaining"))))


def reverse_deps(lib: Library) -> DataFrame:
    """How many chunks depend on each, and how many of these hard."""
    return lib.deps.groupBy("dst").agg(F.count(F.lit(1)).alias("dependents"), F.count_if(F.col("kind") == "hard").alias("hard"))


def trace_outcomes(lib: Library) -> DataFrame:
    """The last outcome of each trace (ties: the larger id) and how many were reported."""
    x = lib.usage.filter("chunk_id IS NULL AND event IN ('task_ok', 'task_fail')")
    return x.groupBy("trace_id").agg(F.max_by("event", F.struct("ts", "id")).alias("outcome"), F.count(F.lit(1)).alias("reports"))


# What the columns of stored tables may hold; null is legal.
DOMAINS = {
    "chunks": {"origin": ["installed", "distilled", "captured", "spark"], "state": ["pending", "active", "archived"]},
    "usage": {"event": ["retrieved", "selected", "refined", "used", "task_ok", "task_fail"], "attribution": ["explicit", "cited", "inferred"], "source": ["mcp", "sdk", "cli", "hook", "daemon", "augmented"]},
    "log": {"event_source": ["mcp", "sdk", "cli", "hook", "daemon", "augmented"], "task_state": ["recalled", "running", "completed", "abandoned", "timed_out"], "usage_state": ["unknown", "known_none", "known_some"]},
    "distill": {"distill_state": ["open", "new", "screening", "distilled", "discarded", "failed"]},
    "feedback": {"signal": ["up", "down"]},
    "validations": {"verdict": ["shown", "observed", "applied", "supported", "contradicted", "irrelevant", "unknown"]},
    "submitted": {"verdict": ["shown", "observed", "applied", "supported", "contradicted", "irrelevant", "unknown"]},
}


def domain_violations(lib: Library) -> DataFrame:
    """source_table, column_name, value, n and first_id of values outside their closed sets, and of used rows without attribution."""
    out = None
    for table, domains in DOMAINS.items():
        df = getattr(lib, table)
        bad = [F.when(~F.col(c).isin(legal), F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))) for c, legal in domains.items()]
        if table == "usage":
            bad.append(F.when((F.col("event") == "used") & F.col("attribution").isNull(), F.struct(F.lit("attribution").alias("column_name"), F.lit("(null)").alias("value"))))
        key = F.col("id" if "id" in df.columns else "trace_id").cast("string").alias("id")
        x = df.select(F.lit(table).alias("source_table"), key, F.explode(F.array_compact(F.array(*bad))).alias("b"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("source_table", "b.column_name", "b.value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def blacklisted(lib: Library) -> DataFrame:
    """id and content_hash of chunks in use whose content was archived under another id; null hashes match nothing."""
    gone = lib.chunks.filter("state = 'archived'").select("content_hash").distinct()
    return lib.chunks.filter("state <> 'archived'").join(gone, "content_hash", "left_semi").select("id", "content_hash")


def conflicting_feedback(lib: Library) -> DataFrame:
    """Trace and chunk that one report both praises and blames, with the number of signals."""
    x = lib.feedback.groupBy("trace_id", "chunk_id").agg(F.count_distinct("signal").alias("kinds"), F.count(F.lit(1)).alias("signals"))
    return x.filter("kinds > 1").select("trace_id", "chunk_id", "signals")


def attributed(lib: Library) -> DataFrame:
    """Each use with what is wrong with its attribution: the chunk is missing, or its trace did not select it; null if nothing."""
    chosen = lib.events.filter("event = 'selected'").select("trace_id", "chunk_id").withColumn("chosen", F.lit(True))
    known = lib.chunks.select(F.col("id").alias("chunk_id")).withColumn("known", F.lit(True))
    x = lib.events.filter("event = 'used'").join(known, "chunk_id", "left").join(chosen, ["trace_id", "chunk_id"], "left")
    return x.select("id", F.when(F.col("known").isNull(), "missing_chunk").when(F.col("chosen").isNull(), "not_selected").alias("problem"))


def orphans(lib: Library) -> DataFrame:
    """Hard edges with a missing end."""
    ids = lib.chunks.select("id")
    hard = lib.deps.filter("kind = 'hard'")
    lost = hard.join(ids, hard.src == ids.id, "left_anti").unionByName(hard.join(ids, hard.dst == ids.id, "left_anti"))
    return lost.select("src", "dst").distinct()


def hashes_and_tokens(lib: Library) -> DataFrame:
    """SHA-256 of the content and a token estimate, a quarter of its bytes rounded up; null for null content."""
    content = F.col("content")
    return lib.chunks.select("id", F.sha2(content, 256).alias("hash"), F.ceil(F.octet_length(content) / 4).cast("long").alias("tokens"))


def normalized(query: Column) -> Column:
    """Lower case, punctuation to spaces, stop words out, distinct words in order."""
    words = F.filter(F.split(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}]+", " "), " "), lambda w: (w != "") & ~w.isin(QUERY_STOP))
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def normalized_queries(lib: Library) -> DataFrame:
    """Normalised query and its hash, the context key."""
    n = normalized(F.col("query"))
    return lib.queries.select("query_id", n.alias("normalized"), F.sha2(n, 256).alias("context_hash"))


def anti_hits(lib: Library) -> DataFrame:
    """query_id and chunk_id of each chunk whose anti-trigger has a comma part that is in the lower-cased query.

    Equal parts are looked up once, by their first three characters among all
    that stand together in a query.
    """
    parts = lib.chunks.filter("anti_trigger_desc IS NOT NULL").select("id", F.explode(F.split(F.lower("anti_trigger_desc"), ",")).alias("part"))
    parts = parts.select("id", F.trim("part").alias("part")).filter("part <> ''")
    texts = lib.queries.select("query_id", F.lower("query").alias("q"))
    places = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("q"), F.lit(1))), lambda i: F.substring(F.col("q"), i, F.lit(n))))
    wanted = parts.select("part").distinct().withColumn("gram", F.substring("part", 1, 3)).withColumn("n", F.length("gram"))
    grams = texts.select("query_id", "q", F.explode(F.array_distinct(F.concat(places(1), places(2), places(3)))).alias("gram"))
    found = grams.join(wanted, "gram").filter(F.contains(F.col("q"), F.col("part"))).select("query_id", "part").distinct()
    return found.join(parts, "part").select("query_id", F.col("id").alias("chunk_id")).distinct()


def activation(uses: Column, last: Column, now: Column) -> Column:
    """Sigmoid of ln(1 + n) - ln(1 + days) / 2; 0 when never used."""
    x = F.log1p(uses) - 0.5 * F.log1p(days_between(now, last))
    return F.when((uses > 0) & last.isNotNull(), 1 / (1 + F.exp(-x))).otherwise(F.lit(0.0))


def activations(lib: Library) -> DataFrame:
    """Activation of each chunk used."""
    used = lib.events.filter("event = 'used'").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("uses"), F.max("ts").alias("last"))
    return used.select("chunk_id", "uses", F.round(activation(F.col("uses"), F.col("last"), lib.as_of), 6).alias("activation"))


def length_penalties(lib: Library) -> DataFrame:
    """Penalty of each chunk, 0 up to length_free bytes."""
    p, size = lib.params, F.octet_length("content")
    return lib.chunks.select("id", F.round(F.when(size > p.length_free, -p.length_weight * F.log(size / p.length_free)).otherwise(F.lit(0.0)), 6).alias("penalty"))
