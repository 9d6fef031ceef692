"""Batch retrieval: exact vector search, BM25, fusion, and ranking metrics (R, E)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators.bm25 import best_hits
from memspark.operators.entities import spread
from memspark.operators.evidence import context_stats, folded, usage_counts
from memspark.operators.listing import activation, recallable
from memspark.operators.packing import Trim, expanded, packed_blocks, seed_first
from memspark.tables import stored

#: Bytes of query vectors up to which they are sent to every task; beyond, both sides are dealt into blocks.
BATCH_BYTES = 64 << 20
QUERY_BLOCK, VECTOR_BLOCK = 4096, 16384
# Words that lexical search leaves out, and how many distinct words of a query it takes.
LEXICAL_STOP = ["the", "a", "an", "to", "of", "in", "on", "for", "and", "or", "is", "do", "i"]
QUERY_WORDS = 32
#: Hits of lexical search that stand in for a reranker's order.
RERANKED = 10


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric runs of at least two bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 2)


def query_words(query: Column) -> Column:
    """The first QUERY_WORDS distinct words of a query that are no stop words."""
    return F.slice(F.array_distinct(F.filter(tokens(query), lambda w: ~w.isin(LEXICAL_STOP))), 1, QUERY_WORDS)


def lexical_tokens(lib: Library) -> DataFrame:
    """query_id and words of each query; null queries have a null list."""
    return lib.queries.select("query_id", F.array_join(query_words(F.col("query")), " ").alias("words"))


def _matrices(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values, starts = lists.flatten().to_numpy().astype(np.float64), np.cumsum(lengths) - lengths
    rows = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
    return {n: (at, values[starts[at][:, None] + np.arange(n)]) for n, at in rows.items() if n}


def _best(query_ids: np.ndarray, queries: dict, chunk_ids: np.ndarray, vectors: dict, k: int) -> pa.Table:
    """Best ``k`` vectors for each query of the same length, and what ties with the last of them."""
    ids, chunks, sims = [], [], []
    for length in queries.keys() & vectors.keys():
        (asking, q), (given, v) = queries[length], vectors[length]
        for at in range(0, len(q), 256):
            scores = np.round(q[at : at + 256] @ v.T, 6)
            keep = min(k, scores.shape[1])
            floor = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
            row, col = np.nonzero(scores >= floor[:, None])
            ids.append(query_ids[asking[at + row]])
            chunks.append(chunk_ids[given[col]])
            sims.append(scores[row, col])
    join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
    return pa.table({"query_id": join(ids, pa.int64()), "chunk_id": join(chunks, pa.string()), "sim": join(sims, pa.float64())})


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def vector_hits(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Best ``k`` vectors of each query by inner product (6 places), ties to the smaller chunk.

    Products of blocks; each task keeps the best ``k`` of a block before anything
    is shuffled.  Up to BATCH_BYTES of queries go to the vectors where they are,
    more are dealt into a grid of blocks.  Vectors that are null or hold null or
    non-finite components take no part; a query meets vectors of its length only.
    """
    q = queries.filter(_finite(F.col("vec"))).select(F.col("query_id").cast("long"), F.col("vec").cast("array<double>").alias("vec"))
    v = vectors.filter(_finite(F.col("embedding"))).select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    size = q.agg(F.coalesce(F.sum(F.size("vec") * 8 + 8), F.lit(0)), F.count(F.lit(1))).first()
    if size[0] <= BATCH_BYTES:
        held = q.toArrow()
        ids, matrix = held.column("query_id").to_numpy(), _matrices(held.column("vec"))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _best(ids, matrix, np.array(batch.column(0).to_pylist(), object), _matrices(batch.column(1)), k).to_batches()

        x = v.mapInArrow(near, "query_id long, chunk_id string, sim double")
    else:
        down, across = math.ceil(size[1] / QUERY_BLOCK), max(1, math.ceil(v.count() / VECTOR_BLOCK))
        series = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        asked = q.withColumns({"qb": F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int"), "cb": series(across)})
        given = v.withColumns({"cb": F.pmod(F.xxhash64("chunk_id"), F.lit(across)).cast("int"), "qb": series(down)})

        def cell(one: pa.Table, two: pa.Table) -> pa.Table:
            return _best(one.column("query_id").to_numpy(), _matrices(one.column("vec")), np.array(two.column("chunk_id").to_pylist(), object), _matrices(two.column("embedding")), k)

        x = asked.groupBy("qb", "cb").cogroup(given.groupBy("qb", "cb")).applyInArrow(cell, "query_id long, chunk_id string, sim double")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id")
    return x.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def postings(chunks: DataFrame) -> DataFrame:
    """token, id and how often it occurs in the chunk's content, trigger and skill."""
    x = chunks.select("id", F.explode(tokens(F.concat_ws(" ", "content", "trigger_desc", "skill_name"))).alias("token"))
    return x.groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))


def asked_words(queries: DataFrame) -> DataFrame:
    """query_id and token: the first QUERY_WORDS distinct words of each query; rows that repeat an id are one query."""
    x = queries.select("query_id", F.posexplode(query_words(F.col("query"))).alias("at", "token")).groupBy("query_id", "token").agg(F.min("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "token"))
    return x.withColumn("nth", nth).filter(F.col("nth") <= QUERY_WORDS).select("query_id", "token")


def lexical_hits(lib: Library, k: int) -> DataFrame:
    """BM25 of query words over content, trigger and skill, as a share of a query's best hit.

    Statistics are over all chunks, hits over those that are no spark and not
    archived.  Up to BATCH_BYTES of query words go to the chunks where they are,
    more go in parts; a task keeps only what may be among the best ``k``.
    """
    words = asked_words(lib.queries)
    size = words.agg(F.coalesce(F.sum(F.octet_length("token") + 16), F.lit(0))).first()[0]
    ok = F.coalesce((F.col("state") != "archived") & (F.col("origin") != "spark"), F.lit(False))
    chunks = lib.chunks.select("id", ok.alias("ok"), tokens(F.concat_ws(" ", "content", "trigger_desc", "skill_name")).alias("words"))
    n, x = max(1, math.ceil(size / BATCH_BYTES)), None
    for i in range(n):
        part = best_hits(chunks, words.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else words, k)
        x = part if x is None else x.unionByName(part)
    top = x.groupBy("query_id").agg(F.max("s").alias("top")).withColumnRenamed("query_id", "of")
    x = x.join(top, F.col("query_id").eqNullSafe(F.col("of"))).select("query_id", "chunk_id", F.round(F.col("s") / F.col("top"), 6).alias("lexical"))
    order = Window.partitionBy("query_id").orderBy(F.desc("lexical"), "chunk_id")
    return x.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def kept_hits(lib: Library, k: int) -> DataFrame:
    """``lexical_hits`` of up to ``k``, searched and written once for recall and reranking."""
    most = max(RERANKED, 2 * lib.params.top_k)
    if k > most:
        return lexical_hits(lib, k)
    return lib.kept("lexical", lambda: stored(lexical_hits(lib, most), "hits")).filter(F.col("rank") <= k)


def content_hits(lib: Library) -> DataFrame:
    """Ten best chunks of each query by content vectors."""
    return vector_hits(lib.queries, lib.vec_content, 10)


def lexical_top(lib: Library) -> DataFrame:
    """Ten best chunks of each query by BM25."""
    return lexical_hits(lib, 10)


def spark_hits(lib: Library) -> DataFrame:
    """The top_k sparks of each query by the larger similarity of both spaces, of the top_k hits of each space."""
    open_ = ~F.col("maturity").isin("promoted", "dropped") & (F.col("state") != "archived") & (F.col("embed_version") >= lib.params.embed_version)
    ok = lib.chunks.filter((F.col("origin") == "spark") & open_).select(F.col("id").alias("chunk_id"))
    both = vector_hits(lib.queries, lib.vec_content, lib.params.top_k).unionByName(vector_hits(lib.queries, lib.vec_trigger, lib.params.top_k))
    x = both.join(ok, "chunk_id", "left_semi").groupBy("query_id", "chunk_id").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id")
    return x.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= lib.params.top_k)


def context_scores(stats: DataFrame, prior_m: float, base_rate: float) -> DataFrame:
    """``stats`` (counts of a chunk in a context) with score in [-1, 1]: a Beta prior, feedback twice, weighed by evidence."""
    wins, losses = F.col("success_count") + 2.0 * F.col("positive_feedback"), F.col("failure_count") + 2.0 * F.col("negative_feedback")
    posterior = (wins + prior_m * base_rate) / (wins + losses + prior_m)
    return stats.withColumn("context_score", (posterior - 0.5) * 2.0 * F.least((wins + losses) / 5.0, F.lit(1.0)))


def candidates(lib: Library, lexical_only: bool = False) -> DataFrame:
    """query_id, chunk_id and the best similarity of each channel: twice top_k hits of each, then recall-valid chunks.

    Soft dependencies of a candidate gain soft_bonus in the content channel for
    each edge, up to 1, or enter with it, unless archived or sparks.
    """
    p, none = lib.params, F.lit(0.0)
    row = lambda c, t, x: [F.col("query_id"), F.col("chunk_id"), c.alias("c"), t.alias("t"), x.alias("l")]
    one = kept_hits(lib, 2 * p.top_k).select(*row(none, none, F.col("lexical")))
    if not lexical_only:
        c = vector_hits(lib.queries, lib.vec_content, 2 * p.top_k).select(*row(F.col("sim"), none, none))
        t = vector_hits(lib.queries, lib.vec_trigger, 2 * p.top_k).select(*row(none, F.col("sim"), none))
        one = one.unionByName(c).unionByName(t)
    ok = recallable(lib.chunks, p.embed_version).select(F.col("id").alias("chunk_id"))
    base = one.groupBy("query_id", "chunk_id").agg(F.max("c").alias("c"), F.max("t").alias("t"), F.max("l").alias("l")).join(ok, "chunk_id", "left_semi")
    to = lib.chunks.filter("state <> 'archived' AND origin <> 'spark'").select(F.col("id").alias("dst"))
    soft = lib.deps.filter("kind = 'soft'").join(to, "dst", "left_semi")
    bonus = base.join(soft, F.col("chunk_id") == F.col("src")).groupBy("query_id", F.col("dst").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))
    x = base.join(bonus, ["query_id", "chunk_id"], "full_outer")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    lifted = F.when(F.col("n") > 0, F.greatest(zero("c"), F.least(F.lit(1.0), zero("c") + p.soft_bonus * F.col("n")))).otherwise(zero("c"))
    return x.select("query_id", "chunk_id", lifted.alias("c"), zero("t").alias("t"), zero("l").alias("l"))


def spread_hits(lib: Library) -> DataFrame:
    """query_id, chunk_id and spread: what shared entities pass on from a query and its best candidates."""
    return spread(lib, candidates(lib))


def sixth(value: Column) -> Column:
    """``value`` at six places by its binary value: what only prints as a half, and lies below it, goes down."""
    return F.round(value * 1e6) / 1e6


def scored(lib: Library, lexical_only: bool = False) -> DataFrame:
    """Candidates with their weighted channels, fused and gate score, as a table that is written once.

    With a weight for it, activation spread along entities is a channel that may
    add candidates.  The gate score carries the anti-trigger penalty but not that
    of pending chunks.  Confidence is that after the evidence, or the base without
    any.  Evidence, counts and contexts are folded for the candidates alone,
    from the traces that met them.
    """
    return lib.kept(f"scored-{lexical_only}", lambda: _scored(lib, lexical_only))


def _scored(lib: Library, lexical_only: bool) -> DataFrame:
    p = lib.params
    found = stored(candidates(lib, lexical_only), "candidates").withColumn("s", F.lit(0.0))
    if p.w_spread > 0:
        passed = spread(lib, found.drop("s"))
        zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
        found = stored(found.drop("s").join(passed.withColumnRenamed("spread", "s"), ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", *map(zero, "ctls")), "spread")
    only = stored(found.select("chunk_id").distinct(), "found")
    near = lib.about(only)
    conf = folded(near, only).select("chunk_id", "confidence")
    uses = usage_counts(near, only).select(F.col("id").alias("chunk_id"), "used", "last_used_at")
    stats = context_scores(context_stats(near, only), p.prior_m, p.base_rate).select("chunk_id", "context_key", "context_score")
    size = F.octet_length("content")
    chunks = lib.chunks.select(F.col("id").alias("chunk_id"), "state", "confidence_base", "anti_trigger_desc", "token_count", (F.ltrim("content").startswith("Avoid:") | (F.coalesce("anti_trigger_desc", F.lit("")) != "")).alias("fail_origin"), F.when(size > p.length_free, -p.length_weight * F.log(size / p.length_free)).otherwise(F.lit(0.0)).alias("w_length"))
    asked = lib.queries.select("query_id", F.lower("query").alias("q"), "context_key")
    x = found.join(chunks, "chunk_id").join(conf, "chunk_id", "left").join(uses, "chunk_id", "left").join(asked, "query_id").join(stats, ["chunk_id", "context_key"], "left")
    anti = F.exists(F.split(F.lower("anti_trigger_desc"), ","), lambda part: (F.trim(part) != "") & F.contains(F.col("q"), F.trim(part)))
    x = x.select(
        "query_id", "chunk_id", "state", "token_count", "t", "fail_origin",
        (p.w_content * F.col("c")).alias("w_content"), (p.w_trigger * F.col("t")).alias("w_trigger"), (p.w_lexical * F.col("l")).alias("w_lexical"), (p.w_spread * F.col("s")).alias("w_spread"),
        (p.w_confidence * F.coalesce("confidence", "confidence_base")).alias("w_confidence"), (p.w_context * F.coalesce("context_score", F.lit(0.0))).alias("w_context"),
        (p.w_activation * activation(F.col("used"), F.col("last_used_at"), lib.as_of)).alias("w_activation"), "w_length",
        F.coalesce(anti, F.lit(False)).alias("anti"),
    )
    total = sum((F.col(f"w_{c}") for c in CHANNELS), F.col("w_length"))
    gate = total * F.when(F.col("anti"), p.anti_penalty).otherwise(1.0)
    x = x.withColumn("gate", sixth(gate)).withColumn("score", sixth(gate * F.when(F.col("state") == "pending", p.pending_penalty).otherwise(1.0)))
    return stored(x, "scored")


#: Channels of the fused score that can explain a match; the length penalty is the ninth term.
CHANNELS = ("content", "trigger", "lexical", "spread", "confidence", "context", "activation")


def recall(lib: Library, lexical_only: bool = False) -> DataFrame:
    """The chunks of each query in order: the top_k by fused score, of these those that pass min_score, with at most one pending.

    ``reason`` names the channel that gives most and those with at least 15 % of
    the positive sum.  Ties go to the smaller chunk.
    """
    p = lib.params
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    x = scored(lib, lexical_only).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= p.top_k)
    if p.min_score is not None:
        x = x.filter(F.col("gate") >= p.min_score)
    pending = F.count_if(F.col("state") == "pending").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("before", pending).filter("state <> 'pending' OR before = 0")
    parts = F.filter(F.array(*[F.struct((-F.round(F.col(f"w_{c}"), 6)).alias("v"), F.lit(c).alias("name")) for c in CHANNELS]), lambda e: e["v"] < 0)
    positive = F.aggregate(parts, F.lit(0.0), lambda acc, e: acc - e["v"])
    named = F.filter(F.array_sort(parts), lambda e, i: (i == 0) | (-e["v"] >= 0.15 * positive))
    return x.select("query_id", F.row_number().over(order).alias("rank"), "chunk_id", "score", "gate", "token_count", F.array_join(F.transform(named, lambda e: e["name"]), "+").alias("reason"))


def lexical_recall(lib: Library) -> DataFrame:
    """Recall without vectors."""
    return recall(lib, lexical_only=True).select("query_id", "rank", "chunk_id", "score")


def hook_recall(lib: Library) -> DataFrame:
    """Recall as an agent's hook asks for it: gate 0.40, a budget of 4,000 tokens, no dependencies, the first five.

    A query without a usable vector is recalled by its words alone.
    """
    gated = Library(lib.spark, lib.sf_dir, params=replace(lib.params, min_score=0.40))
    gated.queries = lib.queries.filter(_finite(F.col("vec")))
    words = Library(lib.spark, lib.sf_dir, params=gated.params)
    words.queries = lib.queries.filter(~F.coalesce(_finite(F.col("vec")), F.lit(False)))
    found = recall(gated)
    if not words.queries.isEmpty():
        found = found.unionByName(recall(words, lexical_only=True))
    return packed_blocks(expanded(lib, found, "false"), 4000).filter("pos <= 5").drop("seed")


def ranking(lib: Library) -> DataFrame:
    """Recall, written once for all that reads it."""
    return lib.kept("recall", lambda: stored(recall(lib), "recall"))


def packed(lib: Library, budget: int = 1200, expand: str = "closure", trim: Trim | None = None) -> DataFrame:
    """query_id, pos, chunk_id, tokens, pass and seed of what fits a token budget, chunks with all they depend on."""
    return packed_blocks(expanded(lib, ranking(lib), expand), budget, trim)


def trimmed(lib: Library) -> DataFrame:
    """Packing with a trimmer that keeps a block's seed where its dependencies do not fit."""
    return packed(lib, 1200, "closure", seed_first)


def ranking_metrics(lib: Library, k: int = 10) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG of content search, by query."""
    hits = vector_hits(lib.queries, lib.vec_content, k)
    rel = lib.relevant.distinct()
    found = hits.join(rel.withColumn("good", F.lit(1)), ["query_id", "chunk_id"], "left")
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    gain = lambda r: 1 / F.log2(r + 1)
    x = found.groupBy("query_id").agg(F.count("good").alias("h"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("good") == 1, gain(F.col("rank"))).otherwise(0.0)).alias("dcg")).join(n, "query_id")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant")).cast("int")), F.lit(0.0), lambda a, r: a + gain(r))
    return x.select("query_id", F.round(F.col("h") / k, 6).alias("precision"), F.round(F.col("h") / F.col("relevant"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def trace_events(lib: Library, budget: int = 1200, expand: str = "closure") -> DataFrame:
    """What a recall leaves in the log: query_id, chunk_id, event, rank, score and skip_reason.

    ``retrieved``: each ranked chunk, and why it was not taken (its block, or the
    budget); ``selected``: each chunk taken, with its place, dependencies under
    the score of the chunk that brought them in; ``spark``: the sparks that came
    along, by similarity.
    """
    found = lib.kept(f"blocks-{expand}", lambda: stored(expanded(lib, ranking(lib), expand), "blocks"))
    fits = stored(packed_blocks(found, budget), "packed").select("query_id", "chunk_id", "pos", "seed")
    none = F.lit(None).cast("string")
    seen = found.select("query_id", "chunk_id", "rank", "score", "skip_reason").join(fits.select("query_id", "chunk_id", "pos"), ["query_id", "chunk_id"], "left")
    why = F.when(F.col("pos").isNull(), F.coalesce("skip_reason", F.lit("budget")))
    seen = seen.select("query_id", "chunk_id", F.lit("retrieved").alias("event"), "rank", "score", why.alias("skip_reason"))
    taken = fits.join(found.select("query_id", F.col("chunk_id").alias("seed"), "score"), ["query_id", "seed"])
    taken = taken.select("query_id", "chunk_id", F.lit("selected").alias("event"), F.col("pos").alias("rank"), "score", none.alias("skip_reason"))
    sparks = spark_hits(lib).select("query_id", "chunk_id", F.lit("spark").alias("event"), "rank", F.col("sim").alias("score"), none.alias("skip_reason"))
    return seen.unionByName(taken).unionByName(sparks)


def recall_snapshots(lib: Library) -> DataFrame:
    """query_id, retrieved, selected, sparks (chunk ids, comma-joined in order) and tokens: the row that a recall stores for its trace."""
    e = stored(trace_events(lib), "events")
    listed = lambda event, name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == event, F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"]), ",").alias(name)
    cost = lib.chunks.select(F.col("id").alias("chunk_id"), "token_count")
    x = e.join(cost, "chunk_id", "left").groupBy("query_id").agg(listed("retrieved", "retrieved"), listed("selected", "selected"), listed("spark", "sparks"), F.sum(F.when(F.col("event") == "selected", F.col("token_count")).otherwise(0)).cast("long").alias("tokens"))
    return lib.queries.select("query_id").join(x, "query_id", "left").select("query_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("retrieved", "selected", "sparks")], F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def self_labels(lib: Library) -> DataFrame:
    """query and chunk_id: probes whose right answer is known, the trigger (90 characters) and an excerpt of the body (from 60 to 200, 40 at least)."""
    ok = recallable(lib.chunks, lib.params.embed_version).select(F.col("id").alias("chunk_id"), F.substring("trigger_desc", 1, 90).alias("probe"), F.substring("content", 61, 140).alias("body"))
    a = ok.filter("probe <> ''").select("chunk_id", F.lit("trigger").alias("kind"), F.col("probe").alias("query"))
    return a.unionByName(ok.filter("length(body) >= 40").select("chunk_id", F.lit("body").alias("kind"), F.col("body").alias("query")))


#: Settings that a sweep compares: a channel and its weight, of activation and of spread; none, the default or a light one, far too much.
SWEEP = {"off": ("activation", 0.0), "default": ("activation", 0.08), "heavy": ("activation", 1.0), "spread_off": ("spread", 0.0), "spread_heavy": ("spread", 1.0)}


def weight_sweep(lib: Library, k: int = 5) -> DataFrame:
    """setting, queries, mean precision, reciprocal rank and misses of recall at ``k`` by the weight of a channel; candidates are scored once.

    Without a weight for spread there are no settings of it, as no candidate came by it.
    """
    p, c = lib.params, F.col
    held = {"activation": p.w_activation, "spread": p.w_spread}
    settings = F.explode(F.array(*[F.struct(F.lit(name).alias("setting"), F.lit(channel).alias("channel"), F.lit(w / held[channel]).alias("factor")) for name, (channel, w) in SWEEP.items() if held[channel] > 0]))
    x = scored(lib).select("*", settings.alias("s")).select("*", "s.setting", "s.channel", "s.factor")
    weighed = lambda name: c(f"w_{name}") * F.when(c("channel") == name, c("factor")).otherwise(1.0)
    total = sum((weighed(name) if name in held else c(f"w_{name}") for name in CHANNELS), c("w_length"))
    score = F.round(total * F.when(c("anti"), p.anti_penalty).otherwise(1.0) * F.when(c("state") == "pending", p.pending_penalty).otherwise(1.0), 6)
    order = Window.partitionBy("setting", "query_id").orderBy(F.desc("score"), "chunk_id")
    top = x.withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter(c("rank") <= k)
    good = lib.relevant.distinct().withColumn("good", F.lit(1))
    each = top.join(good, ["query_id", "chunk_id"], "left").groupBy("setting", "query_id").agg(F.count("good").alias("h"), F.min(F.when(c("good") == 1, c("rank"))).alias("first"))
    return each.groupBy("setting").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(c("h") / k), 6).alias("precision"), F.round(F.avg(F.coalesce(1 / c("first"), F.lit(0.0))), 6).alias("mrr"), F.count_if(c("h") == 0).alias("misses"))


def ranking_averages(lib: Library, k: int = 10) -> DataFrame:
    """One row: queries, means of the ranking metrics, and queries without any hit."""
    mean = lambda name: F.round(F.avg(name), 6).alias(name)
    return ranking_metrics(lib, k).agg(F.count(F.lit(1)).alias("queries"), mean("precision"), mean("recall"), mean("rr"), mean("ndcg"), F.count_if(F.col("rr") == 0).alias("misses"))


def reranked(lib: Library, order: DataFrame | None = None) -> DataFrame:
    """Recall in an injected order: the chunks that ``order`` (query_id, chunk_id, pos) lists come first, in that order, the others as before.

    Without one, the order of lexical search stands in for a reranker.
    """
    given = order if order is not None else kept_hits(lib, RERANKED).select("query_id", "chunk_id", F.col("rank").alias("pos"))
    x = ranking(lib).join(given, ["query_id", "chunk_id"], "left")
    by = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("pos"), "rank")
    return x.select("query_id", F.row_number().over(by).alias("rank"), "chunk_id", F.col("rank").alias("fused_rank"))


def search_results(lib: Library, most: int = 100) -> DataFrame:
    """Lexical search as a search page shows it: query_id, rank, chunk_id, state and preview (280 characters)."""
    shown = lib.chunks.select(F.col("id").alias("chunk_id"), "state", F.substring("content", 1, 280).alias("preview"))
    return lexical_hits(lib, most).select("query_id", "rank", "chunk_id").join(shown, "chunk_id").select("query_id", "rank", "chunk_id", "state", "preview")
