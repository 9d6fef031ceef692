"""Dependency blocks and what of them fits a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.library import Library

#: Fixed value: a hard dependency this many steps away makes a block too deep.
DEPTH = 3
#: A chunk of a block and what it costs; a candidate with its block.
PART = "struct<id:string,cost:bigint>"
#: Takes a block and the tokens left, gives the block to try instead, or null.
Trim = Callable[[Column, Column], Column]


def usable_deps(lib: Library) -> DataFrame:
    """dst and cost of chunks that a hard dependency may lead to: there, not archived, no spark, embedded under some version."""
    ok = (F.col("state") != "archived") & (F.col("origin") != "spark") & (F.coalesce("embed_version", F.lit(0)) != 0)
    return lib.chunks.filter(ok).select(F.col("id").alias("dst"), F.col("token_count").cast("long").alias("cost"))


def _paths(lib: Library, seeds: DataFrame) -> DataFrame:
    """id of a seed and path of each way along up to DEPTH hard dependencies, as (dst, cost) steps; cost is null where the chunk cannot be used.

    One frontier join a step; ways go on only from chunks that can be used and
    never through a chunk twice.
    """
    hard = lib.deps.filter("kind = 'hard'").select("src", "dst").distinct().join(usable_deps(lib), "dst", "left").select("src", "dst", "cost")
    step = F.struct(F.col("dst").alias("id"), "cost")
    front = seeds.select("id", F.col("id").alias("src"), F.array().cast(f"array<{PART}>").alias("path"))
    out = None
    for _ in range(DEPTH):
        met = F.col("dst").eqNullSafe(F.col("id")) | F.exists("path", lambda p: p["id"] == F.col("dst"))
        front = front.join(hard, "src").filter(~met).select("id", F.col("dst").alias("src"), F.concat("path", F.array(step)).alias("path"))
        out = front if out is None else out.unionByName(front)
        front = front.filter(F.element_at("path", -1)["cost"].isNotNull())
    return out.select("id", "path")


def closed_blocks(lib: Library, seeds: DataFrame) -> DataFrame:
    """id, block and skip_reason of each seed with all it depends on, as a walk in depth finds it.

    Dependencies are walked in order of their ids, each chunk at its first place
    only.  The first that cannot be used makes the block ``hard_dep_unavailable``,
    the first that stands DEPTH steps away ``dep_depth_limit``.
    """
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<array<string>>").alias("open"), F.array().cast(f"array<{PART}>").alias("block"), F.lit(None).cast("string").alias("reason"))

    def walk(acc: Column, path: Column) -> Column:
        last, names = F.element_at(path, -1), F.transform(path, lambda p: p["id"])
        under = F.slice(names, 1, F.size(names) - 1)
        here = acc["reason"].isNull() & ((F.size(names) == 1) | F.array_contains(acc["open"], under)) & ~F.array_contains(acc["seen"], last["id"])
        reason = F.when(here & last["cost"].isNull(), "hard_dep_unavailable").when(here & (F.size(names) >= DEPTH), "dep_depth_limit").otherwise(acc["reason"])
        added = lambda held, x: F.when(here, F.concat(held, F.array(x))).otherwise(held)
        return F.struct(added(acc["seen"], last["id"]).alias("seen"), added(acc["open"], names).alias("open"), added(acc["block"], last).alias("block"), reason.alias("reason"))

    # Arrays of paths in order are the walk's order: a path stands before its continuations.
    ways = _paths(lib, seeds).groupBy("id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    walked = ways.select("id", F.aggregate("paths", start, walk).alias("w"))
    return _with_seed(lib, seeds, walked.select("id", F.col("w.block").alias("deps"), F.col("w.reason").alias("reason")))


def direct_blocks(lib: Library, seeds: DataFrame) -> DataFrame:
    """id, block and skip_reason of each seed with its own hard dependencies; one that cannot be used makes the block unavailable."""
    ways = lib.deps.filter("kind = 'hard'").select(F.col("src").alias("id"), "dst").distinct().join(seeds.select("id"), "id", "left_semi").join(usable_deps(lib), "dst", "left")
    deps = ways.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("id"), "cost"))).alias("deps"), F.max(F.when(F.col("cost").isNull(), "hard_dep_unavailable")).alias("reason"))
    return _with_seed(lib, seeds, deps)


def single_blocks(lib: Library, seeds: DataFrame) -> DataFrame:
    """id, block and skip_reason of each seed alone."""
    none = F.array().cast(f"array<{PART}>")
    return _with_seed(lib, seeds, seeds.select("id", none.alias("deps"), F.lit(None).cast("string").alias("reason")))


def _with_seed(lib: Library, seeds: DataFrame, deps: DataFrame) -> DataFrame:
    """Blocks that begin with the seed itself; empty where there is a reason to skip."""
    own = seeds.select("id").join(lib.chunks.select("id", F.col("token_count").cast("long").alias("cost")), "id")
    x = own.join(deps, "id", "left")
    block = F.concat(F.array(F.struct("id", "cost")), F.coalesce("deps", F.array().cast(f"array<{PART}>")))
    return x.select("id", F.when(F.col("reason").isNull(), block).otherwise(F.array().cast(f"array<{PART}>")).alias("block"), F.col("reason").alias("skip_reason"))


BLOCKS = {"false": single_blocks, "direct": direct_blocks, "closure": closed_blocks}


def expanded(lib: Library, ranked: DataFrame, expand: str) -> DataFrame:
    """``ranked`` (query_id, rank, chunk_id, score) with the block of each chunk; a chunk's block is built once."""
    if expand not in BLOCKS:
        raise ValueError(f"expand is one of {sorted(BLOCKS)}")
    blocks = BLOCKS[expand](lib, ranked.select(F.col("chunk_id").alias("id")).distinct())
    return ranked.join(blocks.withColumnRenamed("id", "chunk_id"), "chunk_id")


def packed_blocks(blocks: DataFrame, budget: int, trim: Trim | None = None) -> DataFrame:
    """query_id, pos, chunk_id, tokens, pass and seed of what fits ``budget``; ``blocks`` has query_id, rank, chunk_id, score, block and skip_reason.

    In order of rank each block whose new chunks still fit is taken, without
    those that are in already; a chunk that came in with an earlier block is
    passed over.  Of a block that does not fit ``trim`` may give a shorter one.
    Then blocks left over are tried again, the densest first (score by tokens of
    what is new after the first pass).  Blocks with a reason to skip stay out.
    A query's list is short, as recall gives at most its top.
    """
    out_item = "struct<id:string,cost:bigint,pass:string,seed:string>"
    listed = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "block", "skip_reason"))).alias("list"))
    ids = lambda taken: F.transform(taken, lambda t: t["id"])
    new = lambda taken, block: F.filter(block, lambda b: ~F.array_contains(ids(taken), b["id"]))
    cost = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, b: a + b["cost"])
    marked = lambda block, name, seed: F.transform(block, lambda b: F.struct(b["id"].alias("id"), b["cost"].alias("cost"), F.lit(name).alias("pass"), seed.alias("seed")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{out_item}>").alias("taken"), F.array().cast("array<int>").alias("left"))

    def first(acc: Column, e: Column) -> Column:
        part = new(acc["taken"], e["block"])
        open_ = ~F.array_contains(ids(acc["taken"]), e["chunk_id"]) & e["skip_reason"].isNull()
        fits = open_ & (acc["used"] + cost(part) <= budget)
        used, taken = F.when(fits, acc["used"] + cost(part)), F.when(fits, F.concat(acc["taken"], marked(part, "order", e["chunk_id"])))
        left = open_ & ~fits
        if trim is not None:
            short = trim(e["block"], F.lit(budget) - acc["used"])
            trims = left & short.isNotNull() & (acc["used"] + cost(short) <= budget)
            used, taken = used.when(trims, acc["used"] + cost(short)), taken.when(trims, F.concat(acc["taken"], marked(new(acc["taken"], short), "trimmed", e["chunk_id"])))
            left = left & ~trims
        return F.struct(used.otherwise(acc["used"]).alias("used"), taken.otherwise(acc["taken"]).alias("taken"), F.when(left, F.concat(acc["left"], F.array(e["rank"]))).otherwise(acc["left"]).alias("left"))

    x = listed.withColumn("one", F.aggregate("list", start, first))
    rest = F.filter("list", lambda e: F.array_contains(F.col("one.left"), e["rank"]))
    dense = F.transform(rest, lambda e: F.struct(new(F.col("one.taken"), e["block"]).alias("part"), e["rank"].alias("rank"), e["chunk_id"].alias("seed"), e["score"].alias("score")))
    dense = F.transform(F.filter(dense, lambda d: F.size(d["part"]) > 0), lambda d: F.struct((-d["score"] / F.greatest(cost(d["part"]), F.lit(1))).alias("d"), d["rank"].alias("rank"), d["seed"].alias("seed"), d["part"].alias("part")))
    # Densities are those before this pass; a chunk that two blocks bring in counts in both.
    again = F.struct(F.aggregate(F.col("one.taken"), F.lit(0).cast("long"), lambda a, t: a + t["cost"]).alias("used"), F.col("one.taken").alias("taken"))

    def second(acc: Column, d: Column) -> Column:
        fits = acc["used"] + cost(d["part"]) <= budget
        return F.struct(F.when(fits, acc["used"] + cost(d["part"])).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], marked(new(acc["taken"], d["part"]), "density", d["seed"]))).otherwise(acc["taken"]).alias("taken"))

    y = x.withColumn("two", F.aggregate(F.array_sort(dense), again, second)).select("query_id", F.posexplode("two.taken").alias("at", "t"))
    return y.select("query_id", (F.col("at") + 1).alias("pos"), F.col("t.id").alias("chunk_id"), F.col("t.cost").alias("tokens"), F.col("t.pass").alias("pass"), F.col("t.seed").alias("seed"))


def seed_first(block: Column, room: Column) -> Column:
    """A trimmer: the seed alone, where that still fits."""
    return F.when(F.element_at(block, 1)["cost"] <= room, F.slice(block, 1, 1))


def block_table(lib: Library) -> DataFrame:
    """id, mode, chunks, tokens and skip_reason of every recall-valid chunk's block, direct and closed."""
    seeds = lib.chunks.filter((F.col("state") != "archived") & (F.col("origin") != "spark") & (F.col("embed_version") >= lib.params.embed_version)).select("id")
    out = None
    for mode in ("direct", "closure"):
        part = BLOCKS[mode](lib, seeds).select("id", F.lit(mode).alias("mode"), F.array_join(F.transform("block", lambda b: b["id"]), ",").alias("chunks"), F.aggregate("block", F.lit(0).cast("long"), lambda a, b: a + b["cost"]).alias("tokens"), "skip_reason")
        out = part if out is None else out.unionByName(part)
    return out
