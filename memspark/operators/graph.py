"""Components and cycles of edge tables, by rounds of joins in the logarithm of a chain's length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.tables import stored

#: Rounds after which a graph counts as too deep; nothing is cut short silently.
ROUNDS = 200


def _graph(df: DataFrame) -> DataFrame:
    return stored(df, "graph")


def _starred(edges: DataFrame, all_neighbours: bool) -> DataFrame:
    """``edges`` (a, b), a over b, tied to the least neighbour of a node: its larger neighbours, or itself and its smaller ones."""
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if all_neighbours else edges
    least = F.least("a", F.min("b").over(Window.partitionBy("a")))
    tied = seen.select("a", "b", least.alias("m"))
    if all_neighbours:
        return tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(tied.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of an undirected edge table (a, b); null ends are left out.

    Large and small stars in turn until nothing changes: a node's larger
    neighbours, then its smaller ones, are tied to the least it knows.
    """
    known = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    alone = known.filter("a = b").select(F.col("a").alias("node"))
    now, mark = _graph(known.filter("a <> b")), None
    for _ in range(ROUNDS):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        now = _graph(_starred(_starred(now, True), False))
    else:
        raise ValueError(f"stars still move after {ROUNDS} rounds")
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    every = tied.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).unionByName(alone.select("node", F.col("node").alias("component")))
    return every.groupBy("node").agg(F.min("component").alias("component"))


def _lowest(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Least label that reaches each node (node, label) along ``edges`` (a to b); labels only go down edges within the table."""
    for _ in range(ROUNDS):
        offered = edges.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("offer"))
        stepped = _graph(labels.join(offered, "node", "left").select("node", F.least("label", "offer").alias("label"), (F.col("offer") < F.col("label")).alias("moved")))
        labels = stepped.select("node", "label")
        if stepped.filter("moved").isEmpty():
            return labels
    raise ValueError(f"labels still move after {ROUNDS} rounds")


def _raked(edges: DataFrame) -> DataFrame:
    """``edges`` without those from nodes that nothing enters, or into nodes that nothing leaves."""
    into, out = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
    return edges.join(into, "a", "left_semi").join(out, "b", "left_semi").select("a", "b")


def _spliced(edges: DataFrame, turn: int) -> DataFrame:
    """Nodes v with one edge in (from u) and one out (to w), no two of them neighbours, as v, u, w.

    Of neighbours that could go, the one with the least hash of this turn does.
    """
    one_in = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("u"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    one_out = edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("w"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    may = _graph(one_in.join(one_out, "v"))
    place = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("i"))
    other = lambda end: may.select(F.col("v").alias(end), F.lit(True).alias(f"{end}_may"))
    first = lambda end: F.col(f"{end}_may").isNull() | (place("v") < place(end))
    return may.join(other("u"), "u", "left").join(other("w"), "w", "left").filter(first("u") & first("w")).select("v", "u", "w")


def _core_groups(edges: DataFrame) -> DataFrame:
    """node and cycle of the nodes of ``edges`` that lie on a cycle: each node takes the least node that reaches it, and those that reach it back are its group."""
    found = None
    for _ in range(ROUNDS):
        if edges.isEmpty():
            break
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        colour = _graph(_lowest(nodes.withColumn("label", F.col("node")), edges))
        inside = _graph(edges.join(colour.toDF("a", "ca"), "a").join(colour.toDF("b", "cb"), "b").filter("ca = cb").select("a", "b", "ca"))
        # Back from each root within its colour: 0 where the root is reached.
        back = inside.select(F.col("b").alias("a"), F.col("a").alias("b"))
        start = colour.select("node", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("label"))
        reached = _graph(_lowest(start, back).filter("label = 0").select("node").join(colour, "node"))
        # A root that only joins two cycles is alone in its group and leaves without a row.
        looped = inside.join(reached.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"))
        group = reached.join(looped, "node", "left_semi").select("node", F.col("label").alias("cycle"))
        found = group if found is None else found.unionByName(group)
        gone = reached.select("node")
        edges = _graph(edges.join(gone, edges.a == gone.node, "left_anti").join(gone, edges.b == gone.node, "left_anti"))
    else:
        raise ValueError(f"cycles left after {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("a").alias("cycle")) if found is None else found


def strong_groups(edges: DataFrame) -> DataFrame:
    """node and cycle (its smallest node) of every node of a directed edge table (a, b) that lies on a cycle, self-loops included.

    Rake and compress first: edges that cannot lie on a cycle go, and of each
    run of nodes with one way in and one way out a third is spliced out a turn,
    so chains and rings shrink in rounds that grow with the logarithm of their
    length.  What stays is grouped by labels; then the spliced nodes come back:
    one between two nodes of a group is in it too.
    """
    clean = _graph(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    itself = lambda df: df.filter("a = b").select(F.col("a").alias("node"))
    loops, now, left, taken = itself(clean), clean.filter("a <> b"), None, []
    for turn in range(ROUNDS):
        raked = _graph(_raked(now))
        out = _graph(_spliced(raked, turn))
        gone = out.select("v")
        kept = raked.join(gone, raked.a == gone.v, "left_anti").join(gone, raked.b == gone.v, "left_anti")
        joined = _graph(kept.unionByName(out.select(F.col("u").alias("a"), F.col("w").alias("b"))).distinct())
        n = joined.count()
        if n == left:
            break
        left, now = n, joined.filter("a <> b")
        taken.append(out)
        loops = loops.unionByName(itself(joined))
        if n == 0:
            break
    else:
        raise ValueError(f"edges still fall after {ROUNDS} rounds")
    loops, groups = _graph(loops.distinct()), _core_groups(now)
    own = lambda df: df.select("node", F.col("node").alias("cycle"))
    # A node with a way back to itself is a group at least, when its turn comes.
    later = None
    for x in taken:
        later = x.select(F.col("v").alias("node")) if later is None else later.unionByName(x.select(F.col("v").alias("node")))
    back = loops.join(groups, "node", "left_anti")
    groups = _graph(groups.unionByName(own(back if later is None else back.join(later, "node", "left_anti"))))
    for x in reversed(taken):
        of = lambda end: groups.select(F.col("node").alias(end), F.col("cycle").alias(f"{end}_in"))  # noqa: B023, E731
        inside = x.join(of("u"), "u").join(of("w"), "w").filter("u_in = w_in").select(F.col("v").alias("node"), F.col("u_in").alias("cycle"))
        alone = own(x.select(F.col("v").alias("node")).join(loops, "node", "left_semi")).join(inside, "node", "left_anti")
        groups = _graph(groups.unionByName(inside).unionByName(alone))
    least = groups.groupBy("cycle").agg(F.min("node").alias("least"))
    return groups.join(least, "cycle").select("node", F.col("least").alias("cycle"))


def hard_cycles(lib: Library) -> DataFrame:
    """id and cycle of each chunk on a cycle of hard dependencies; cycle names the smallest chunk of the group."""
    edges = lib.deps.filter("kind = 'hard'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return strong_groups(edges).select(F.col("node").alias("id"), "cycle")
