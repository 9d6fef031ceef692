"""Similarity self-join of vectors above a threshold, in a grid of blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.tables import stored

#: Vectors of one side of a cell, and components of them, at most.
CELL, COMPONENTS = 32768, 1 << 21
#: Blocks that few vectors are dealt into as well, so that several tasks have work, and rows that are worth one.
BLOCKS, WORTH = 8, 2048


def usable(vector: Column) -> Column:
    """True for vectors with a direction: not null or empty, all components finite, one at least not 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def normalized(vector: Column) -> Column:
    """``vector`` at length 1, as doubles; one without a direction stays as it is."""
    x = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.when(norm > 0, F.transform(x, lambda v: v / norm)).otherwise(x)


def cosine(one: Column, two: Column) -> Column:
    """Cosine of two vectors, 0 where one has no direction or their lengths differ."""
    a, b = one.cast("array<double>"), two.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda v, w: v * w), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, width)


def _forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of row and column that connect all that ``ok`` links; at most one for each row and column."""
    out, seen_row, seen_col = [], np.zeros(ok.shape[0], bool), np.zeros(ok.shape[1], bool)
    for start in np.flatnonzero(ok.any(1)):
        todo = [] if seen_row[start] else [start]
        seen_row[start] = True
        while todo:
            i = todo.pop()
            columns = np.flatnonzero(ok[i] & ~seen_col)
            seen_col[columns] = True
            for j in columns:
                out.append((i, j))
                rows = np.flatnonzero(ok[:, j] & ~seen_row)
                seen_row[rows] = True
                out += [(r, j) for r in rows]
                todo += rows.tolist()
    return out


def _joined(pairs: list[tuple[int, int]], above: list[int]) -> list[tuple[int, int]]:
    """The ``pairs`` that connect what was apart; ``above`` names a node's parent and is kept up to date."""

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    out = []
    for i, j in pairs:
        one, two = root(i), root(j)
        if one != two:
            above[one] = two
            out.append((i, j))
    return out


def _cell(width: int, least: float):
    # Products of 32-bit floats only pass over pairs that are below the threshold by more than their error.
    margin = 1e-6 + (width + 4) * 1.2e-7

    def run(rows: pa.Table) -> pa.Table:
        ids, block = rows.column("id").to_numpy(zero_copy_only=False), rows.column("block").to_numpy()
        sessions = rows.column("session").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        points = _matrix(rows.column("vec"), width)
        home, given = (np.flatnonzero(block == rows.column(c)[0].as_py()) for c in ("ca", "cb"))
        coarse, above, found = points[given].astype(np.float32), list(range(len(ids))), []
        for at in range(0, len(home), 256):
            here = home[at : at + 256]
            near = points[here].astype(np.float32) @ coarse.T >= least - margin
            a, b = here[near.any(1)], given[near.any(0)]
            if len(a):
                differ = (sessions[a][:, None] != sessions[b][None, :]) | (sessions[a] < 0)[:, None]
                ok = (np.round(points[a] @ points[b].T, 6) >= least) & differ
                found += _joined([(a[i], b[j]) for i, j in _forest(ok)], above)
        return pa.table({"a": pa.array([str(ids[i]) for i, _ in found], pa.string()), "b": pa.array([str(ids[j]) for _, j in found], pa.string())})

    return run


def links(rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that connect the rows (id, session, vec) whose vectors have a cosine of ``least`` (6 places) and whose sessions differ.

    Not every pair is given, but rows that pairs connect are connected.  Equal
    vectors meet as a star of sessions first and go on as one row, without a
    session if they have several, so a vector that very many episodes share is
    no all-pairs block.  The rest is dealt into a grid of blocks, of which each
    two meet in a cell that gives a forest.  Vectors of other length, and without
    a direction, have no link.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    x = rows.filter("vec IS NOT NULL AND id IS NOT NULL AND session IS NOT NULL").select(text("id"), text("session"), "vec")
    # Sorted and dealt by the hash, which most often tells vectors apart; each is judged and normalized once, however many rows share it.
    x = x.withColumn("hash", F.xxhash64("vec"))
    first = F.struct("session", "id")
    given = x.groupBy("hash", "vec").agg(F.min(first).alias("lo"), F.max(first).alias("hi")).filter(usable(F.col("vec")))
    given = stored(given.withColumn("unit", normalized(F.col("vec"))).withColumn("unit_hash", F.xxhash64("unit")), "given")
    ends = stored(given.groupBy("unit_hash", "unit").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "ends")
    several = F.col("lo.session") != F.col("hi.session")
    of = given.drop("lo", "hi").join(ends, ["unit_hash", "unit"]).select("hash", "vec", "lo", "hi")
    members = stored(x.join(of, ["hash", "vec"]).filter("id <> lo.id").select("id", "session", "lo", "hi"), "members")
    star = members.filter(several).select(F.col("id").alias("a"), F.when(F.col("session") == F.col("lo.session"), F.col("hi.id")).otherwise(F.col("lo.id")).alias("b"))
    points = ends.select(F.col("lo.id").alias("id"), F.when(~several, F.col("lo.session")).alias("session"), F.col("unit").alias("vec"), F.size("unit").alias("width"))
    out = None
    for width, n in [(r["width"], r["n"]) for r in points.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()]:
        part = _within(points.filter(F.col("width") == width).drop("width"), width, n, least)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return star
    out = stored(out, "links")
    # Equal vectors of one session meet the same others as the one that stands for them.
    linked = out.select("a").unionByName(out.select(F.col("b").alias("a"))).distinct()
    alike = members.filter(~several).select(F.col("id").alias("a"), F.col("lo.id").alias("b")).join(linked.select(F.col("a").alias("b")), "b", "left_semi")
    return out.unionByName(star).unionByName(alike.select("a", "b")).filter("a <> b")


def _within(points: DataFrame, width: int, n: int, least: float) -> DataFrame:
    """Edges of the ``n`` ``points`` (id, session, vec) of one length; a null session differs from all."""
    side = max(1, min(CELL, COMPONENTS // width))
    blocks = max(math.ceil(n / side), min(BLOCKS, math.ceil(n / WORTH)))
    own, other = F.col("block"), F.col("other")
    dealt = points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = dealt.select(F.least(own, other).alias("ca"), F.greatest(own, other).alias("cb"), "block", "id", "session", "vec")
    return cells.groupBy("ca", "cb").applyInArrow(_cell(width, least), "a string, b string")
