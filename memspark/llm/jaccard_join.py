"""Exact similarity join of documents in the metric space of the Jaccard distance.

The distance of two shingle sets is 1 - |intersection| / |union|, a metric.  Sets
within the radius (1 - least similarity) are linked.

1. Equal sets are one node.  Sets that cannot have a partner leave: of a linked
   pair both hold a share of their own least shingles in common, so a set whose
   least shingles are its own alone has no link; nor has one of whose whole
   shingles too many are its own.
2. Pivots create regions.  In the order of rarity, linked sets share one of the
   first shingles that each may miss; of the sets around such a shingle the most
   central one is the pivot, and its region holds all of them.  So any two linked
   sets lie in one region, with their exact distances to its pivot known.
3. Within the radius of the pivot a set is linked to it.  What is then still
   apart is joined inside the region: a set x outside the pivot's component meets
   only sets y with |d(x, p) - d(y, p)| <= radius (triangle inequality).
4. The join of a region recurses: pivots among its sets make smaller Voronoi
   regions; y is replicated into the region of p if d(y, p) is within twice the
   radius of its least distance and in the window of what lies there.  Where
   that no longer separates, the sets are compared as they are.

Regions of many sets are dealt over a grid of cells, so none is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.arrays import mixed, text_parts
from memspark.llm.common import written
from memspark.llm.components import components
from memspark.llm.minhash import SMALL, _with_groups, full_sets, shingles

#: Of a set's least shingles one in EXTRA of its size is looked at beyond those that a partner may lack.
EXTRA = 8
#: Members of a region that meet the pivot's set in one part; sets and shingles of one side of a cell.
PART = 500
CELL_SETS, CELL_SHINGLES = 1000, 2_000_000
#: Pairs that are compared without further regions; pivots of a split; pairs a split has to save, in percent.
LEAF, PIVOTS, SAVED = 4096, 8, 30
#: Matches of shingles that are expanded at once.
MATCHES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _at_least(n: Column, percent: int) -> Column:
    """Shingles that a set of ``n`` shares at least with a linked one: ceil(n * percent / 100)."""
    return F.floor((n * percent + 99) / 100).cast("int")


def sketched(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (digests that equal sets share) and ``least``, the least shingles of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("least", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_parts(batch.column(1)):
                n = len(offsets) - 1
                owner, h = shingles(data, offsets)
                size = np.bincount(owner, minlength=n)
                ends = np.cumsum(size)
                run_sum = lambda x: (c := np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]))[ends] - c[ends - size]  # noqa: E731, B023
                digests = [run_sum(mixed(h ^ _STEP)).view(np.int64), run_sum(mixed(h + _STEP)).view(np.int64)]
                first = size - (size * percent + 99) // 100 + (size + EXTRA - 1) // EXTRA
                kept = np.arange(len(h)) - (ends - size)[owner] < first[owner]
                held = np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=n))]).astype(np.int32)
                least = pa.ListArray.from_arrays(held, pa.array(h[kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(size, pa.int64()), *map(pa.array, digests), least], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, least array<long>")


def _common(postings: DataFrame) -> DataFrame:
    """``postings`` (id, s) of shingles that several rows hold, with their number df."""
    held = postings.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return postings.join(held, "s")


def may_link(sketch: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """id of the sets (``groups``: rep, n_shingles, rows) that may have a partner.

    A pair that shares o shingles has, for any k up to o, its k least common ones
    among the first n - o + k of either set.  With k = n / EXTRA of the smaller
    set, at least percent% of n / EXTRA of a set's least shingles are shared: more
    rows hold them than hold equal sets.  48 bits of a shingle do here, as chance
    matches only let a set stay.
    """
    postings = sketch.select(F.col("doc_id").alias("id"), F.explode("least").alias("s")).withColumn("s", F.col("s").bitwiseAND((1 << 48) - 1))
    held = _common(postings).groupBy("id", "df").agg(F.count(F.lit(1)).alias("m"))
    shared = held.join(groups, F.col("id") == F.col("rep")).filter("df > rows").groupBy("id", "n_shingles").agg(F.sum("m").alias("shared"))
    return shared.filter(F.col("shared") >= F.ceil(F.col("n_shingles") * percent / F.lit(100 * EXTRA) - 1e-9)).select("id").distinct()


def regions(sets: DataFrame, percent: int) -> DataFrame:
    """Stars (pivot, id) of the sets (id, shingles) that share one of the first shingles in the order of rarity; id <> pivot.

    Rows that repeat an id (texts under one id) are taken together.
    """
    n = sets.groupBy("id").agg(F.min(F.size("shingles")).alias("n"), F.max(F.size("shingles")).alias("most"), F.count(F.lit(1)).alias("texts"))
    postings = sets.select("id", F.explode("shingles").alias("s"))
    held = _common(postings).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("held")).join(n, "id")
    # Shingles of its own come first in the order and are not among those held.  Texts under one id keep all they hold.
    own = F.col("n") - F.size("held")
    first = F.when(F.col("texts") > 1, F.size("held")).otherwise(F.col("n") - _at_least(F.col("n"), percent) + 1 - own)
    central = F.floor(F.aggregate("held", F.lit(0).cast("long"), lambda t, x: t + x["df"]) * 1000 / F.col("most")).cast("long")
    first = held.filter((F.col("texts") > 1) | (F.size("held") >= _at_least(F.col("n"), percent))).select("id", central.alias("central"), F.slice("held", F.lit(1), first.cast("int")).alias("first"))
    first = written(first, "first")
    around = first.select("id", "central", F.explode("first.s").alias("s"))
    pivots = around.groupBy("s").agg(F.max(F.struct("central", (-F.col("id")).alias("i"))).alias("p"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("s", (-F.col("p.i")).alias("pivot"))
    return around.select("s", "id").join(pivots, "s").filter("id <> pivot").select("pivot", "id").distinct()


def distances(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """``stars`` (pivot, id) with the size of the set, the shingles shared with the pivot and those of both together.

    A pivot's set goes to one part for every PART members, and each member to one of these.
    """
    parts = stars.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    pivots = parts.join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("mid")), "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    members = stars.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).join(sets.select("id", "shingles"), "id")
    shared = F.size(F.array_intersect("shingles", "mid"))
    return members.join(pivots, ["pivot", "part"]).select("pivot", "id", F.size("shingles").alias("n"), shared.alias("shared"), (F.size("shingles") + F.size("mid") - shared).alias("joint"))


class Sets:
    """Sets of codes, flat."""

    def __init__(self, starts: np.ndarray, codes: np.ndarray):
        self.starts, self.codes = starts, codes

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def take(self, rows: np.ndarray) -> Sets:
        sizes = self.sizes[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(starts[-1]) + np.repeat(self.starts[rows] - starts[:-1], sizes)
        return Sets(starts, self.codes[at])

    @cached_property
    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes in order, and the set that each stands in."""
        order = np.argsort(self.codes, kind="stable")
        return self.codes[order], np.repeat(np.arange(len(self.sizes)), self.sizes)[order]

    def shared(self, other: Sets) -> np.ndarray:
        """Codes that each set here shares with each of the other."""
        codes, column = other.postings
        low = np.searchsorted(codes, self.codes, "left")
        times = np.searchsorted(codes, self.codes, "right") - low
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        width, ends = len(other.sizes), np.cumsum(times)
        out = np.zeros(len(self.sizes) * width, np.int64)
        at = 0
        while at < len(times):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MATCHES, "right")))
            t = times[at:upto]
            hit = column[np.repeat(low[at:upto] - np.cumsum(t) + t, t) + np.arange(t.sum())]
            out += np.bincount(np.repeat(row[at:upto], t) * width + hit, minlength=len(out))
            at = upto
        return out.reshape(len(self.sizes), width)

    def distances(self, other: Sets) -> np.ndarray:
        """Jaccard distances of all sets here to all of the other."""
        shared = self.shared(other)
        return 1 - shared / np.maximum(self.sizes[:, None] + other.sizes[None, :] - shared, 1)


def joined(sets: Sets, a: np.ndarray, b: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and of ``b`` whose sets are similar enough, by regions inside regions."""
    if not len(a) or not len(b):
        return
    radius = 1 - percent / 100
    if len(a) * len(b) > LEAF:
        both = np.unique(np.concatenate([a, b]))
        pivots = sets.take(both[np.argsort(mixed(both.astype(np.uint64)), kind="stable")[:PIVOTS]])
        da, db = sets.take(a).distances(pivots), sets.take(b).distances(pivots)
        home = da.argmin(1)
        parts = []
        for p in range(da.shape[1]):
            mine = home == p
            if mine.any():
                low, high = da[mine, p].min() - radius - 1e-9, da[mine, p].max() + radius + 1e-9
                parts.append((a[mine], b[(db[:, p] >= low) & (db[:, p] <= high) & (db[:, p] <= db.min(1) + 2 * radius + 1e-9)]))
        if sum(len(x) * len(y) for x, y in parts) * 100 <= len(a) * len(b) * (100 - SAVED):
            for x, y in parts:
                yield from joined(sets, x, y, percent)
            return
    step = max(1, LEAF * 16 // len(b))
    other = sets.take(b)
    for at in range(0, len(a), step):
        one = sets.take(a[at : at + step])
        shared = one.shared(other)
        i, j = np.nonzero(shared * 100 >= (one.sizes[:, None] + other.sizes[None, :] - shared) * percent)
        yield a[at : at + step][i], b[j]


def _cell(percent: int):
    def run(cell: pa.Table) -> pa.Table:
        ids, roots = cell.column("id").to_numpy(), cell.column("root").to_numpy()
        lists = cell.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        sets = Sets(np.concatenate([[0], np.cumsum(sizes)]), np.unique(lists.flatten().to_numpy(), return_inverse=True)[1])
        side = lambda c: np.flatnonzero(cell.column(c).to_numpy(zero_copy_only=False))
        found = [np.empty((2, 0), np.int64)]
        for i, j in joined(sets, side("asks"), side("given"), percent):
            ok = roots[i] != roots[j]
            found.append(np.stack([ids[i[ok]], ids[j[ok]]]))
        a, b = np.unique(np.concatenate(found, 1), axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _unsettled(stars: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components inside the regions ``stars`` (pivot, id, n, shared, joint)."""
    of = lambda key: roots.select(F.col("node").alias(key), F.col("root").alias(f"{key}_root"))
    d = 1 - F.col("shared") / F.col("joint")
    x = stars.join(of("id"), "id", "left").join(of("pivot"), "pivot", "left")
    x = x.select("pivot", "id", "n", d.alias("d"), F.coalesce("id_root", "id").alias("root"), F.coalesce("pivot_root", "pivot").alias("main"))
    itself = x.select("pivot", F.col("pivot").alias("id"), F.lit(0).alias("n"), F.lit(0.0).alias("d"), F.col("main").alias("root"), "main").distinct()
    x = written(x.unionByName(itself), "regions")
    apart = F.col("root") != F.col("main")
    radius = 1 - percent / 100
    window = x.filter(apart).groupBy("pivot").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    x = x.join(window, "pivot").filter(apart | ((F.col("d") >= F.col("low") - radius - 1e-9) & (F.col("d") <= F.col("high") + radius + 1e-9)))
    asks = F.col("root") != F.col("main")
    many = lambda what: F.greatest(F.ceil(F.count(F.when(what, 1)) / CELL_SETS), F.ceil(F.sum(F.when(what, F.col("n"))) / CELL_SHINGLES), F.lit(1)).cast("int")
    cells = x.groupBy("pivot").agg(many(asks).alias("down"), many(F.lit(True)).alias("across"))
    x = written(x.join(cells, "pivot").withColumn("asks", asks), "apart")
    deal = lambda m: F.pmod(F.xxhash64("id"), m).cast("int")
    series = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    single = (F.col("down") == 1) & (F.col("across") == 1)
    one = x.filter(single).select("pivot", F.lit(0).alias("ca"), F.lit(0).alias("cb"), "id", "root", "asks", F.lit(True).alias("given"))
    grid = x.filter(~single)
    asking = grid.filter("asks").withColumn("cb", series(F.col("across"))).select("pivot", deal(F.col("down")).alias("ca"), "cb", "id", "root", F.lit(True).alias("asks"), F.lit(False).alias("given"))
    giving = grid.withColumn("ca", series(F.col("down"))).select("pivot", "ca", deal(F.col("across")).alias("cb"), "id", "root", F.lit(False).alias("asks"), F.lit(True).alias("given"))
    rows = one.unionByName(asking).unionByName(giving).join(sets.select("id", "shingles"), "id")
    return rows.groupBy("pivot", "ca", "cb").applyInArrow(_cell(percent), "a long, b long")


def _of_one_id(named: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """Links (a, b) between the groups of equal sets that rows of one id belong to."""
    repeated = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("doc_id")
    rows = named.select("doc_id", *key).join(repeated, "doc_id").join(groups, key)
    return rows.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def clustered(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; sets of at least ``percent`` similarity are linked.

    A set holds the distinct shingles of five words, lower-cased in A-Z; a shorter
    text is one shingle.  component_id is the least doc_id reachable by links.
    Null and empty texts have no shingles and link with nothing.  Rows with a null
    id take no part: their component_id is null.  Rows that repeat an id form one
    node.  An empty table gives an empty table; other columns are ignored.
    """
    if not 50 < percent <= 100:
        raise ValueError("the least similarity has to be over 50 percent")
    sketch = written(sketched(docs, percent), "sketch")
    named = sketch.filter("doc_id IS NOT NULL AND n_shingles > 0")
    key = ["n_shingles", "set_a", "set_b"]
    groups = written(named.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "groups")
    chosen = written(may_link(named, groups, percent), "chosen")
    wanted = chosen.withColumnRenamed("id", "doc_id")
    wanted = F.broadcast(wanted) if chosen.count() <= SMALL else wanted
    sets = written(full_sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")), "sets")
    stars = written(distances(written(regions(sets, percent), "members"), sets), "stars")
    links = stars.filter(F.col("shared") * 100 >= F.col("joint") * percent).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    roots = components(links.unionByName(_of_one_id(named, groups, key)))
    more = written(_unsettled(stars, roots, sets, percent), "more")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    joined_groups = groups.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*key, "rows", F.coalesce("root", "rep").alias("root"))
    found = _with_groups(sketch.select("doc_id", *key), written(joined_groups, "rooted"), key)
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
