"""Near-duplicate documents by one-permutation hashing.

Each distinct shingle set gets a signature: one permutation splits its hashes
into bins, the least of each bin is kept, and an empty bin borrows from the
first filled bin in an order of its own (optimal densification).  Bands of the
signature are bucket keys.

Candidates form stars: in a bucket every set is paired with the bucket's centre
only, the set that meets most others, so a bucket of n sets gives n - 1 pairs.  Pairs are confirmed on full
sets.  Buckets whose members then still lie in different components get an exact
second pass over pairs of different components, which in large buckets joins
what the sets have changed against the centre instead of pairing all.
Sets that share no bucket are the only ones never
compared; at similarity 0.85 the chance of that is (1 - 0.85^6)^40 = 6e-9, at
0.80 it is 5e-6.

Documents with the same set are collapsed before and share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.arrays import LOWER, mixed, span_hashes, text_parts, words
from memspark.llm.common import written
from memspark.llm.components import components

#: Words of a shingle; least similarity in percent where the caller gives none; rows of a band and bands.
WIDTH, PERCENT, ROWS, BANDS = 5, 85, 6, 40
BINS = ROWS * BANDS
#: Pairs of a bucket up to which the second pass compares them without looking at changes.
FEW = 256
#: In a star, changes that one member in so many shares come after the rarer ones.
COMMON = 20
#: Parts that the members of one centre are spread over where they meet what belongs to it.
SALTS = 32
#: Groups of equal sets that are broadcast at most, and rows of such a group at least.
GROUPS, LARGE = 100_000, 1000
#: Ids up to which a list of candidates is broadcast (some 40 MB as a hash table).
SMALL = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: For each bin the order in which it looks for a filled bin.
_DONORS = np.argsort(mixed(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS), axis=1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct shingles of a part, in that order."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    each = span_hashes(data, starts, ends)
    count = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    place = np.arange(len(each)) - first[owner]
    # A window starts at each word that has WIDTH words from it on; a shorter text is one window.
    width = np.minimum(WIDTH, count)[owner]
    begin = np.flatnonzero(place + width <= count[owner])
    short = width[begin] < WIDTH
    begin = begin[~short | (place[begin] == 0)]
    h, w = np.zeros(len(begin), np.uint64), width[begin]
    for j in range(WIDTH):
        more = j < w
        h[more] = mixed(h[more] * _STEP + each[begin[more] + j] + np.uint64(j))
    owner = owner[begin]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def signatures(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Densified signatures (text x bin) of sorted shingles; rows of texts without any stay 0."""
    bins = (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    least = np.ones(len(h), bool)  # hashes ascend with their bins, so the first of a bin is its least
    least[1:] = (bins[1:] != bins[:-1]) | (owner[1:] != owner[:-1])
    out, filled = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    out[owner[least], bins[least]] = h[least]
    filled[owner[least], bins[least]] = True
    row, bin_ = np.nonzero(~filled & filled.any(1)[:, None])
    for turn in range(BINS):
        if not len(row):
            break
        donor = _DONORS[bin_, turn]
        ok = filled[row, donor]
        out[row[ok], bin_[ok]] = out[row[ok], donor[ok]]
        row, bin_ = row[~ok], bin_[~ok]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """Bucket keys (text x band)."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(BANDS, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = mixed(key * _STEP + parts[:, :, j])
    return key.view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (digests that equal sets share) and bands of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_parts(batch.column(1)):
                n = len(offsets) - 1
                owner, h = shingles(data, offsets)
                size = np.bincount(owner, minlength=n)
                ends = np.cumsum(size)
                run_sum = lambda x: (c := np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]))[ends] - c[ends - size]  # noqa: E731, B023
                digests = [run_sum(mixed(h ^ _STEP)).view(np.int64), run_sum(mixed(h + _STEP)).view(np.int64)]
                keys = band_keys(signatures(owner, h, n))
                held = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(held, pa.array(keys[size > 0].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(size, pa.int64()), *map(pa.array, digests), bands], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """id and shingles (sorted hashes) of every text."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_parts(batch.column(1)):
                n = len(offsets) - 1
                owner, h = shingles(data, offsets)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "id long, shingles array<long>")


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a, b) of ``sets`` (id, shingles) that are similar enough, by their full sets."""
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    x = two.select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return x.filter(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b")


def clustered(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; sets of at least ``percent`` similarity are linked.

    Null and empty texts have no shingles and link with nothing.  Rows with a
    null id take no part: their component_id is null and they are kept.  Rows
    that repeat an id form one node.  Of a component the least id is kept.  An
    empty table gives an empty table; other columns are ignored.
    """
    sketch = written(sketched(docs), "sketch")
    named = sketch.filter("doc_id IS NOT NULL AND n_shingles > 0")
    key = ["n_shingles", "set_a", "set_b"]
    groups = written(named.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "groups")
    # The row of each group's least id stands for the group.
    reps = named.join(groups.select("rep", *[F.col(k).alias(f"_{k}") for k in key]), (F.col("doc_id") == F.col("rep")) & (F.col("n_shingles") == F.col("_n_shingles")) & (F.col("set_a") == F.col("_set_a")) & (F.col("set_b") == F.col("_set_b")), "left_semi")
    rows = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = written(_buckets(rows), "buckets")
    star = F.struct(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b"))
    pairs = shared.filter((F.col("id") != F.col("centre")) & _near_sizes(F.col("n"), F.col("cn"), percent)).select(star.alias("p")).select("p.*").distinct()
    pairs = written(pairs, "pairs")
    bucketed = shared.select(F.col("id").alias("doc_id")).distinct()
    bucketed = F.broadcast(bucketed) if bucketed.count() <= SMALL else bucketed
    sets = written(full_sets(docs.select("doc_id", "text").join(bucketed, "doc_id", "left_semi")), "sets")
    links = written(confirmed(pairs, sets, percent), "confirmed")
    roots = components(links)
    rest = written(_unsettled(shared, roots, sets, percent), "rest")
    more = confirmed(rest.join(pairs, ["a", "b"], "left_anti"), sets, percent)
    more = written(more, "more")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named_groups = groups.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*key, "rows", F.coalesce("root", "rep").alias("root"))
    found = _with_groups(sketch.select("doc_id", *key), written(named_groups, "rooted"), key)
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_groups(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the root of their group; rows of the largest groups, at most GROUPS of them, meet it without a shuffle."""
    most = (groups.agg(F.sum("rows")).first()[0] or 0) // GROUPS + LARGE
    large = F.broadcast(groups.filter(F.col("rows") > most).drop("rows"))
    rest = rows.join(large.select(*key), key, "left_anti").join(groups.filter(F.col("rows") <= most).drop("rows"), key, "left")
    return rows.join(large, key).unionByName(rest)


def _buckets(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, n) of buckets with several sets, with the bucket's centre and its size.

    The centre is the set that meets most others over all buckets (ties: the
    least id): of a text and its altered copies that is mostly the text, which
    resembles each copy more than they resemble each other.
    """
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    x = written(rows.join(held, "key"), "met")
    degree = x.groupBy("id").agg(F.sum(F.col("m") - 1).alias("degree"))
    x = x.drop("m").join(degree, "id")
    best = F.max(F.struct(F.col("degree"), -F.col("id"), F.col("id").alias("c"), F.col("n").alias("cn"))).alias("best")
    centres = x.groupBy("key").agg(best).select("key", F.col("best.c").alias("centre"), F.col("best.cn").alias("cn"))
    return x.drop("degree").join(centres, "key")


def _unsettled(shared: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of sets that meet in a bucket of ``shared`` (key, id, n, centre, cn) and may be linked across components.

    Only buckets that lie in several components count, and only pairs of which
    one set is outside the bucket's largest component.  Where that leaves few
    pairs they are all given; in larger buckets those that ``_by_changes`` finds.
    """
    x = shared.join(roots, shared["id"] == roots["node"], "left").select("key", "id", "n", "centre", "cn", F.coalesce("root", "id").alias("root"))
    held = x.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    top = held.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("roots"))
    few = (F.col("all") - F.col("top.m")) * F.col("all") <= FEW
    x = x.join(top.filter("roots > 1").select("key", F.col("top.root").alias("main"), few.alias("few")), "key")
    x = written(x, "unsettled")
    direct = x.filter("few AND id <> centre")
    out = direct.filter("root <> main").select("key", F.col("id").alias("i"), F.col("n").alias("k"), F.col("root").alias("r"))
    two = direct.join(out, "key").filter((F.col("root") != F.col("r")) & _near_sizes(F.col("n"), F.col("k"), percent) & ((F.col("root") == F.col("main")) | (F.col("id") < F.col("i"))))
    pairs = two.select(F.least("id", "i").alias("a"), F.greatest("id", "i").alias("b"))
    # Large buckets with the same largest component share one centre, the one that most of them have.
    large = x.filter("NOT few")
    votes = large.groupBy("main", "centre", "cn").agg(F.count(F.lit(1)).alias("v"))
    hub = votes.groupBy("main").agg(F.max(F.struct("v", "centre", "cn")).alias("h")).select("main", F.col("h.centre").alias("centre"), F.col("h.cn").alias("cn"))
    stars = large.select("main", "id", "n", "root").distinct().join(hub, "main").filter("id <> centre").select("centre", "cn", "id", "n", "root").distinct()
    return pairs.unionByName(_by_changes(stars, sets, percent)).distinct()


def _with_centre(members: DataFrame, centres: DataFrame, how: str) -> DataFrame:
    """``members`` (centre, id and others) with the columns of ``centres`` (centre and others).

    A centre's row goes to SALTS parts and each member to one of them, so that a
    star with very many members isn't one task's.
    """
    spread = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["centre", "salt"], how).drop("salt")


def _by_changes(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of members of one star (centre, cn, id, n, root) that may be linked but lie in different components.

    What a member adds to the centre's set and lacks of it are its changes, e of
    them.  Sets x and y differ in e(x) + e(y) - 2 * shared changes, and are
    linked if that is at most d * (|x| + |y|), with d = (100 - percent) / (100 +
    percent).  So a link needs (u(x) + u(y)) / 2 shared changes, u = e - d * size.
    Sets linked to the centre are paired with it.  Of two others in different
    components one at least is not linked to the centre, thus has u > d * |centre|.  Sets that need t shared changes share one among the
    first e - t + 1 of each in any common order; changes that few members share
    come first.  No pair that could be linked is left out.
    """
    less, both = 100 - percent, 100 + percent
    middles = stars.select("centre").distinct().join(sets.select(F.col("id").alias("centre"), F.col("shingles").alias("mid")), "centre")
    x = _with_centre(stars.join(sets.select("id", F.col("shingles").alias("own")), "id"), middles, "inner")
    changes = F.concat(F.array_except("own", "mid"), F.array_except("mid", "own"))
    x = written(x.select("centre", "cn", "id", "n", "root", changes.alias("changes")), "changed")
    # Changes that at least one member in COMMON shares: on average a member has e changes, so a star has at most COMMON * e of them.
    members = x.groupBy("centre").agg(F.count(F.lit(1)).alias("m"))
    often = x.select("centre", F.explode("changes").alias("c")).groupBy("centre", "c").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    often = often.join(members, "centre").filter(F.col("times") * COMMON >= F.col("m"))
    often = often.groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("times", "c"))).getField("c").alias("often"))
    x = _with_centre(x, often, "left").withColumn("often", F.coalesce("often", F.array().cast("array<long>")))
    ordered = F.concat(F.sort_array(F.array_except("changes", "often")), F.array_intersect("often", "changes"))
    x = x.select("centre", "cn", "id", "n", "root", ordered.alias("changes")).withColumn("e", F.size("changes"))
    far = both * F.col("e") > less * (F.col("n") + F.col("cn"))
    need = F.ceil((both * F.col("e") - less * F.col("n") + less * F.col("cn")) / F.lit(2.0 * both) - 1e-9)
    short = F.greatest(F.lit(0), F.least(F.col("e"), F.col("e") - need + 1)).cast("int")
    # Against any partner: it has at least u - d * |partner| changes, and |partner| <= size * 100 / percent.
    wide = F.least(F.col("e"), F.ceil(F.col("n") * F.lit(less / both * (1 + 100 / percent)) + 1)).cast("int")
    x = written(x.select("centre", "id", "n", "root", far.alias("far"), F.slice("changes", 1, F.greatest(short, F.lit(0))).alias("short"), F.slice("changes", 1, wide).alias("wide")), "changes")
    side = lambda rows, column, p: rows.select("centre", F.explode(column).alias("c"), F.col("id").alias(f"i{p}"), F.col("n").alias(f"n{p}"), F.col("root").alias(f"r{p}"))
    may = (F.col("r1") != F.col("r2")) & _near_sizes(F.col("n1"), F.col("n2"), percent)
    meet = lambda a, b, more: a.join(b, ["centre", "c"]).filter(may & more).select(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b"))
    far_far = meet(side(x.filter("far"), "short", 1), side(x.filter("far"), "short", 2), F.col("i1") < F.col("i2"))
    far_near = meet(side(x.filter("far"), "wide", 1), side(x.filter("NOT far"), "short", 2), F.lit(True))
    hubs = x.filter("NOT far").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b"))
    return far_far.unionByName(far_near).unionByName(hubs)
