"""Mixing sources to target weights by entropy balancing.

The mix is the one nearest to the corpus, in relative entropy over documents,
whose word totals meet the targets and in which no document counts more than
``cap`` times.  Its document rates are exponentially tilted by what a document
adds to its source's token constraint,

    rate = min(cap, exp(lambda of the source * size of the document / mean size)),

and Newton iterations solve the convex dual for lambda.  Sizes enter by class
(four to a doubling, by the class's own mean), so documents of a class share a
rate.  In each iteration Spark sums every source's gradient (words taken less
target) and Hessian over the table of sources and classes; a step that leaves
the interval known to hold the solution is halved back into it.  Iterations end
when the largest residual is small.

Rates become whole copies: every document gets the floor of its rate, and within
a source and size class the documents of smallest hash get one more, up to a
threshold found on a two-level histogram of hashes.  What a class falls short of
is carried to the next smaller class, so a source misses its target by no more
than about half a small document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import WORD_SPACE, written

#: Newton iterations at most, and the residual, as a share of the target, at which they end.
STEPS, CLOSE = 40, 1e-9
#: Size classes to a doubling of the size.
PER_DOUBLING = 4
#: Bits of each of the two histogram levels.
BITS = 12
#: Rows of a rule table up to which it is broadcast.
SMALL = 100_000


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WORD_SPACE}]+")), F.lit(0)).cast("long")


def _sized(docs: DataFrame) -> list[Column]:
    """doc_id, source, size and a hash of id and text, by which rows are ordered within a class."""
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [id_.alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(id_, text).alias("u")]


def _keyed(df: DataFrame) -> DataFrame:
    """Adds size class and the two hash digits used by the thresholds."""
    return df.withColumns({
        "cls": F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * PER_DOUBLING).cast("int")).otherwise(-1),
        "d1": F.shiftrightunsigned("u", 64 - BITS).cast("int"),
        "d2": F.shiftrightunsigned("u", 64 - 2 * BITS).bitwiseAND((1 << BITS) - 1).cast("int"),
    })


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """source, source_size, target of each source of ``sizes`` (source, source_size).

    Sources by code point, null last, take ``weights`` in turn and share all
    words; a target stops at ``cap`` times its source's size and the excess is
    shared again by weight.  One row a source passes through one task.
    """
    every = Window.partitionBy()
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (order % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    x = x.withColumn("full", F.col("w") * left / open_w >= F.col("most"))
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    open_all = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(every)
    return x.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * rest / open_all).alias("target"))


def _features(classes: DataFrame) -> DataFrame:
    """``classes`` (source, cls, total, n) with x, the mean size of the class over that of its source."""
    of = Window.partitionBy("source")
    return classes.withColumn("x", (F.col("total") / F.col("n")) / (F.sum("total").over(of) / F.sum("n").over(of)))


def tilts(classes: DataFrame, aims: DataFrame, cap: float) -> DataFrame:
    """of (the source) and lam of each source, by Newton's method on the dual.

    ``classes``: source, cls, total (words), n (documents); ``aims``: source,
    source_size, target.  A class's feature is its mean size over its source's
    mean size.  Sources without words or target, and those whose target takes
    every document ``cap`` times, have no row.
    """
    table = written(_features(classes).filter("total > 0"), "mix-classes")
    state = aims.filter("target > 0").filter(~_full(cap)).select(F.col("source").alias("of"), F.col("target").alias("t"), F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"))
    state = written(state.withColumn("left", F.lit(1.0)), "mix-state")
    small = state.count() <= SMALL
    for _ in range(STEPS):
        if (state.agg(F.max("left")).first()[0] or 0.0) <= CLOSE:
            break
        rate = F.exp(F.least(F.col("lam") * F.col("x"), F.lit(700.0)))
        mass = F.col("total") * F.least(rate, F.lit(float(cap)))
        curve = F.when(rate < cap, F.col("total") * F.col("x") * rate).otherwise(0.0)
        both = table.join(F.broadcast(state) if small else state, F.col("source").eqNullSafe(F.col("of")))
        sums = both.groupBy("of", "t", "lam", "lo", "hi").agg(F.sum(mass).alias("mass"), F.sum(curve).alias("h"))
        g = F.col("mass") - F.col("t")
        lo, hi = F.when(g < 0, F.col("lam")).otherwise(F.col("lo")), F.when(g >= 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.when(F.col("h") > 0, g / F.col("h"))
        # Where the step is not inside the interval, its middle; neither goes further than to double lambda.
        reach = F.greatest(F.abs("lam"), F.lit(1.0))
        within = lambda x: F.greatest(F.least(x, F.col("lam") + reach), F.col("lam") - reach)
        near, half = within(step), within((lo + hi) / 2)
        left = F.abs(g) / F.col("t")
        done = (left <= CLOSE) | ((hi - lo) < 1e-13)
        new = F.when(done, F.col("lam")).when((near > lo) & (near < hi), near).otherwise(half)
        state = written(sums.select("of", "t", new.alias("lam"), lo.alias("lo"), hi.alias("hi"), F.when(done, 0.0).otherwise(left).alias("left")), "mix-state")
    return state.select("of", "lam")


def _full(cap: float) -> Column:
    """Whether a source's target takes all of it ``cap`` times."""
    return F.col("target") >= F.col("source_size") * (cap * (1 - 1e-12))


def _crossing(hist: DataFrame, digit: str) -> DataFrame:
    """Of each source and class, the bin of ``hist`` where the running mass passes ``need``."""
    order = Window.partitionBy("source", "cls").orderBy(digit)
    upto = F.sum("mass").over(order)
    x = hist.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("mass"))
    return x.filter((F.col("before") <= F.col("need")) & (F.col("need") < F.col("upto")))


def rules(sized: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """One row for each source and size class: source_size, target, lam, rate, base copies and the threshold of one more."""
    if cap < 1 or cap != int(cap):
        raise ValueError(f"copies are whole, so the cap must be too: {cap}")
    keyed = _keyed(sized)
    first = written(keyed.groupBy("source", "cls", "d1").agg(F.sum("size").alias("mass"), F.count(F.lit(1)).alias("n")), "mix-hist")
    per_source = first.groupBy("source").agg(F.sum("mass").alias("source_size"))
    aims = written(targets(per_source, weights, cap), "mix-aims")
    classes = written(first.groupBy("source", "cls").agg(F.sum("mass").alias("total"), F.sum("n").alias("n")), "mix-totals")
    solved = tilts(classes, aims, cap)
    aims = aims.join(solved, aims["source"].eqNullSafe(solved["of"]), "left").drop("of").withColumnRenamed("source", "_of")
    rates = _features(classes).join(aims, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    # Rounded, so that a rate that is a whole number but for the last bits is one.
    rate = F.round(F.least(F.exp(F.least(F.col("lam") * F.col("x"), F.lit(700.0))), F.lit(float(cap))), 9)
    rate = F.when(_full(cap), F.lit(float(cap))).when(F.col("lam").isNotNull(), rate).otherwise(0.0)
    rates = rates.withColumn("rate", F.when(F.col("total") > 0, rate).otherwise(0.0))
    rates = rates.withColumn("base", F.floor("rate").cast("long"))
    needs = written(rates.withColumn("need", F.col("total") * (F.col("rate") - F.col("base"))), "mix-needs")
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["cls"] == b["cls"])
    pick = needs.filter(F.col("rate") < cap).select("source", "cls", "need")  # classes at the cap get no copy more
    one = _crossing(first.join(pick, same(first, pick)).select(first["source"], first["cls"], "d1", "mass", "need"), "d1")
    one = one.filter("cls >= 0").select(F.col("source").alias("s1"), F.col("cls").alias("k1"), F.col("d1").alias("t1"), (F.col("need") - F.col("before")).alias("need"))
    one = written(one, "mix-first")
    inside = keyed.join(one, keyed["source"].eqNullSafe(one["s1"]) & (keyed["cls"] == one["k1"]) & (keyed["d1"] == one["t1"]))
    second = inside.groupBy("source", "cls", "t1", "d2", "need").agg(F.sum("size").alias("mass"))
    two = _crossing(second, "d2").select("source", "cls", "t1", F.col("d2").alias("t2"), (F.col("need") - F.col("before")).alias("short"), F.col("mass").alias("next"))
    # At most 64 * PER_DOUBLING classes a source: from the largest, carry what is missing and add the next bin where that brings the sum nearer.
    listed = F.reverse(F.array_sort(F.collect_list(F.struct("cls", "t1", "t2", "short", "next"))))
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<boolean>").alias("more"))

    def carry(acc: Column, x: Column) -> Column:
        owed = acc["owed"] + x["short"]
        add = owed * 2 >= x["next"]
        return F.struct((owed - F.when(add, x["next"]).otherwise(0)).cast("double").alias("owed"), F.concat(acc["more"], F.array(add)).alias("more"))

    folded = two.groupBy("source").agg(listed.alias("list")).withColumn("more", F.aggregate("list", start, carry)["more"])
    cuts = folded.select(F.col("source").alias("s2"), F.explode(F.arrays_zip("list", "more")).alias("x"))
    cuts = cuts.select("s2", F.col("x.list.cls").alias("k2"), F.col("x.list.t1").alias("t1"), F.col("x.list.t2").alias("t2"), F.col("x.more").alias("more"))
    on = needs["source"].eqNullSafe(cuts["s2"]) & (needs["cls"] == cuts["k2"])
    return written(needs.join(cuts, on, "left").select("source", "cls", "source_size", "target", "lam", "x", "rate", "base", "t1", "t2", "more"), "mix-rules")


def with_copies(rows: DataFrame, rule: DataFrame) -> DataFrame:
    """``rows`` (source, size, u and others) with source_size, target and copies."""
    named = rule.select(F.col("source").alias("_s"), F.col("cls").alias("_k"), "source_size", "target", "base", "t1", "t2", "more")
    if named.count() <= SMALL:
        named = F.broadcast(named)
    x = _keyed(rows)
    x = x.join(named, x["source"].eqNullSafe(named["_s"]) & (x["cls"] == named["_k"]), "left")
    below = (F.col("d1") < F.col("t1")) | ((F.col("d1") == F.col("t1")) & ((F.col("d2") < F.col("t2")) | ((F.col("d2") == F.col("t2")) & F.col("more"))))
    copies = F.when(F.col("size") > 0, F.col("base") + F.coalesce(below.cast("long"), F.lit(0))).otherwise(F.lit(0))
    return x.withColumn("copies", copies.cast("long")).select(*rows.columns, "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document.

    Null and empty texts have size 0 and are never taken.  A null source is a
    source of its own, after the others.  Rows equal in doc_id and text hash
    alike: within a source they get equally many copies, so a source made of
    such rows meets its target only as far as that allows.  An empty table gives
    an empty table.  Reruns agree, as copies depend on hashes of rows only.
    """
    sized = written(docs.select(*_sized(docs)), "mix-sizes")
    return with_copies(sized, rules(sized, weights, cap)).withColumn("taken", F.col("copies") * F.col("size"))


def repeated(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    own = docs.columns
    sized = written(docs.select(*_sized(docs)), "mix-sizes")
    packed = docs.select(F.struct(*own).alias("row"), *_sized(docs))
    x = with_copies(packed, rules(sized, weights, cap)).filter("copies > 0")
    return x.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
