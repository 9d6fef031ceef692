"""Entities of texts, their index over chunks, and activation spread along it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.library import Library
from memspark.operators.listing import recallable

# What is trimmed off a token, which signs a name may have, and how many entities a text gives.
TRIM = r"""["'`,;.()\[\]{}?!<>*|=@#%\\]+"""
NAME = r"^[\p{L}\p{N}_:./-]+$"
MOST, LEAST_BYTES = 64, 2
#: Tokens with one of the signs that every kind but that of marked names needs: found in the text, so that prose makes no rows.
LIKELY = r"(?<!\S)(?=\S*?(?:[-_:/0-9]|\p{Ll}\p{Lu}))\S++"


def entities(df: DataFrame, key: str, *texts: str, placed: bool = False) -> DataFrame:
    """``key``, entity and etype: the distinct entities of each row's ``texts`` in order, at most MOST of them.

    Of each text those in backticks come first, for which any name will do, then
    all tokens.  An entity keeps the type of its first place.  Null texts give
    none; rows that repeat a key count as one.  Tokens that may be entities are rows
    before they are classed, and only entities are shuffled.  ``placed`` adds nth, their order.
    """
    each = lambda found, marked: F.transform(found, lambda t: F.struct(t.alias("t"), F.lit(marked).alias("marked")))
    parts = []
    for name in texts:
        text = F.coalesce(F.col(name), F.lit(""))
        spans = F.array_join(F.regexp_extract_all(text, F.lit("`([^`]*)`"), F.lit(1)), " ")
        parts += [each(F.split(spans, r"\s+"), True), each(F.regexp_extract_all(text, F.lit(LIKELY), F.lit(0)), False)]
    x = df.select(key, F.posexplode(F.concat(*parts)).alias("at", "x")).select(key, "at", F.regexp_replace("x.t", f"^{TRIM}|{TRIM}$", "").alias("t"), "x.marked")
    t, low = F.col("t"), F.lower("t")
    name, holds = t.rlike(NAME), lambda sign: F.contains(t, F.lit(sign))
    word = name & t.rlike(r"\p{L}")
    kind = (
        F.when(t.rlike(r"^--[\p{L}\p{N}_:./-]+$") & (F.octet_length(t) >= 4), "flag").when(F.octet_length(t) < LEAST_BYTES, None).when(t.rlike("^[A-Za-z]{1,4}[0-9]{3,}$"), "error")
        .when(name & (holds("::") | (holds("/") & holds("."))), "path")
        .when(word & t.rlike("[_-]"), "symbol").when(t.rlike(r"^[\p{L}\p{N}]+$") & t.rlike(r"\p{Ll}\p{Lu}"), "symbol").when(F.col("marked") & word, "symbol")
    )
    entity = F.when((F.col("etype") == "path") & ~holds("::"), F.regexp_replace(low, "/+$", "")).otherwise(low)
    found = x.withColumn("etype", kind).filter("etype IS NOT NULL").withColumn("entity", entity).filter(F.octet_length("entity") >= LEAST_BYTES)
    once = found.groupBy(key, "entity").agg(F.min(F.struct("at", "etype")).alias("first"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("first.at"))
    x = once.withColumn("nth", nth).filter(F.col("nth") <= MOST)
    return x.select(key, "entity", "first.etype", "nth") if placed else x.select(key, "entity", "first.etype")


def entity_index(lib: Library) -> DataFrame:
    """chunk_id, entity and etype: the entities of each chunk's content and trigger."""
    return entities(lib.code, "id", "content", "trigger_desc").withColumnRenamed("id", "chunk_id")


def spread(lib: Library, candidates: DataFrame) -> DataFrame:
    """query_id, chunk_id and spread: activation that a query's entities and its best candidates pass on along shared entities.

    A query's own entities weigh 1, those of its spread_seeds best ``candidates``
    (query_id, chunk_id, c, t, l) their best similarity.  An entity passes its weight in equal shares to the
    chunks that have it; one with over spread_fan chunks passes nothing.  Shares
    are summed and divided by the query's largest sum.  Only chunks valid for
    recall are returned.
    """
    p = lib.params
    index = entity_index(lib)
    order = Window.partitionBy("query_id").orderBy(F.desc("base"), "chunk_id")
    seeds = candidates.withColumn("base", F.greatest("c", "t", "l")).filter("base > 0").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= p.spread_seeds)
    own = entities(lib.queries, "query_id", "query").select("query_id", "entity", F.lit(1.0).alias("a"))
    lent = seeds.join(index, "chunk_id").select("query_id", "entity", F.col("base").alias("a"))
    source = own.unionByName(lent).groupBy("query_id", "entity").agg(F.sum("a").alias("a"))
    links = index.join(lib.chunks.filter("state <> 'archived' AND origin <> 'spark'").select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    # Fans are counted first, so that what is joined has at most spread_fan rows an entity.
    fans = links.groupBy("entity").agg(F.count(F.lit(1)).alias("fan")).filter(F.col("fan") <= p.spread_fan)
    raw = source.join(fans, "entity").join(links, "entity").groupBy("query_id", "chunk_id").agg(F.sum(F.col("a") / F.col("fan")).alias("raw"))
    x = raw.withColumn("spread", F.round(F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")), 6))
    ok = recallable(lib.chunks, p.embed_version).select(F.col("id").alias("chunk_id"))
    return x.join(ok, "chunk_id", "left_semi").select("query_id", "chunk_id", "spread")
