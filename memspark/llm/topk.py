"""Exact top-k search by inner product, exhaustive and term at a time.

Queries and candidates are dealt into a grid of cells (query block x candidate
block).  In a cell every nonzero query weight scatters ``weight * posting`` into
a dense score array, one term (vector component) after the other; a partition
selection keeps the best ``k`` of the cell and a window merges the cells.

Blocks have bounded sizes, so a cell's memory does not grow with the tables and
more rows only mean more cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one query block and of one candidate block.
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 16384
#: Candidate blocks that small tables are spread over, and the least rows of such a block.
SPREAD, LEAST_ROWS = 64, 64
#: Queries scored at once inside a cell.
LANES = 64


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    return vector.isNotNull() & finite


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending, and their vectors padded with zeros to one width.

    Of rows that repeat an id the lexicographically smallest vector stays.
    """
    ids = rows.column("id").to_numpy()
    lists = rows.column("vec").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max()) if len(lengths) else 0
    vectors = np.zeros((len(ids), width), np.int64)
    vectors[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    keys = [vectors[:, t] for t in range(width - 1, -1, -1)]
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (np.diff(ids[order]) == 0).any():
        order = np.lexsort([*keys, ids])
    ids, vectors = ids[order], vectors[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], vectors[first]


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates), scattered one term after the other."""
    width = min(queries.shape[1], candidates.shape[1])
    most = lambda x: int(np.abs(x.astype(float)).max(initial=0))
    reach = most(queries) * most(candidates) * max(width, 1)
    if reach >= 2**63:
        raise OverflowError(f"scores may reach {reach}, beyond 64 bits")
    kind = np.int32 if reach < 2**31 else np.int64
    queries, postings = queries.astype(kind), np.ascontiguousarray(candidates.T.astype(kind))
    # A row for each candidate, so that a posting scatters to all queries of the term in one stretch.
    scores = np.zeros((candidates.shape[0], len(queries)), kind)
    for term in range(width):
        weights, holders = queries[:, term], np.flatnonzero(postings[term])
        if weights.any():
            scores[holders] += np.multiply.outer(postings[term, holders], weights)
    return np.ascontiguousarray(scores.T)


def _cell(k: int):
    def best(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        qid, q = _matrix(queries)
        cid, c = _matrix(candidates)
        out: list[tuple[np.ndarray, ...]] = []
        keep = min(k + 1, len(cid))
        for at in range(0, len(qid), LANES) if keep else ():
            scores = accumulate(q[at : at + LANES], c)
            for own, row in zip(qid[at : at + LANES], scores, strict=True):
                floor = np.partition(row, len(row) - keep)[len(row) - keep]
                found = np.flatnonzero(row >= floor)
                found = found[cid[found] != own]
                found = found[np.lexsort((cid[found], -row[found].astype(np.int64)))][:k]
                out.append((np.full(len(found), own), cid[found], row[found].astype(np.int64)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "id", "score"), columns, strict=True)})

    return best


def top_k(rows: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int) -> DataFrame:
    """Best ``k`` other rows of each query row: query_id, rank, id, score.

    Rows whose id is null or whose vector is null, or holds null or non-finite
    components, take no part.  Rows that repeat an id count once, with the
    smallest vector.  Vectors of unequal length are padded with zeros; an empty
    vector scores 0 with all.  Ties go to the smaller id.  An empty table gives
    no rows.  Other columns of ``rows`` are ignored.  Where scores could pass 64
    bits the job fails rather than wrap around (at 64 components, beyond 10^6).

    Exhaustive search compares every query with every candidate; candidates are
    sent once for each QUERY_BLOCK queries, queries once for each block of
    candidates.
    """
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), is_query.alias("asks"))
    held = held.filter(F.col("id").isNotNull() & usable(F.col("raw"))).select("id", quantised(F.col("raw")).alias("vec"), "asks")
    n, n_asks = held.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    down = max(1, math.ceil(n_asks / QUERY_BLOCK))
    across = max(1, math.ceil(n / CANDIDATE_BLOCK), min(SPREAD, math.ceil(n / LEAST_ROWS)))
    deal = F.xxhash64("id")
    series = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = held.filter("asks").select("id", "vec", F.pmod(deal, F.lit(down)).cast("int").alias("qb"), series(across).alias("cb"))
    given = held.select("id", "vec", F.pmod(deal, F.lit(across)).cast("int").alias("cb"), series(down).alias("qb"))
    cells = asked.groupBy("qb", "cb").cogroup(given.groupBy("qb", "cb"))
    partial = cells.applyInArrow(_cell(k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
