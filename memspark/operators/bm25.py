"""BM25 chunk by chunk: each task scores whole chunks against all queries and keeps what may be among the best (R2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.tables import stored

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Rows whose words are counted at once; products of words and queries, and scores, of a block; hits a task holds before it prunes them.
COUNTED, PRODUCTS, SCORES, HELD = 1024, 1 << 22, 1 << 22, 1 << 20
#: Share of a query's largest possible score within which two scores may come to one rounded share.
CLOSE = 2e-6


def counted(chunks: DataFrame, vocabulary: list[str]) -> DataFrame:
    """id, times, size, codes and counts of each id: how often it may be shown, words in all, which of ``vocabulary`` it has and how often.

    ``chunks`` has id, ok and words.  Rows that repeat an id count as one chunk,
    shown once for each of them that is ok; a null id is shown never.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED):
                part = batch.slice(at, COUNTED)
                listed = part.column(2)
                sizes, flat = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), listed.flatten()
                known = pa.array(vocabulary, flat.type) if known is None else known
                code = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
                both, times = np.unique(row * len(vocabulary) + code[code >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(both // len(vocabulary), np.arange(len(sizes) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (both % len(vocabulary), times)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), *lists], names=["id", "ok", "size", "codes", "counts"])

    shown = F.when(F.col("ok") & F.col("id").isNotNull(), 1).otherwise(0).cast("long")
    x = chunks.select("id", "ok", "words").mapInArrow(count, "id string, ok boolean, size long, codes array<int>, counts array<int>")
    x = stored(x.select("id", shown.alias("times"), "size", "codes", "counts"), "counted")
    again = stored(x.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "again")
    if again.isEmpty():
        return x
    same = x["id"].eqNullSafe(again["id"])
    many = x.join(again, same, "left_semi")
    whole = many.groupBy("id").agg(F.sum("times").alias("times"), F.sum("size").alias("size")).withColumnRenamed("id", "own")
    word = many.select("id", F.explode(F.arrays_zip("codes", "counts")).alias("e")).groupBy("id", F.col("e.codes").alias("code")).agg(F.sum("e.counts").cast("int").alias("n"))
    listed = word.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("e"))
    none = F.array().cast("array<int>")
    merged = whole.join(listed, F.col("own").eqNullSafe(F.col("id")), "left").select(F.col("own").alias("id"), "times", "size", F.coalesce("e.code", none).alias("codes"), F.coalesce("e.n", none).alias("counts"))
    return stored(x.join(again, same, "left_anti").unionByName(merged), "merged")


def _blocks(work: np.ndarray, most_rows: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows whose ``work`` sums to PRODUCTS at most, or single rows."""
    done, at = np.append(0, np.cumsum(work)), 0
    while at < len(work):
        end = min(max(at + 1, int(np.searchsorted(done, done[at] + PRODUCTS, "right")) - 1), at + most_rows, len(work))
        yield at, end
        at = end


def _undercut(rank: np.ndarray, k: int) -> np.ndarray:
    """Of ids by rank, in order of their scores, which may be among the best ``k``: all but those with k smaller ones before them (and a few more)."""
    keep, at = np.ones(len(rank), bool), k
    least = rank[:k]
    while at < len(rank):
        end = min(len(rank), 2 * at)
        keep[at:end] = rank[at:end] < least.max()
        least = np.partition(np.append(least, rank[at:end][keep[at:end]]), k - 1)[:k]
        at = end
    return keep


def pruned(hits: pa.Table, close: np.ndarray, k: int) -> tuple[pa.Table, np.ndarray]:
    """Of ``hits`` (query, id, s) those that may be among a query's best ``k`` by rounded share and id, and each query's bound.

    Scores below the k-th by more than ``close`` never are, nor is one that no
    share of the top can lift over k hits of as good a score and a smaller id.
    """
    hits = hits.take(pc.sort_indices(hits, [("query", "ascending"), ("s", "descending"), ("id", "ascending")]))
    query, s = hits.column("query").to_numpy(), hits.column("s").to_numpy()
    first = np.searchsorted(query, np.arange(len(close) + 1))
    many = np.flatnonzero(np.diff(first) >= k)
    bound = np.zeros(len(close))
    bound[many] = s[first[many] + k - 1] - close[many]
    keep = s >= bound[query]
    rank = pc.rank(hits.column("id"), tiebreaker="dense").to_numpy()
    for q in many[np.diff(first)[many] > k]:
        keep[first[q] : first[q + 1]] &= _undercut(rank[first[q] : first[q + 1]], k)
    return hits.filter(pa.array(keep)), bound


def scored_best(rows: DataFrame, queries: pa.Array, query: np.ndarray, code: np.ndarray, idf: np.ndarray, mean: float, most_times: int, k: int, kind: str) -> DataFrame:
    """query_id, chunk_id and s of what may be among the ``k`` best chunks of each query, the best among them.

    ``query`` and ``code`` (in order of code) say which of ``queries`` has which
    word.  A task sums the words of a chunk in order of their codes and holds a
    bounded number of hits of each query.
    """
    n_queries = len(queries)
    first = np.searchsorted(code, np.arange(len(idf) + 1))
    close = CLOSE * most_times * (K1 + 1) * np.bincount(query, weights=idf[code], minlength=n_queries)
    schema = pa.schema([("query", pa.int64()), ("id", pa.string()), ("s", pa.float64())])

    def hits(part: pa.RecordBatch, bound: np.ndarray) -> Iterator[pa.Table]:
        sizes = part.column("codes").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        word, tf = part.column("codes").flatten().to_numpy(), part.column("counts").flatten().to_numpy().astype(np.float64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        size, times = part.column("size").to_numpy().astype(np.float64), part.column("times").to_numpy()
        weight = idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / mean))
        meets = first[word + 1] - first[word]
        starts = np.append(0, np.cumsum(sizes))
        for at, end in _blocks(np.bincount(row, weights=meets, minlength=len(sizes)).astype(np.int64), max(1, SCORES // n_queries)):
            a, b = starts[at], starts[end]
            n, width = meets[a:b], end - at
            own = np.repeat(np.arange(a, b), n)
            asking = query[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + first[word[own]]]
            s = np.bincount(asking * width + row[own] - at, weights=weight[own], minlength=n_queries * width).reshape(n_queries, width) * times[at:end]
            if width > k:
                np.maximum(bound, np.partition(s, width - k, axis=1)[:, width - k] - close, out=bound)
            q, r = np.nonzero((s > 0) & (s >= bound[:, None]))
            yield pa.table([pa.array(q), part.column("id").take(pa.array(at + r)).cast(pa.string()), pa.array(s[q, r])], schema=schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bound = [schema.empty_table()], 0, np.zeros(n_queries)
        for batch in batches:
            for one in hits(batch, bound):
                held.append(one)
                size += len(one)
                if size > HELD:
                    kept, least = pruned(pa.concat_tables(held), close, k)
                    np.maximum(bound, least, out=bound)
                    held, size = [kept], 0
        kept, _ = pruned(pa.concat_tables(held), close, k)
        out = pa.table({"query_id": pa.chunked_array([queries]).take(kept.column("query")), "chunk_id": kept.column("id"), "s": kept.column("s")})
        yield from out.to_batches()

    return rows.filter("times > 0 AND size(codes) > 0").mapInArrow(best, f"query_id {kind}, chunk_id string, s double")


def best_hits(chunks: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id and s (BM25) of what may be among the ``k`` best chunks of each query, the best among them; written once.

    ``chunks`` has id, ok and words (statistics are over all, hits over those
    that are ok), ``words`` has query_id and token.  A chunk's words are counted
    once; words that no query has are dropped there, and hits never leave the
    task unless they may be among the best.
    """
    kind = words.schema["query_id"].dataType.simpleString()
    held = words.toArrow().sort_by("token")
    token = held.column("token").combine_chunks().dictionary_encode() if held.num_rows else pa.array([], pa.string()).dictionary_encode()
    vocabulary = token.dictionary.to_pylist()
    if not vocabulary:
        return words.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("double").alias("s")).filter("false")
    named = held.column("query_id").combine_chunks().dictionary_encode("encode")
    order = np.lexsort((named.indices.to_numpy(), token.indices.to_numpy()))
    query, code = named.indices.to_numpy()[order].astype(np.int64), token.indices.to_numpy()[order].astype(np.int64)
    rows = counted(chunks, vocabulary)
    docs, mean, most_times = rows.filter("size > 0").agg(F.count(F.lit(1)), F.avg("size"), F.max("times")).first()
    known = rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    value = F.greatest(F.lit(IDF_FLOOR), F.log((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    found = known.select("code", value.alias("idf")).toArrow()
    idf = np.full(len(vocabulary), IDF_FLOOR)
    idf[found.column("code").to_numpy()] = found.column("idf").to_numpy()
    return stored(scored_best(rows, named.dictionary, query, code, idf, mean or 1.0, most_times or 1, k, kind), "lexical")
