"""Hard negatives by an inverted multi-index over the two halves of a vector.

Each half-space has a codebook of its own; a row's pair of nearest codewords is
its cell.  The index is dealt over shards.  For an anchor, a half's codewords get
an upper bound of what the half can add to a score: inner product with the
codeword, plus the codeword's radius (largest distance of a row to it) times the
length of the anchor's half.  A heap walks the cells in falling order of the sum
of their two bounds (multi-sequence), rows of a cell are scored exactly, and the
walk ends when the next sum is below all that is still asked for: the best rows
so far are then certified.

The first walk finds an anchor's positives, the second the best rows of other
labels in the score window of each positive.  Codebooks are only a guide: they
decide how soon a walk ends, never what it finds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import written
from memspark.llm.topk import quantised, usable

#: Codewords of a half; rows that codebooks are fitted on at most; rounds of fitting.
WORDS, SAMPLE, FITTING = 16, 4096, 12
#: Anchors of a block, rows of a shard, shards that small tables are spread over and the least rows of such a shard.
ANCHOR_BLOCK, SHARD_ROWS, SPREAD, LEAST_ROWS = 2048, 16384, 16, 512
#: Rows scored at once at first; twice as many each further time.
FIRST_ROWS = 512
#: What float rounding may add to a bound, relative to it.
SLACK = 1e-9

FOUND = "anchor_id long, id long, score long"
MINED = "anchor_id long, positive_id long, positive_score long, id long, score long"


def codebook(points: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Codewords of ``points``: the farthest point first, then means of the nearest points, always the same."""
    points = np.unique(points.astype(np.float64), axis=0)
    if not len(points):
        return np.zeros((1, points.shape[1]))
    chosen = [points[0]]
    apart = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < min(words, len(points)):
        chosen.append(points[int(apart.argmax())])
        apart = np.minimum(apart, ((points - chosen[-1]) ** 2).sum(1))
    book = np.array(chosen)
    for _ in range(FITTING):
        near = nearest(points, book)
        count = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, points)
        book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
    return book


def nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1)[None, :] - 2 * points @ book.T).argmin(1)


def _arrays(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions kept, ids ascending, labels and vectors padded to ``width``; of a repeated id the least vector, then label, stays."""
    ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    lists = rows.column("vec").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = np.zeros((len(ids), width), np.int64)
    vectors[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (np.diff(ids[order]) == 0).any():
        order = np.lexsort([labels, *vectors.T[::-1], ids])
    first = np.ones(len(ids), bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    order = order[first]
    return order, ids[order], labels[order], vectors[order]


class Index:
    """Rows of a shard, those of a cell together."""

    def __init__(self, rows: pa.Table, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.half = books, books[0].shape[1]
        kept, ids, labels, vectors = _arrays(rows, self.half + books[1].shape[1])
        codes = [rows.column(c).to_numpy()[kept].astype(np.int64) for c in ("c1", "c2")]
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, cell = ids[order], labels[order], cell[order]
        self.exact = vectors[order]
        self.most = int(np.abs(self.exact).max(initial=0))
        self.near = self.exact.astype(np.float64)
        bounds = np.searchsorted(cell, np.arange(len(books[0]) * len(books[1]) + 1))
        self.starts, self.ends = bounds[:-1], bounds[1:]
        self.radii = []
        for book, code, part in zip(books, (c[order] for c in codes), (self.near[:, : self.half], self.near[:, self.half :]), strict=True):
            radius = np.zeros(len(book))
            np.maximum.at(radius, code, np.sqrt(((part - book[code]) ** 2).sum(1)))
            self.radii.append(radius)

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products with the rows at these places."""
        reach = self.most * int(np.abs(q).max(initial=0)) * max(len(q), 1)
        if reach >= 2**63:
            raise OverflowError(f"scores may reach {reach}, beyond 64 bits")
        if reach < 2**53:
            return (self.near[at] @ q.astype(np.float64)).astype(np.int64)
        return (self.exact[at] * q[None, :]).sum(1)

    def walk(self, q: np.ndarray, most: int | None = None) -> Iterator[tuple[np.ndarray, float]]:
        """Places of rows in falling order of their cells' bounds, and the bound of all rows not yet given.

        Cells whose rows all score over ``most`` are passed over.
        """
        high, low, orders = [], [], []
        for book, radius, part in zip(self.books, self.radii, (q[: self.half], q[self.half :]), strict=True):
            part = part.astype(np.float64)
            middle, reach = book @ part, radius * np.sqrt(part @ part)
            room = SLACK * (np.abs(book) @ np.abs(part) + reach) + 1e-6
            order = np.argsort(-(middle + reach + room), kind="stable")
            orders.append(order)
            high.append((middle + reach + room)[order].tolist())
            low.append((middle - reach - room)[order].tolist())
        rows, columns = (x.tolist() for x in orders)
        (high_a, high_b), (low_a, low_b), across = high, low, len(columns)
        starts, ends = self.starts, self.ends
        heap = [(-(high_a[0] + high_b[0]), 0, 0)]
        batch: list[np.ndarray] = []
        held, wanted = 0, FIRST_ROWS
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < across:
                heapq.heappush(heap, (-(high_a[i] + high_b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(rows):
                heapq.heappush(heap, (-(high_a[i + 1] + high_b[0]), i + 1, 0))
            cell = rows[i] * across + columns[j]
            start, end = starts[cell], ends[cell]
            if end > start and (most is None or low_a[i] + low_b[j] <= most):
                batch.append(np.arange(start, end))
                held += end - start
            if held >= wanted or not heap:
                yield (np.concatenate(batch) if batch else np.empty(0, np.int64)), (-heap[0][0] if heap else -math.inf)
                batch, held, wanted = [], 0, 2 * wanted

    def positives(self, anchor: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best other rows of the label."""
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for at, rest in self.walk(q):
            at = at[(self.labels[at] == label) & (self.ids[at] != anchor)]
            ids, scores = _best(np.concatenate([ids, self.ids[at]]), np.concatenate([scores, self.scores(q, at)]), k)
            if len(ids) == k and rest < scores[-1]:
                break
        return ids, scores

    def negatives(self, anchor: int, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least and largest score) the ``k`` best rows of other labels in it."""
        none = np.empty(0, np.int64)
        found = [(none, none) for _ in windows]
        for at, rest in self.walk(q, max(high for _, high in windows)):
            at = at[(self.labels[at] != label) & (self.ids[at] != anchor)]
            scores = self.scores(q, at)
            open_ = False
            for w, (low, high) in enumerate(windows):
                ok = (scores >= low) & (scores <= high)
                if ok.any():
                    found[w] = _best(np.concatenate([found[w][0], self.ids[at[ok]]]), np.concatenate([found[w][1], scores[ok]]), k)
                open_ |= rest >= (max(low, found[w][1][-1]) if len(found[w][0]) == k else low)
            if not open_:
                break
        return found


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _table(columns: list[list], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for n, c in zip(names, columns, strict=True)})


def _first_walk(books: tuple[np.ndarray, np.ndarray], k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        index, out = Index(rows, books), [[], [], []]
        _, ids, labels, vectors = _arrays(anchors, books[0].shape[1] + books[1].shape[1])
        for anchor, label, q in zip(ids.tolist(), labels.tolist(), vectors, strict=True):
            found, scores = index.positives(anchor, label, q, k) if len(index.ids) else ([], [])
            for held, x in zip(out, (np.full(len(found), anchor, np.int64), found, scores), strict=True):
                held.append(np.asarray(x, np.int64))
        return _table(out, ["anchor_id", "id", "score"])

    return run


def _second_walk(books: tuple[np.ndarray, np.ndarray], k: int, least: int, largest: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        index, out = Index(rows, books), [[], [], [], [], []]
        kept, ids, labels, vectors = _arrays(anchors, books[0].shape[1] + books[1].shape[1])
        pairs = anchors.column("positives").take(pa.array(kept)).to_pylist()
        for anchor, label, q, own in zip(ids.tolist(), labels.tolist(), vectors, pairs, strict=True):
            # 100 * score is between least and largest times the positive's score.
            window = {p: (-((-least * p) // 100), (largest * p) // 100) for p in {x["score"] for x in own}}
            window = {p: w for p, w in window.items() if w[0] <= w[1]}
            if not window or not len(index.ids):
                continue
            found = dict(zip(window, index.negatives(anchor, label, q, list(window.values()), k), strict=True))
            for x in own:
                if x["score"] not in found:
                    continue
                negatives, scores = found[x["score"]]
                same = lambda v, n=len(negatives): np.full(n, v, np.int64)
                for held, values in zip(out, (same(anchor), same(x["id"]), same(x["score"]), negatives, scores), strict=True):
                    held.append(values)
        return _table(out, ["anchor_id", "positive_id", "positive_score", "id", "score"])

    return run


def _coded(books: tuple[np.ndarray, np.ndarray]):
    half, width = books[0].shape[1], books[0].shape[1] + books[1].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("vec"))
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            points = np.zeros((len(lists), width))
            points[np.arange(width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
            codes = [pa.array(nearest(part, book).astype(np.int32)) for part, book in zip((points[:, :half], points[:, half:]), books, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *codes], [*batch.schema.names, "c1", "c2"])

    return run


def _padded(values: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for row, x in zip(out, values, strict=True):
        row[: len(x)] = x
    return out


def mined(rows: DataFrame, id_col: str, vector_col: str, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, largest: int = 90) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its ``positives`` best other rows of its label;
    a positive's negatives are the ``negatives`` best rows of another label whose
    score is from ``least`` to ``largest`` percent of the positive's score.
    Scores are inner products of floor(256 * component); ties go to the smaller id.

    Rows whose id or label is null, or whose vector is null or holds null or
    non-finite components, take no part.  Rows that repeat an id count once, with
    the least vector, then label.  Vectors of unequal length are padded with zeros.
    A positive with a score below 0 has an empty window.  An empty table gives no
    rows; other columns are ignored.  Where scores could pass 64 bits the job fails.

    Codebooks are fitted on at most SAMPLE rows, those of least hash; all rows are
    indexed and the result does not depend on the sample.
    """
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), label.cast("long").alias("label"), is_anchor.alias("asks"))
    held = held.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("raw"))).select("id", "label", "asks", quantised(F.col("raw")).alias("vec"))
    held = written(held, "vectors")
    n, asking, width = held.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max(F.size("vec"))).first()
    width = max(2, width or 2)
    half = width // 2
    sample = [x["vec"] for x in held.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).select("vec").collect()]
    points = _padded(sample, width)
    books = codebook(points[:, :half]), codebook(points[:, half:])
    shards = max(1, math.ceil(n / SHARD_ROWS), min(SPREAD, math.ceil(n / LEAST_ROWS)))
    blocks = max(1, math.ceil(asking / ANCHOR_BLOCK))
    deal = F.xxhash64("id")
    series = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = held.select("id", "label", "vec").mapInArrow(_coded(books), "id long, label long, vec array<long>, c1 int, c2 int")
    index = written(index.withColumn("shard", F.pmod(deal, F.lit(shards)).cast("int")), "index")
    dealt = index.withColumn("block", series(blocks)).groupBy("block", "shard")
    anchors = held.filter("asks").select("id", "label", "vec", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"))
    every = lambda x: x.withColumn("shard", series(shards)).groupBy("block", "shard")
    near = every(anchors).cogroup(dealt).applyInArrow(_first_walk(books, positives), FOUND)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
    own = near.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    own = written(own, "positives")
    asked = anchors.join(own, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    far = every(asked).cogroup(dealt).applyInArrow(_second_walk(books, negatives, least, largest), MINED)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
