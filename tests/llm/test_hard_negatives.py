"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import hard_negatives
from memspark.llm.hard_negatives import Index, _coded, codebook, mined

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, positives=5, negatives=10):
    held = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = ([math.floor(256 * float(np.float32(x))) for x in v], label)
        padded = lambda k: (k[0] + [0] * (8 - len(k[0])), k[1])
        held[i] = min(held.get(i, padded(key)), padded(key))
    out = []
    for a, (q, label) in held.items():
        if a % 10:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, (v, other) in held.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(-t, i) for t, i, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in mined(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0).collect())


def random_rows(n, seed, width=8):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(width)], r.randrange(3), "x", "y") for i in range(n)]
    same = [r.gauss(0, 1) for _ in range(width)]
    # A hot vector with both labels, ties, and rows that take no part.
    rows += [(n + i, same, i % 2, None, None) for i in range(n // 3)]
    rows += [(5000, None, 1, "", ""), (5010, [1.0, None], 1, "", ""), (5020, [float("nan")] * width, 1, "", ""), (5030, [float("inf")] * width, 2, "", "")]
    rows += [(5040, [0.5] * width, None, "", ""), (None, [0.5] * width, 1, "", ""), (5050, [], 1, "", ""), (5060, [0.5, -0.25, 1.5], 2, "", "")]
    return [*rows, *rows[:7], (0, [9.0] * width, 0, "", ""), (10, rows[10][1], -5, "", "")]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 20)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 100)
    rows = random_rows(300, 1)
    assert found(spark, rows) == brute(rows)


def test_small_and_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1, None, None)]) == []
    two = [(0, [1.0, 1.0], 1, None, None), (1, [1.0, 1.0], 1, None, None), (2, [0.5, 0.5], 2, None, None), (3, [0.95, 0.95], 2, None, None)]
    assert found(spark, two) == brute(two) == [(0, 1, 1, 2, 131072, 65536)]


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_walk_gives_every_row_once_in_certified_order(spread):
    r = np.random.default_rng(3)
    import pyarrow as pa

    centres = r.normal(0, 200, (12, 6))
    points = np.floor(centres[r.integers(0, 12, 400)] + r.normal(0, 200 * spread, (400, 6))).astype(np.int64)
    books = codebook(points[:, :3]), codebook(points[:, 3:])
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(400), pa.int64()), "label": pa.array([0] * 400, pa.int64()), "vec": pa.array(points.tolist(), pa.list_(pa.int64()))})
    index = Index(pa.Table.from_batches(list(_coded(books)([batch]))), books)
    for q in points[:20]:
        seen, bound = np.empty(0, np.int64), math.inf
        for at, rest in index.walk(q):
            assert rest <= bound and (index.scores(q, at) <= bound).all()
            seen, bound = np.concatenate([seen, at]), rest
            left = np.setdiff1d(np.arange(400), seen)
            assert (index.scores(q, left) <= rest).all()
        assert sorted(seen.tolist()) == list(range(400))


def test_tight_cells_end_the_walk_early():
    import pyarrow as pa

    r = np.random.default_rng(4)
    centres = r.normal(0, 300, (16, 8))
    points = np.floor(centres[np.arange(8000) % 16] + r.normal(0, 3, (8000, 8))).astype(np.int64)
    books = codebook(points[:500, :4]), codebook(points[:500, 4:])
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(8000), pa.int64()), "label": pa.array([0] * 8000, pa.int64()), "vec": pa.array(points.tolist(), pa.list_(pa.int64()))})
    index = Index(pa.Table.from_batches(list(_coded(books)([batch]))), books)
    scored, real = [], index.scores
    index.scores = lambda q, at: scored.append(len(at)) or real(q, at)
    ids, scores = index.positives(0, 0, points[0], 5)
    assert sum(scored) < 2500
    every = real(points[0], np.arange(8000))
    best = sorted(zip(-every, index.ids, strict=True))
    assert [(int(s), int(i)) for s, i in zip(scores, ids, strict=True)] == [(-int(s), int(i)) for s, i in best if i != 0][:5]


def test_scores_beyond_64_bits_fail():
    import pyarrow as pa

    books = np.zeros((1, 1)), np.zeros((1, 1))
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1], pa.int64()), "label": pa.array([0], pa.int64()), "vec": pa.array([[2**40, 1]], pa.list_(pa.int64()))})
    index = Index(pa.Table.from_batches(list(_coded(books)([batch]))), books)
    with pytest.raises(OverflowError):
        index.scores(np.array([2**40, 1]), np.array([0]))
    assert index.scores(np.array([2**20, 1]), np.array([0])).tolist() == [2**60 + 1]
