"""Components, cycles and links of vectors against plain Python."""

import random

import numpy as np
import pytest

from memspark.operators import vector_links
from memspark.operators.graph import components, strong_groups
from memspark.operators.vector_links import cosine, links, normalized


def groups_of(edges):
    """Component of each node by merging."""
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    return sorted((x, find(x)) for x in root)


def cycles_of(edges):
    """Least node of each node's group of mutual reach, for nodes on a cycle."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for start in out:
        seen, todo = set(), [start]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        reach[start] = seen
    return sorted((x, min(y for y in reach[x] if x in reach.get(y, ()))) for x in reach if x in reach[x])


def edges_df(spark, edges):
    return spark.createDataFrame(edges, "a string, b string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_long_chains_and_rings(spark):
    name = lambda kind, i: f"{kind}{i:05d}"
    chain = [(name("c", i), name("c", i + 1)) for i in range(1000)]
    ring = [(name("r", i), name("r", (i + 1) % 500)) for i in range(500)]
    tail = [(name("r", 7), name("t", 0)), (name("t", 0), name("t", 1))]
    assert rows(strong_groups(edges_df(spark, chain + ring + tail))) == sorted((name("r", i), name("r", 0)) for i in range(500))
    assert rows(components(edges_df(spark, chain + ring))) == sorted([(name("c", i), name("c", 0)) for i in range(1001)] + [(name("r", i), name("r", 0)) for i in range(500)])


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(40):02d}", f"n{r.randrange(40):02d}") for _ in range(45)] + [("x", "y"), ("y", "x"), ("y", "z"), ("z", "z"), ("p", "q"), ("q", "r"), ("r", "p"), ("r", "s"), ("s", "t"), ("t", "s"), (None, "x"), ("x", None)]
    known = [e for e in edges if None not in e]
    assert rows(strong_groups(edges_df(spark, edges))) == cycles_of(known)
    assert rows(components(edges_df(spark, edges))) == groups_of(known)


def test_no_edges(spark):
    assert rows(components(edges_df(spark, []))) == rows(strong_groups(edges_df(spark, []))) == []


VECTORS = "id string, session string, vec array<float>"


def linked_groups(rows_, least):
    out = []
    for i, s, v in rows_:
        for j, t, w in rows_:
            if i < j and s is not None and t is not None and s != t and v and w and len(v) == len(w) and None not in [*v, *w]:
                a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                norm = np.linalg.norm(a) * np.linalg.norm(b)
                if np.isfinite([*a, *b]).all() and norm > 0 and round(float(a @ b / norm), 6) >= least:
                    out.append((i, j))
    return groups_of(out)


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "CELL", 30)
    r = np.random.default_rng(1)
    centres = r.normal(size=(25, 6))
    rows_ = [(f"e{i:03d}", f"s{i % 9}", (centres[i % 25] + r.normal(size=6) * 0.45).tolist()) for i in range(150)]
    rows_ += [(f"h{i}", f"s{i % 2}", [1.0, 0, 0, 0, 0, 0]) for i in range(12)] + [(f"k{i}", "s1", [0.0, 0, 0, 0, 0, -2.0]) for i in range(5)]
    rows_ += [("short", "s1", [1.0, 0.0]), ("short2", "s2", [2.0, 0.0]), ("null", "s1", None), ("empty", "s2", []), ("zero", "s3", [0.0] * 6), ("nan", "s3", [float("nan")] * 6), ("part", "s3", [1.0, None, 0, 0, 0, 0]), ("lost", None, [1.0, 0, 0, 0, 0, 0])]
    rows_ = [(i, t, v and [None if x is None else float(x) for x in v]) for i, t, v in rows_]
    found = [tuple(x) for x in links(spark.createDataFrame(rows_, VECTORS), 0.82).collect()]
    assert groups_of(found) == linked_groups(rows_, 0.82)
    assert len(found) < 3 * len(rows_)
    assert links(spark.createDataFrame([], VECTORS), 0.82).collect() == []


def test_equal_vectors_stand_as_one_point(spark, monkeypatch):
    counts, within = [], vector_links._within
    monkeypatch.setattr(vector_links, "_within", lambda points, *rest: counts.append(points.count()) or within(points, *rest))
    # Twice a vector is the same direction; the third is near the second, in the session of its rows alone.
    rows_ = [(f"e{i:02d}", f"s{i % 3}", [1.0 + i % 2, 0.0, 0.0]) for i in range(30)] + [(f"f{i}", "s9", [0.0, 1.0, 0.0]) for i in range(6)] + [("g", "s9", [0.0, 1.0, 0.1]), ("h", "s8", [0.0, 1.0, -0.5])]
    found = [tuple(x) for x in links(spark.createDataFrame(rows_, VECTORS), 0.82).collect()]
    assert groups_of(found) == linked_groups(rows_, 0.82)
    assert counts == [4]


def test_reference_cases(spark):
    near = [("a", "s1", [1.0, 0.0, 0.0]), ("b", "s2", [0.95, 0.05, 0.0]), ("c", "s2", [0.0, 1.0, 0.0])]
    assert groups_of([tuple(x) for x in links(spark.createDataFrame(near, VECTORS), 0.82).collect()]) == [("a", "a"), ("b", "a")]
    same_session = [("a", "s1", [1.0, 0.0]), ("b", "s1", [1.0, 0.0])]
    assert links(spark.createDataFrame(same_session, VECTORS), 0.82).collect() == []


def test_cosine_and_length(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(x[0], 6) for x in df.select(cosine(df.a, df.b)).collect()] == [0.96, 0.0, 0.0]
    assert [x[0] for x in df.select(normalized(df.a)).collect()] == [[0.6, 0.8], [0.0, 0.0], [1.0]]
