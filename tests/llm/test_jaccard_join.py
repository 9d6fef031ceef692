"""The Jaccard join against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import jaccard_join
from memspark.llm.jaccard_join import Sets, clustered, joined


def shingles_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=80):
    """(doc_id, n_shingles, component_id) by all pairs; rows of one id are one node."""
    held = [(i, shingles_of(t)) for i, t in rows]
    root = {i: i for i, _ in held if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in held:
        for j, b in held:
            if i is not None and j is not None and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((str(i), len(s), str(None if i is None else find(i) if s else i)) for i, s in held)


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def altered(r, text, times):
    words = text.split()
    for _ in range(times):
        i = r.randrange(len(words))
        words[i : i + 1] = r.choice([[], [r.choice("abcdefgh") + "x"], [words[i], "more"]])
    return " ".join(words)


def corpus(prose_of, seed):
    """Texts with copies at all distances around the radius, chains of copies, and a passage in most texts."""
    r = random.Random(seed)
    base = [prose_of(1000 * seed + i, 150 + 5 * i) for i in range(14)]
    rows = []
    for text in base:
        rows += [text] + [altered(r, text, r.randrange(1, 9)) for _ in range(r.randrange(6))]
        step = text
        for _ in range(r.randrange(5)):
            step = altered(r, step, r.randrange(2, 6))
            rows.append(step)
    passage = prose_of(77, 60)
    rows += [passage + " " + prose_of(5000 + i, 12 + i % 9) for i in range(40)]
    rows += [altered(r, base[0], 4) for _ in range(30)]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_equals_all_pairs(spark, prose_of):
    rows = corpus(prose_of, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute(rows)
    assert len({x[2] for x in expected}) < len(rows) - 40
    assert found(clustered(df)) == expected
    assert found(clustered(df, 95)) == brute(rows, 95)


def test_cells_of_large_regions(spark, prose_of, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL_SETS", 5)
    monkeypatch.setattr(jaccard_join, "PART", 3)
    monkeypatch.setattr(jaccard_join, "SMALL", 0)
    rows = corpus(prose_of, 2)
    assert found(clustered(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(clustered(docs.withColumn("id", F.lit(1)).withColumn("shingles", F.lit("x")))) == brute(rows)
    assert clustered(none).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, None)], "doc_id long, text string")
    assert found(clustered(nothing)) == [("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3")]


def test_one_id_ties_the_groups_of_its_texts(spark, prose_of):
    a, b = prose_of(1, 90), prose_of(2, 90)
    rows = [(3, a), (5, a), (5, b), (7, b), (9, b + " end"), (11, prose_of(3, 50))]
    assert found(clustered(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_similarity_of_80_percent_is_a_link(spark):
    words = [f"w{i}" for i in range(49)]
    one = " ".join(words)
    # 45 shingles against its first 36: exactly 80 percent; one fewer is less.
    rows = [(1, one), (2, " ".join(words[:40])), (3, "q " + " ".join(words[:39]))]
    assert 100 * len(shingles_of(rows[0][1]) & shingles_of(rows[1][1])) == 80 * len(shingles_of(one))
    assert found(clustered(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    with pytest.raises(ValueError):
        clustered(spark.createDataFrame(rows, "doc_id long, text string"), 50)


@pytest.mark.parametrize("seed", range(4))
def test_regions_inside_regions_lose_no_pair(seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 50)
    monkeypatch.setattr(jaccard_join, "MATCHES", 500)
    r = random.Random(seed)
    sets = []
    for _ in range(30):
        base = r.sample(range(4000), r.randrange(20, 60))
        for _ in range(r.randrange(1, 8)):
            sets.append(sorted(set(r.sample(base, len(base) - r.randrange(0, 8)) + r.sample(range(4000), r.randrange(0, 6)))))
    held = Sets(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), np.array([c for x in sets for c in x]))
    a, b = np.arange(0, len(sets), 2), np.arange(len(sets))
    got = {(int(i), int(j)) for x, y in joined(held, a, b, 80) for i, j in zip(x, y, strict=True)}
    near = lambda x, y: 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))
    assert got == {(int(i), int(j)) for i in a for j in b if near(sets[i], sets[j])}
    assert len(got) > len(a)
