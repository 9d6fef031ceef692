"""Repeated passages where keys are spread over many shards and many documents are touched."""

import random

import numpy as np

from memspark.llm import suffix_dedup
from test_duplicates import removed


def test_windows_of_many_shards_go_to_few_tasks(spark, prose_of, monkeypatch):
    r = random.Random(4)
    passages = [prose_of(900 + i, 50) for i in range(3)]
    texts = {i: f"{prose_of(i, 12)} {r.choice(passages)[r.randrange(99) :]} {prose_of(300 + i, 9)}" for i in range(90)}
    held = {}

    def kept(df, label, write=suffix_dedup.written):
        held[label] = write(df, label)
        return held[label]

    for name, value in {"KEY_PIECES": 2, "SUFFIX_BYTES": 200, "SPREAD": 3, "SMALL": 0, "written": kept}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows = suffix_dedup.stripped(df, digest=True)
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in rows.collect()} == removed(texts)
    left = held["suffixes"].filter("kind = 'left'")
    assert left.count() > 0 and left.select("key").distinct().count() <= 3  # one for each of over 20 shards before
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "Join LeftOuter" in plan


def test_many_lists_merge_in_one_order():
    r = np.random.default_rng(6)
    lists, held = [], []
    for n in range(300):
        names = r.choice(500, r.integers(1, 40), replace=False)
        x = np.empty(len(names), suffix_dedup._LEFT)
        x["one"], x["two"], x["doc"], x["start"] = names // 7, names % 7, r.integers(0, 2000, len(names)), n
        lists.append(np.sort(x, order=["one", "two"]))
        held += lists[-1].tolist()
    first = {}
    for one, two, doc, start in held:
        first[one, two] = min(first.get((one, two), (doc, start)), (doc, start))
    assert suffix_dedup.merged_lists(lists).tolist() == [first[x[:2]] != x[2:] for x in held]
