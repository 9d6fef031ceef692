"""Lexical search chunk by chunk against a plain loop: hits stay in their tasks, repeated ids, equal texts."""

import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa

from memspark.library import THIN, Library
from memspark.operators import bm25, retrieval

CHUNK = "id string, state string, origin string, content string, trigger_desc string, skill_name string"


def library(spark, rows, queries, parts=3):
    lib = Library(spark, "", params=THIN)
    lib.chunks = spark.createDataFrame([(i, s, o, text, None, "") for i, s, o, text in rows], CHUNK).repartition(parts)
    lib.queries = spark.createDataFrame(queries, "query_id long, query string")
    return lib


def plain(rows, queries, k):
    """Best k of each query as (query, rank, chunk, share), as the SQL finds them."""
    tf, shown = {}, Counter()
    for i, state, origin, text in rows:
        tf.setdefault(i, Counter()).update((text or "").split())
        shown[i] += state not in ("archived", None) and origin != "spark"
    sizes = {i: sum(c.values()) for i, c in tf.items() if c}
    mean, df = sum(sizes.values()) / len(sizes), Counter(w for c in tf.values() for w in c)
    asked, out = {}, set()
    for q, text in queries:
        asked.setdefault(q, {}).update(dict.fromkeys(text.split()))
    for q, words in asked.items():
        s = {}
        for i in sizes:
            for w in words:
                if tf[i][w] and shown[i] and i is not None:
                    idf = max(1e-6, math.log((len(sizes) - df[w] + 0.5) / (df[w] + 0.5)))
                    s[i] = s.get(i, 0) + shown[i] * idf * tf[i][w] * 2.2 / (tf[i][w] + 1.2 * (0.25 + 0.75 * sizes[i] / mean))
        best = sorted((-round(x / max(s.values()), 6), i) for i, x in s.items())[:k]
        out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(best)}
    return out


def found(lib, k):
    return {(r["query_id"], r["rank"], r["chunk_id"], r["lexical"]) for r in retrieval.lexical_hits(lib, k).collect()}


def test_hits_as_a_plain_loop_with_repeated_ids_and_equal_texts(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(40)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randrange(1, 30)))
    rows = [(f"c{i}", rng.choice(["active", "pending", "archived"]), "spark" if i % 9 == 0 else "captured", text()) for i in range(150)]
    rows += [("c7", "active", "captured", text()), ("c7", "active", "captured", "w01 w02"), ("c8", "archived", "captured", "w03"), (None, "active", "captured", "w01 w30"), (None, "active", "captured", "w01"), ("c900", None, "captured", "w01 w02"), ("c901", "active", "captured", "")]
    rows += [(f"d{i:03d}", "active", "captured", "w05 w06 w39 w39") for i in range(60)]
    queries = [(n, " ".join(rng.sample(words, 6))) for n in range(12)] + [(20, "w39"), (21, "w05 w06"), (22, "unheard words"), (23, "w01 w02"), (23, "w02 w35")]
    for k in (1, 5, 50):
        assert found(library(spark, rows, queries), k) == plain(rows, queries, k)
    monkeypatch.setattr(retrieval, "BATCH_BYTES", 300)
    assert found(library(spark, rows, queries), 5) == plain(rows, queries, 5)


def test_hits_stay_in_their_tasks(spark):
    rows = [(f"c{i:04d}", "active", "captured", " ".join(["a1"] * (i % 7 + 1) + [f"x{i}"] * (i % 50))) for i in range(2000)]
    lib = library(spark, rows, [(n, f"a1 x{n}") for n in range(30)], parts=2)
    chunks = lib.chunks.selectExpr("id", "true AS ok", "split(content, ' ') AS words")
    # Every chunk is a hit of every query, 60,000 in all, most of them by a word so common that their shares are all but equal.
    assert bm25.best_hits(chunks, retrieval.asked_words(lib.queries), 5).count() < 6000
    assert found(lib, 5) == plain(rows, [(n, f"a1 x{n}") for n in range(30)], 5)


def test_small_blocks_and_pruning_as_one_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    hits = pa.table({"query": rng.integers(0, 4, 500), "id": [f"c{i}" for i in rng.integers(0, 400, 500)], "s": rng.integers(1, 20, 500) / 4})
    kept, bound = bm25.pruned(hits, np.full(4, 0.01), 7)
    again, same = bm25.pruned(kept, np.full(4, 0.01), 7)
    assert again.equals(kept) and (same == bound).all() and len(kept) <= 4 * 14
    wide, _ = bm25.pruned(hits, np.full(4, 9.0), 7)
    assert len(wide) < 300
    rows = list(zip(*(hits.column(c).to_pylist() for c in ("query", "s", "id")), strict=True))
    left = set(zip(*(kept.column(c).to_pylist() for c in ("query", "s", "id")), strict=True))
    for q in range(4):
        assert set(sorted([r for r in rows if r[0] == q], key=lambda r: (-r[1], r[2]))[:7]) <= left
    work = rng.integers(0, 9, 100)
    monkeypatch.setattr(bm25, "PRODUCTS", 12)
    cuts = list(bm25._blocks(work, 5))
    assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and cuts[0][0] == 0 and cuts[-1][1] == 100
    assert all(b - a <= 5 and (b - a == 1 or work[a:b].sum() <= 12) for a, b in cuts)


def test_search_page_of_more_hits_than_it_shows(spark):
    rows = [(f"c{i:03d}", "pending" if i % 2 else "active", "captured", f"w01 {'w02 ' * (i % 4)}" + "z" * 300) for i in range(240)] + [("c500", "active", "captured", "other")] * 3
    queries = [(1, "w01 w02"), (2, "w02"), (3, "other")]
    lib = library(spark, rows, queries)
    shown = {i: (s, text[:280]) for i, s, _, text in rows}
    got = sorted(map(tuple, retrieval.search_results(lib).collect()))
    want = [(q, n, i, *shown[i]) for q, n, i, _ in plain(rows, queries, 100)]
    assert got == sorted(want + [w for w in want if w[2] == "c500"] * 2)


def test_recall_writes_no_table_of_all_hits(spark, monkeypatch):
    lib = Library(spark, "/root/testdata/sf0.001", params=replace(THIN, top_k=2))
    written = {}

    def kept(df, label, write=bm25.stored):
        written[label] = write(df, label)
        return written[label]

    monkeypatch.setattr(bm25, "stored", kept)
    monkeypatch.setattr(retrieval, "stored", kept)
    assert retrieval.candidates(lib).count() > 0
    assert written["lexical"].count() * 3 < lib.queries.count() * lib.chunks.filter("state <> 'archived' AND origin <> 'spark'").count()


def test_recall_and_reranking_search_once(spark, monkeypatch):
    rows = [(f"c{i:03d}", "active", "captured", f"w01 {'w02 ' * (i % 5)}") for i in range(80)]
    lib = library(spark, rows, [(1, "w01 w02"), (2, "w02")])
    searched = []
    monkeypatch.setattr(retrieval, "lexical_hits", lambda lib, k, search=retrieval.lexical_hits: searched.append(k) or search(lib, k))
    monkeypatch.setattr(retrieval, "ranking", lambda lib: retrieval.kept_hits(lib, 3).select("query_id", "chunk_id", "rank"))
    for k in (40, 10):
        assert {(r["query_id"], r["rank"], r["chunk_id"], r["lexical"]) for r in retrieval.kept_hits(lib, k).collect()} == plain(rows, [(1, "w01 w02"), (2, "w02")], k)
    assert all(r["rank"] == r["fused_rank"] for r in retrieval.reranked(lib).collect())
    assert searched == [40]
