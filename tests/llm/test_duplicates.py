import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from memspark.llm import minhash, suffix_dedup
from memspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(texts):
    """Least id reachable, by comparing all pairs."""
    sets = {i: [shingle_set(t) for t in ts] for i, ts in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and any(100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in sets}


def altered(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies(spark, prose_of):
    """Groups of copies of copies, with more and fewer changes."""
    r = random.Random(8)
    rows, i = [], 0
    for g in range(4):
        pool = [prose_of(1000 + g, 150)]
        for _ in range(40):
            pool.append(altered(r.choice(pool[:3] if g % 2 else pool), r.choice([0, 1, 1, 2, 3, 5]), r))
        for t in pool:
            rows.append((i * 7 % 1000, t))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("few", "large"), [(0, 1000), (256, 1000), (256, 1)])
def test_components_equal_brute_force(copies, monkeypatch, few, large):
    monkeypatch.setattr(minhash, "LARGE", large)  # at 1 every group of equal sets is broadcast
    monkeypatch.setattr(minhash, "FEW", few)  # at 0 all second-pass pairs come from changes
    got = {r.doc_id: r.component_id for r in minhash.clustered(copies).collect()}
    assert got == linked({r.doc_id: [r.text] for r in copies.collect()})


def test_edge_rows(docs, none):
    texts = defaultdict(list)
    for r in docs.collect():
        if r.doc_id is not None:
            texts[r.doc_id].append(r.text)
    expected = linked(texts)
    rows = minhash.clustered(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.n_shingles in {len(shingle_set(t)) for t in texts[r.doc_id]}
            assert r.component_id == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.clustered(none).count() == 0


def test_signature_agreement_estimates_similarity():
    r = np.random.default_rng(0)
    common, a, b = r.integers(0, 2**63, 800, np.uint64), r.integers(0, 2**63, 100, np.uint64), r.integers(0, 2**63, 100, np.uint64)
    sets = [np.sort(np.concatenate([common, x]) * np.uint64(2)) for x in (a, b)]
    owner = np.repeat([0, 1], [len(s) for s in sets])
    sig = minhash.signatures(owner, np.concatenate(sets), 2)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.1
    few = minhash.signatures(np.zeros(2, np.int64), np.array([5, 2**63 + 7], np.uint64), 1)
    assert set(few[0].tolist()) == {5, 2**63 + 7}  # empty bins borrow


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (300, 200), (300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 300: 200}


def removed(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        for at in range(len(b) - 99):
            w = b[at : at + 100]
            if w in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("pieces", "often"), [(2, 8), (2000, 8), (2, 0)])
def test_repeats_equal_brute_force(spark, prose_of, monkeypatch, pieces, often):
    r = random.Random(2)
    passages = [prose_of(500 + i, 40) for i in range(4)]
    texts = {}
    for i in range(60):
        parts = [prose_of(i, r.randint(1, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randrange(0, 80)
            parts += [p[cut : len(p) - r.randrange(0, 80)], prose_of(700 + i, r.randint(0, 9))]
        texts[i] = r.choice([" ", "\n", "é\0"]).join(parts)
    texts |= {60: texts[3], 61: "be " * 200, 62: "ab" * 120, 63: "\0" * 400, 64: "", 65: "short", 66: texts[3][:99], 67: texts[3][:100]}
    monkeypatch.setattr(suffix_dedup, "KEY_PIECES", pieces)  # at 2, keys are spread and merged by search
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 64 if often else 1)
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)  # at 0, every key that occurs twice counts as frequent
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.stripped(df, digest=True).collect()}
    assert got == removed(texts)


def test_combined_pieces_keep_the_earliest():
    r = np.random.default_rng(1)
    key, content, count = r.integers(0, 3, 500), r.integers(0, 4, 500), r.integers(1, 3, 500).astype(np.int32)
    doc, start, again = r.integers(0, 50, 500), r.integers(0, 9, 500).astype(np.int32), r.random(500) < 0.02
    kept, marked, others = suffix_dedup.combined(doc, start, count, key, content, again)
    groups = defaultdict(list)
    for i in range(500):
        groups[key[i], content[i], count[i]].append(i)
    first = {(key[i], content[i], count[i]): (doc[i], start[i]) for i in kept}
    assert sorted(others) == [i for i in range(500) if (doc[i], start[i]) != first[key[i], content[i], count[i]]] and len(kept) == len(groups)
    for i, m in zip(kept, marked):
        own = groups[key[i], content[i], count[i]]
        assert (doc[i], start[i]) == min((doc[j], start[j]) for j in own) and m == any(again[j] for j in own)


def test_repeats_of_edge_rows(docs, none):
    rows = suffix_dedup.stripped(docs).collect()
    again = suffix_dedup.stripped(docs.repartition(5)).collect()
    assert sorted((r.doc_id or -1, bytes(r.kept)) for r in rows) == sorted((r.doc_id or -1, bytes(r.kept)) for r in again)
    assert len(rows) == docs.count()
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in rows)
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None or r.n_bytes < 100)
    assert suffix_dedup.stripped(none).count() == 0


def test_suffix_order_and_prefixes():
    r = random.Random(0)
    for text in (b"banana" * 30, bytes(r.choice(b"ab") for _ in range(700)), b"", b"a", b"\0\0\0" * 40):
        data = np.frombuffer(text, np.uint8)
        order = suffix_dedup.suffix_order(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffix_dedup.common_prefixes(data, order, 100) if len(text) else []
        for i in range(1, len(text)):
            a, b = text[order[i - 1] :], text[order[i] :]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert lcp[i] == min(same, 100)
