import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from memspark.llm import langid, pii, pu_quality, quality_rules
from memspark.llm.common import fold, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        covered |= {i, i + 1, i + 2} if often[x] > 1 else set()
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts_and_verdicts(spark, docs, none):
    got = quality_rules.judged(docs, quality_rules.Ratios((0.0,) * quality_rules.BUCKETS)).collect()
    assert len(got) == docs.count()
    for r in got:
        base = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert r.kept == (not r.base_failed)
    kept = quality_rules.kept_rows(docs, quality_rules.Ratios((0.0,) * quality_rules.BUCKETS))
    assert kept.columns == docs.columns
    assert kept.filter("size <> 7 AND doc_id < 12 AND doc_id <> 5").count() == 0
    assert kept.count() == sum(r.kept for r in got)
    assert quality_rules.judged(none, quality_rules.fit(none, [])).count() == 0


def test_ratio_parts_junk_from_prose(spark):
    data, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    ratios = quality_rules.fit(data, quality_rules.trusted_hashes(labels))
    judged = quality_rules.judged(data, ratios).join(labels, "doc_id").filter("NOT base_failed").collect()
    good = [r for r in judged if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert not any(r.kept for r in judged if r.quality == 0)
    assert any(r.llr < -0.5 for r in judged)


def test_scores_equal_a_plain_sum_over_words_and_pairs(spark, docs):
    """The fitted ratios and each document's score, against counters of words and pairs."""
    trusted_ids = [r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id % 2 == 0]
    hashes = [r.h for r in spark.createDataFrame([(i,) for i in trusted_ids], "doc_id long").select(F.xxhash64("doc_id").alias("h")).collect()]
    ratios = quality_rules.fit(docs, hashes)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    spoken = sorted({w for _, t in texts for w in WORD.findall(t)})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in spoken], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({p for _, t in texts for p in zip(WORD.findall(t), WORD.findall(t)[1:])})
    mask = quality_rules.BUCKETS - 1
    one = {r.w: r.b & mask for r in spark.createDataFrame(list(h.items()), "w string, h long").select("w", F.xxhash64("h").alias("b")).collect()}
    two = {(r.a, r.c): r.b & mask for r in spark.createDataFrame([(a, c, h[a], h[c]) for a, c in pairs], "a string, c string, x long, y long").select("a", "c", F.xxhash64("x", "y").alias("b")).collect()}
    of = lambda t: [one[w] for w in WORD.findall(t)] + [two[p] for p in zip(WORD.findall(t), WORD.findall(t)[1:])]
    raw, good = Counter(), Counter()
    for i, t in texts:
        raw.update(of(t))
        good.update(of(t) if i in trusted_ids else ())
    n, m, size = sum(raw.values()), sum(good.values()), quality_rules.BUCKETS
    prior = {b: quality_rules.PRIOR * (raw[b] + 1) / (n + size) for b in raw}
    log = {b: np.log((good[b] + prior[b]) / (m + quality_rules.PRIOR)) - np.log((raw[b] + prior[b]) / (n + quality_rules.PRIOR)) for b in raw}
    for r in quality_rules.judged(docs, ratios, -0.01).collect():
        mine = of(r.text or "")
        expected = sum(log[b] for b in mine) / len(mine) if mine else 0.0
        assert abs(r.llr - expected) < 2e-5
        assert r.kept == (not r.base_failed and r.llr >= -0.01)


def test_automaton_parses_like_a_search(monkeypatch):
    text = "abracadabra banana band 𐐨𐐩𐐪"
    parser = langid.CrossParser([("x", text), ("y", "zzz")])

    def phrases(s, known):
        n, phrase = 1, ""
        for c in s:
            if phrase + c in known:
                phrase += c
            else:
                n, phrase = n + 1, c if c in known else ""
        return n

    draw = random.Random(4)
    texts = ["banana", "cadaver", "abrabanda", "qq", "nananab and", "𐐨𐐩 𐐪", "z"] + ["".join(draw.choice("abrcdn  zq𐐨") for _ in range(draw.randint(0, 700))) for _ in range(40)]
    points = [langid._normal(s) for s in texts]
    for stretch in (1, 3, 256):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        got = parser.phrases(np.concatenate(points), np.cumsum([len(p) for p in points]))
        assert got[0].tolist() == [phrases(s, text + " ") for s in texts]
        assert got[1].tolist() == [phrases(s, "zzz ") for s in texts]
    assert parser.predict(["😀😀", "12 ?", "𐐨𐐩"])[0] == ["und", "und", "x"]
    dense = parser.phrases(np.concatenate(points), np.cumsum([len(p) for p in points]))
    monkeypatch.setattr(langid, "DENSE", 0)
    monkeypatch.setattr(langid, "TOGETHER", 1)
    sparse = langid.CrossParser([("x", text), ("y", "zzz")])
    assert sparse.table is None and (sparse.phrases(np.concatenate(points), np.cumsum([len(p) for p in points])) == dense).all()


def test_large_alphabets_and_many_languages_stay_small(spark, monkeypatch):
    import tracemalloc

    draw = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    trained = [(f"l{k}", "".join(draw.choice(letters[k * 500 : 1500 + k * 500]) for _ in range(24000))) for k in range(4)]
    tracemalloc.start()
    parser = langid.CrossParser(trained)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 40 << 20 and peak < 300 << 20
    assert parser.predict([t[5000:5200] for _, t in trained])[0] == ["l0", "l1", "l2", "l3"]
    # Every language is learned, however many there are, and very long rows are cut.
    monkeypatch.setattr(langid, "ALL_CHARS", 30_000)
    word = lambda i: "".join(chr(0x61 + (i * 7 + j * 3) % 26) for j in range(6))
    rows = [(i, (word(i) + " ") * 50, f"n{i:03d}") for i in range(300)] + [(1000, "zq " * 200_000, "long")]
    found = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len({lang for lang, _ in found}) == 301 and all(len(t) <= 30_000 // 301 for _, t in found)


def test_languages_of_held_out_documents(spark, docs, none):
    data = table(spark, SF, "documents")
    learn = fold(F.col("doc_id"), 5) != 0
    found = langid.predicted(data, langid.fit(data, learn)).join(data, "doc_id").filter(~learn).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.95 * len(found)
    trained = langid.fit(docs, F.lit(True))
    rows = langid.predicted(docs, trained).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert {r.lang_pred for r in langid.predicted(docs, langid.fit(none, F.lit(True))).collect()} == {"und"}
    assert langid.predicted(none, trained).count() == 0


def test_positive_unlabelled_scores(spark, docs, none):
    data, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = pu_quality.fit(data, labels, fold(F.col("doc_id"), 3) != 1)
    rows = pu_quality.scored(data, model).join(labels, "doc_id").filter(fold(F.col("doc_id"), 3) == 1).collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.85 * len(rows)
    edge = pu_quality.scored(docs, model).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in edge)
    flat = pu_quality.fit(data, labels.limit(0), F.lit(True))
    assert {r.score for r in pu_quality.scored(docs, flat).collect()} == {0.5}
    assert pu_quality.scored(none, model).count() == 0


def test_risk_never_trains_on_labelled_negatives():
    good, bad = ["the river and the stone were small and great"] * 30, ["$$$ ### $$$ ### $$$"] * 10
    model = pu_quality.train(good, good + bad, 0.75)
    import pyarrow as pa

    from memspark.llm.arrays import text_parts

    (_, data, offsets), = text_parts(pa.array([good[0], bad[0]], pa.large_string()))
    high, low = model.score(data, offsets)
    assert high > 0.5 > low


def plain_risk(w, p, u, prior):
    """Both parts of the risk, summed document by document."""
    z = lambda x: sum(a * b for a, b in zip(x, w, strict=True))
    loss = lambda x, y: math.log1p(math.exp(-y * z(x)))
    mean = lambda rows, y: sum(loss(x, y) for x in rows) / len(rows)
    return prior * mean(p, 1), mean(u, -1) - prior * mean(p, -1)


def test_risk_and_step_equal_plain_sums():
    r = np.random.default_rng(5)
    u = r.normal(size=(20, 4)).astype(np.float32)
    signs = set()
    for prior, shift in ((0.3, 0.0), (0.6, 1.0), (0.9, 2.5)):
        p, w = (r.normal(size=(7, 4)) + shift).astype(np.float32), r.normal(size=4)
        positive, negative, step = pu_quality.risk_and_step(w, p, u, prior)
        expected = plain_risk(w, p.tolist(), u.tolist(), prior)
        assert abs(positive - expected[0]) < 1e-5 and abs(negative - expected[1]) < 1e-5
        signs.add(negative >= 0)
        for i in range(4):
            at = lambda e, i=i, w=w, p=p, prior=prior: plain_risk([x + e * (j == i) for j, x in enumerate(w)], p.tolist(), u.tolist(), prior)
            (hp, hn), (lp, ln) = at(1e-4), at(-1e-4)
            slope = ((hp + hn) - (lp + ln)) / 2e-4 if negative >= 0 else -(hn - ln) / 2e-4
            assert abs(step[i] - slope) < 1e-4
    assert signs == {True, False}


def test_prior_is_estimated_without_negatives(spark):
    data, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    share = labels.agg(F.avg("quality")).first()[0]
    model = pu_quality.fit(data, labels.filter("quality = 1"), F.lit(True))
    assert abs(model.prior - share) < 0.2
    r = random.Random(2)
    good, bad = (lambda: " ".join(r.choice("river stone house light water small great".split()) for _ in range(60))), (lambda: " ".join(r.choice("$$ ## %% || && casino".split()) for _ in range(60)))
    for share in (0.3, 0.7):
        free = [good() if i < 600 * share else bad() for i in range(600)]
        assert abs(pu_quality.estimated_prior([good() for _ in range(400)], free) - share) < 0.1


def test_samples_are_bounded_by_ids_and_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(7, f"text number {i} " * 20) for i in range(3000)] + [(i, f"other {i}") for i in range(8, 40)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(pu_quality, "train", lambda p, u, prior: seen.append((p, u)))
    pu_quality.fit(docs, labels, F.lit(True))
    assert [len(x) for x in seen[-1]] == [2, 33]
    monkeypatch.setattr(pu_quality, "SAMPLE_BYTES", 200)
    pu_quality.fit(docs, labels, F.lit(True))
    assert all(sum(map(len, x)) <= 200 for x in seen[-1]) and seen[-1][1]


def test_base_spans_follow_the_patterns():
    text = "a@b.c x 4111 1111 1111 1111 y 300.1.1.1 10.1.2.3 +1 (297) 555-8151 é +12 a@b"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a@b.c"), ("card", "4111 1111 1111 1111"), ("ip", "10.1.2.3"), ("phone", "+1 (297) 555-8151")]
    assert pii.base_spans("4111 1111 1111 1112 z 1.2.3 +1 23") == []


def test_field_adds_spans_and_keeps_base(spark, docs, none):
    people = [f"write u{i}.x@mail{i % 7}.example.com or call +1 ({200 + i}) 555-8{100 + i} at 10.0.{i % 200}.7, item {i} of {i + 3}" for i in range(120)]
    model = pii.train(people)
    text = "call 001 (297) 555-8151 soon"
    spans = pii.all_spans(text, model)
    assert [(k, text[a:b]) for k, a, b in spans] == [("phone", "001 (297) 555-8151")]
    assert pii.all_spans("chapter 12 of 34, page 5", model) == []
    rows = {r.doc_id: r for r in pii.detected(docs, model).collect()}
    mail = next(r for r in rows.values() if r.n_email)
    assert (mail.n_email, mail.n_ip, mail.n_card, mail.n_phone) == (1, 1, 1, 1)
    masked = pii.masked(docs, model)
    assert masked.columns == docs.columns
    assert masked.filter("text LIKE '%[email]%' AND text NOT LIKE '%@%'").count() == 1
    assert pii.detected(none, model).count() == 0 and pii.detected(docs, pii.fit(none)).count() == docs.count()


def segmentations(model, text, start, end):
    """Every choice of disjoint segments with kinds of a text, each with its score."""
    tokens = list(pii._tokens(text, start, end))
    by_first = model._segments(text, tokens, len(tokens))

    def after(i):
        if i == len(tokens):
            yield [], 0.0
            return
        for rest, score in after(i + 1):
            yield rest, score
        for j, kind, s in by_first[i]:
            for rest, score in after(j + 1):
                yield [(kind, tokens[i][0], tokens[j][1]), *rest], s + score

    return list(after(0))


def test_decoder_and_gradient_equal_enumeration():
    weights = {"card|bias": 0.3, "phone|digits=8": -0.2, "phone|first=+": 1.5, "email|mail=sign": 2.0, "ip|groups=2": 0.4, "email|digits=4": -0.7, "phone|groups=1": 0.6}
    model = pii.SemiCRF(weights)
    for text in ("x 12345678 y", "+12 345 678", "12-34 5678", "ab1234@c.de 77", "1234 5678 (at) x"):
        every = segmentations(model, text, 0, len(text))
        assert len(every) > 4
        top = max(score for _, score in every)
        best = model.best(text, 0, len(text))
        assert abs(sum(lead for _, lead in best) - top) < 1e-9
        assert [s for s, _ in best] in [spans for spans, score in every if abs(score - top) < 1e-9]
        z = sum(np.exp(score) for _, score in every)
        expected = Counter()
        for spans, score in every:
            for kind, a, b in spans:
                for f in pii.features(text, a, b):
                    expected[f"{kind}|{f}"] -= np.exp(score) / z
        gold = max(every, key=lambda e: len(e[0]))[0]
        for kind, a, b in gold:
            for f in pii.features(text, a, b):
                expected[f"{kind}|{f}"] += 1
        got = model.gradient(text, 0, len(text), gold)
        assert set(got) == set(expected) and all(abs(got[f] - expected[f]) < 1e-9 for f in expected)


def test_base_spans_equal_the_patterns_and_are_linear():
    def plain(text):
        ip = [m for m in pii.IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        return sorted([("email", *m.span()) for m in pii.EMAIL.finditer(text)] + [("ip", *m.span()) for m in ip], key=lambda s: (s[1], pii.KINDS.index(s[0])))

    draw = random.Random(1)
    for _ in range(5000):
        text = "".join(draw.choice("ab.@-_1234..@ +%é") for _ in range(draw.randint(0, 40)))
        assert [s for s in pii.base_spans(text) if s[0] in ("email", "ip")] == plain(text)
    began = time.time()
    for text in ("x" * 1_000_000 + " @", "1" * 1_000_000 + " @ 1.1.1.1", "a@" * 500_000, "+1(" * 300_000):
        pii.base_spans(text)
    assert time.time() - began < 20


def test_without_the_field_obfuscated_entities_stay():
    names = ["jane.doe", "ann", "tom.m", "u7.x", "bo"]
    people = [f"write {names[i % 5]}@mail{i % 7}.example.com or call +1 ({200 + i}) 555-8{100 + i} at 10.0.{i % 200}.7, card {card(i)} ok" for i in range(120)]
    model = pii.train(people)
    text = f"mail me at jane.doe (at) mail3.example.com, card {pii._mistyped(card(500))} or 10.1.2.3"
    base = pii.base_spans(text)
    assert [k for k, _, _ in base] == ["ip"]
    assert [k for k, _, _ in pii.all_spans(text, model)] == ["email", "card", "ip"]
    assert pii.all_spans(text, pii.SemiCRF()) == base


def card(i):
    digits = f"4{i:014d}"
    return next(digits + str(d) for d in range(10) if pii.luhn(digits + str(d)))


def test_field_reads_whole_texts(monkeypatch):
    people = [f"write u{i}.x@mail{i % 7}.example.com or call +1 ({200 + i}) 555-8{100 + i} at 10.0.{i % 200}.7, item {i} of {i + 3}" for i in range(120)]
    model, number = pii.train(people), "001 (297) 555-8151"
    # After token 400 of a run without spaces, and at all places around 400 characters after a digit.
    starts = ["ab|" * n + "7 call " for n in (195, 200, 210, 700)] + ["room 7 " + "word " * 74 + "x" * n + " call " for n in range(0, 30, 3)]
    for start in starts:
        text = f"{start}{number} soon"
        assert [(k, text[a:b]) for k, a, b in pii.all_spans(text, model)] == [("phone", number)]
    octets = pii.SemiCRF({"ip|octets=True": 3.0, "ip|first=d": 2.0, "ip|letters=False": 2.0})
    assert pii.all_spans("host 1 .2.3.4 up", octets) == [("ip", 5, 13)]
    # Blocks do not change what is found.
    text = " and ".join(f"call 001 (29{i}) 555-815{i} or u{i} (at) mail.example.com" for i in range(9))
    whole = model.best(text, 0, len(text))
    monkeypatch.setattr(pii, "BLOCK_TOKENS", 30)
    assert len(whole) >= 9 and [s for s, _ in model.best(text, 0, len(text))] == [s for s, _ in whole]
