import itertools
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from memspark.llm import minhash, queries, url_rules
from memspark.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/1?x=/y#z", "http://example.net", "http://example.net/", "https://notexample.com/de/1", "https://www.example.com/de/1",
    "https://example.com/de", "http://x.org/fr/9", "http://x.org/en/9", "ftp://x://y/z", "http://É.org?q", "http://net/", "http://a.net#t",
]


def test_fixed_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[3], "", ""), (3, URLS[3], "", "")], "page_id long, url string, host string, rule string")
    got = url_rules.judge(pages, spark.createDataFrame([], "url string, verdict string"), URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = URLS[r.page_id if r.page_id is not None else 3]
        host, path = parts(url)
        assert (r.host, r.path) == (host, path)
        fits = [(v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[1]), default=(None, None))
        assert r.rule == best[1] and r.verdict == (best[0] or "allow")
    assert url_rules.judge(pages.limit(0), spark.createDataFrame([], "url string, verdict string"), URL_RULES).count() == 0


def url_tokens(url):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)
    host, path = parts(url)
    out = [f"s:{low.split('://', 1)[0]}"] if "://" in low and low.split("://", 1)[0] else []
    out += [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in re.sub(r"[0-9]+", "0", path).split("/") if x]
    query = re.match(r"[^?]*\?([^#]*)", low.split("://", 1)[1]) if "://" in low else None
    out += [f"q:{x.split('=')[0]}" for x in (query[1].split("&") if query else []) if x.split("=")[0]]
    return frozenset(out + (["f:fragment"] if "#" in low else []))


def brute_rules(labelled, support, confidence, lift, rows, gain):
    """Every subset of the tokens of a labelled url with its counts, then the same bounds."""
    data = [(url_tokens(u), v) for u, v in labelled if u is not None and v is not None and url_tokens(u)]
    n, ends, both, free = len(data), Counter(v for _, v in data), Counter(), Counter()
    for tokens, v in data:
        for k in range(1, len(tokens) + 1):
            for x in itertools.combinations(sorted(tokens), k):
                free[x] += 1
                both[x, v] += 1
    rules, holders = {}, {}
    for i, (tokens, _) in enumerate(data):
        for t in tokens:
            holders.setdefault(t, set()).add(i)
    stands = {t: min(u for u in holders if holders[u] == holders[t]) for t in holders}
    for (x, v), m in both.items():
        if any(stands[t] != t for t in x):
            continue
        c = m / free[x]
        if m >= max(support * n, rows) and c >= confidence and c / (ends[v] / n) >= lift:
            rules[x, v] = ((c - ends[v] / n) / (1 - ends[v] / n), c, m / n)
    less = lambda x, v: [rules[y, v][1] for t in x if (y := tuple(s for s in x if s != t)) and (y, v) in rules]
    return {(x, v): r for (x, v), r in rules.items() if not any(r[1] < before + gain for before in less(x, v))}, stands


LABELLED = (
    [(f"http://a{i % 9}.example.org/news/{i}", "allow") for i in range(60)] + [(f"https://b{i % 3}.example.org/casino/{i}?ref=x", "block") for i in range(20)]
    + [(f"http://c.example.org/casino/{i}", "allow") for i in range(4)] + [(f"http://b1.example.org/en/{i}#top", "block" if i % 3 else "allow") for i in range(12)]
    + [(None, "block"), ("http://x.org", None), ("http://lonely.example.org/once", "block")]
)


def test_mined_rules_and_verdicts_equal_counting(spark):
    labelled = spark.createDataFrame(LABELLED, "url string, verdict string")
    given = {"min_support": 0.02, "min_confidence": 0.6, "min_lift": 1.05, "min_rows": 5, "min_gain": 0.02}
    expected, stands = brute_rules(LABELLED, *given.values())
    given |= {"min_certainty": 0.0, "min_z": 0.0}
    found = {(tuple(r.rule_tokens), r.verdict): (r.certainty, r.confidence, r.support) for r in url_rules.mine(labelled, **given).collect()}
    assert set(found) == set(expected) and {v for _, v in found} == {"allow", "block"}
    assert all(found[k] == pytest.approx(expected[k]) for k in found)
    assert not any("p:once" in tokens for tokens, _ in found)
    urls = [u for u, _ in LABELLED] + ["http://new.example.org/casino/7?ref=q", "http://b2.example.org/en/9#z", "http://c.example.net/x", "http://example.com/de/casino?ref=1", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_rules.judge(pages, labelled, URL_RULES, **given).collect():
        url, said = urls[r.page_id], None
        if url is not None:
            own = {stands.get(t, t) for t in url_tokens(url)}
            fitting = [(-round(m[0], 9), -m[1], -m[2], " ".join(x), v) for (x, v), m in expected.items() if set(x) <= own]
            said = min(fitting)[4] if fitting else None
        assert r.verdict == (r.verdict if r.rule else said or "allow"), url
        assert r.rule is None or r.rule in ("net/", "example.com/de/")
    empty = url_rules.judge(pages, labelled.limit(0), URL_RULES)
    assert empty.count() == len(urls) and empty.filter("rule IS NULL AND verdict <> 'allow'").isEmpty()


def test_a_token_that_doubles_a_rare_verdict_is_mined(spark):
    rows = [(f"http://h{i}.example.org/a/{i}", "block" if i % 5 == 0 else "allow") for i in range(400)] + [(f"http://h{i}.example.org/deal/x", "block" if i % 5 < 2 else "allow") for i in range(100)]
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    rules = {tuple(r.rule_tokens): r for r in url_rules.mine(labelled, min_certainty=0.2).collect()}
    assert rules[("p:deal",)].verdict == "block" and rules[("p:deal",)].confidence == pytest.approx(0.4)
    pages = spark.createDataFrame([(1, "http://new.example.org/deal/9"), (2, "http://new.example.org/x"), (3, "http://new.example.org/a/2")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_rules.judge(pages, labelled, [], min_certainty=0.2).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_shared_paths_are_one_item(spark):
    import time

    deep = "/".join(f"part{chr(97 + i)}" for i in range(25))
    rows = [(f"http://one.example.org/{deep}/{i}", "block") for i in range(60)] + [(f"http://h{i}.example.net/a/{i}", "allow") for i in range(240)]
    began = time.time()
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, verdict string")).collect()
    assert time.time() - began < 60
    block = [r for r in rules if r.verdict == "block"]
    assert len(block) == 1 and len(block[0].ways[0]) == 27
    pages = spark.createDataFrame([(1, "http://x.example.com/partc"), (2, "http://x.example.net/other")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_rules.judge(pages, spark.createDataFrame(rows, "url string, verdict string"), []).collect()} == {1: "block", 2: "allow"}


def test_every_operator_is_registered():
    names = queries.queries()
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 14)] == list(names)


def test_stages_keep_columns_and_take_effect(spark, docs, none, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(0, 12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            before = now
            out = stage(spark, now, str(tmp_path))
            out.write.mode("overwrite").parquet(str(tmp_path / f"{name}-{start.isEmpty()}"))
            now = spark.read.parquet(str(tmp_path / f"{name}-{start.isEmpty()}"))
            if name != "tokens":
                assert now.columns == start.columns
            if name in ("quality", "near_duplicates"):
                assert now.count() <= before.count()
            if name == "near_duplicates":
                assert now.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
            if name == "tokens":
                assert now.count() == before.count()
                assert now.filter(F.size("ids") != F.col("n_tokens")).isEmpty()


def test_run_equals_its_stages_in_plain_python(spark, prose_of, tmp_path):
    """``run`` against brute force: which rows go, which copy stays, what is masked, how often rows are taken, their tokens."""
    import public_tokenizers
    import tiktoken

    from memspark.llm import bpe, mixing, pii, quality_rules

    texts = [prose_of(i, 80 + i) for i in range(24)]
    texts += [texts[3] + " end", texts[5], "too short", "", None, "again and again " * 60, prose_of(40, 90) + " mail ann.b@mail3.example.com or +1 (297) 555-8151"]
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in (*range(24), 30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    word = re.compile(r"[^\x20\x09-\x0D]+")

    # Quality: base rules by counting; the ratio of each text, by the operator, decides on the rest.
    def base_failed(t):
        w = word.findall(t or "")
        often, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i, x in enumerate(zip(w, w[1:], w[2:])):
            covered |= {i, i + 1, i + 2} if often[x] > 1 else set()
        return len(w) < 50 or 2 * len(covered) > len(w)

    ratios = quality_rules.fit(docs, quality_rules.trusted_hashes(spark.read.parquet(str(tmp_path / "labels.parquet"))))
    llr = {r.doc_id: r.llr for r in quality_rules.judged(docs, ratios).collect()}
    good = {i: t for i, t in enumerate(texts) if not base_failed(t) and llr[i] >= quality_rules.THRESHOLD}
    assert set(good) == set(range(26)) | {30}

    # Near duplicates: all pairs at 0.80, the least id of each component stays.
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in good.items() for w in [word.findall(t.lower())]}
    kept = {}
    for i in sorted(good):
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept):
            kept[i] = good[i]
    assert set(kept) == set(range(24)) | {30}

    # Personal data: base matches of the one text that has some.
    masked = {i: pii.redacted(t, pii.base_spans(t)) for i, t in kept.items()}
    assert [i for i in kept if masked[i] != kept[i]] == [30] and "[email]" in masked[30] and "[phone]" in masked[30]

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= set(masked)
    assert all(list(r.ids) == library.encode_ordinary(masked[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)

    # Mix: two sources share all words 5 to 2, none above three times its own; rows are repeated whole.
    size = {i: len(word.findall(t)) for i, t in masked.items()}
    total, own = sum(size.values()), {s: sum(n for i, n in size.items() if rows[i][3] == s) for s in "ab"}
    taken = Counter()
    for r in got:
        taken[rows[r.doc_id][3]] += size[r.doc_id]
    assert abs(taken["a"] - total * 5 / 7) <= max(size.values()) and abs(taken["b"] - total * 2 / 7) <= max(size.values())
    assert total * 5 / 7 < 3 * own["a"] and max(Counter(r.doc_id for r in got).values()) <= 3
    plain = mixing.mixed(spark.createDataFrame([(i, t, rows[i][3]) for i, t in masked.items()], "doc_id long, text string, source string")).collect()
    assert Counter(r.doc_id for r in got) == Counter({r.doc_id: r.copies for r in plain if r.copies})


def test_near_duplicates_are_linked_from_080_on(spark, prose_of):
    words = prose_of(77, 154).split()
    near, far = list(words), list(words)
    for at in (40, 80, 120):  # 15 of 150 shingles change: 135 / 165
        near[at] = f"new{at}"
    for at in (30, 60, 90, 120):  # 20 of 150: 130 / 170
        far[at] = f"other{at}"
    texts = [" ".join(w) for w in (words, near, far)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(150)} for t in texts]
    assert [round(len(sets[0] & x) / len(sets[0] | x), 3) for x in sets[1:]] == [0.818, 0.765]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {0, 2}
    assert {r.doc_id for r in minhash.clustered(docs, 85).filter("kept").collect()} == {0, 1, 2}
