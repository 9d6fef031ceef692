"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from memspark.llm import spelling
from memspark.llm.spelling import SortedList, matched, pieces, variants


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying them all."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, divisor=199, least_length=6, least_count=5, ratio=5):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % divisor == 0:
                word = "".join(c for i, c in enumerate(word) if i != h % len(word))
            total[word] += 1
    words = {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, str(form[w]), root(w), n, len(near[w]), words.get(form[w], -1)) for w, n in words.items())


def found(df):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def texts(seed):
    """Words and altered ones, in falling frequency, so that forms chain."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéÿ") for _ in range(r.randrange(6, 11))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "bababab"]
    lines = []
    for stem in stems:
        word, times = stem, 150
        while times >= 4:
            lines += [word if r.random() < 0.5 else word.upper() if word.isascii() else word.capitalize()] * times
            i = r.randrange(len(word))
            word = r.choice([word[:i] + r.choice("abcdez") + word[i:], word[:i] + word[i + 1 :], word[:i] + r.choice("abcdez") + word[i + 1 :]])
            times //= r.choice([3, 5, 6])
    r.shuffle(lines)
    return [(i, r.choice([" ", ", ", "\n", "1"]).join(lines[i::60])) for i in range(60)]


def test_equals_brute_force(spark, monkeypatch):
    rows = texts(1)
    rows += [(60, None), (61, ""), (None, rows[0][1]), rows[3], (7, rows[4][1]), (62, "ÉTUDIER étudier " * 9 + "İstanbul Kelvin" * 9), (63, "longest" * 9000 + " " + "word stands " * 40)]
    df = spark.createDataFrame([(i, t, "n", "w") for i, t in rows], "doc_id long, text string, n string, word string").repartition(4)
    expected = brute(rows, divisor=13)
    assert sum(x[1] != "None" for x in expected) > 20 and any(x[1] not in ("None", x[2]) for x in expected)
    assert found(variants(df, divisor=13)) == expected
    monkeypatch.setattr(spelling, "PIECE", 100)
    monkeypatch.setattr(spelling, "HELD", 5)
    assert found(variants(df, divisor=13)) == expected


def test_large_lists_are_cut_into_cells(spark, monkeypatch):
    r = random.Random(5)
    ends = {"".join(r.choice("abc") for _ in range(r.randrange(4, 6))) for _ in range(150)}
    rows = [(i, " ".join(f"prefix{e}" for e in sorted(ends))) for i in range(6)] + [(9, "prefixabca " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "CELL", 20)
    assert found(variants(df)) == brute(rows)


def test_empty_table(spark, none):
    assert variants(none).collect() == []


def test_scan_gives_words_within_one_edit():
    r = random.Random(2)
    for letters in ("ab", "abcdef"):
        words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(400)})
        held = SortedList(words, 0)
        for asked in words[:120] + ["", "zzz", "a", "abababababab"]:
            assert list(held.within_one(asked)) == [w for w in words if w == asked or one_edit(w, asked)]


def test_each_pair_is_found_once_under_its_halves():
    r = random.Random(4)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(6, 10))) for _ in range(300)})
    pairs = Counter()
    for size in range(6, 10):
        half = size // 2
        for backward in (False, True):
            lists = {}
            for w in words:
                if len(w) in (size, size + 1):
                    lists.setdefault(w[-(size - half) :] if backward else w[:half], []).append((w, 1))
            for held in lists.values():
                for w, near, _, _ in matched(held, held, size, backward):
                    pairs[w] += near
    assert pairs == Counter({w: n for w in words if (n := sum(one_edit(w, x) for x in words))})


def test_pieces_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 5)
    text = "abcdefgh ij klmnop,qr" + "s" * 30 + " end"
    assert "".join(pieces(text)) == text
    assert [w for p in pieces(text) for w in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)
