"""Spelling variants: words one edit apart, found on sorted lists.

A list of words is scanned in order with the edit matrix of the asking word kept
as a stack of rows, three cells each (a band of one edit either way).  The next
word reuses the rows of the prefix that it shares with the last (their longest
common prefix, LCP); where a row exceeds one edit in all cells, every further
word with that prefix is passed over.

Lists are small because an edit leaves one half of the shorter word alone: words
meet under that half, read forward or backward, so every pair is found, and once.
Lists that stay large are cut into a grid of cells.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import written

#: Characters of a text whose words are counted at once; words that a task counts before it passes them on.
PIECE, HELD = 1 << 20, 200_000
#: Words of a list, and of those that ask it, in one cell.
CELL = 4096
_RUN, _OTHER = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
KEYED = "size int, backward boolean, half string, asks_in int, listed_in int, asks boolean, listed boolean, word string, n long"
FOUND = "word string, n_near long, near_n long, near string"


def pieces(text: str) -> Iterator[str]:
    """The text in stretches of bounded length that cut no run of letters."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def vocabulary(docs: DataFrame, divisor: int, least_length: int, least_count: int) -> DataFrame:
    """word and n of the lower-cased letter runs of all texts, runs that a hash picks with one code point less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in pieces(text.as_py() or ""):
                    for found, times in Counter(_RUN.findall(piece)).items():
                        word = lowered(found)
                        h = zlib.crc32(word.encode(), start)
                        if h % divisor == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) >= least_length:
                            total[word] += times
                if len(total) > HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(total.values(), pa.int64())})
                    total = Counter()
        if total:
            yield pa.RecordBatch.from_pydict({"word": list(total), "n": pa.array(total.values(), pa.int64())})

    each = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class SortedList:
    """Words in order, with what a scan needs to reuse rows and to pass over ranges."""

    def __init__(self, words: list[str], shared: int):
        self.words, self.shared = sorted(words), shared
        self.lcp = [shared]
        for a, b in zip(self.words, self.words[1:], strict=False):
            k, most = shared, min(len(a), len(b))
            while k < most and a[k] == b[k]:
                k += 1
            self.lcp.append(k)
        # For each place the next one that shares less with its predecessor.
        self.next, stack = [len(words)] * len(words), []
        for i, k in enumerate(self.lcp):
            while stack and self.lcp[stack[-1]] > k:
                self.next[stack.pop()] = i
            stack.append(i)

    def within_one(self, asked: str) -> Iterator[str]:
        """Words at most one edit from ``asked``; all words here share their first ``shared`` code points with it."""
        words, lcp, n, length = self.words, self.lcp, len(self.words), len(asked)
        rows: list[tuple[int, int, int]] = [(2, 2, 2)] * (length + 3)
        known = self.shared
        rows[known] = (1 if known else 2, 0, 1)
        padded = asked + "\0\0"  # beyond its end nothing matches
        at = 0
        while at < n:
            word = words[at]
            depth = known = min(known, lcp[at])
            left, mid, right = rows[depth]
            end = len(word)
            # Cells of a row: distance of the word's first depth code points to the first depth - 1, depth, depth + 1 of the other.
            while depth < end and depth <= length:
                c = word[depth]
                left = min(mid + 1, left + (depth == 0 or padded[depth - 1] != c))
                mid = min(right + 1, mid + (padded[depth] != c), left + 1) if depth < length else 2
                right = min(right + (padded[depth + 1] != c), mid + 1) if depth + 1 < length else 2
                depth += 1
                rows[depth] = (left, mid, right)
                if left > 1 and mid > 1 and right > 1:
                    break
            known = depth
            if depth == end:
                if abs(length - end) <= 1 and (left, mid, right)[length - end + 1] <= 1:
                    yield word
                at += 1
                continue
            at += 1
            while at < n and lcp[at] >= depth:
                at = self.next[at]


def matched(asking: list[tuple[str, int]], listed: list[tuple[str, int]], size: int, backward: bool) -> Iterator[tuple[str, int, int, str]]:
    """word, number of near words, count and spelling of the best, of the askers that have any; the shorter word of a pair has ``size`` code points."""
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    half = size // 2
    counts = {turn(w): n for w, n in listed}
    ordered = SortedList(list(counts), size - half if backward else half)
    for word, _ in asking:
        own, near, best = turn(word), 0, None
        for other in ordered.within_one(own):
            if other == own or min(len(other), len(own)) != size:
                continue
            spelled = turn(other)
            if backward and spelled[:half] == word[:half]:
                continue  # found forward
            near += 1
            rank = (-counts[other], spelled)
            best = rank if best is None or rank < best else best
        if near:
            yield word, near, -best[0], best[1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    out: list[tuple[str, int, int, str]] = []
    table = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "near_n", "near"])
    for (size, backward, *_), cell in groupby(rows(), lambda r: r[:5]):
        held = list(cell)
        if len(held) > 1:
            out += matched([r[7:] for r in held if r[5]], [r[7:] for r in held if r[6]], size, backward)
        if len(out) > HELD:
            yield table()
            out = []
    if out:
        yield table()


def keyed(words: DataFrame, least_length: int) -> DataFrame:
    """``words`` (word, n) under each half that a near word may share: size of the shorter word, backward, half."""
    length = F.length("word")
    sizes = F.filter(F.array(length, length - 1), lambda x: x >= least_length)
    forward = F.transform(sizes, lambda x: F.struct(x.alias("size"), F.lit(False).alias("backward"), F.substring("word", F.lit(1), F.floor(x / 2).cast("int")).alias("half")))
    rest = lambda x: (x - F.floor(x / 2)).cast("int")
    backward = F.transform(sizes, lambda x: F.struct(x.alias("size"), F.lit(True).alias("backward"), F.substring("word", length - rest(x) + 1, rest(x)).alias("half")))
    return words.select("word", "n", F.explode(F.concat(forward, backward)).alias("k")).select("k.*", "word", "n")


def near_words(words: DataFrame, least_length: int) -> DataFrame:
    """word, n_near, near_n and near of all ``words`` (word, n); near_n and near are null without a near word."""
    key = ["size", "backward", "half"]
    under = keyed(words, least_length)
    sizes = under.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    under = under.join(sizes, key)
    series = lambda m: F.sequence(F.lit(0), m - 1)
    cells = F.ceil(F.col("m") / CELL).cast("int")
    small = under.filter(F.col("m") <= CELL).select(*key, F.lit(0).alias("asks_in"), F.lit(0).alias("listed_in"), F.lit(True).alias("asks"), F.lit(True).alias("listed"), "word", "n")
    large = under.filter(F.col("m") > CELL).withColumn("own", F.pmod(F.xxhash64("word"), cells).cast("int"))
    asks = large.withColumn("listed_in", F.explode(series(cells))).select(*key, F.col("own").alias("asks_in"), "listed_in", F.lit(True).alias("asks"), F.lit(False).alias("listed"), "word", "n")
    listed = large.withColumn("asks_in", F.explode(series(cells))).select(*key, "asks_in", F.col("own").alias("listed_in"), F.lit(False).alias("asks"), F.lit(True).alias("listed"), "word", "n")
    place = [*key, "asks_in", "listed_in"]
    every = small.unionByName(asks).unionByName(listed).repartition(*place).sortWithinPartitions(*place)
    found = every.mapInArrow(_scan, FOUND)
    none = words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("near_n"), F.lit(None).cast("string").alias("near"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("r"), "near"))).alias("best")
    merged = found.unionByName(none).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", (-F.col("best.r")).alias("near_n"), F.col("best.near").alias("near"))


def rooted(forms: DataFrame, hops: int) -> DataFrame:
    """``forms`` (word, form and others) with root, the last word on the way along forms, of at most ``hops`` steps."""
    links, reach = written(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("to")), "forms"), 1
    while reach < hops and not links.isEmpty():
        on = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        links = written(links.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to")), "hops")
        reach *= 2
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def variants(docs: DataFrame, divisor: int = 199, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of all texts.

    Words are the maximal runs of Latin letters (to U+00FF), lower-cased in A-Z
    only; where ``divisor`` divides the crc32 of ``<doc_id>:<run>`` (an empty id for
    null) the run loses the code point at the hash modulo its length.  Of these,
    words of ``least_length`` code points and ``least_count`` occurrences count.
    Words one inserted, deleted or replaced code point apart are near.  A word's
    form is its commonest near word (ties: the least in code-point order), if it is
    ``ratio`` times as common; its root is where the way along forms ends.

    Null and empty texts have no words, repeated rows count again, and very long
    texts are counted piece by piece.  An empty table gives no rows; other columns
    are ignored.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 the way along forms need not end")
    words = written(vocabulary(docs, divisor, least_length, least_count), "words")
    best = near_words(words, least_length).join(words, "word")
    is_form = F.col("near_n") >= ratio * F.col("n")
    forms = best.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    forms, most, hops = written(forms, "near"), words.agg(F.max("n")).first()[0] or 1, 0
    while ratio ** (hops + 1) <= most:
        hops += 1
    return rooted(forms, hops).select("word", "form", "root", "n", "n_near", "form_n")
