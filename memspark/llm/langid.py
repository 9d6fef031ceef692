"""Language identification by cross-parsing.

A suffix automaton of each language's labelled text holds all its substrings.
A text is parsed against a language greedily: each phrase is the longest match
that the automaton allows.  The language that needs the fewest phrases per
character wins.

Parsing reads forward transitions only.  Where alphabets are small the automata
are one dense table (state x character class -> next state, and whether a phrase
ended); else a hash table of the transitions that there are, so its size grows
with the characters learned, whatever the alphabet.  It is built once, on the
driver, and broadcast.  Long
texts are walked in many stretches side by side: a stretch that began in another
state than the one before it ended in is walked again from there, until all
meet, so the result is that of one walk over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows (one for each hash slot) that a language is fitted on at most; rows up to ROW_CHARS characters
#: come first; of all rows LANG_CHARS characters are learned, or an equal share of ALL_CHARS where there are many languages.
SLOTS, ROW_CHARS, LANG_CHARS, ALL_CHARS = 64, 4000, 24000, 2_000_000
#: Entries of a dense table at most; languages whose states are walked at once.
DENSE, TOGETHER = 16_000_000, 16
#: Characters of a stretch of text; where stretches end does not change the result.
STRETCH = 256
#: Characters handled at once.
PART = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)

Trained = list[tuple[str, str]]


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton; state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        here = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in move[p]:
            move[p][c] = here
            p = link[p]
        if p != -1:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return move


#: Of code points below 0x10000 the lower-case letter, or a space.
_FOLD = np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else 0x20 for c in range(0x10000)], np.uint32)


def _normal(text: str) -> np.ndarray:
    """Code points, lower-cased, with a space for each character that is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    far = points > 0xFFFF
    out = _FOLD[np.where(far, 0x20, points)]
    for c in np.unique(points[far]):
        if chr(c).isalpha():
            out[points == c] = c
    return out


class Hashed:
    """A map of whole numbers, at least 0, to others: an open-addressed table that is at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2 - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        todo, slot, self.probes = np.arange(len(keys)), self._slots(keys), 0
        while len(todo):
            free = self.keys[slot] == -1
            first = np.zeros(len(todo), bool)
            first[np.unique(np.where(free, slot, -1 - np.arange(len(todo))), return_index=True)[1]] = True
            wins = free & first
            self.keys[slot[wins]], self.values[slot[wins]] = keys[todo[wins]], values[todo[wins]]
            todo, slot, self.probes = todo[~wins], (slot[~wins] + 1) & (len(self.keys) - 1), self.probes + 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, or -1."""
        slot = self._slots(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], -1)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.keys) - 1)
            hit = self.keys[slot] == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            open_ = ~hit & (self.keys[slot] != -1)
            todo, slot = todo[open_], slot[open_]
        return out


class CrossParser:
    """Automata of several languages in one table."""

    def __init__(self, trained: Trained) -> None:
        texts: dict[str, list[np.ndarray]] = {}
        for lang, text in trained:
            texts.setdefault(lang, []).append(np.append(_normal(text), np.uint32(0x20)))
        self.langs = sorted(texts)
        joined = [np.concatenate(texts[lang]) for lang in self.langs]
        self.alphabet = np.unique(np.concatenate([np.array([0x20], np.uint32), *joined]))
        self.width = len(self.alphabet) + 2  # and the class of unknown characters, and that of the padding
        self.pad = len(self.alphabet) + 1
        keys, values, self.starts, at = [], [], [], 0
        for text in joined:
            move = suffix_automaton(self.classes(text))
            counts = np.fromiter((len(m) for m in move), np.int64, len(move))
            state = np.repeat(np.arange(at, at + len(move)), counts)
            keys.append(state * self.width + np.fromiter((c for m in move for c in m), np.int64, len(state)))
            values.append((at + np.fromiter((to for m in move for to in m.values()), np.int64, len(state))).astype(np.int32))
            self.starts.append(at)
            at += len(move)
        self.states = at
        keys, values = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, values))
        self.hashed, self.table = None, None
        if at * self.width > DENSE:
            self.hashed = Hashed(keys, values)
            return
        # Next state and whether a phrase ended on the way to it: where a state has no transition, the start has its turn.
        self.table = np.empty((at, self.width), np.int32)
        bounds = [*self.starts, at]
        state, cls = np.divmod(keys, self.width)
        for a, b in zip(bounds, bounds[1:], strict=False):
            root = np.full(self.width, a * 2 + 1, np.int32)
            first = state == a
            root[cls[first]] = values[first] * 2 + 1
            self.table[a:b] = root
        self.table[state, cls] = values * 2
        self.table[:, self.pad] = np.arange(at) * 2
        self.table = self.table.ravel()

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Place of each code point in the alphabet, or the class of unknown characters."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet)).astype(np.int32)

    def _step(self, state: np.ndarray, cls: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after a character, and whether a phrase ended before it."""
        if self.hashed is None:
            step = self.table[state * self.width + cls]
            return (step >> 1).astype(np.int64), step & 1
        to = self.hashed.get(state * self.width + cls).astype(np.int64)
        ended = (to < 0) & (cls != self.pad)
        again = self.hashed.get(start[ended] * self.width + cls[ended])
        to[ended] = np.where(again < 0, start[ended], again)
        return np.where(cls == self.pad, state, to), ended.astype(np.int64)

    def phrases(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases (language x text) of texts that end at ``ends`` in ``points``."""
        n = len(ends)
        begins = np.concatenate([[0], ends[:-1]])
        lanes = -(-(ends - begins) // STRETCH)
        owner = np.repeat(np.arange(n), lanes)
        m = len(owner)
        if not m:
            return np.ones((len(self.langs), n))
        first = begins[owner] + (np.arange(m) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * STRETCH
        length = np.minimum(STRETCH, ends[owner] - first)
        wide = np.arange(int(length.max()))[:, None]
        known = self.classes(points)
        classes = np.where(wide < length, known[np.minimum(first + wide, len(points) - 1)], self.pad)
        heads = np.append(True, owner[1:] != owner[:-1])
        starts = np.array(self.starts, np.int64)
        counts = [self._walked(starts[at : at + TOGETHER], classes, heads) for at in range(0, len(starts), TOGETHER)]
        return 1 + np.stack([np.bincount(owner, weights=row, minlength=n) for part in counts for row in part])

    def _walked(self, starts: np.ndarray, classes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Phrases that end in each stretch, of some languages."""
        m = classes.shape[1]
        # State that each stretch was walked from, the one it ended in, and phrases ended on the way.
        walked = np.repeat(starts[:, None], m, 1)
        lang, lane = np.divmod(np.arange(len(starts) * m), m)
        final, count = np.empty_like(walked), np.empty_like(walked)
        while len(lang):
            state, ended, start = walked[lang, lane], np.zeros(len(lang), np.int64), starts[lang]
            for column in classes:
                state, over = self._step(state, column[lane], start)
                ended += over
            final[lang, lane], count[lang, lane] = state, ended
            due = np.where(heads, walked, np.roll(final, 1, axis=1))
            lang, lane = np.nonzero(due != walked)
            walked = due
        return count

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        points = [_normal(t) for t in texts]
        ends = np.cumsum([len(p) for p in points])
        letters = np.array([bool((p != 0x20).any()) for p in points])
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        counts = self.phrases(np.concatenate(points), ends)
        best = counts.argmin(0)
        ordered = np.sort(counts, 0)
        # By how much fewer phrases the winner needs than the next language does.
        score = 1 - ordered[0] / np.maximum(ordered[1], 1) if len(self.langs) > 1 else np.ones(len(texts))
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0).tolist()


def fit(docs: DataFrame, learn: object) -> Trained:
    """Labelled text of every language, of the rows for which ``learn`` holds.

    Bounded: of each language one row in each of SLOTS slots, of least id hash
    among those of up to ROW_CHARS characters (else the shortest), and of these
    rows LANG_CHARS characters, or an equal share of ALL_CHARS; the last row is
    cut there.
    """
    h = F.xxhash64("doc_id")
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rank = F.struct(F.greatest(F.length("text"), F.lit(ROW_CHARS)).alias("size"), h.alias("h"), F.length("text").alias("chars"))
    least = rows.groupBy("lang", F.pmod(h, F.lit(SLOTS)).alias("slot")).agg(F.min(rank).alias("r")).select("lang", "r.*").collect()
    share = max(1, min(LANG_CHARS, ALL_CHARS // max(1, len({r.lang for r in least}))))
    taken, held = {}, {}
    for r in sorted(least, key=lambda r: (r.size, r.h)):
        left = share - held.get(r.lang, 0)
        if left > 0:
            held[r.lang] = held.get(r.lang, 0) + r.chars
            taken[r.lang, r.h] = left
    # Rows that repeat an id and language: the least text.  No more than a language's share leaves the executors.
    cut = F.substring("text", 1, share)
    found = rows.filter(h.isin(sorted({x for _, x in taken}))).groupBy("lang", h.alias("h")).agg(F.min(cut).alias("text")).collect() if taken else []
    return [(r.lang, r.text[: taken[r.lang, r.h]]) for r in sorted(found, key=lambda r: (r.lang, r.h)) if (r.lang, r.h) in taken]


def predicted(docs: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, lang_pred and score of every whole text.

    One row per input row, repeated and null ids included; other columns are
    ignored.  Null texts and texts without a letter are ``und`` with score 0, as
    is everything when no language was learned.  Ties go to the smaller name.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(trained))  # at most DENSE entries, or some 60 bytes for each character learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, total = [], 0
                while at + len(texts) < batch.num_rows and (not texts or total < PART):
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    total += len(texts[-1])
                langs, scores = shared.value.predict(texts)
                columns = [batch.column(0).slice(at, len(texts)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
