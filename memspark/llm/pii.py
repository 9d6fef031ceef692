"""Personal data: base patterns, and a semi-Markov conditional random field.

Base spans are the matches of four patterns that pass their checks.  The field
reads all clauses with digits or an at sign, cut into runs of digits, runs
of letters and single marks.  A segment of some tokens gets a kind and a score
from features of the whole span (its shape, digits, checks, the words before
it); the best joint choice of boundaries and kinds is found by dynamic
programming over segments of bounded length.  Base spans are fixed segments of
every segmentation, so the program chooses among the rest.

It is trained here, on regions whose labels the base patterns give, with base
matches also written in other ways and with mistyped card numbers, so that it
finds entities that the patterns miss.  Regions with a long digit run that no
base span covers are no training text: the patterns don't say what it is.  The
lead over plain text that a span needs is chosen on regions held out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and bounds, kinds in their order.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

#: Tokens of a segment at most and tokens read at a time, rows and snippets of a row a model is fitted on, regions it is fitted on (by hash of their row), passes.
MOST_TOKENS, BLOCK_TOKENS, FIT_ROWS, ROW_SNIPPETS, FIT_REGIONS, PASSES = 24, 400, 2000, 3, 600, 5
#: Leads over plain text, in log-odds, among which the one that does best on every HELD-th region is chosen.
MARGINS, HELD = (0.5, 1.0, 2.0, 3.0, 4.0, 6.0), 5
_DIGIT, _FOUR_DIGITS = re.compile(r"[0-9]"), re.compile(r"[0-9](?:[^0-9]?[0-9]){6}")
_CLAUSE, _WORTH = re.compile(r"[^\n,;]+"), re.compile(r"@|\(at\)|\[at\]|[0-9]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = (int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


#: Runs that a match can lie in; each character is read once, however long a run is.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL: the run before an at sign is scanned once, not from each of its characters."""
    done = 0
    for run in _LOCAL.finditer(text):
        end = run.end()
        start = max(run.start(), done)
        if start < end and text.startswith("@", end) and (domain := _DOMAIN.match(text, end + 1)):
            done = domain.end()
            yield start, done


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of IP with parts of at most 255: each four groups of a dotted run in turn."""
    for run in _DOTTED.finditer(text):
        groups = [m.span() for m in re.finditer(r"[0-9]+", run.group())]
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            if all(_octet(text[run.start() + a : run.start() + b]) for a, b in four):
                yield run.start() + four[0][0], run.start() + four[3][1]


def _octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its checks, by start, then kind; linear in the text."""
    found: list[Span] = []
    if "@" in text:
        found += [("email", *span) for span in _emails(text)]
    if _DIGIT.search(text):
        if text.count(".") > 2:
            found += [("ip", *span) for span in _ips(text)]
        for m in CARD.finditer(text) if _FOUR_DIGITS.search(text) else ():
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def regions(text: str) -> list[tuple[int, int]]:
    """Places worth reading: the whole clauses with a digit or an at sign."""
    return [m.span() for m in _CLAUSE.finditer(text) if _WORTH.search(text, *m.span())]


def _tokens(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _TOKEN.finditer(text, start, end))


def features(text: str, start: int, end: int) -> list[str]:
    """Features of the whole span."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    groups = re.findall(r"[0-9]+", span)
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start])
    n = len(digits)
    out = [
        "bias", f"digits={n if n < 20 else '20+'}", f"groups={min(len(groups), 6)}", f"marks={marks[:8]}", f"first={'+' if span[0] == '+' else 'd' if span[0] in '0123456789' else 'a' if span[0].isalpha() else 'm'}",
        f"last={'d' if span[-1] in '0123456789' else 'a' if span[-1].isalpha() else 'm'}", f"letters={any(c.isalpha() for c in span)}",
        f"joined={'l' if start and text[start - 1].isalnum() else ''}{'r' if end < len(text) and text[end].isalnum() else ''}",
    ]
    if before:
        out.append(f"cue={before[-1].lower()[:8]}" if before[-1].lower() in _CUES else "cue=none")
    if n >= 12:
        out.append(f"luhn={luhn(digits)}")
    if len(groups) == 4 and "." in marks:
        out.append(f"octets={all(map(_octet, groups))}")
    at = re.fullmatch(r"[\w.%+-]+ ?(@|\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+)+", span)
    out.append(f"mail={'sign' if at and at[1] == '@' else 'word' if at else 'no'}")
    return out


#: Words that announce an entity, in several languages.
_CUES = {"tel", "phone", "call", "fax", "mobile", "mail", "email", "card", "visa", "ip", "host", "telefon", "téléphone", "teléfono", "karte", "carte", "tarjeta"}


class SemiCRF:
    """Segments of one token without a kind, or of up to MOST_TOKENS tokens with one."""

    def __init__(self, weights: dict[str, float] | None = None, margin: float = 4.0) -> None:
        self.weights, self.margin, self.features = weights or {}, margin, features

    def _segments(self, text: str, tokens: list[tuple[int, int]], n: int) -> list[list[tuple[int, str, float]]]:
        """By first token, for the first ``n``: last token, kind and score of the segments that may be entities."""
        get = self.weights.get
        out: list[list[tuple[int, str, float]]] = [[] for _ in range(n)]
        parts = [text[a:b] for a, b in tokens]
        at = [p in ("@", "at") for p in parts]
        # A segment has an at sign or 4 digits: sums tell whether any can begin at a token.
        enough = [0, *accumulate(4 if x else min(len(p), 4) if p[0] in "0123456789" else 0 for p, x in zip(parts, at, strict=True))]
        signs = [0, *accumulate(at)]
        for i in range(n):
            a, stop = tokens[i][0], min(i + MOST_TOKENS, len(tokens))
            if enough[stop] - enough[i] < 4 or not (parts[i].isalpha() or parts[i][0] in "0123456789+@(") or (a and text[a - 1].isalnum() and text[a].isalnum()):
                continue
            n_digits, has_at = 0, False
            for j in range(i, stop):
                part = parts[j]
                # Letters belong to mail addresses only, so there must be an at sign by the last token.
                if part.isalpha() and signs[stop] == signs[i]:
                    break
                n_digits += len(part) if part[0] in "0123456789" else 0
                has_at |= at[j]
                if n_digits > 19 and not has_at:
                    break
                if not part[-1].isalnum() or (n_digits < 4 and not has_at):
                    continue
                named = self.features(text, a, tokens[j][1])
                out[i] += [(j, kind, sum(get(f"{kind}|{f}", 0.0) for f in named)) for kind in KINDS]
        return out

    def best(self, text: str, start: int, end: int) -> list[tuple[Span, float]]:
        """Spans of the best segmentation, each with its lead over plain text.

        Tokens are read in blocks; a token's segments are taken up once all
        tokens they may have are there, and scores carry over between blocks.
        """
        more = _tokens(text, start, end)
        # Best score and chain of spans before the token at hand; the same by tokens that end a segment.
        score, chain, ending = 0.0, None, {}
        tokens, first, last = [], 0, False
        while not last:
            new = list(islice(more, BLOCK_TOKENS))
            tokens, last = tokens + new, len(new) < BLOCK_TOKENS
            ready = len(tokens) if last else len(tokens) - MOST_TOKENS + 1
            for i, segments in enumerate(self._segments(text, tokens, ready)):
                for j, kind, lead in segments:
                    if first + j not in ending or score + lead > ending[first + j][0]:
                        ending[first + j] = (score + lead, ((kind, tokens[i][0], tokens[j][1]), lead, chain))
                top = ending.pop(first + i, None)
                if top is not None and top[0] > score:
                    score, chain = top
            tokens, first = tokens[ready:], first + ready
        out = []
        while chain is not None:
            span, lead, chain = chain
            out.append((span, lead))
        return out[::-1]

    def gradient(self, text: str, start: int, end: int, gold: list[Span]) -> dict[str, float]:
        """Of the log-likelihood of ``gold``: its features less those expected, by forward and backward sums."""
        tokens = list(_tokens(text, start, end))
        n = len(tokens)
        by_first = self._segments(text, tokens, n)
        segments: list[list[tuple[int, str, float]]] = [[] for _ in tokens]
        for i in range(n):
            for j, kind, s in by_first[i]:
                segments[j].append((i, kind, s))
        add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        ahead = [0.0] * (n + 1)
        for j in range(n):
            total = ahead[j]
            for i, _, s in segments[j]:
                total = add(total, ahead[i] + s)
            ahead[j + 1] = total
        behind = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            total = behind[i + 1]
            for j, _, s in by_first[i]:
                total = add(total, behind[j + 1] + s)
            behind[i] = total
        out: dict[str, float] = {}
        for j in range(n):
            for i, kind, s in segments[j]:
                p = math.exp(min(0.0, ahead[i] + s + behind[j + 1] - ahead[n]))
                for f in self.features(text, tokens[i][0], tokens[j][1]):
                    out[f"{kind}|{f}"] = out.get(f"{kind}|{f}", 0.0) - p
        reachable = {(kind, tokens[i][0], tokens[j][1]) for j in range(n) for i, kind, _ in segments[j]}
        for span in gold:
            if span in reachable:
                for f in features(text, *span[1:]):
                    out[f"{span[0]}|{f}"] = out.get(f"{span[0]}|{f}", 0.0) + 1
        return out


def _mistyped(card: str) -> str:
    """The number with its last digit raised by one, which fails the check sum."""
    return card[:-1] + str((int(card[-1]) + 1) % 10)


#: Other ways to write an entity, by kind: the field learns them with the base matches' own labels.
_WRITTEN = (
    {"email": lambda s: s.replace("@", " (at) ")}, {"email": lambda s: s.replace("@", "[at]").replace(".", "[dot]")},
    {"phone": lambda s: "00" + s[1:]}, {"phone": lambda s: s.replace(" ", "-")}, {"phone": lambda s: s[1:]},
    {"card": _mistyped}, {"card": lambda s: " ".join(_mistyped(s)[i : i + 4] for i in range(0, len(s), 4)) if s.isdigit() else _mistyped(s)},
)


def _variants(text: str, spans: list[Span]) -> Iterable[tuple[str, list[Span]]]:
    """The text as it is, and with its entities written in other usual ways."""
    yield text, spans
    for change in _WRITTEN:
        parts, moved, at, size = [], [], 0, 0
        if not any(kind in change for kind, _, _ in spans):
            continue
        for kind, a, b in spans:
            new = change.get(kind, str)(text[a:b])
            parts += [text[at:a], new]
            size += a - at
            moved.append((kind, size, size + len(new)))
            size, at = size + len(new), b
        yield "".join([*parts, text[at:]]), moved


def _disjoint(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in spans:
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def _explained(text: str, spans: list[Span]) -> bool:
    """Whether every long digit run lies in a span."""
    return all(any(a <= m.start() and m.end() <= b for _, a, b in spans) for m in _LONG_DIGITS.finditer(text))


_LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){8,}")
Example = tuple[str, int, int, list[Span]]


def examples(texts: list[str]) -> list[Example]:
    """Regions to learn from, with their spans: at most FIT_REGIONS, in the order of ``texts``."""
    found: list[Example] = []
    for text in texts:
        for a, b in regions(text):
            clip = text[max(0, a - 30) : b]
            inside = _disjoint(base_spans(clip))
            for changed, gold in _variants(clip, inside) if _explained(clip, inside) else ():
                found += [(changed, x, y, [g for g in gold if x <= g[1] and g[2] <= y]) for x, y in regions(changed)]
        if len(found) >= FIT_REGIONS:
            break
    return found[:FIT_REGIONS]


def chosen_margin(model: SemiCRF, held: list[Example]) -> float:
    """Of MARGINS the lead with the best F1 over the spans of ``held``; of equal ones the largest."""
    said = [(model.best(text, a, b), set(gold)) for text, a, b, gold in held]
    n_gold = sum(len(gold) for _, gold in said)

    def f1(margin: float) -> float:
        given = [(span, gold) for found, gold in said for span, lead in found if lead >= margin]
        hits = sum(span in gold for span, gold in given)
        return 2 * hits / max(1, len(given) + n_gold)

    return max(MARGINS, key=lambda m: (f1(m), m))


def train(texts: list[str]) -> SemiCRF:
    """Model fitted on the regions of ``texts``; the same texts give the same model."""
    found = examples(texts)
    model, held = SemiCRF(), found[::HELD]
    model.features = cache(features)  # of at most FIT_REGIONS regions, read in every pass
    squares: dict[str, float] = {}
    for _ in range(PASSES):
        for i, (text, a, b, gold) in enumerate(found):
            if i % HELD == 0:
                continue
            for f, g in model.gradient(text, a, b, gold).items():
                squares[f] = squares.get(f, 0.0) + g * g
                if squares[f]:
                    model.weights[f] = (1 - 1e-4) * model.weights.get(f, 0.0) + 0.5 * g / math.sqrt(squares[f])
    model.features = features
    model.margin = chosen_margin(model, held)
    return model


def fit(docs: DataFrame) -> SemiCRF:
    """Model from at most FIT_ROWS documents with a digit run or an at sign: those of least id hash in as many slots.

    Of each the first ROW_SNIPPETS places with such a run, 200 characters to
    each side, are learned from; null ids take no part.
    """
    h = F.xxhash64("doc_id")
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"@|[0-9](?:[^0-9]?[0-9]){6}"))
    chosen = [r.h for r in rows.groupBy(F.pmod(h, F.lit(FIT_ROWS))).agg(F.min(h).alias("h")).collect()]
    if not chosen:
        return SemiCRF()
    snippets = F.slice(F.regexp_extract_all("text", F.lit(r"[^\n]{0,200}(?:@|[0-9](?:[^0-9]?[0-9]){6})[^\n]{0,200}"), F.lit(0)), 1, ROW_SNIPPETS)
    # Rows that repeat an id: the least snippets, so that the rows collected stay within FIT_ROWS.
    texts = docs.filter(h.isin(chosen)).filter("text IS NOT NULL").groupBy(h.alias("h")).agg(F.min(snippets).alias("t")).collect()
    return train(["\n".join(r.t) for r in sorted(texts, key=lambda r: r.h)])


def _free(start: int, end: int, held: list[Span]) -> Iterator[tuple[int, int]]:
    """What base spans leave of a region: as they are fixed, segmentations of the parts are independent."""
    at = start
    for _, a, b in held:
        if b > at and a < end:
            if a > at:
                yield at, a
            at = max(at, b)
    if at < end:
        yield at, end


def all_spans(text: str, model: SemiCRF, base: list[Span] | None = None) -> list[Span]:
    """Base spans and those that the field adds, by start, then kind, then end."""
    held = base_spans(text) if base is None else base
    added, first = [], 0
    for a, b in regions(text) if model.weights else ():
        while first < len(held) and held[first][2] <= a and all(s[2] <= a for s in held[first : first + len(KINDS)]):
            first += 1
        near = []
        for s in held[first:]:
            if s[1] >= b:
                break
            near.append(s)
        for x, y in _free(a, b, near):
            added += [span for span, lead in model.best(text, x, y) if lead >= model.margin]
    return sorted({*held, *added}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detected(docs: DataFrame, model: SemiCRF) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of base spans) and spans (all) of every whole text.

    One row per input row, repeated and null ids included; null and empty texts
    have no spans; other columns are ignored.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    schema = pa.schema([(n, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n in names])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.margin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiCRF(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for text in part.column(1):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_spans(text, own, base))))
                columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, model: SemiCRF) -> DataFrame:
    """``docs``, all columns, with spans masked in text; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.margin))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SemiCRF(*shared.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts = [None if t is None else redacted(t, all_spans(t, own)) for t in (x.as_py() for x in part.column(at))]
                columns = [pa.array(texts, part.schema.field(at).type) if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
