"""Repeated passages: bytes covered by a 100-byte string that also starts earlier.

1. Routing.  Each 100-byte window has a key, the least hash among its 16-byte
   grams.  Equal windows have equal keys wherever they stand, so windows of
   different keys need not be compared.  Runs of windows with one key form a
   piece; pieces go, without their text, to the shard of their key.  Equal ones
   of a task are combined before.  Keys that a sample of documents shows to be
   very frequent are dealt by key and content; that changes where pieces are
   compared, not what is found.
2. Equal pieces are settled there: all but the earliest repeat it whole.  Keys
   that are left with one piece are done.
3. Shards of suffixes.  The pieces of other keys, and those in which a key occurs
   again, come with their bytes.  A shard sorts its suffixes by Larsson-Sadakane
   refinement (sort by a prefix, then double it within groups that are still
   tied), takes common prefixes by Kasai's rule, and so finds equal windows.
4. Merging.  A key with very many pieces is spread over several shards.  What
   windows each of them is left with, all different, are dealt by a hash of the
   whole window, so that equal ones meet and no task gets a whole key, and are
   merged in the order of their digests.  They are dealt to as many tasks as
   their bytes need, however many shards they come from.

A window is a repeat if an equal one starts earlier: in a smaller doc_id, or in
the same document before it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.arrays import _INVERSE, mixed, powers, prefix_hashes, span_hashes, text_parts
from memspark.llm.common import written

#: Bytes of a window and of a gram; grams of a window.
LENGTH, GRAM = 100, 16
GRAMS = LENGTH - GRAM + 1
#: Text of a shard when routing, bytes of a shard of suffixes, pieces of one key in a shard, pieces that a task gathers at once.
ROUTED_BYTES, SUFFIX_BYTES, KEY_PIECES, GATHERED = 1 << 23, 1 << 20, 2000, 1 << 20
#: Bytes of left windows that a task merges.
LEFT_BYTES = 1 << 24
#: A key is frequent from so many times KEY_PIECES pieces on, and from such a share of all; one document in so many is sampled for it, at least and at most.
OFTEN, SHARE, SAMPLED, SAMPLED_MOST = 8, 1e-5, 64, 8192
#: Least number of shards that small inputs are spread over.
SPREAD = 48
#: Ids up to which a list of documents is broadcast (some 40 MB as a hash table).
SMALL = 500_000
#: Stretches that Kasai's rule runs over side by side.
LANES = 4096

_PIECES = "shard int, key binary, content binary, doc binary, start binary, count binary, again binary"
_FOUND = "kind string, key long, doc_id long, start int, count int, pieces long"
Frequent = tuple[np.ndarray, np.ndarray]


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of the ``width`` values from each place on (fewer at the end of the array)."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            best(out[:-step], out[step:], out=out[:-step])
        have += step
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of the texts of a part: text number, start in it, windows, key, content hash, whether the key occurs in it again."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int64, np.int64, bool))
    if len(data) < LENGTH:
        return none
    prefix = prefix_hashes(data)
    gram = mixed((prefix[GRAM:] - prefix[:-GRAM]) * powers(_INVERSE, len(data))[: len(data) - GRAM + 1])
    n = len(data) - LENGTH + 1
    least = _sliding(gram, GRAMS, np.minimum)[:n]
    begins, stops = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1)
    has = stops > begins
    change = np.zeros(n + 1, np.int8)
    change[begins[has]] += 1
    np.subtract.at(change, stops[has], 1)
    inside = np.cumsum(change[:-1]).astype(bool)
    new = inside.copy()
    new[1:] &= least[1:] != least[:-1]
    new[begins[has]] = True
    start = np.flatnonzero(new)
    if not len(start):
        return none
    owner = np.searchsorted(offsets, start, "right") - 1
    count = np.minimum(np.append(start[1:], n), stops[owner]) - start
    key = least[start]
    # Grams that are the least of a window of their text; a key twice among those of one text may repeat inside a piece.
    most = np.zeros(len(gram), np.uint64)
    most[:n] = np.where(inside, least, np.uint64(0))
    most = _sliding(most[::-1], GRAMS, np.maximum)[::-1]
    chosen = np.flatnonzero(most == gram)
    mark = mixed(gram[chosen] + mixed((np.searchsorted(offsets, chosen, "right")).astype(np.uint64)))
    values, times = np.unique(mark, return_counts=True)
    twice = values[times > 1]
    own = mixed(key + mixed((owner + 1).astype(np.uint64)))
    at = np.searchsorted(twice, own)
    again = (at < len(twice)) & (twice[np.minimum(at, max(len(twice) - 1, 0))] == own) if len(twice) else np.zeros(len(own), bool)
    content = span_hashes(data, start, start + count + LENGTH - 1)
    return owner, (start - offsets[owner]).astype(np.int32), count.astype(np.int32), key.view(np.int64), content.view(np.int64), again


def _frequent(docs: DataFrame, n_docs: int) -> Frequent:
    """Keys (ascending) of very many pieces and about how many each has, from a sample of documents.

    At most 1 / SHARE keys.  A key that the sample misses takes the usual way.
    """
    one_in = int(min(max(SAMPLED, n_docs // 2_000_000), SAMPLED_MOST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_parts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(pieces(data, offsets)[3])], names=["key"])

    found = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "key long").groupBy("key").count()
    found = written(found.filter("count > 1"), "frequent")
    total = found.agg(F.sum("count")).first()[0] or 0
    rows = found.filter(F.col("count") > max(OFTEN * KEY_PIECES / one_in, SHARE * total)).orderBy("key").collect()
    return np.array([r.key for r in rows], np.int64), np.array([r["count"] * one_in for r in rows], np.int64)


def _times(frequent: Frequent, key: np.ndarray) -> np.ndarray:
    """About how many pieces a frequent key has; 0 for others."""
    keys, times = frequent
    if not len(keys):
        return np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, times[at], 0)


def combined(doc: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, content: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the earliest of equal pieces, whether one of its equals has ``again``, and places of those that start elsewhere."""
    name = mixed(content.view(np.uint64) + mixed(key.view(np.uint64)) + count.astype(np.uint64) * _INVERSE)
    order = np.argsort(name, kind="stable")
    new = np.append(True, name[order][1:] != name[order][:-1]) if len(order) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    part = order[many]
    order[many] = part[np.lexsort((start[part], doc[part], group[many]))]
    first = order[new]
    elsewhere = (doc[order] != doc[first][group]) | (start[order] != start[first][group])  # rows may repeat an id and text
    return first, np.bincount(group, weights=again[order]) > 0, order[elsewhere]


def _routed(docs: DataFrame, shards: int, frequent: Frequent) -> DataFrame:
    """Pieces of all documents, packed by shard; those that repeat another of the same task come apart, with negative shards."""
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def row(shard: np.ndarray, columns: list[list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(pa.array(r, pa.binary()) for r in columns)], names=names)

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, start, count, key, content, again = (np.concatenate(x) for x in zip(*held, strict=True))
        kept, marked, others = combined(doc, start, count, key, content, again)
        for at in range(0, len(others), GATHERED // 8):
            own = others[at : at + GATHERED // 8]
            yield row(np.array([-1 - int(mixed(doc[own[:1]].view(np.uint64))[0] % np.uint64(shards))]), [[x[own].tobytes()] for x in (key, content, doc, start, count, again)])
        doc, start, count, key, content, again = doc[kept], start[kept], count[kept], key[kept], content[kept], marked
        own = key.view(np.uint64) ^ np.where(_times(frequent, key) > 0, mixed(content.view(np.uint64)), np.uint64(0))
        shard = (mixed(own) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        columns = [x[order] for x in (key, content, doc, start, count, again)]
        yield row(shard[order][edges[:-1]], [[x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, data, offsets in text_parts(batch.column(1)):
                owner, start, count, key, content, again = pieces(data, offsets)
                held.append((ids[at + owner], start, count, key, content, again))
                size += len(owner)
                if size >= GATHERED:
                    yield from packed(held)
                    held, size = [], 0
        if size:
            yield from packed(held)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def settle(key: np.ndarray, content: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, repeats, wanted, pieces): equal pieces that start later, and the earliest ones of keys that need their bytes."""
    order = np.lexsort((start, doc, count, content, key))
    k, c, n, d, s, a = key[order], content[order], count[order], doc[order], start[order], again[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new = new_key | np.append(True, (c[1:] != c[:-1]) | (n[1:] != n[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    repeats = (d != d[first]) | (s != s[first])
    group = np.cumsum(new_key) - 1
    distinct = np.bincount(group, weights=new)[group]
    recurs = np.bincount(group, weights=a)[group] > 0
    return order, repeats, new & ((distinct > 1) | recurs), distinct


def _settled(frequent: Frequent):
    """Of a shard of ``_routed``: repeats, and the pieces whose bytes are wanted."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = {"key": np.int64, "content": np.int64, "doc": np.int64, "start": np.int32, "count": np.int32, "again": bool}
        held = {name: np.frombuffer(b"".join(x.as_py() for x in rows.column(name)), kind) for name, kind in kinds.items()}
        if rows.num_rows and rows.column("shard")[0].as_py() < 0:
            use = np.arange(len(held["key"]))
            order, repeats, distinct = use, np.ones(len(use), bool), np.ones(len(use), np.int64)
            use = repeats
        else:
            order, repeats, wanted, distinct = settle(*held.values())
            # A frequent key has its pieces in several shards: all that are no repeats are wanted.
            often = _times(frequent, held["key"][order])
            wanted, distinct = wanted | (~repeats & (often > 0)), np.where(often > 0, often, distinct)
            use = repeats | wanted
        at = order[use]
        said = np.where(repeats[use], "repeat", "wanted")
        return pa.table({
            "kind": pa.array(said.tolist(), pa.string()), "key": held["key"][at], "doc_id": held["doc"][at],
            "start": held["start"][at], "count": held["count"][at], "pieces": pa.array(distinct[use], pa.int64(), safe=False),
        })

    return run


def suffix_order(data: np.ndarray) -> np.ndarray:
    """Suffixes in full order, as Kasai's rule needs it, by Larsson-Sadakane refinement.

    The end of the data counts as smaller than any byte.
    """
    n = len(data)
    padded = np.zeros(n + 7, np.uint64)
    padded[:n] = data
    padded[:n] += np.uint64(1)
    first = np.zeros(n, np.uint64)  # seven bytes at once, of nine bits each: 0 is the end
    for j in range(7):
        first = (first << np.uint64(9)) | padded[j : n + j]
    order = np.argsort(first, kind="stable")
    new = np.append(True, first[order][1:] != first[order][:-1]) if n else np.empty(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.empty(0, np.int64)
    rank[order] = lead + 1  # a group is numbered by its first place; 0 is the end
    h = 7
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        which = order[places]
        key = (rank[which] << 32) | rank[np.minimum(which + h, n)]
        by = np.argsort(key, kind="stable")
        order[places] = which[by]
        key = key[by]
        new[places] = np.append(True, key[1:] != key[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[places]] = lead[places] + 1
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix in ``order`` with the one before it.

    Kasai's rule: going through the text, a prefix shrinks by at most one from a
    place to the next.  Stretches of the text are followed side by side.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    width = max(1, -(-n // LANES))
    at = np.arange(0, n, width)
    end = np.minimum(at + width, n)
    held = np.zeros(len(at), np.int64)
    bytes_ = np.append(data.astype(np.int16), np.int16(-1))
    while len(at):
        other = before[at]
        x, y = at + held, other + held
        go = (other >= 0) & (held < most) & (x < n) & (y < n)
        go &= bytes_[np.minimum(x, n)] == bytes_[np.clip(y, 0, n)]
        stop = ~go
        out[at[stop]] = held[stop]
        held = np.where(go, held + 1, np.maximum(held - 1, 0))
        at = at + stop
        live = at < end
        if not live.all():
            at, end, held = at[live], end[live], held[live]
    return out[order]


def later_windows(data: np.ndarray, begins: np.ndarray, counts: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of the windows of joined pieces, in order, whether an equal one starts earlier."""
    order = suffix_order(data)
    prefix = common_prefixes(data, order, LENGTH)
    piece = np.repeat(np.arange(len(begins)), counts)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    window = np.full(len(data), -1, np.int64)
    window[begins[piece] + nth] = np.arange(len(piece))
    group = np.cumsum(prefix < LENGTH)
    here = window[order]
    is_window = here >= 0
    here, group = here[is_window], group[is_window]
    place = np.lexsort((start[piece[here]] + nth[here], doc[piece[here]], group))
    g, w = group[place], here[place]
    head = np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1]), np.arange(len(g)), 0)) if len(g) else g
    late = np.zeros(len(piece), bool)
    same = (doc[piece[w]] == doc[piece[w[head]]]) & (start[piece[w]] + nth[w] == start[piece[w[head]]] + nth[w[head]])
    late[w] = ~same
    return late


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, ...]:
    count = rows.column("count").to_numpy().astype(np.int64)
    blob = np.frombuffer(b"".join(x.as_py() for x in rows.column("bytes")), np.uint8)
    size = count + LENGTH - 1
    return blob, np.cumsum(size) - size, count, rows.column("doc_id").to_numpy(), rows.column("start").to_numpy().astype(np.int64)


def _spans(flag: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first window and number of windows of each stretch of set flags within a piece."""
    piece = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = flag & ~(np.append(False, flag[:-1]) & (nth > 0))
    last = flag & ~(np.append(flag[1:], False) & (np.append(nth[1:], 0) > 0))
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return piece[a], nth[a], b - a + 1


_SORTED = "kind string, key long, doc_id long, start int, count int, bytes binary"


def _emit(kind: str, rows: pa.Table, piece: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Table:
    return pa.table({
        "kind": pa.array([kind] * len(piece), pa.string()), "key": rows.column("key").to_numpy()[piece], "doc_id": rows.column("doc_id").to_numpy()[piece],
        "start": pa.array(rows.column("start").to_numpy()[piece] + first, pa.int32()), "count": pa.array(count, pa.int32()), "bytes": pa.nulls(len(piece), pa.binary()),
    })


def _digests(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit digests of the windows that start at ``at``, as byte strings in order of their bytes."""
    one, two = span_hashes(data, at, at + LENGTH), mixed(span_hashes(data ^ np.uint8(0x5A), at, at + LENGTH) + _INVERSE)
    return np.stack([one, two], axis=1).astype(">u8")


_LEFT = np.dtype([("one", ">u8"), ("two", ">u8"), ("doc", "<i8"), ("start", "<i8")])


def _suffix_shard(shards: int):
    """Of the pieces of a shard: repeats; of keys spread over several shards also the windows that are left, packed by ``shards`` of their digests."""

    def run(rows: pa.Table) -> pa.Table:
        data, begins, counts, doc, start = _unpacked(rows)
        late = later_windows(data, begins, counts, doc, start)
        found = _emit("repeat", rows, *_spans(late, counts))
        piece = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        own = np.flatnonzero(~late & (rows.column("parts").to_numpy() > 1)[piece])
        held = np.empty(len(own), _LEFT)
        digest = _digests(data, begins[piece[own]] + nth[own]) if len(own) else np.empty((0, 2), ">u8")
        held["one"], held["two"], held["doc"], held["start"] = digest[:, 0], digest[:, 1], doc[piece[own]], start[piece[own]] + nth[own]
        to = (held["one"].astype(np.uint64) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((held["two"], held["one"], to))
        edges = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
        packs = [held[order[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        n = len(packs)
        left = pa.table({
            "kind": pa.array(["left"] * n, pa.string()), "key": pa.array(to[order][edges[:-1]], pa.int64()), "doc_id": np.zeros(n, np.int64),
            "start": np.zeros(n, np.int32), "count": np.zeros(n, np.int32), "bytes": pa.array(packs, pa.binary()),
        })
        return pa.concat_tables([found, left])

    return run


def merged_lists(lists: list[np.ndarray]) -> np.ndarray:
    """Which of the windows of several lists (each without equals) repeat an earlier start: one sort of them all, by digest, then place."""
    held = np.concatenate(lists)
    one, two = held["one"].astype(np.uint64), held["two"].astype(np.uint64)
    order = np.lexsort((held["start"], held["doc"], two, one))
    late = np.zeros(len(held), bool)
    late[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    return late


def _merged_shards(rows: pa.Table) -> pa.Table:
    """Repeats among the left windows of different shards whose digests were dealt here."""
    lists = [np.frombuffer(x.as_py(), _LEFT) for x in rows.column("bytes")]
    late = merged_lists(lists)
    found = np.concatenate(lists)[late]
    order = np.lexsort((found["start"], found["doc"]))
    doc, start = found["doc"][order], found["start"][order]
    first = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)) if len(doc) else np.empty(0, bool)
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(doc)))
    n = len(begin)
    return pa.table({
        "kind": pa.array(["repeat"] * n, pa.string()), "key": rows.column("key").to_numpy()[:1].repeat(n) if n else np.empty(0, np.int64),
        "doc_id": doc[begin].astype(np.int64), "start": pa.array(start[begin], pa.int32()), "count": pa.array(count, pa.int32()), "bytes": pa.nulls(n, pa.binary()),
    })


def _listed(spans: DataFrame) -> DataFrame:
    """doc_id and its spans; a document has no more spans than bytes."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count", "key", "parts")).alias("spans"))


def _few(ids: DataFrame) -> bool:
    return ids.count() <= SMALL


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted pieces with their bytes."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("count", pa.int32()), ("parts", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text, spans in zip(*(batch.column(k) for k in range(3)), strict=True):
                data = text.as_py().encode()
                # A row that shares its id with a longer one may lack a span.
                held = [s for s in spans.as_py() if s["start"] + s["count"] + LENGTH - 1 <= len(data)]
                rows = [(s["key"], i.as_py(), s["start"], s["count"], s["parts"], data[s["start"] : s["start"] + s["count"] + LENGTH - 1]) for s in held]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    ids = wanted.select("doc_id").distinct()
    # Few documents are found before their texts are shuffled; with many the join itself finds them.
    held = docs.join(F.broadcast(ids), "doc_id", "left_semi") if _few(ids) else docs
    joined = held.join(_listed(wanted), "doc_id").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "key long, doc_id long, start int, count int, parts long, bytes binary").distinct()


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, start and count: stretches of ``count`` windows from ``start`` on that repeat earlier ones.

    Rows with a null id or text take no part.  Rows that share an id count as
    one document, whose windows start at the same places in each of their texts;
    spans found in one are cut to each text.
    """
    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    total, n_docs = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(SPREAD, math.ceil(total / ROUTED_BYTES))
    frequent = _frequent(held, n_docs)
    found = written(_routed(held, shards, frequent).groupBy("shard").applyInArrow(_settled(frequent), _FOUND), "settled")
    wanted = found.filter("kind = 'wanted'").withColumn("parts", F.ceil(F.col("pieces") / KEY_PIECES).cast("long"))
    size = wanted.agg(F.sum(F.col("count") + LENGTH)).first()[0] or 0
    runs = found.filter("kind = 'repeat'").select("doc_id", "start", "count")
    if not size:
        return runs
    n = max(SPREAD, math.ceil(size / SUFFIX_BYTES))
    cut = _cut(held, wanted).withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(n)).cast("int"))
    spread = wanted.filter("parts > 1").agg(F.sum("count")).first()[0] or 0
    merging = max(SPREAD, math.ceil(spread * _LEFT.itemsize / LEFT_BYTES))
    compared = written(cut.groupBy("shard").applyInArrow(_suffix_shard(merging), _SORTED), "suffixes")
    left = compared.filter("kind = 'left'")
    merged = left.groupBy("key").applyInArrow(_merged_shards, _SORTED)
    later = compared.filter("kind = 'repeat'").unionByName(merged)
    return runs.unionByName(later.select("doc_id", "start", "count"))


def stripped(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document.

    One row per input row.  Null texts count as empty; texts under 100 bytes,
    and rows with a null id, keep all bytes.  Rows that share an id are described
    under ``repeats``.  Other columns are ignored.  With ``digest`` the remaining
    bytes come as kept_sha256, in hex.
    """
    spans = written(repeats(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("spans")), "spans")
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = spans.select("doc_id")
    if _few(ids):
        touched = own.join(F.broadcast(ids), "doc_id", "left_semi").join(spans, "doc_id").select("doc_id", "text", "spans")
        none = F.lit(None).cast("array<struct<start:int,count:int>>")
        rows = touched.unionByName(own.join(F.broadcast(ids), "doc_id", "left_anti").select("doc_id", "text", none.alias("spans")))
    else:
        rows = own.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    last = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), last])

    def strip(doc_id: int | None, text: str, found: list[dict] | None) -> tuple:
        data, removed, n_spans = text.encode(), 0, 0
        size = len(data)
        if found:
            edge = np.zeros(size + 1, np.int64)
            start = np.minimum([s["start"] for s in found], size)
            np.add.at(edge, start, 1)
            np.subtract.at(edge, np.minimum(start + [s["count"] for s in found] + LENGTH - 1, size), 1)
            gone = np.cumsum(edge[:-1]) > 0
            removed, n_spans = int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
            data = np.frombuffer(data, np.uint8)[~gone].tobytes()
        return doc_id, size, removed, n_spans, hashlib.sha256(data).hexdigest() if digest else data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [strip(i.as_py(), t.as_py(), s.as_py()) for i, t, s in zip(*(part.column(k) for k in range(3)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last[0]} {'string' if digest else 'binary'}")
