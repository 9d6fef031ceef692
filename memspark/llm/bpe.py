"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until the halves are short; halves are encoded by themselves
and neighbours are joined.  A join re-encodes a window around the boundary and
widens it until the tokens outside provably stay as they are: the splitting
pattern has no match with white space after another character, nor with a letter
next to a digit, so the place between two such characters is a border of matches
in every context.
Once the window starts and ends at such places, what lies outside is encoded the
same with and without the neighbour.  The join is associative, so any bracketing
gives the same tokens.  Decoding concatenates up the same kind of tree.

The pattern must have the properties named above, as those of the usual
byte-level vocabularies have.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a leaf when encoding, ids of a leaf when decoding, first reach of a window to each side.
TEXT_LEAF, ID_LEAF, REACH = 256, 4096, 64
#: A place that splits matches in every context: between the two characters.
_BORDER = re.compile(r"\S(?=[ \t\n\r])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    """Encoder and decoder for one vocabulary and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.bytes_of = codec.encode_ordinary, codec.decode_bytes
        self.size = {rank: len(token) for token, rank in ranks.items()}

    def _drop(self, ids: list[int], n_bytes: int, step: int) -> int:
        """How many ids at the end (step -1) or the start (1) have ``n_bytes`` bytes together."""
        count, at = 0, -1 if step < 0 else 0
        while n_bytes > 0:
            n_bytes -= self.size[ids[at]]
            at, count = at + step, count + 1
        return count

    def join(self, left: str, right: str, left_ids: list[int], right_ids: list[int]) -> list[int]:
        """Ids of ``left + right`` from those of both."""
        reach = REACH
        start = end = -1
        while start < 0 or end < 0:
            if start < 0:
                at = max(0, len(left) - reach)
                found = [m.end() + at for m in _BORDER.finditer(left[at:])]
                start = found[-1] if found else 0 if at == 0 else -1
            if end < 0:
                found = _BORDER.search(right[:reach])
                end = found.end() if found else len(right) if reach >= len(right) else -1
            reach *= 4
        inner = self.leaf(left[start:] + right[:end])
        head = len(left_ids) - self._drop(left_ids, len(left[start:].encode()), -1)
        return left_ids[:head] + inner + right_ids[self._drop(right_ids, len(right[:end].encode()), 1) :]

    def encode(self, text: str) -> list[int]:
        if len(text) <= TEXT_LEAF:
            return self.leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, right, self.encode(left), self.encode(right))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= ID_LEAF:
            return self.bytes_of(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_workers: dict[tuple[str, str], ByteBPE] = {}


def _worker(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _workers:
        _workers[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _workers[path, pattern]


def _each(docs: DataFrame, make: Callable[[str], tuple], names: str, schema: pa.Schema) -> DataFrame:
    """``make`` of every text, beside doc_id; 256 rows are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = zip(*(make(t.as_py() or "") for t in part.column(1)), strict=True)
                columns = [part.column(0), *(pa.array(x, f.type) for x, f in zip(made, list(schema)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, names)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text, without special tokens.

    One row per input row, repeated and null ids included; a null text counts as
    empty and has no ids.  Other columns are ignored.  An empty table gives an
    empty table.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _each(docs, lambda text: (_worker(ranks_path, pattern).encode(text),), "doc_id long, ids array<int>", schema)


def decoded(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and data (binary): the bytes of the rows of ``encoded``; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(ranks_path, pattern)
        for batch in batches:
            data = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, as ``encoded`` and ``decoded`` give them.

    Both directions run in one pass, so the ids are never stored.
    """

    def make(text: str) -> tuple:
        bpe = _worker(ranks_path, pattern)
        ids = bpe.encode(text)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _each(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", schema)
