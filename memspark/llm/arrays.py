"""Columns of text as flat numpy arrays, cut into parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text makes a part of its own.
PART_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_powers = {_MULTIPLIER: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """0th to (n-1)th power of the hash multiplier or its inverse, modulo 2^64."""
    if len(_powers[base]) < n:
        grown = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.cumprod(grown, dtype=np.uint64)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def text_parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its rows and the end) of parts of a string or binary array; null is empty."""
    texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a part, and the row each belongs to."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[offsets[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums of byte times power; ``span_of`` reads the hash of any span off them."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_MULTIPLIER, len(data)), dtype=np.uint64, out=prefix[1:])
    return prefix


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, wherever it stands."""
    prefix = prefix_hashes(data)
    raw = (prefix[ends] - prefix[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * _MIX_1)


def sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by row number."""
    return np.bincount(rows, weights=values, minlength=n)
