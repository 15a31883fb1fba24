"""Vectorised words and shingles over Arrow string columns.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``. Words are hashed by a
polynomial modulo 2**64 over their bytes, finished with an avalanche step; shingles likewise over
their words' hashes. Nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE, _STEP = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95)
_SPAN = 1 << 20
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit changes half the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each (one more than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some texts: where each starts and ends, and each text's first word (one more than texts)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray | None = None) -> Words:
    """Words of texts; ``blank`` may give, for each of 256 bytes, whether it separates words."""
    inside = ~(((data == 32) | ((data >= 9) & (data <= 13))) if blank is None else blank[data])
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    edges = offsets
    head = before[:-1].copy()
    head[edges[:-1][edges[:-1] < len(data)]] = False
    tail = after[1:].copy()
    ends_of = edges[1:][edges[1:] > 0] - 1
    tail[ends_of] = False
    starts = np.flatnonzero(inside & ~head)
    ends = np.flatnonzero(inside & ~tail) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets), _hash_words(data, starts, ends, lower))


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _SPAN)))
        base, end = int(starts[at]), int(ends[to - 1])
        span = data[base:end].astype(np.uint64)
        if lower:
            span += np.uint64(32) * ((span >= 65) & (span <= 90))
        up, down = _power_tables(max(len(span) + 1, _SPAN + 4096))
        sums = np.zeros(len(span) + 1, dtype=np.uint64)
        np.cumsum((span + np.uint64(1)) * up[: len(span)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEP
        at = to
    return mix(out)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``k`` words, whatever text they are in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    step = _STEP + np.uint64(2 * seed)
    out = np.full(n, np.uint64(k + 1000003 * seed), dtype=np.uint64)
    for j in range(k):
        out *= step
        out += hashes[j : j + n]
    return mix(out)


def shingles(w: Words, k: int) -> list[np.ndarray]:
    """For each text its shingle hashes in order; fewer than ``k`` words make one shingle, no word none."""
    runs = grams(w.hashes, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        out.append(runs[a : b - k + 1] if b - a >= k else grams(w.hashes[a:b], b - a) if b > a else runs[:0])
    return out


def pieces(texts: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``limit`` bytes at most: (from, to, bytes, offsets)."""
    data, offsets = buffers(texts)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def binary(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def list_of(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive runs of ``flat``."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat, type=kind))
