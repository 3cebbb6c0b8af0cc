"""Hashes of the words of many texts at once, on the bytes of an Arrow column.

A word's hash is a polynomial of its bytes modulo 2**64, read off prefix sums,
so that a whole batch needs a few passes over its bytes and no loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kpisleuth.llm.common import worker_memory

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, grown on demand."""
    kept = worker_memory("powers", dict)
    if "both" not in kept or len(kept["both"][0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))

        def run(base):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        kept["both"] = (run(BASE), run(inverse))
    return kept["both"]


def byte_values(lower: bool) -> np.ndarray:
    values = salts(256, 7)
    if lower:
        values[65:91] = values[97:123]
    return values


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def columns(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the offsets of each row (a null row is empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of rows whose bytes together stay near ``size``."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


class Words:
    """Words of a chunk of rows.

    ``starts`` and ``ends`` count bytes from the chunk's first; ``rows[i]`` is the
    index of row i's first word; ``hash`` gives the hash of any byte ranges.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, gaps: np.ndarray = SPACE):
        base = int(offsets[0])
        self.bytes = part = data[base: int(offsets[-1])]
        self.offsets = rows = offsets - base
        n = len(part)
        inside = ~gaps[part]
        start, stop = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        firsts, lasts = rows[:-1][rows[:-1] < n], rows[1:][rows[1:] > 0] - 1
        start[firsts], stop[lasts] = inside[firsts], inside[lasts]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.rows = np.searchsorted(self.starts, rows)
        up, self._down = powers(n + 1)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(byte_values(lower)[part] * up[:n], out=self._sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray):
    """Hash of each word, and each row's first word index."""
    found = Words(data, offsets)
    return found.hash(found.starts, found.ends), found.rows
