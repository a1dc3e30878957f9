"""Vectorised word and window hashing over Arrow string buffers.

Texts are handled as one byte buffer per slice of documents, so that no Python
code runs per word.  Words are the maximal runs of bytes outside
``\\x20\\x09-\\x0D`` (which never occur inside a multi-byte UTF-8 sequence).
A word's hash is a polynomial over its bytes modulo 2**64, read off prefix sums;
a window's hash is a polynomial over the mixed hashes of its words, so it
depends on the word sequence alone and not on the white space between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers of the byte polynomial and of two word polynomials.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
SLICE_BYTES = 1 << 20


def settle() -> None:
    """Gives memory that a worker no longer uses back to the system; workers live on between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def frugal(run):
    """``run`` over batches, settling after each of its results."""

    def wrapped(batches):
        for out in run(batches):
            yield out
            settle()
        settle()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, factor, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


class Hasher:
    """Holds the power tables; one per task."""

    def __init__(self):
        self.powers = {b: Powers(b) for b in (BYTE_BASE, WORD_BASE, WORD_BASE_2)}

    def _polynomial(self, values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.powers[base].upto(len(values) + 1)
        prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=prefix[1:])
        return prefix, down

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each of the byte ranges [starts, ends)."""
        prefix, down = self._polynomial(BYTE_CODES[data], BYTE_BASE)
        return mix((prefix[ends] - prefix[starts]) * down[starts])

    def windows(self, hashes: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
        """A 64-bit hash of each k consecutive word hashes (len(hashes) - k + 1 of them)."""
        if len(hashes) < k:
            return np.zeros(0, dtype=np.uint64)
        prefix, down = self._polynomial(hashes, base)
        n = len(hashes) - k + 1
        return mix((prefix[k:] - prefix[:-k]) * down[:n])

    def ranges(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each range of words [starts, ends)."""
        prefix, down = self._polynomial(hashes, WORD_BASE)
        return mix((prefix[ends] - prefix[starts]) * down[starts])


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offs


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each document's first word."""
    inside = IS_WORD[data]
    n = len(data)
    inner = offsets[(offsets > 0) & (offsets < n)]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[inner] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole documents of about ``limit`` bytes."""
    raw, offs = string_buffers(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1)
        yield row, end, raw[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end
