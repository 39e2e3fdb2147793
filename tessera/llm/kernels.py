"""Vectorised byte and word kernels shared by the duplicate operators.

Texts stay in the Arrow buffers they arrive in: a group of documents is one uint8 array plus offsets, and every
kernel runs over the whole group, so no Python object is made for a word or a character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NO_ID = np.iinfo(np.int64).max
GROUP_BYTES = 1 << 21
U = np.uint64

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
WORD_BASE = 0xD1B54A32D192ED03

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values; other salts give independent hashes."""
    h = h ^ U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class _Powers:
    """Powers of the base and of its inverse, grown when a longer array comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.cumprod(np.concatenate([[U(1)], np.full(size - 1, base, dtype=np.uint64)]), dtype=np.uint64)
                    for base in (_BASE, _BASE_INV)
                )
        return self.up, self.down


POWERS = _Powers()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def column_ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def ids_out(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, type=pa.int64(), mask=ids == NO_ID)


def groups(ids: np.ndarray, raw: np.ndarray, offs: np.ndarray, size: int = GROUP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Consecutive documents with at most `size` bytes together (one at least): ids, bytes, offsets from 0."""
    i, n = 0, len(ids)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        j = min(j, n)
        yield ids[i:j], raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums C of a polynomial over the bytes, and inverse powers: a span's hash is (C[e] - C[s]) * down[s]."""
    up, down = POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return sums, down


TILE = 1 << 18


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), which are sorted by start; TILE bytes at a time, so memory is bounded."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(starts, a + TILE))
        sums, down = prefix(data[a : ends[i:j].max()])
        s = starts[i:j] - a
        out[i:j] = (sums[ends[i:j] - a] - sums[s]) * down[s]
        i = j
    return out


def counts_by(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of each slice [offs[k], offs[k + 1]) are set."""
    done = np.cumsum(mask, dtype=np.int32)
    at = np.where(offs > 0, done[np.maximum(offs, 1) - 1], 0) if len(done) else np.zeros(len(offs), np.int32)
    return np.diff(at).astype(np.int64)


class Words:
    """The words of a group of documents: byte starts and ends, 64-bit hashes, and each document's first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1 : n + 1] = ~IS_SPACE[data]
        before, after = inside[:n].copy(), inside[2:].copy()
        bounds = offs[(offs > 0) & (offs < n)]
        before[bounds] = False
        after[bounds - 1] = False
        here = inside[1 : n + 1]
        self.starts = np.flatnonzero(here & ~before)
        self.ends = np.flatnonzero(here & ~after) + 1
        self.hashes = mix(span_hashes(data, self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.counts)
        self.last = np.repeat(self.first[1:], self.counts)

    def windows(self, k: int, salt: int = 0) -> np.ndarray:
        """Hashes of the k words from each word on; those that would run past the group's end are left out."""
        n = max(0, len(self.hashes) - k + 1)
        out = np.zeros(n, dtype=np.uint64)
        for t in range(k):
            out *= U(WORD_BASE + 2 * salt)
            out += self.hashes[t : t + n]
        return mix(out, salt + 1)


def pack_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack_bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n).astype(bool)


_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def expand(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return _ZSTD.decompress(memoryview(blob)[8:], decompressed_size=n, asbytes=True) if n else b""


def release() -> None:
    """Give memory that a task has freed back to the system: workers stay, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and release() when they are through."""
    try:
        yield from batches
    finally:
        release()
