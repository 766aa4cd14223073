"""Vectorised views of text columns inside Arrow batches.

A kernel sees one `Block` of whole texts at a time. Blocks hold about `BLOCK_BYTES` (or one longer
text), so a worker's memory follows the longest text and not the batch or the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 19
U64 = np.uint64
Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@dataclass
class Block:
    """Whole texts as one byte array. off has one more entry than there are texts; null texts are empty."""

    buf: np.ndarray
    off: np.ndarray
    null: np.ndarray
    rows: pa.RecordBatch

    @property
    def n(self) -> int:
        return len(self.off) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.off)

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_binary(col.type) or pa.types.is_string(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    null = np.asarray(col.is_null())
    if null.any():
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off, null


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    buf, off, null = _column(batch, text)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield Block(buf[off[a] : off[b]], off[a : b + 1] - off[a], null[a:b], batch.slice(a, b - a))
        a = b


def trim() -> None:
    """Gives freed memory back to the system: a worker is kept for the next task, beside an executor that needs the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Kernel) -> Kernel:
    """run, with the worker's memory trimmed at the end of each task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return kernel


def map_blocks(df: DataFrame, fn: Callable[[Block], pa.RecordBatch | None], schema: str, text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """df's rows go block by block through fn, on the executors and in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text, limit):
                if (out := fn(block)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(trimmed(run), schema)


# --- bytes, words and hashes -------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z: digits, letters, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words [^\x20\x09-\x0D]+.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def words(block: Block, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in block.buf, and the text's number, of each maximal run of bytes of the table."""
    if not len(block.buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    on = table[block.buf]
    edge = np.zeros(len(on) + 1, bool)
    edge[block.off] = True
    before = np.empty(len(on), bool)
    before[0] = False
    before[1:] = on[:-1]
    starts = np.flatnonzero(on & (~before | edge[:-1]))
    after = np.empty(len(on), bool)
    after[-1] = False
    after[:-1] = on[1:]
    ends = np.flatnonzero(on & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(block.off, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    h = h ^ (h >> U64(33))
    h = h * U64(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    h ^= h >> U64(33)
    h *= U64(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    h ^= h >> U64(33)
    return h


class Rolling:
    """Hashes of any substrings from one prefix sum: sum T[byte] * P**position, modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 60)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, BLOCK_BYTES + 2)
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, np.uint64(base))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf))
        s = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.up[: len(buf)], out=s[1:])
        return s

    def of(self, s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((s[end] - s[start]) * self.down[start])

    def every(self, s: np.ndarray, k: int) -> np.ndarray:
        """The hash of each k bytes."""
        n = len(s) - k
        return mix((s[k:] - s[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


@lru_cache(4)
def rolling(seed: int) -> Rolling:
    return Rolling(seed)


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    d = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list for each count, from the values in order."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
