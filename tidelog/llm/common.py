"""What the corpus operators share: small helpers over Arrow batches, and bitmaps that thin out a shuffle."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.scratch import clear_scratch, materialize, shared_dir

__all__ = ["binary", "bitmap", "clear_scratch", "in_bitmap", "materialize", "mix", "shared_dir", "slices", "trimmed", "word_hashes"]

#: A bitmap has 16 bits for each key, but 16 MiB at most: with more keys more rows pass, and what follows drops them.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Bits of one of Spark's bitmaps.
CHUNK = 1 << 15
#: Powers of an odd number, which tell a word's letters apart by their place; they repeat in words beyond their number.
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
#: Bytes whose words are hashed at once, so that a long text takes a bounded table.
HASHED_BYTES = 2 << 20


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts in ``column`` hold about ``most_bytes`` (one row at least)."""
    start = size = 0
    for i, x in enumerate(batch.column(column)):
        n = len(x.as_buffer() or b"") if x.is_valid else 0
        if size and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives free memory back; workers go on to other stages."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return inner


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of unsigned longs over all bits."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def word_hashes(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of ``data`` starts and ends, and its hash. Words are what is between the bytes in ``gap``, of which the last is one."""
    gaps = np.flatnonzero(gap)
    start = np.append(0, gaps[:-1] + 1)
    start, end = start[start < gaps], gaps[start < gaps]
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + HASHED_BYTES)))
        low, high = start[at], end[stop - 1]
        place = np.arange(low, high) - np.repeat(start[at:stop], np.diff(start[at:stop], append=high))
        part = (data[low:high].astype(np.uint64) + np.uint64(1)) * POWERS[place % len(POWERS)]
        part[gaps[np.searchsorted(gaps, low) : np.searchsorted(gaps, high)] - low] = 0
        out[at:stop] = np.add.reduceat(part, start[at:stop] - low)
        at = stop
    return start, end, mix(out)


def bitmap(keys: DataFrame, column: str) -> bytes:
    """A bit for the low bits of every key (a hash, as a long), of MOST_BITS bits at most.

    It only thins out rows ahead of an exact join. Spark builds it in chunks of CHUNK bits, so what reaches the driver is bounded, too.
    """
    bits = min(MOST_BITS, max(CHUNK, 1 << (BITS_EACH * keys.count()).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1  # Spark counts positions from 1
    chunks = keys.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in chunks.toLocalIterator():
        out[(row["k"] - 1) * CHUNK // 8 : row["k"] * CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def in_bitmap(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    table = np.frombuffer(bits, np.uint8)
    at = keys & np.int64(8 * len(table) - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
