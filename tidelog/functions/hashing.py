"""32-bit hashes of UTF-8 text: FNV-1a as an expression, Murmur3 and xxHash32 over whole Arrow batches in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants that the hash definitions and the reference's results rest on.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
MURMUR_SEED = 0xC58F1A7B
MURMUR_C1, MURMUR_C2, MURMUR_ADD, MURMUR_F1, MURMUR_F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
XX1, XX2, XX3, XX4, XX5 = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1


def fnv1a(text: Column) -> Column:
    """FNV-1a 32 as a long, of a text's UTF-8 bytes (as hex pairs, so that no byte is signed)."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    pairs = F.when(F.length(hexed) > 0, F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long")))
    return F.when(text.isNotNull(), F.aggregate(F.coalesce(pairs, F.array().cast("array<long>")), F.lit(FNV_BASIS).cast("long"), lambda h, b: (h.bitwiseXOR(b) * FNV_PRIME) % (1 << 32)))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint32(r) | x >> np.uint32(32 - r)


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Little-endian 32-bit words that start at the given bytes."""
    b = data.astype(np.uint32)
    return b[at] | b[at + 1] << np.uint32(8) | b[at + 2] << np.uint32(16) | b[at + 3] << np.uint32(24)


def murmur3_many(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = MURMUR_SEED) -> np.ndarray:
    """Murmur3 x86-32 of the byte ranges; word i of all texts that have one is mixed in one numpy step."""
    u = np.uint32
    h = np.full(len(start), seed, u)
    mix = lambda k: _rotl(k * u(MURMUR_C1), 15) * u(MURMUR_C2)
    whole = size // 4
    for i in range(int(whole.max(initial=0))):
        on = np.flatnonzero(whole > i)
        h[on] = _rotl(h[on] ^ mix(_words(data, start[on] + 4 * i)), 13) * u(5) + u(MURMUR_ADD)
    tail, k = size % 4, np.zeros(len(start), u)
    for j in (2, 1, 0):
        on = np.flatnonzero(tail > j)
        k[on] ^= data[start[on] + 4 * whole[on] + j].astype(u) << u(8 * j)
    h ^= mix(k)
    h ^= size.astype(u)
    h ^= h >> u(16)
    h *= u(MURMUR_F1)
    h ^= h >> u(13)
    h *= u(MURMUR_F2)
    return h ^ h >> u(16)


def xxhash32_many(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxHash32 of the byte ranges."""
    u = np.uint32
    stripes = size // 16
    v = [np.full(len(start), (seed + x) & 0xFFFFFFFF, u) for x in (XX1 + XX2, XX2, 0, -XX1)]
    for i in range(int(stripes.max(initial=0))):
        on = np.flatnonzero(stripes > i)
        for lane in range(4):
            v[lane][on] = _rotl(v[lane][on] + _words(data, start[on] + 16 * i + 4 * lane) * u(XX2), 13) * u(XX1)
    h = np.where(stripes > 0, _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18), u((seed + XX5) & 0xFFFFFFFF))
    h += size.astype(u)
    rest = size - 16 * stripes
    for i in range(3):
        on = np.flatnonzero(rest // 4 > i)
        h[on] = _rotl(h[on] + _words(data, start[on] + 16 * stripes[on] + 4 * i) * u(XX3), 17) * u(XX4)
    for j in range(3):
        on = np.flatnonzero(rest % 4 > j)
        h[on] = _rotl(h[on] + data[start[on] + 16 * stripes[on] + 4 * (rest[on] // 4) + j].astype(u) * u(XX5), 11) * u(XX1)
    h ^= h >> u(15)
    h *= u(XX2)
    h ^= h >> u(13)
    h *= u(XX3)
    return h ^ h >> u(16)


def _bytes(text: pd.Series | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = (text if isinstance(text, pa.Array) else pa.array(text, pa.string())).cast(pa.large_binary())
    size = np.diff(np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, 8 * joined.offset))
    start = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, 8 * joined.offset)[:-1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8) if joined.buffers()[2] is not None else np.empty(0, np.uint8)
    return np.concatenate([data, np.zeros(4, np.uint8)]), start, size


def _arrow_hash(kernel: Callable) -> Callable[[Column], Column]:
    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            with np.errstate(over="ignore"):
                yield pd.Series(kernel(*_bytes(text)).astype(np.int64)).where(text.notna().reset_index(drop=True), None).astype("Int64")

    return hashed


def murmur3_array(text: pa.Array) -> np.ndarray:
    """Murmur3 of an Arrow array's texts, for use within a batch; a null is hashed as an empty text."""
    with np.errstate(over="ignore"):
        return murmur3_many(*_bytes(text)).astype(np.int64)


def xxhash32_array(text: pa.Array) -> np.ndarray:
    with np.errstate(over="ignore"):
        return xxhash32_many(*_bytes(text)).astype(np.int64)


def murmur3(text: Column, seed: int = MURMUR_SEED) -> Column:
    """Murmur3 as an unsigned value in a long; null for null."""
    return _arrow_hash(lambda *a: murmur3_many(*a, seed=seed))(text)


def xxhash32(text: Column) -> Column:
    return _arrow_hash(xxhash32_many)(text)
