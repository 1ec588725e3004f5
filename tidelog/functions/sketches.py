"""Bloom and counting Bloom filters as relations of set positions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import murmur3, murmur3_array, xxhash32, xxhash32_array


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for n items at a false-positive rate p; halves are rounded to even."""
    if n < 1 or not 0 < p < 1:
        raise ValueError("needs n >= 1 and 0 < p < 1")
    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return bits, max(1, round(bits / n * math.log(2)))


def positions(h1: Column, h2: Column, bits: int, hashes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: ((h1 + i * h2) % (1 << 32)) % bits)


def positions_array(text: pa.Array, bits: int, hashes: int) -> np.ndarray:
    """``positions`` of an Arrow array's texts, a row a text."""
    h1, h2 = murmur3_array(text)[:, None], xxhash32_array(text)[:, None]
    return (h1 + np.arange(hashes) * h2) % (1 << 32) % bits


def with_positions(items: DataFrame, item: str, bits: int, hashes: int) -> DataFrame:
    hashed = items.withColumns({"_h1": murmur3(F.col(item).cast("string")), "_h2": xxhash32(F.col(item).cast("string"))})
    return hashed.withColumn("positions", positions(F.col("_h1"), F.col("_h2"), bits, hashes)).drop("_h1", "_h2")


def bloom_build(items: DataFrame, item: str, bits: int, hashes: int) -> DataFrame:
    """``pos``: the set bits, ``bits`` rows at most."""
    return with_positions(items.select(item), item, bits, hashes).select(F.explode("positions").alias("pos")).distinct()


def bloom_probe(probes: DataFrame, item: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``item, maybe``: whether all of an item's positions are set."""
    at = with_positions(probes.select(item).distinct(), item, bits, hashes).select(item, F.explode("positions").alias("pos"))
    hit = at.join(filter_.select("pos", F.lit(1).alias("one")), "pos", "left")
    return hit.groupBy(item).agg((F.count("one") == F.count("*")).alias("maybe"))


def counting_build(changes: DataFrame, item: str, delta: str, bits: int, hashes: int) -> DataFrame:
    """``pos, n``: additions less removals of items that were there, by position; no count falls below 0."""
    per = changes.groupBy(item).agg(F.sum(delta).alias("d"))
    at = with_positions(per, item, bits, hashes).select("d", F.explode("positions").alias("pos"))
    return at.groupBy("pos").agg(F.greatest(F.sum("d"), F.lit(0)).alias("n")).where("n > 0")


def counting_count(probes: DataFrame, item: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``item, n``: the least count over an item's positions; 0 says that it isn't there."""
    at = with_positions(probes.select(item).distinct(), item, bits, hashes).select(item, F.explode("positions").alias("pos"))
    return at.join(filter_, "pos", "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
