"""Change logs ``(key, value, seq, op)`` with op 'put' or 'del', and reads that resolve them.

A store is the last writer's row of every key. ``latest`` groups on the key, so that a filter on keys reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import numbered

PUT, DELETE = "put", "del"


def puts(df: DataFrame, key: Column, value: Column, seq: Column) -> DataFrame:
    return df.select(key.alias("key"), value.alias("value"), seq.cast("long").alias("seq"), F.lit(PUT).alias("op"))


def change_log(df: DataFrame, key: Column, value: Column, seq: Column, deleted: Column) -> DataFrame:
    """A log in which rows where ``deleted`` is true are tombstones without a value; null keys are refused."""
    op = F.when(deleted, DELETE).otherwise(PUT)
    return df.where(key.isNotNull()).select(key.alias("key"), F.when(~F.coalesce(deleted, F.lit(False)), value).alias("value"), seq.cast("long").alias("seq"), op.alias("op"))


def append(*logs: DataFrame) -> DataFrame:
    """Bulk put: logs one after another; the greater seq wins."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


def latest(log: DataFrame) -> DataFrame:
    """The last row of each key, tombstones included. Partial aggregation keeps one row a key and task."""
    last = F.max(F.struct("seq", "op", "value"))
    return log.groupBy("key").agg(last.alias("last")).select("key", "last.value", "last.seq", "last.op")


def live(log: DataFrame) -> DataFrame:
    """Keys and values that a full scan of the store returns."""
    return latest(log).where(F.col("op") == PUT).select("key", "value", "seq")


def get(log: DataFrame, key) -> DataFrame:
    return live(log.where(F.col("key") == key))


def multi_get(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, value, found`` of every wanted key. Only the wanted keys' rows are aggregated."""
    keys = wanted.select("key").distinct()
    held = live(log.join(keys, "key", "left_semi"))
    return keys.join(held, "key", "left").select("key", "value", F.col("seq").isNotNull().alias("found"))


def contains(wanted: DataFrame, log: DataFrame) -> DataFrame:
    return wanted.join(live(log).select("key"), "key", "left_semi")


def missing(wanted: DataFrame, log: DataFrame) -> DataFrame:
    return wanted.join(live(log).select("key"), "key", "left_anti")


def scan_range(log: DataFrame, low, high) -> DataFrame:
    """Live rows with low <= key <= high; none if low > high."""
    return live(log.where(F.col("key").between(low, high)))


def ordered_scan(log: DataFrame) -> DataFrame:
    """``key, value, n``: the live rows by key, numbered from 0."""
    return numbered(live(log).select("key", "value"), "key")


def bounds(log: DataFrame) -> DataFrame:
    """``min_key, min_value, max_key, max_value`` of the live rows."""
    ends = live(log).agg(F.min(F.struct("key", "value")).alias("a"), F.max(F.struct("key", "value")).alias("z"))
    return ends.select(F.col("a.key").alias("min_key"), F.col("a.value").alias("min_value"), F.col("z.key").alias("max_key"), F.col("z.value").alias("max_value"))


def after_clear(log: DataFrame, cleared_at: int) -> DataFrame:
    """What is live if the store was emptied at a sequence number."""
    return live(log.where(F.col("seq") > cleared_at))
