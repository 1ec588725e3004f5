"""Sorted tables: order checks, sparse indexes, floor lookups and merges; offset and secondary indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import numbered, offsets, previous, running

__all__ = ["floor_lookup", "merge", "offsets", "out_of_order", "place", "secondary_index", "secondary_lookup", "sparse_index"]


def out_of_order(entries: DataFrame) -> DataFrame:
    """Entries ``(pos, key)`` whose key isn't above the one before; a sorted table is refused if there are any. Null keys aren't compared."""
    return previous(entries, "key", "pos").where(F.col("key") <= F.col("before")).select("pos", "key")


def sparse_index(entries: DataFrame, order: str, size: Column, interval: int) -> DataFrame:
    """Key and offset of every ``interval``-th entry from the first."""
    return offsets(entries, order, size).where(F.col("n") % interval == 0)


def floor_lookup(probes: DataFrame, index: DataFrame) -> DataFrame:
    """For each probe ``key``, the greatest index ``key`` at or below it and its offset; null if there is none.

    An as-of join: both sides are in one order, where the greatest index entry so far is carried on.
    """
    entry = "struct<k:long,o:long>"
    both = probes.select("key", F.lit(1).alias("kind"), F.lit(None).cast(entry).alias("e")).unionByName(index.select("key", F.lit(0).alias("kind"), F.struct(F.col("key").cast("long").alias("k"), F.col("offset").cast("long").alias("o")).alias("e")))
    found = running(both, "e", "max", "key", "kind").where("kind = 1")
    return found.select("key", F.col("seen.k").alias("index_key"), F.col("seen.o").alias("offset"))


def merge(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Union of two tables with unique keys; on equal keys the other's value, even a null, wins."""
    a, b = mine.select("key", F.col("value").alias("a")), other.select("key", F.col("value").alias("b"), F.lit(True).alias("hit"))
    return a.join(b, "key", "full").select("key", F.when(F.col("hit"), F.col("b")).otherwise(F.col("a")).alias("value"))


def secondary_index(rows: DataFrame, extracted: Column, key: str = "key") -> DataFrame:
    """``index_key, key``: the distinct primary keys of each extracted value, a row each; rows without a value aren't indexed.

    A value that most keys have is many rows, not one long one. Written sorted by both, a lookup reads a few row groups.
    """
    return rows.select(extracted.alias("index_key"), F.col(key).alias("key")).where("index_key is not null").distinct()


def secondary_lookup(rows: DataFrame, extracted: Column, wanted, key: str = "key") -> DataFrame:
    return rows.where(extracted == wanted).select(F.col(key).alias("key")).distinct()


def place(entries: DataFrame, *order: str) -> DataFrame:
    """Rank of each entry by a composite key, column by column."""
    return numbered(entries, *order)
