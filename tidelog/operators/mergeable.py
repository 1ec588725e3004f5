"""State that replicas merge in any order: counters, sets, vector and Lamport clocks, gossip."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gcounter_merge(states: DataFrame) -> DataFrame:
    """``node, n``: the greatest count of each node over all replicas' ``(replica, node, n)``."""
    return states.groupBy("node").agg(F.max("n").alias("n"))


def gcounter_value(states: DataFrame) -> DataFrame:
    return gcounter_merge(states).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value"))


def pncounter_value(states: DataFrame) -> DataFrame:
    """Increments less decrements, each merged per node, of ``(replica, node, pos, neg)``."""
    merged = states.groupBy("node").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    return merged.agg(F.coalesce(F.sum(F.col("pos") - F.col("neg")), F.lit(0)).alias("value"))


def gset_merge(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets).distinct()


def orset_merge(*tags: DataFrame) -> DataFrame:
    """Union of tags ``(item, tag)``; as there are no tombstones, a tag that one replica removed and another has comes back."""
    return reduce(lambda a, b: a.unionByName(b), tags).select("item", "tag").distinct()


def orset_items(tags: DataFrame) -> DataFrame:
    return tags.select("item").distinct()


def orset_observed(tags: DataFrame) -> DataFrame:
    """Items with a tag that no replica removed, of ``(item, tag, removed)``: a concurrent add outlives a remove."""
    return tags.groupBy("item", "tag").agg(F.max("removed").alias("removed")).where("not removed").select("item").distinct()


def clock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def clock_relation(a: Column, b: Column) -> Column:
    """before, after, equal or concurrent; a missing node counts 0."""
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))
    less, more = F.exists(both, lambda d: d < 0), F.exists(both, lambda d: d > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def clocks_merged(clocks: DataFrame, by: str) -> DataFrame:
    """``by, node, n``: the merge of any number of clocks in rows ``(by, node, n)``."""
    return clocks.groupBy(by, "node").agg(F.max("n").alias("n"))


def lamport(events: DataFrame, start: int = 0) -> DataFrame:
    """``process, seq, ts``: own clocks, where a received time (null: none) raises the clock to max(clock, it) + 1.

    The recurrence has a closed form per process: i + max(start, max over j <= i of received_j - (j - 1)).
    """
    own = Window.partitionBy("process").orderBy("seq")
    i = F.row_number().over(own)
    lead = F.max(F.col("received") - (F.col("i") - 1)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("i", i).select("process", "seq", (F.col("i") + F.greatest(F.lit(start), lead)).cast("long").alias("ts"))


def lamport_order(stamps: DataFrame) -> DataFrame:
    """The total order of stamps: by time, then process."""
    return stamps.orderBy("ts", "process")


def gossip_merge(local: DataFrame, received: DataFrame) -> DataFrame:
    """``node, state, version``: the higher version of each node; at equal versions the local state stays."""
    mine = lambda df, first: df.select("node", F.struct("version", F.lit(first).alias("mine"), "state").alias("s"))
    best = mine(local, 1).unionByName(mine(received, 0)).groupBy("node").agg(F.max("s").alias("s"))
    return best.select("node", "s.state", "s.version")
