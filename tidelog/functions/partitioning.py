"""Which partition or node a key belongs to: by hash, range, ring and highest random weight."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import murmur3, murmur3_array

VNODES = 150
#: Scores of keys and nodes that a task has at a time.
SCORES = 1 << 18


def hash_partition(key: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("needs a partition")
    return murmur3(key.cast("string")) % n


def range_partition(key: Column, boundaries: list) -> Column:
    """Partition 0 is below the first boundary; a key at a boundary belongs to its right."""
    if any(a >= b for a, b in zip(boundaries, boundaries[1:], strict=False)):
        raise ValueError("boundaries must rise")
    out = F.lit(0)
    for b in boundaries:
        out = out + F.when(key >= b, 1).otherwise(0)
    return out


def range_span(low: Column, high: Column, boundaries: list) -> Column:
    """First and last partition that a range of keys touches."""
    return F.struct(range_partition(low, boundaries).alias("first"), range_partition(high, boundaries).alias("last"))


def signed(h: Column) -> Column:
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def ring(nodes: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """``hash, node``: the virtual nodes of ``(node, ord)``; where two collide, the node added last has the place."""
    every = nodes.select("node", "ord", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    hashed = every.select("node", "ord", "i", signed(murmur3(F.concat_ws("#", "node", F.col("i").cast("string")))).alias("hash"))
    return hashed.groupBy("hash").agg(F.max_by("node", F.struct("ord", "i")).alias("node"))


def _at(keys: DataFrame, places: DataFrame, *held: str) -> DataFrame:
    """``key, held``: columns of the first place at or after each key's hash, else of the first of all.

    The ring has nodes x vnodes places, so it is one sorted array beside every key, searched by bisection.
    """
    sorted_places = places.agg(F.array_sort(F.collect_list(F.struct("hash", *held))).alias("ring"))
    hashed = keys.select("key", signed(murmur3(F.col("key").cast("string"))).alias("h"))
    both = hashed.join(F.broadcast(sorted_places), F.lit(True))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = (acc["lo"] < acc["hi"]) & (F.get("ring", middle)["hash"] < F.col("h"))
        return F.struct(F.when(below, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(below | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(middle).alias("hi"))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), F.size("ring").alias("hi")), halve, lambda acc: acc["lo"])
    found = both.select("key", F.get("ring", (at % F.size("ring")).cast("int")).alias("place"))
    return found.select("key", *(F.col(f"place.{c}").alias(c) for c in held))


def ring_lookup(keys: DataFrame, places: DataFrame) -> DataFrame:
    """``key, node``: the first place at or after a key's hash, else the first of all."""
    return _at(keys, places, "node")


def ring_replicas(keys: DataFrame, places: DataFrame, count: int) -> DataFrame:
    """``key, k, node``: the next ``count`` distinct nodes clockwise, fewer if there are fewer.

    They are the same for all keys of a place, so they are found once a place, by pairs of the ring's places, and read off by lookup.
    """
    here = places.select(F.col("hash").alias("at"))
    far = here.join(F.broadcast(places), F.lit(True)).groupBy("at", "node").agg(F.min(F.pmod(F.col("hash") - F.col("at"), F.lit(1 << 32))).alias("d"))
    near = far.groupBy("at").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "node"))), 1, count).alias("near"))  # a row a node in each
    nodes = near.select(F.col("at").alias("hash"), F.transform("near", lambda x: x["node"]).alias("nodes"))
    return _at(keys, nodes, "nodes").select("key", F.posexplode("nodes").alias("k", "node")).select("key", (F.col("k") + 1).alias("k"), "node")


def rendezvous(keys: DataFrame, nodes: DataFrame, count: int = 1) -> DataFrame:
    """``key, k, node``: the nodes with the highest hashes of ``key:node``; the node added first wins a tie.

    The nodes, a few, come to the driver. A key is scored with all of them where it is, in batches, so no pair is a row that is sorted or
    shuffled. Of a key that comes several times, each of its rows counts: every node has as many places, if ``count`` is above 1.
    """
    named = [r["node"] for r in nodes.select("node", "ord").orderBy("ord").collect()]
    kind = dict(keys.dtypes)["key"]
    step = max(1, SCORES // max(1, len(named)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                texts = (pc.binary_join_element_wise(part.column("text"), pa.scalar(n, part.column("text").type), ":", null_handling="skip") for n in named)
                scores = np.stack([murmur3_array(t) for t in texts], axis=1)
                best = np.argsort(-scores, axis=1, kind="stable")
                times = part.column("times").to_numpy() if count > 1 else np.ones(part.num_rows, np.int64)
                for k in range(min(count, len(named) * int(times.max()))):
                    rank = k // times
                    on = np.flatnonzero(rank < len(named))
                    node = pa.array(named, pa.string()).take(pa.array(best[on, rank[on]]))
                    yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(on)), pa.array(np.full(len(on), k + 1, np.int32)), node], ["key", "k", "node"])

    if not named:
        return keys.sparkSession.createDataFrame([], f"key {kind}, k int, node string")
    each = keys.select("key").repartition("key").groupBy("key").agg(F.count("*").alias("times"))  # shuffled first: few keys come twice
    return each.select("key", F.col("key").cast("string").alias("text"), "times").mapInArrow(run, f"key {kind}, k int, node string")
