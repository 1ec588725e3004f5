"""Leader and follower logs, and quorum reads, writes and repair over versioned replica cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.log import live
from tidelog.operators.ordered import previous, running


def entries_after(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") > seq)


def refused_appends(entries: DataFrame) -> DataFrame:
    """``pos, seq`` of entries, in order of arrival, whose number isn't above 0 and above all that came before; a log takes none of them."""
    seen = running(entries.select("pos", "seq", F.col("seq").alias("_s")), "_s", "max", "pos")
    numbers = previous(seen.select("pos", "seq", "seen"), "seen", "pos")
    return numbers.where((F.col("seq") <= 0) | (F.col("seq") <= F.col("before"))).select("pos", "seq")


def latest_seq(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("latest_seq"))


def follower_state(log: DataFrame, followers: DataFrame) -> DataFrame:
    """``follower, key, value``: what each follower holds, having applied the log up to its ``hwm``."""
    own = log.join(F.broadcast(followers), F.col("seq") <= F.col("hwm"))  # a row a follower
    last = own.groupBy("follower", "key").agg(F.max(F.struct("seq", "op", "value")).alias("last"))
    return last.where("last.op = 'put'").select("follower", "key", F.col("last.value").alias("value"))


def with_follower(followers: DataFrame, name: str) -> DataFrame:
    """Another follower, which has nothing yet; one that is known stays as it is."""
    new = followers.sparkSession.createDataFrame([(name, 0)], "follower string, hwm long")
    return followers.unionByName(new.join(followers.select("follower"), "follower", "left_anti"))


def without_follower(followers: DataFrame, name: str) -> DataFrame:
    return followers.where(F.col("follower") != name)


def lag(log: DataFrame, followers: DataFrame) -> DataFrame:
    return followers.join(F.broadcast(latest_seq(log)), F.lit(True)).select("follower", (F.col("latest_seq") - F.col("hwm")).alias("lag"))


def leader_state(log: DataFrame) -> DataFrame:
    return live(log).select("key", "value")


def check_quorum(n: int, w: int, r: int) -> None:
    if not (n >= 1 and 1 <= w <= n and 1 <= r <= n and w + r > n):
        raise ValueError("needs 1 <= W, R <= N and W + R > N")


def availability(replicas: DataFrame, changes: DataFrame) -> DataFrame:
    """``replica, available``: the last of ``(seq, replica, available)`` decides, and all are available at first; an unknown replica is an error."""
    known = replicas.select("replica", F.lit(True).alias("known"))
    last = changes.groupBy("replica").agg(F.max_by("available", "seq").alias("available"))
    both = F.broadcast(known).join(last, "replica", "full")
    unknown = F.raise_error(F.concat(F.lit("unknown replica "), F.col("replica"))).cast("boolean")
    return both.select("replica", F.when(F.col("known").isNull(), unknown).otherwise(F.coalesce("available", F.lit(True))).alias("available"))


def quorum_write(writes: DataFrame, available: DataFrame, w: int) -> DataFrame:
    """``version, replica, success``: each write goes to the first W available replicas; fewer are kept, without success."""
    placed = writes.select("version").join(F.broadcast(available.select("version_from", "version_to", "replica")), F.col("version").between(F.col("version_from"), F.col("version_to")))
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy("version").orderBy("replica"))).where(F.col("k") <= w)
    return ranked.select("version", "replica", (F.count("*").over(Window.partitionBy("version")) >= w).alias("success"))


def quorum_read(cells: DataFrame, r: int) -> DataFrame:
    """``key, value, version, n_replicas, ok``: the highest version over all replicas that answer; ok if R answer."""
    best = cells.groupBy("key").agg(F.max(F.struct("version", "value")).alias("best"), F.count_distinct("replica").alias("n_replicas"))
    return best.select("key", "best.value", "best.version", "n_replicas", (F.col("n_replicas") >= r).alias("ok"))


def read_repair(cells: DataFrame, replicas: DataFrame) -> DataFrame:
    """``replica, key, value, version``: cells to write where an available replica misses a key or has an older version."""
    best = cells.groupBy("key").agg(F.max(F.struct("version", "value")).alias("best"))
    held = cells.groupBy("replica", "key").agg(F.max("version").alias("held"))
    every = best.join(F.broadcast(replicas.select("replica").distinct()), F.lit(True))  # a row a replica
    behind = every.join(held, ["replica", "key"], "left").where(F.col("held").isNull() | (F.col("held") < F.col("best.version")))
    return behind.select("replica", "key", "best.value", "best.version")
