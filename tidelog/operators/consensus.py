"""Votes, commit indexes and log matching of a replicated log, as queries over what nodes sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def granted_votes(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """``voter, term, candidate``: each voter's first request of a term, of those whose log is no older than its own.

    requests: ``seq, voter, term, candidate, last_term, last_index``; voters: ``voter, own_last_term, own_last_index``.
    """
    current = F.struct("last_term", "last_index") >= F.struct("own_last_term", "own_last_index")
    fit = requests.join(F.broadcast(voters), "voter").where(current)
    return fit.groupBy("voter", "term").agg(F.min(F.struct("seq", "candidate")).alias("first")).select("voter", "term", "first.candidate")


def tally(votes: DataFrame, n_nodes: int) -> DataFrame:
    """``term, candidate, votes, leader``: a leader has more than half of the nodes' votes."""
    counted = votes.groupBy("term", "candidate").agg(F.count_distinct("voter").alias("votes"))
    return counted.select("term", "candidate", "votes", (2 * F.col("votes") > n_nodes).alias("leader"))


def commit_index(log: DataFrame, matches: DataFrame, current_term: int) -> DataFrame:
    """The greatest index that more than half of the nodes have and whose entry is of the current term; -1 if none.

    log: ``idx, term``; matches: ``node, match_index``. With the matches sorted, the majority's is the middle one.
    """
    ranked = matches.select("match_index", F.row_number().over(Window.orderBy(F.desc("match_index"))).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))  # a row a node
    major = ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("match_index")
    return log.join(F.broadcast(major), F.col("idx") <= F.col("match_index")).where(F.col("term") == current_term).agg(F.coalesce(F.max("idx"), F.lit(-1)).cast("long").alias("commit_index"))


def committed(log: DataFrame, index: DataFrame) -> DataFrame:
    return log.join(F.broadcast(index), F.col("idx") <= F.col("commit_index")).select(*log.columns)


def divergence(leader: DataFrame, followers: DataFrame) -> DataFrame:
    """``node, first_conflict``: the first index at which a follower's entry has another term than the leader's."""
    mine = leader.select("idx", F.col("term").alias("leader_term"))
    return followers.join(mine, "idx").where(F.col("term") != F.col("leader_term")).groupBy("node").agg(F.min("idx").alias("first_conflict"))


def append_entries(log: DataFrame, entries: DataFrame, previous_index: int, previous_term: int) -> DataFrame:
    """``idx, term, command`` of a follower's log after it got a leader's entries.

    They are refused, and the log stays, unless it has the previous entry with its term (an index of -1 always
    matches). The log is cut off at the first entry of another term than the leader's, and the leader's are added.
    """
    matches = F.broadcast(log.where((F.col("idx") == previous_index) & (F.col("term") == previous_term)).agg((F.count("*") > 0).alias("ok")))  # one row
    sent = entries.select("idx", F.col("term").alias("sent"))
    cut = F.broadcast(log.join(sent, "idx").where(F.col("term") != F.col("sent")).agg(F.min("idx").alias("cut")))  # one row
    ok = F.col("ok") | F.lit(previous_index < 0)
    kept = log.join(matches, F.lit(True)).join(cut, F.lit(True)).where(~ok | F.col("cut").isNull() | (F.col("idx") < F.col("cut"))).select("idx", "term", "command")
    added = entries.join(matches, F.lit(True)).where(ok).select("idx", "term", "command")
    return kept.join(added.select("idx"), "idx", "left_anti").unionByName(added)
