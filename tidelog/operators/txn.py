"""Snapshot reads and serializability checks over an event log ``(seq, txn, op, key, value)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordered import running
from tidelog.scratch import materialize


def states(ops: DataFrame) -> DataFrame:
    """``txn, begin_seq, end_seq, state``; the first commit or abort decides, and without one it is active."""
    ends = F.when(F.col("op").isin("commit", "abort"), F.struct("seq", "op"))
    found = ops.groupBy("txn").agg(F.min(F.when(F.col("op") == "begin", F.col("seq"))).alias("begin_seq"), F.min(ends).alias("end"))
    state = F.when(F.col("end.op") == "commit", "committed").when(F.col("end.op") == "abort", "aborted").otherwise("active")
    return found.select("txn", "begin_seq", F.col("end.seq").alias("end_seq"), state.alias("state"))


def snapshot_reads(ops: DataFrame) -> DataFrame:
    """``seq, txn, key, value``: what every read sees: the last write before it that is its own or was committed when its transaction began.

    Two lookups in time, no pairs of reads and writes: the last own write so far in each transaction, and the last
    write among those of each key that were committed before the transaction began. What comes after its
    transaction's end isn't written.
    """
    rows = ops.where("op in ('read', 'write')").join(states(ops), "txn")
    version = F.struct(F.col("seq").alias("w_seq"), "value")
    mine = Window.partitionBy("txn", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.max(F.when(F.col("op") == "write", version)).over(mine))
    reads = rows.where("op = 'read'").select("key", F.col("begin_seq").alias("t"), F.lit(0).alias("kind"), "seq", "txn", "own", F.lit(None).cast("struct<w_seq:long,value:string>").alias("version"))
    writes = rows.where("op = 'write' and state = 'committed' and seq < end_seq").select("key", F.col("end_seq").alias("t"), F.lit(1).alias("kind"), "seq", "txn", F.lit(None).cast("struct<w_seq:long,value:string>").alias("own"), version.alias("version"))
    seen = running(reads.unionByName(writes), "version", "max", "t", "kind", "seq", group="key").where("kind = 0")
    return seen.select("seq", "txn", "key", F.greatest("own", "seen")["value"].alias("value"))


def conflict_pairs(ops: DataFrame) -> DataFrame:
    """Pairs ``(reader, writer)`` of concurrent transactions that both committed where one read a key the other wrote.

    Time is cut into spans of a mean transaction's length, and only transactions in one span of a key meet; a pair is
    found in the span in which the later of both began.
    """
    known = materialize(states(ops).where("state = 'committed'"), "committed")
    span = known.agg(F.greatest(F.ceil(F.avg(F.col("end_seq") - F.col("begin_seq"))), F.lit(1)).alias("s")).first()["s"] or 1
    at = lambda c: F.floor(F.col(c) / span)

    def side(op: str, name: str) -> DataFrame:
        held = ops.where(F.col("op") == op).select("txn", "key").distinct().join(known, "txn")
        return held.select("key", F.col("txn").alias(name), F.col("begin_seq").alias(f"{name}_b"), F.col("end_seq").alias(f"{name}_e"), F.explode(F.sequence(at("begin_seq"), at("end_seq"))).alias("span"))

    both = side("read", "reader").join(side("write", "writer"), ["key", "span"])
    met = (F.col("reader_b") < F.col("writer_e")) & (F.col("writer_b") < F.col("reader_e")) & (F.col("span") == F.floor(F.greatest("reader_b", "writer_b") / span))
    return both.where((F.col("reader") != F.col("writer")) & met).select("reader", "writer").distinct()


def ssi_outcome(ops: DataFrame, group: str = "store") -> DataFrame:
    """``store, txn, outcome``: commit requests in order; one is refused if a concurrent transaction that committed wrote what it read or read what it wrote.

    A refusal frees later ones, so this is a fold over a store's operations, which are in one task; stores run in
    parallel. For each key it knows only when the last committed reader and writer ended.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        began: dict = {}
        reads: dict[int, set] = {}
        writes: dict[int, set] = {}
        read_until: dict = {}
        written_until: dict = {}
        out = []
        for seq, txn, op, key in pdf.sort_values("seq")[["seq", "txn", "op", "key"]].itertuples(index=False):
            if op == "begin":
                began[txn], reads[txn], writes[txn] = seq, set(), set()
            elif txn in began and op in ("read", "write"):
                (reads if op == "read" else writes)[txn].add(key)
            elif txn in began and op in ("commit", "abort"):
                start, r, w = began.pop(txn), reads.pop(txn), writes.pop(txn)
                ok = op == "commit" and not any(written_until.get(k, -1) > start for k in r) and not any(read_until.get(k, -1) > start for k in w)
                if ok:
                    read_until.update(dict.fromkeys(r, seq))
                    written_until.update(dict.fromkeys(w, seq))
                out.append((pdf[group].iloc[0], txn, "committed" if ok else "aborted"))
        return pd.DataFrame(out, columns=[group, "txn", "outcome"])

    return ops.select(group, "seq", "txn", "op", "key").groupBy(group).applyInPandas(fold, f"{group} {dict(ops.dtypes)[group]}, txn long, outcome string")
