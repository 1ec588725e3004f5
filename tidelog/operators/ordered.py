"""Places, running sums and running maxima over a total order, in parallel over ranges of it.

Rows are partitioned by ranges of the order and sorted once, and written with the partition and the place that each
got. All that follows reads these, so every branch of a query sees the same partitions, whatever adaptive execution
makes of them. One row a partition is then carried from partition to partition. Orders are ascending, nulls first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.scratch import materialize


def placed(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``_p``, the number of a row's range, and ``_k``, its place in it from 0. The order must be total for places to be defined."""
    rows = df.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "placed")  # 33 bits of place below the partition
    return rows.withColumns({"_p": F.shiftright("_at", 33).cast("int"), "_k": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def _ahead(values: str):
    """Sum over the partitions before; the window has a row a partition."""
    return F.coalesce(F.sum(values).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``n``: the row's place from 0 in the order."""
    rows = placed(df, *order)
    before = rows.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", _ahead("_n").alias("_b"))
    return rows.join(F.broadcast(before), "_p").withColumn("n", F.col("_b") + F.col("_k")).drop("_p", "_k", "_b")


def previous(df: DataFrame, value: str, *order: str) -> DataFrame:
    """Adds ``before``, the value of the row before, and ``first``, whether there is none."""
    rows = placed(df, *order)
    own = F.lag(value).over(Window.partitionBy("_p").orderBy("_k"))
    ends = rows.groupBy("_p").agg(F.max_by(F.struct(value), "_k").alias("_end"))
    carried = ends.select("_p", F.lag("_end").over(Window.orderBy("_p")).alias("_carried"))  # a row a partition
    both = rows.withColumn("_own", own).join(F.broadcast(carried), "_p")
    start = F.col("_k") == 0
    return both.withColumns({"before": F.when(start, F.col(f"_carried.{value}")).otherwise(F.col("_own")), "first": start & F.col("_carried").isNull()}).drop("_p", "_k", "_own", "_carried")


def running(df: DataFrame, value: str, how: str, *order: str, group: str | None = None) -> DataFrame:
    """Adds ``seen``: the sum or maximum (``how``) of the values up to and with each row, nulls left out, within its group if there are groups.

    A group may be larger than a range: what came before its part in a range is carried into it.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    plus = lambda a, b: F.greatest(a, b) if how == "max" else F.coalesce(a + b, a, b)
    by = group or "_g"
    rows = placed(df if group else df.withColumn("_g", F.lit(0)), by, *order)
    parts = rows.groupBy("_p", by).agg(fold(value).alias("v"), F.min("_k").alias("lo"))
    ends = parts.groupBy("_p").agg(F.min_by(F.struct(F.col(by).alias("g")), "lo").alias("first"), F.max_by(F.struct(F.col(by).alias("g"), "v"), "lo").alias("last"))
    # a row a partition: what the last group of each has in all up to its end
    same = Window.partitionBy("last.g").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("sofar", F.struct(F.col("last.g").alias("g"), fold("last.v").over(same).alias("v"))).withColumn("came", F.lag("sofar").over(Window.orderBy("_p")))
    carried = ends.select("_p", "first", F.when(F.col("came.g").eqNullSafe(F.col("first.g")), F.col("came.v")).alias("_carried"))
    own = fold(value).over(Window.partitionBy("_p", by).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("_own", own).join(F.broadcast(carried), "_p")
    here = F.when(F.col(by).eqNullSafe(F.col("first.g")), F.col("_carried"))
    return both.withColumn("seen", plus(F.col("_own"), here)).drop("_p", "_k", "_own", "_carried", "first", "_g")


def offsets(entries: DataFrame, order: str, size: Column) -> DataFrame:
    """Adds ``size``, ``n`` and the byte ``offset`` of each entry in a file of all entries in order."""
    rows = placed(entries.withColumn("size", size.cast("long")), order)
    sums = rows.groupBy("_p").agg(F.count("*").alias("c"), F.sum("size").alias("s")).select("_p", _ahead("c").alias("_c"), _ahead("s").alias("_s"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_o", before).join(F.broadcast(sums), "_p").withColumns({"n": F.col("_c") + F.col("_k"), "offset": F.col("_s") + F.col("_o")}).drop("_p", "_k", "_o", "_c", "_s")
