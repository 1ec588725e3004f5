"""Following a log with Structured Streaming: segments, follower state, gossip."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.log import latest, live
from tidelog.operators.mergeable import gossip_merge
from tidelog.operators.segments import Options, SizeTiered, compact_folder, read_segments
from tidelog.sources import files


def _each(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush_segments(stream: DataFrame, path: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Each micro-batch of a change log becomes a sorted segment under ``path``; its number is the batch's, so a repeated batch replaces its own.

    After each flush, what the options' strategy or threshold chooses is compacted. A batch that is repeated after
    that puts its rows back, which reads resolve by their sequence numbers.
    """
    strategy = options.compaction if options else None

    def apply(batch: DataFrame, number: int) -> None:
        own = latest(batch)
        own.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/segment_id={number}")
        if strategy is not None:
            compact_folder(batch.sparkSession, path, strategy, ", ".join(f"{n} {t}" for n, t in own.dtypes))

    return _each(stream, checkpoint, apply)


def follow(stream: DataFrame, path: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """A follower: a micro-batch adds its own rows as a segment, and segments are compacted by size, so that no batch rewrites the state.

    The checkpoint is the high-water mark. ``follower_state`` reads what the follower holds.
    """
    return flush_segments(stream, path, checkpoint, options or Options(strategy=SizeTiered(4)))


def follower_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return live(read_segments(spark, path, schema))


def gossip(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Received ``(node, state, version)`` merged into what is known; the known state wins at equal versions.

    State n is under ``path/n``: a row a node, so each batch writes it anew, and that before the last goes.
    """

    def apply(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.parquet(f"{path}/{number - 1}") if number else batch.limit(0)
        gossip_merge(known, batch).write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            files.delete(batch.sparkSession, f"{path}/{number - 2}")

    return _each(stream, checkpoint, apply)
