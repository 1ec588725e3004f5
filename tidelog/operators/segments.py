"""Segments of a log-structured store: flush, catalog, compaction strategies, rolling by size, and recovery from a write-ahead log."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.sketches import bloom_size, positions_array, with_positions
from tidelog.operators.log import DELETE, PUT, latest, live, multi_get
from tidelog.operators.ordered import numbered, offsets, running
from tidelog.scratch import materialize, scratch_path

#: Bits of the filters that a task has unpacked at a time (a byte each), and keys that one holds while filters pass.
SLAB_BITS, SHARD_KEYS = 1 << 24, 1 << 17
#: Stands for a null segment in a batch.
NO_SEGMENT = -(1 << 63)


def flush(log: DataFrame, capacity: int) -> DataFrame:
    """``segment_id`` of a log whose keys are unique: a buffer of ``capacity`` keys is flushed when the next one comes."""
    return numbered(log, "seq").withColumn("segment_id", F.floor(F.col("n") / capacity).cast("long")).drop("n")


def flush_exact(log: DataFrame, capacity: int, store: str = "store", overwrites_fit: bool = False) -> DataFrame:
    """``store, seq, key, segment_id`` where keys repeat: a put to a full buffer flushes it first, an overwrite too, unless ``overwrites_fit``.

    The rule is a fold over the puts of a store, whose number and keys are in one task; stores run in parallel.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held: set = set()
        segment, out = 0, []
        pdf = pdf.sort_values("seq")
        for key in pdf["key"]:
            if len(held) >= capacity and not (overwrites_fit and key in held):
                held.clear()
                segment += 1
            held.add(key)
            out.append(segment)
        return pdf[[store, "seq", "key"]].assign(segment_id=out)

    kinds = dict(log.dtypes)
    return log.select(store, "seq", "key").groupBy(store).applyInPandas(fold, f"{store} {kinds[store]}, seq long, key {kinds['key']}, segment_id long")


def buffer_full(log: DataFrame, capacity: int, store: str = "store") -> DataFrame:
    """``store, n_keys, full``: whether each store's buffer, which holds all keys of its log, has room for another key."""
    held = log.groupBy(store).agg(F.count_distinct("key").alias("n_keys"))
    return held.select(store, "n_keys", (F.col("n_keys") >= capacity).alias("full"))


def catalog(segments: DataFrame) -> DataFrame:
    """Rows, distinct keys, key range and sequence range of each segment."""
    of = lambda f, c: f(c).alias(f"{f.__name__}_{c}")
    return segments.groupBy("segment_id").agg(F.count("*").alias("n_rows"), F.count_distinct("key").alias("n_keys"), of(F.min, "key"), of(F.max, "key"), of(F.min, "seq"), of(F.max, "seq"))


def read_amplification(segments: DataFrame) -> DataFrame:
    """``key, n_segments``: how many segments a lookup of each key has to consider by their key ranges.

    Ranges that have begun less those that have ended, as a running sum over the sorted ends and keys.
    """
    ranges = segments.groupBy("segment_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    end = lambda c, kind, d: ranges.select(F.col(c).alias("key"), F.lit(kind).alias("kind"), F.lit(d).alias("d"))
    keys = segments.select("key").distinct().select("key", F.lit(1).alias("kind"), F.lit(0).alias("d"))
    at = running(keys.unionByName(end("lo", 0, 1)).unionByName(end("hi", 2, -1)), "d", "sum", "key", "kind")
    return at.where("kind = 1").select("key", F.col("seen").alias("n_segments"))


def _full(positions: int, bits: int) -> bool:
    """Whether a filter is kept as bits; one of fewer than a position in 64 bits is shorter as a list of them."""
    return positions * 64 >= bits


def segment_filters(segments: DataFrame, rate: float = 0.01) -> tuple[DataFrame, int, int]:
    """``segment_id, filter, positions``: a Bloom filter of each segment's keys, and their bits and hashes, sized for the largest segment.

    A filter is packed bits, or, for a segment much smaller than the largest, the positions set; the other column is null.
    The rows of a segment come one after another, so a task holds one filter of a segment at a time, whatever its size.
    """
    most = segments.groupBy("segment_id").agg(F.count_distinct("key").alias("n")).agg(F.max("n")).first()[0]
    bits, hashes = bloom_size(most or 1, rate)

    def made(ids: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        full = [_full(int(n), bits) for n in held.sum(axis=1)]
        packed = np.packbits(held, axis=1, bitorder="little")
        filters = pa.array([row.tobytes() if f else None for row, f in zip(packed, full, strict=True)], pa.binary())
        positions = pa.array([None if f else np.flatnonzero(row) for row, f in zip(held, full, strict=True)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(ids), filters, positions], ["segment_id", "filter", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for b in batches:
            if not b.num_rows:
                continue
            every, at = b.column("segment_id").fill_null(NO_SEGMENT).to_numpy(), positions_array(b.column("text"), bits, hashes)
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            ends, ids = np.append(first[1:], len(every)), every[first]
            step = max(1, SLAB_BITS // bits)
            for i in range(0, len(ids), step):
                part = slice(first[i], ends[min(i + step, len(ids)) - 1])
                new, sizes = ids[i : i + step], (ends - first)[i : i + step]
                if last is not None and new[0] == last:
                    held = np.concatenate([carried, np.zeros((len(new) - 1, bits), bool)])
                else:
                    if last is not None:
                        yield made(np.array([last]), carried)
                    held = np.zeros((len(new), bits), bool)
                held[np.repeat(np.arange(len(new)), sizes)[:, None], at[part]] = True
                if len(new) > 1:
                    yield made(new[:-1], held[:-1])
                last, carried = new[-1], held[-1:].copy() if len(new) > 1 else held
        if last is not None:
            yield made(np.array([last]), carried)

    rows = segments.where(F.col("key").isNotNull()).select("segment_id", F.col("key").cast("string").alias("text"))
    filters = rows.repartition("segment_id").sortWithinPartitions("segment_id").mapInArrow(run, "segment_id long, filter binary, positions array<long>")
    return materialize(filters, "filters"), bits, hashes


def _left(keys: DataFrame, filters: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``key, n``: how many of the packed filters have all of a key's positions.

    Each task holds up to ``SHARD_KEYS`` keys, and all filters pass it in slabs. A slab is turned, so that each position has a bit a
    filter: a key's filters are the AND of its positions' rows. Pairs of keys and filters are never rows.
    """
    total = keys.count()
    shards = max(1, -(-total // SHARD_KEYS), min(filters.sparkSession.sparkContext.defaultParallelism, total // 1024))

    def turn(packed: pa.Array) -> np.ndarray:
        slab = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
        columns = np.unpackbits(slab, axis=1, count=bits, bitorder="little").T
        return np.ascontiguousarray(np.packbits(np.pad(columns, ((0, 0), (0, -len(packed) % 64))), axis=1)).view(np.uint64)

    def count(turned: np.ndarray, at: np.ndarray, found: np.ndarray) -> None:
        step = max(1, (1 << 17) // turned.shape[1])
        for i in range(0, len(at), step):
            rows = turned[at[i : i + step, 0]]
            for j in range(1, hashes):
                rows &= turned[at[i : i + step, j]]
            found[i : i + step] += np.bitwise_count(rows).sum(axis=1, dtype=np.int64)

    def counted(parts: list) -> Iterator[pa.RecordBatch]:
        for key, valid, _, found in parts:
            yield pa.RecordBatch.from_arrays([key, pa.array(np.where(valid, found, 0))], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}  # the keys of one shard, and of the next one in the same batch
        for b in batches:
            shard, is_key = b.column("shard").to_numpy(), b.column("filter").is_null().to_numpy(zero_copy_only=False)
            for s in np.unique(shard):
                for done in [x for x in own if x < s]:
                    yield from counted(own.pop(done))
                mine = b.filter(pa.array((shard == s) & is_key))
                if mine.num_rows:
                    at = positions_array(mine.column("text"), bits, hashes)
                    own.setdefault(s, []).append([mine.column("key"), mine.column("text").is_valid().to_numpy(zero_copy_only=False), at, np.zeros(len(at), np.int64)])
                packed = b.column("filter").filter(pa.array((shard == s) & ~is_key))
                step = max(64, SLAB_BITS // bits // 64 * 64)
                for i in range(0, len(packed), step):
                    turned = turn(packed[i : i + step])
                    for _, _, at, found in own.get(s, []):
                        count(turned, at, found)
        for parts in own.values():
            yield from counted(parts)

    kind = dict(keys.dtypes)["key"]
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    held = keys.select("key", F.col("key").cast("string").alias("text"), shard, F.lit(None).cast("binary").alias("filter"))
    passing = filters.select(F.lit(None).cast(kind).alias("key"), F.lit(None).cast("string").alias("text"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "filter")
    return held.unionByName(passing).repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("filter").isNotNull()).mapInArrow(run, f"key {kind}, n long")


def guarded_get(segments: DataFrame, wanted: DataFrame, filters: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``key, value, found, n_maybe``: lookups by ``segment_filters``, with how many segments these leave for a key.

    A filter has all keys of its segment, so all rows of a key are in segments left for it: the last of its rows decides, as in a
    lookup without filters, and they are joined by key. Positions of small segments' filters, if there are any, are joined.
    """
    keys = wanted.select("key").distinct()
    counts = _left(keys, filters.where("filter is not null").select("filter"), bits, hashes)
    small = filters.where("positions is not null").select("segment_id", F.explode("positions").alias("pos"))
    if not small.isEmpty():
        at = with_positions(keys, "key", bits, hashes).select("key", F.explode(F.array_distinct("positions")).alias("pos"), F.size(F.array_distinct("positions")).alias("n"))
        maybe = at.join(small, "pos").groupBy("key", "n", "segment_id").agg(F.count("*").alias("hits")).where("hits = n")
        counts = counts.unionByName(maybe.groupBy("key").agg(F.count("*").alias("n"))).groupBy("key").agg(F.sum("n").alias("n"))
    held = live(segments.join(keys, "key", "left_semi"))
    return counts.join(held, "key", "left").select("key", "value", F.col("seq").isNotNull().alias("found"), F.col("n").alias("n_maybe"))


def filtered_get(log: DataFrame, wanted: DataFrame, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``key, value, found, asked``: lookups in a store behind one Bloom filter of all keys ever put; keys that it rules out aren't looked up.

    The filter is derived from the log, so it has no key missing; deletes leave it as it is.
    """
    at = with_positions(wanted.select("key").distinct(), "key", bits, hashes).select("key", F.explode("positions").alias("pos"))
    asked = at.join(filter_.select("pos", F.lit(1).alias("one")), "pos", "left").groupBy("key").agg((F.count("one") == F.count("*")).alias("asked"))
    held = multi_get(log, asked.where("asked"))
    return asked.join(held, "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"), "asked")


@dataclass(frozen=True)
class Full:
    """Everything, once there are ``threshold`` segments."""

    threshold: int = 2

    def choose(self, sizes: DataFrame) -> DataFrame:
        """``segment_id`` of what to merge, of a relation ``(segment_id, n_rows)``."""
        n = sizes.agg(F.count("*").alias("n"))  # one row
        return sizes.join(F.broadcast(n), F.col("n") >= max(2, self.threshold)).select("segment_id")


@dataclass(frozen=True)
class SizeTiered:
    """Segments of one size class (row numbers with as many binary digits), once there are ``least`` of it; of several classes, that of the oldest segment."""

    least: int = 4

    def choose(self, sizes: DataFrame) -> DataFrame:
        tier = F.length(F.bin("n_rows"))
        full = sizes.groupBy(tier.alias("tier")).agg(F.count("*").alias("c"), F.min("segment_id").alias("first")).where(F.col("c") >= self.least)
        one = full.agg(F.min_by("tier", "first").alias("tier"))  # one row
        return sizes.join(F.broadcast(one), tier == F.col("tier")).select("segment_id")


@dataclass(frozen=True)
class Leveled:
    """The oldest ``level0`` segments, once there are as many."""

    level0: int = 4

    def choose(self, sizes: DataFrame) -> DataFrame:
        oldest = sizes.select("segment_id").orderBy("segment_id").limit(self.level0)  # as many rows
        n = sizes.agg(F.count("*").alias("n"))
        return oldest.join(F.broadcast(n), F.col("n") >= self.level0).select("segment_id")


@dataclass(frozen=True)
class Levels:
    """Levels of ``base`` rows, each ``multiplier`` times as large as the one before: the segments of the first level that holds more than it may.

    A segment is of the first level that could hold it alone.
    """

    base: int = 1000
    multiplier: int = 10

    def choose(self, sizes: DataFrame) -> DataFrame:
        level = F.greatest(F.ceil(F.log(F.col("n_rows") / self.base) / F.log(F.lit(float(self.multiplier))) - 1e-9), F.lit(0))
        leveled = sizes.withColumn("level", level)
        sums = leveled.groupBy("level").agg(F.sum("n_rows").alias("held"), F.count("*").alias("c")).where((F.col("c") > 1) & (F.col("held") > self.base * F.pow(F.lit(float(self.multiplier)), "level")))
        one = sums.agg(F.min("level").alias("full"))  # one row
        return leveled.join(F.broadcast(one), F.col("level") == F.col("full")).select("segment_id")


@dataclass(frozen=True)
class Options:
    """How a log-structured store behaves: keys in its buffer, segments at which it compacts (0: never), or a strategy that decides."""

    capacity: int = 1000
    threshold: int = 0
    strategy: Full | SizeTiered | Leveled | Levels | None = None
    bloom_rate: float | None = None

    def __post_init__(self) -> None:
        if self.capacity < 1:
            raise ValueError("the buffer must hold a key")
        if self.threshold < 0:
            raise ValueError("the threshold can't be negative")
        if self.bloom_rate is not None and not 0 < self.bloom_rate < 1:
            raise ValueError("a false-positive rate is between 0 and 1")

    @property
    def compaction(self) -> Full | SizeTiered | Leveled | Levels | None:
        return self.strategy or (Full(self.threshold) if self.threshold else None)


def compact(segments: DataFrame, chosen: DataFrame | list[int], into: int | None = None) -> DataFrame:
    """All segments after the chosen ones are merged into one, numbered as the last of them unless ``into`` is given.

    Each key keeps its last row. Tombstones go only if no segment older than the chosen ones is left, where they
    would still hide something. Fewer than two chosen segments change nothing. Of the choice, which is joined, only
    its number and ends come to the driver.
    """
    ids = chosen if isinstance(chosen, DataFrame) else segments.sparkSession.createDataFrame([(i,) for i in chosen], "segment_id long")
    ids = ids.select("segment_id").distinct()
    span = ids.agg(F.count("*").alias("n"), F.min("segment_id").alias("first"), F.max("segment_id").alias("last")).first()
    if span["n"] < 2:
        return segments
    merged = latest(segments.join(ids, "segment_id", "left_semi")).withColumn("segment_id", F.lit(span["last"] if into is None else into).cast("long"))
    rest = segments.join(ids, "segment_id", "left_anti")
    if rest.where(F.col("segment_id") < span["first"]).isEmpty():
        merged = merged.where(F.col("op") == PUT)
    return rest.select(*merged.columns).unionByName(merged)


def write_segment(merged: DataFrame, path: str, compression: str = "snappy") -> None:
    """A sorted run: range-partitioned and sorted by key, so that files and row groups have narrow key ranges."""
    merged.repartitionByRange("key").sortWithinPartitions("key").write.mode("error").option("compression", compression).parquet(path)


def segment_info(spark: SparkSession, path: str) -> DataFrame:
    """``n_rows, min_key, max_key, n_files, bytes, written``: a written run's entries, key range, size and last time."""
    files = F.struct("_metadata.file_path", F.col("_metadata.file_size").alias("size"))
    rows = spark.read.parquet(path).select("key", files.alias("file"), F.col("_metadata.file_modification_time").alias("time"))
    per = rows.groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("time").alias("time"))
    return per.agg(F.sum("n").alias("n_rows"), F.min("lo").alias("min_key"), F.max("hi").alias("max_key"), F.count("*").alias("n_files"), F.sum("file.size").alias("bytes"), F.max("time").alias("written"))


def compact_log(log: DataFrame) -> DataFrame:
    """Last value of each key, with ``first_seq``, the place of its first occurrence, which orders the rewritten file."""
    return log.groupBy("key").agg(F.max(F.struct("seq", "value")).alias("last"), F.min("seq").alias("first_seq")).select("key", "last.value", "first_seq")


def read_segments(spark: SparkSession, path: str, schema: str = "key long, value string, seq long, op string") -> DataFrame:
    """The rows of all ``segment_id=N`` folders under ``path``, which a store finds when it opens; none if there is no folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or not any("=" in f.getPath().getName() for f in fs.listStatus(hadoop)):
        return spark.createDataFrame([], f"{schema}, segment_id long")
    return spark.read.schema(f"{schema}, segment_id long").parquet(path)


def next_segment(segments: DataFrame) -> DataFrame:
    return segments.agg(F.coalesce(F.max("segment_id") + 1, F.lit(0)).alias("next_id"))


def compact_folder(spark: SparkSession, path: str, strategy: Full | SizeTiered | Leveled | Levels, schema: str = "key long, value string, seq long, op string") -> bool:
    """Merge what the strategy chooses among the segment folders under ``path``; whether anything was.

    The merged segment, tombstones included, replaces the last chosen one before the others go, so a crash leaves
    rows twice, which reads resolve, but loses none. Tombstones go when it is the oldest that is left.
    """
    own = read_segments(spark, path, schema)
    ids = sorted(r["segment_id"] for r in strategy.choose(own.groupBy("segment_id").agg(F.count("*").alias("n_rows"))).collect())  # folder names to delete
    if len(ids) < 2:
        return False
    jvm = spark.sparkContext._jvm
    folder = lambda i: f"{path}/segment_id={i}"
    merged = latest(own.where(F.col("segment_id").between(ids[0], ids[-1])).join(spark.createDataFrame([(i,) for i in ids], "segment_id long"), "segment_id", "left_semi"))

    def replace(rows: DataFrame, i: int) -> None:
        held = scratch_path(spark, "merged")
        write_segment(rows, held)
        spark.read.schema(rows.schema).parquet(held).write.mode("overwrite").parquet(folder(i))

    replace(merged, ids[-1])
    for i in ids[:-1]:
        where = jvm.org.apache.hadoop.fs.Path(folder(i))
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    left = read_segments(spark, path, schema)
    if left.where(F.col("segment_id") < ids[-1]).isEmpty():
        replace(left.where((F.col("segment_id") == ids[-1]) & (F.col("op") != DELETE)).drop("segment_id"), ids[-1])
    return True


def compact_indexed(log: DataFrame, size: Column) -> DataFrame:
    """``key, value, first_seq, offset, count``: the rewritten file of ``compact_log`` and where each entry is in it."""
    found = offsets(compact_log(log), "first_seq", size)
    return found.select("key", "value", "first_seq", "offset", F.col("size").alias("count"))


def refused_puts(entries: DataFrame, most: int, store: str = "store") -> DataFrame:
    """``store, seq``: puts into a segment file that held ``most`` bytes or more already, of entries ``(store, seq, size)``."""
    return running(entries.select(store, "seq", "size"), "size", "sum", "seq", group=store).where(F.col("seen") - F.col("size") >= most).select(store, "seq")


def merge_small(sizes: DataFrame, most: int, store: str = "store") -> DataFrame:
    """``store, segment_id, merged_id``: after compaction, a segment is joined to those before it while they hold less than ``most`` bytes together.

    ``sizes``: ``(store, segment_id, size)``, a row a segment.
    """
    rolled = roll(sizes.select(store, F.col("segment_id").alias("seq"), "size"), most, store)
    return rolled.select(store, F.col("seq").alias("segment_id"), F.col("segment_id").alias("merged_id"))


def roll(entries: DataFrame, most: int, store: str = "store") -> DataFrame:
    """``store, seq, size, segment_id``: an entry opens a new segment if the current one has ``most`` bytes or more."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        segment = held = 0
        out = []
        for size in pdf["size"]:
            if held >= most:
                segment, held = segment + 1, 0
            held += size
            out.append(segment)
        return pdf[[store, "seq", "size"]].assign(segment_id=out)

    return entries.select(store, "seq", "size").groupBy(store).applyInPandas(fold, f"{store} {dict(entries.dtypes)[store]}, seq long, size long, segment_id long")


def truncate(frames: DataFrame, flushed: int) -> DataFrame:
    """What a write-ahead log still holds once all up to a sequence number is in segments."""
    return frames.where(F.col("seq") > flushed)


def wal_frames(log: DataFrame, payload: Column) -> DataFrame:
    """``seq, payload, length, crc``: what a write-ahead log stores of each entry."""
    own = log.select("seq", F.encode(payload, "UTF-8").alias("payload"))
    return own.select("seq", "payload", F.length("payload").alias("length"), F.crc32("payload").alias("crc"))


def recover(frames: DataFrame) -> DataFrame:
    """Intact frames in order: those before the first of a wrong length, less those whose checksum is wrong."""
    bad = frames.where(F.col("length").isNull() | (F.col("length") < 0) | (F.col("length") != F.length("payload"))).agg(F.min("seq").alias("cut"))
    kept = frames.join(F.broadcast(bad), F.lit(True)).where(F.col("cut").isNull() | (F.col("seq") < F.col("cut")))
    return kept.where(F.crc32("payload") == F.col("crc")).select("seq", "payload")
