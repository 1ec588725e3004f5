"""The named queries over the driver's tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir)`` gives a DataFrame; ``ORACLES[name]`` is SQL with the same columns.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import hashing, partitioning, sketches
from tidelog.operators import consensus, log, merkle, mergeable, model, replication, segments, sstable, txn
from tidelog.plans.hash_sql import BYTES, fnv, murmur, xx
from tidelog.scratch import scratch_path
from tidelog.sources import files, serde

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = F.col


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Relations that many queries share, in both languages.


def event_log(spark: SparkSession, d: str) -> DataFrame:
    return log.change_log(table(spark, d, "events"), C("user_id"), C("props"), C("event_id"), C("event_type") == "error")


LG = "lg AS (SELECT user_id AS key, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_id AS seq, CASE WHEN event_type = 'error' THEN 'del' ELSE 'put' END AS op FROM events WHERE user_id IS NOT NULL)"
LAST = "last AS (SELECT key, arg_max(struct_pack(v := value), seq).v AS value, max(seq) AS seq, arg_max(op, seq) AS op FROM lg GROUP BY key)"


def event_segments(spark: SparkSession, d: str) -> DataFrame:
    return event_log(spark, d).withColumn("segment_id", F.floor(C("seq") / 250).cast("long"))


def growing_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of about 10, 30, 50 ... rows."""
    return event_log(spark, d).withColumn("segment_id", F.floor(F.sqrt(C("seq") / 10)).cast("long"))


SG = LG + ", sg AS (SELECT *, seq // 250 AS segment_id FROM lg)"


SG2 = LG + ", sg AS (SELECT *, floor(sqrt(seq / 10))::BIGINT AS segment_id FROM lg)"


def order_log(spark: SparkSession, d: str) -> DataFrame:
    return log.puts(table(spark, d, "orders"), C("o_orderkey"), C("o_orderpriority"), C("o_orderkey"))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Two transactions of ten events each run at a time; the first event begins, the last commits or aborts."""
    place = F.floor(C("event_id") % 20 / 2)
    op = F.when(place == 0, "begin").when((place == 9) & (C("user_id") % 7 == 0), "abort").when(place == 9, "commit").when(C("event_type") == "view", "read").otherwise("write")
    return table(spark, d, "events").select(C("event_id").alias("seq"), (F.floor(C("event_id") / 20) * 2 + C("event_id") % 2).cast("long").alias("txn"), op.alias("op"), (C("user_id") % 20).alias("key"), C("props").alias("value"), F.floor(C("event_id") / 2000).cast("long").alias("store"))


TX = """tx AS (SELECT event_id AS seq, (event_id // 20) * 2 + event_id % 2 AS txn, CASE WHEN event_id % 20 // 2 = 0 THEN 'begin' WHEN event_id % 20 // 2 = 9 AND user_id % 7 = 0 THEN 'abort'
  WHEN event_id % 20 // 2 = 9 THEN 'commit' WHEN event_type = 'view' THEN 'read' ELSE 'write' END AS op, user_id % 20 AS key, props AS value FROM events),
st AS (SELECT txn, min(CASE WHEN op = 'begin' THEN seq END) AS begin_seq, min(CASE WHEN op IN ('commit', 'abort') THEN seq END) AS end_seq,
  coalesce(CASE arg_min(op, CASE WHEN op IN ('commit', 'abort') THEN seq END) WHEN 'commit' THEN 'committed' WHEN 'abort' THEN 'aborted' END, 'active') AS state FROM tx GROUP BY txn)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Three replicas, each of which missed a quarter of the writes."""
    names = F.explode(F.array(*(F.struct(F.lit(f"replica-{i}").alias("replica"), F.lit(i).alias("i")) for i in range(3))))
    rows = table(spark, d, "events").select(C("user_id").alias("key"), C("props").alias("value"), C("event_id").alias("version"), names.alias("r"))
    return rows.where((C("version") % 4) != C("r.i")).select("r.replica", "key", "value", "version")


CELLS = "cells AS (SELECT 'replica-' || i AS replica, user_id AS key, props AS value, event_id AS version FROM events, range(3) t(i) WHERE event_id % 4 <> i)"


def nodes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("node-"), C("id").cast("string")).alias("node"), C("id").alias("ord"))


# Key-value reads.


@query(f"WITH {LG}, {LAST} SELECT key, value, seq FROM last WHERE op = 'put'")
def kv_latest_scan(spark, d):
    return log.live(event_log(spark, d))


@query(f"WITH {LG} SELECT key, value, seq, op FROM lg")
def kv_log_scan(spark, d):
    return event_log(spark, d).orderBy("seq")


@query(f"WITH {LG}, {LAST} SELECT key, value, seq FROM last WHERE op = 'put' AND key = 42")
def kv_point_get(spark, d):
    return log.get(event_log(spark, d), 42)


@query(f"WITH {LG}, {LAST} SELECT k.key, value, seq IS NOT NULL AS found FROM (SELECT range AS key FROM range(0, 300, 7)) k LEFT JOIN (SELECT * FROM last WHERE op = 'put') USING (key)")
def kv_multi_get(spark, d):
    return log.multi_get(event_log(spark, d), spark.range(0, 300, 7).select(C("id").alias("key")))


@query("SELECT c_custkey AS key, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def kv_contains(spark, d):
    held = log.puts(table(spark, d, "orders"), C("o_custkey"), C("o_orderstatus"), C("o_orderkey"))
    return log.contains(table(spark, d, "customer").select(C("c_custkey").alias("key"), "c_name"), held)


@query("SELECT c_custkey AS key, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def kv_missing(spark, d):
    held = log.puts(table(spark, d, "orders"), C("o_custkey"), C("o_orderstatus"), C("o_orderkey"))
    return log.missing(table(spark, d, "customer").select(C("c_custkey").alias("key"), "c_name"), held)


@query(f"WITH {LG}, {LAST} SELECT key, value, seq FROM last WHERE op = 'put' AND key BETWEEN 10 AND 20")
def kv_range_scan(spark, d):
    return log.scan_range(event_log(spark, d), 10, 20)


@query(f"WITH {LG}, {LAST} SELECT key, op = 'del' AS deleted FROM last")
def kv_delete_live(spark, d):
    return log.latest(event_log(spark, d)).select("key", (C("op") == "del").alias("deleted"))


@query(f"WITH lg0 AS (SELECT * FROM (WITH {LG} SELECT * FROM lg)), lg AS (SELECT * FROM lg0 UNION ALL SELECT c_custkey, c_mktsegment, 1000000 + c_custkey, 'put' FROM customer WHERE c_custkey % 3 = 0), {LAST} SELECT key, value, seq FROM last WHERE op = 'put'")
def kv_bulk_put_overwrite(spark, d):
    later = log.puts(table(spark, d, "customer").where("c_custkey % 3 = 0"), C("c_custkey"), C("c_mktsegment"), C("c_custkey") + 1_000_000)
    return log.live(log.append(event_log(spark, d), later))


@query(f"WITH lg0 AS (SELECT * FROM (WITH {LG} SELECT * FROM lg)), lg AS (SELECT * FROM lg0 WHERE seq > 500), {LAST} SELECT key, value, seq FROM last WHERE op = 'put'")
def kv_clear_then_put(spark, d):
    return log.after_clear(event_log(spark, d), 500)


@query(f"WITH {LG}, {LAST} SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS n FROM last WHERE op = 'put'")
def kv_ordered_scan(spark, d):
    return log.ordered_scan(event_log(spark, d))


@query(f"WITH {LG}, {LAST} SELECT min(key) AS min_key, arg_min(value, key) AS min_value, max(key) AS max_key, arg_max(value, key) AS max_value FROM last WHERE op = 'put'")
def kv_bounds(spark, d):
    return log.bounds(event_log(spark, d))


# Segments.


@query("SELECT o_orderkey AS key, o_orderkey AS seq, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS segment_id FROM orders")
def lsm_flush_segments(spark, d):
    return segments.flush(order_log(spark, d), 1000).select("key", "seq", "segment_id")


def _fold_sql(rows: str, start: str, step: str) -> str:
    """A recursive CTE ``fold`` over the rows (store, seq, ...) of each store in the order of seq: state columns with their start and next values."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seq) AS i FROM ({rows})),
    fold AS (SELECT store, 0::BIGINT AS i, {start} FROM (SELECT DISTINCT store FROM o) UNION ALL SELECT o.store, o.i, {step} FROM fold f JOIN o ON o.store = f.store AND o.i = f.i + 1)"""


FLUSHED = _fold_sql("SELECT key % 8 AS store, seq, key FROM lg", "[]::BIGINT[] AS held, 0::BIGINT AS segment_id", "CASE WHEN len(f.held) >= 5 THEN [o.key] ELSE list_distinct(list_append(f.held, o.key)) END, f.segment_id + (len(f.held) >= 5)::INT")


@query(f"WITH RECURSIVE {LG}, {FLUSHED} SELECT store, seq, key, segment_id FROM fold JOIN o USING (store, i)")
def lsm_flush_exact(spark, d):
    return segments.flush_exact(event_log(spark, d).withColumn("store", C("key") % 8), 5)


KEPT = _fold_sql("SELECT key % 8 AS store, seq, key FROM lg", "[]::BIGINT[] AS held, 0::BIGINT AS segment_id", "CASE WHEN len(f.held) >= 5 AND NOT list_contains(f.held, o.key) THEN [o.key] ELSE list_distinct(list_append(f.held, o.key)) END, f.segment_id + (len(f.held) >= 5 AND NOT list_contains(f.held, o.key))::INT")


@query(f"WITH RECURSIVE {LG}, {KEPT} SELECT store, seq, key, segment_id FROM fold JOIN o USING (store, i)")
def lsm_flush_overwrites(spark, d):
    """Flushes of a buffer that takes an overwrite even when it is full."""
    return segments.flush_exact(event_log(spark, d).withColumn("store", C("key") % 8), 5, overwrites_fit=True)


@query(f"WITH {LG} SELECT key % 8 AS store, count(DISTINCT key) AS n_keys, count(DISTINCT key) >= 15 AS \"full\" FROM lg GROUP BY 1")
def lsm_buffer_full(spark, d):
    return segments.buffer_full(event_log(spark, d).withColumn("store", C("key") % 8), 15)


@query("SELECT count(*) AS n_rows, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders")
def sst_segment_info(spark, d):
    """Of a sorted run that is written compressed and read again."""
    path = scratch_path(spark, "run")
    segments.write_segment(order_log(spark, d), path, "gzip")
    return segments.segment_info(spark, path).select("n_rows", "min_key", "max_key")


@query(f"WITH {SG} SELECT segment_id, count(*) AS n_rows, count(DISTINCT key) AS n_keys, min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq FROM sg GROUP BY segment_id")
def lsm_segment_catalog(spark, d):
    return segments.catalog(event_segments(spark, d))


@query(f"WITH {SG}, c AS (SELECT segment_id, min(key) AS a, max(key) AS b FROM sg GROUP BY segment_id) SELECT key, count(*) AS n_segments FROM (SELECT DISTINCT key FROM sg) JOIN c ON key BETWEEN a AND b GROUP BY key")
def lsm_read_amplification(spark, d):
    return segments.read_amplification(event_segments(spark, d))


def _compacted(own, strategy):
    sizes = own.groupBy("segment_id").agg(F.count("*").alias("n_rows"))
    return segments.compact(own, strategy.choose(sizes)).select("key", "value", "seq", "op", "segment_id")


def _compact_sql(chosen: str, sg: str = SG) -> str:
    return f"""WITH {sg}, ids AS (SELECT segment_id, count(*) AS n_rows FROM sg GROUP BY segment_id), chosen AS ({chosen}),
    lg2 AS (SELECT * FROM sg WHERE segment_id IN (SELECT segment_id FROM chosen)),
    m AS (SELECT key, arg_max(struct_pack(v := value), seq).v AS value, max(seq) AS seq, arg_max(op, seq) AS op, (SELECT max(segment_id) FROM chosen) AS segment_id FROM lg2 GROUP BY key)
    SELECT key, value, seq, op, segment_id FROM m WHERE op = 'put' OR EXISTS (SELECT 1 FROM ids WHERE segment_id < (SELECT min(segment_id) FROM chosen))
    UNION ALL SELECT key, value, seq, op, segment_id FROM sg WHERE segment_id NOT IN (SELECT segment_id FROM chosen)"""


OLDEST = "SELECT segment_id FROM ids ORDER BY segment_id LIMIT 4"


@query(_compact_sql("SELECT segment_id FROM ids"))
def lsm_compact_full(spark, d):
    return _compacted(event_segments(spark, d), segments.Full(2))


@query(_compact_sql("SELECT segment_id FROM ids WHERE length(bin(n_rows)) = (SELECT arg_min(t, f) FROM (SELECT length(bin(n_rows)) AS t, min(segment_id) AS f FROM ids GROUP BY 1 HAVING count(*) >= 4))", SG2))
def lsm_compact_size_tiered(spark, d):
    return _compacted(growing_segments(spark, d), segments.SizeTiered(4))


@query(_compact_sql(OLDEST))
def lsm_compact_leveled(spark, d):
    return _compacted(event_segments(spark, d), segments.Leveled(4))


LEVELS = "lv AS (SELECT *, greatest(ceil(ln(n_rows / 40) / ln(2) - 1e-9), 0) AS l FROM ids)"


@query(_compact_sql(f"WITH {LEVELS} SELECT segment_id FROM lv WHERE l = (SELECT min(l) FROM (SELECT l FROM lv GROUP BY l HAVING count(*) > 1 AND sum(n_rows) > 40 * pow(2, l)))", SG2))
def lsm_compact_levels(spark, d):
    return _compacted(growing_segments(spark, d), segments.Levels(40, 2))


@query(f"WITH {LG}, {LAST} SELECT key, seq FROM last WHERE op = 'del'")
def lsm_tombstone_strip(spark, d):
    """The keys whose tombstones a full compaction drops."""
    own = event_segments(spark, d)
    return log.latest(own).join(_compacted(own, segments.Full(2)), "key", "left_anti").select("key", "seq")


def _stored(own: DataFrame) -> str:
    path = scratch_path(own.sparkSession, "store")
    own.repartition("segment_id").write.partitionBy("segment_id").parquet(path)
    return path


@query(f"WITH {SG} SELECT segment_id, count(*) AS n_rows, count(DISTINCT key) AS n_keys, min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq FROM sg GROUP BY segment_id")
def lsm_segment_recovery(spark, d):
    """The catalog of a store that is opened anew from its folders."""
    return segments.catalog(segments.read_segments(spark, _stored(event_segments(spark, d))))


@query(_compact_sql(OLDEST))
def lsm_auto_compact(spark, d):
    """What the folders of a store hold after the compaction that follows a flush."""
    path = _stored(event_segments(spark, d))
    segments.compact_folder(spark, path, segments.Options(strategy=segments.Leveled(4)).compaction)
    return segments.read_segments(spark, path)


@query("SELECT user_id AS key, arg_max(struct_pack(v := props), event_id).v AS value, min(event_id) AS first_seq FROM events GROUP BY user_id")
def log_compact_first_order(spark, d):
    return segments.compact_log(log.puts(table(spark, d, "events"), C("user_id"), C("props"), C("event_id")))


@query("""WITH c AS (SELECT user_id AS key, arg_max(struct_pack(v := props), event_id).v AS value, min(event_id) AS first_seq FROM events GROUP BY user_id), z AS (SELECT *, 8 + coalesce(octet_length(encode(value)), 0) AS s FROM c)
SELECT key, value, first_seq, (sum(s) OVER (ORDER BY first_seq) - s)::BIGINT AS "offset", s::BIGINT AS "count" FROM z""")
def log_compact_indexed(spark, d):
    own = log.puts(table(spark, d, "events"), C("user_id"), C("props"), C("event_id"))
    return segments.compact_indexed(own, 8 + F.coalesce(F.octet_length("value"), F.lit(0)))


def _roll_sql(rows: str, most: int) -> str:
    return "WITH RECURSIVE " + _fold_sql(rows, "0::BIGINT AS held, 0::BIGINT AS segment_id", f"CASE WHEN f.held >= {most} THEN 0 ELSE f.held END + o.size, f.segment_id + (f.held >= {most})::INT")


def sized_documents(spark, d):
    return table(spark, d, "documents").select(C("source").alias("store"), C("doc_id").alias("seq"), C("n_chars").alias("size"))


@query(_roll_sql("SELECT source AS store, doc_id AS seq, n_chars AS size FROM documents", 20_000) + " SELECT store, seq, size, segment_id FROM fold JOIN o USING (store, i)")
def log_roll_segments(spark, d):
    return segments.roll(sized_documents(spark, d), 20_000)


@query("SELECT store, seq FROM (SELECT source AS store, doc_id AS seq, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS before FROM documents) WHERE before >= 20000")
def log_full_guard(spark, d):
    return segments.refused_puts(sized_documents(spark, d), 20_000)


@query(_roll_sql("SELECT source AS store, doc_id // 50 AS seq, sum(n_chars)::BIGINT AS size FROM documents GROUP BY 1, 2", 9000) + " SELECT store, seq AS segment_id, segment_id AS merged_id FROM fold JOIN o USING (store, i)")
def log_merge_small(spark, d):
    sizes = sized_documents(spark, d).groupBy("store", F.floor(C("seq") / 50).cast("long").alias("segment_id")).agg(F.sum("size").alias("size"))
    return segments.merge_small(sizes, 9000)


def _frames(spark, d):
    return segments.wal_frames(event_log(spark, d), F.concat_ws("|", C("key").cast("string"), "value"))


@query(f"WITH {LG} SELECT seq, concat_ws('|', key, value) AS payload FROM lg WHERE seq > 700")
def wal_truncate(spark, d):
    return segments.recover(segments.truncate(_frames(spark, d), 700)).select("seq", F.decode("payload", "UTF-8").alias("payload"))


@query(f"WITH {LG} SELECT seq, concat_ws('|', key, value) AS payload FROM lg WHERE seq % 10 <> 3 AND seq < coalesce((SELECT min(seq) FROM lg WHERE seq = 9000), 9223372036854775807)")
def wal_recover(spark, d):
    damaged = _frames(spark, d).withColumn("crc", F.when(C("seq") % 10 == 3, C("crc") + 1).otherwise(C("crc"))).withColumn("length", F.when(C("seq") == 9000, -1).otherwise(C("length")))
    return segments.recover(damaged).select("seq", F.decode("payload", "UTF-8").alias("payload"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'replayed' ELSE o_orderpriority END AS value FROM orders")
def wal_replay_merge(spark, d):
    own = order_log(spark, d)
    tail = own.where("key % 5 = 0").select("key", F.lit("replayed").alias("value"), (C("seq") + 10_000_000).alias("seq"), "op")
    return log.live(log.append(own, tail)).select("key", "value")


# Sorted tables and indexes.


@query("SELECT pos, key FROM (SELECT event_id AS pos, user_id AS key, lag(user_id) OVER (ORDER BY event_id) AS before FROM events) WHERE key <= before")
def sst_validate_sorted(spark, d):
    return sstable.out_of_order(table(spark, d, "events").select(C("event_id").alias("pos"), C("user_id").alias("key")))


SPARSE = "SELECT o_orderkey AS key, (sum(8 + length(o_orderpriority)) OVER (ORDER BY o_orderkey) - 8 - length(o_orderpriority))::BIGINT AS offset_, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders"


def _sparse(spark, d):
    return sstable.sparse_index(order_log(spark, d).select("key", "value"), "key", 8 + F.octet_length("value"), 4)


@query(f'SELECT key, offset_ AS "offset" FROM ({SPARSE}) WHERE n % 4 = 0')
def sst_sparse_index(spark, d):
    return _sparse(spark, d).select("key", "offset")


@query(f'WITH x AS (SELECT * FROM ({SPARSE}) WHERE n % 4 = 0), p AS (SELECT l_orderkey AS key, count(*) AS c FROM lineitem GROUP BY 1) SELECT p.key, x.key AS index_key, x.offset_ AS "offset" FROM p ASOF LEFT JOIN x ON p.key >= x.key')
def sst_floor_lookup(spark, d):
    return sstable.floor_lookup(table(spark, d, "lineitem").select(C("l_orderkey").alias("key")).distinct(), _sparse(spark, d).select("key", "offset"))


@query("SELECT coalesce(a.c_custkey, b.c_custkey) AS key, CASE WHEN b.c_custkey IS NOT NULL THEN b.c_mktsegment ELSE a.c_name END AS value FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey")
def sst_merge(spark, d):
    c = table(spark, d, "customer")
    return sstable.merge(c.where("c_custkey % 3 <> 0").select(C("c_custkey").alias("key"), C("c_name").alias("value")), c.where("c_custkey % 2 = 0").select(C("c_custkey").alias("key"), C("c_mktsegment").alias("value")))


@query('SELECT doc_id AS key, (sum(8 + octet_length(encode(text))) OVER (ORDER BY doc_id) - 8 - octet_length(encode(text)))::BIGINT AS "offset", (8 + octet_length(encode(text)))::BIGINT AS "count" FROM documents')
def idx_file_offsets(spark, d):
    own = table(spark, d, "documents").select(C("doc_id").alias("key"), F.octet_length("text").alias("bytes"))
    return sstable.offsets(own, "key", 8 + C("bytes")).select("key", "offset", C("size").alias("count"))


@query("SELECT DISTINCT c_mktsegment AS index_key, c_custkey AS key FROM customer WHERE c_mktsegment IS NOT NULL")
def idx_secondary_index(spark, d):
    return sstable.secondary_index(table(spark, d, "customer"), C("c_mktsegment"), "c_custkey")


@query("SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'")
def idx_secondary_lookup(spark, d):
    return sstable.secondary_lookup(table(spark, d, "customer"), C("c_mktsegment"), "BUILDING", "c_custkey")


@query(f"WITH {LG}, {LAST} SELECT seq % 10 AS index_key, count(*) AS n_keys FROM last WHERE op = 'put' GROUP BY 1")
def idx_secondary_remove(spark, d):
    """Keys by an extracted value, after deletes took keys out of the index."""
    return sstable.secondary_index(log.live(event_log(spark, d)), C("seq") % 10).groupBy("index_key").agg(F.count("*").alias("n_keys"))


# Hashes and sketches.


@query(f"SELECT c_custkey, hash FROM (SELECT *, {fnv('c_name', 'hash')} FROM customer)")
def hash_fnv1a(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashing.fnv1a(C("c_name")).alias("hash"))


@query(f"SELECT c_custkey, hash FROM ({murmur('SELECT * FROM customer', 'c_name', 'hash')})")
def hash_murmur3(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashing.murmur3(C("c_name")).alias("hash"))


@query(f"SELECT c_custkey, hash FROM ({xx('SELECT * FROM customer', 'c_name', 'hash')})")
def hash_xxh32(spark, d):
    return table(spark, d, "customer").select("c_custkey", hashing.xxhash32(C("c_name")).alias("hash"))


@query(f"SELECT c_custkey, xor(list_reduce(list_prepend(4294967295::UBIGINT, {BYTES.format(c='c_name')}), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(0, 8), lambda z: z::UBIGINT)), lambda x, y: xor(x >> 1, (x & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT)::BIGINT AS hash FROM customer")
def hash_crc32(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.crc32("c_name").alias("hash"))


BITS, HASHES = sketches.bloom_size(1000, 0.05)


def _positions(source: str, item: str, sized: str | None = None) -> str:
    """The source's rows with each of their positions; ``sized``: a relation of one row (bits, hashes)."""
    hashed = xx(murmur(f"SELECT * FROM ({source}), {sized}" if sized else source, item, "h1"), item, "h2")
    bits, hashes = ("bits", "hashes") if sized else (BITS, HASHES)
    return f"SELECT *, unnest(list_transform(range(0, {hashes}), lambda i: ((h1 + i * h2) % 4294967296) % {bits})) AS pos FROM ({hashed})"


def _sized(n: str, rate: float) -> str:
    """SQL of ``bloom_size`` for a number of items."""
    return f"(SELECT bits, greatest(1, round_even(bits / n * ln(2), 0))::BIGINT AS hashes FROM (SELECT n, ceil(-n * ln({rate}) / pow(ln(2), 2))::BIGINT AS bits FROM ({n})))"


BUILT = "SELECT DISTINCT o_custkey::VARCHAR AS item FROM orders WHERE o_custkey % 5 = 0"
PROBED = "SELECT DISTINCT c_custkey::VARCHAR AS item FROM customer"


def _bloom(spark, d):
    """A filter of every fifth customer's number, sized by how many have orders, and what it says of all customers."""
    built = table(spark, d, "orders").where("o_custkey % 5 = 0").select(C("o_custkey").cast("string").alias("item")).distinct()
    bits, hashes = sketches.bloom_size(max(1, built.count()), 0.05)
    probes = table(spark, d, "customer").select(C("c_custkey").cast("string").alias("item"))
    return built, sketches.bloom_probe(probes, "item", sketches.bloom_build(built, "item", bits, hashes), bits, hashes)


BLOOM_SIZE = _sized(f"SELECT count(*) AS n FROM ({BUILT})", 0.05)
BLOOM = f"WITH f AS (SELECT DISTINCT pos FROM ({_positions(BUILT, 'item', BLOOM_SIZE)})), p AS ({_positions(PROBED, 'item', BLOOM_SIZE)}), r AS (SELECT item, count(f.pos) = count(*) AS maybe FROM p LEFT JOIN f USING (pos) GROUP BY item)"


@query(f"{BLOOM} SELECT item, maybe FROM r")
def bloom_probe(spark, d):
    return _bloom(spark, d)[1]


@query(f"{BLOOM} SELECT count(*) AS n_absent, sum(maybe::INT)::BIGINT AS n_false FROM r WHERE item NOT IN (SELECT item FROM ({BUILT}))")
def bloom_fpr(spark, d):
    built, probed = _bloom(spark, d)
    return probed.join(built, "item", "left_anti").agg(F.count("*").alias("n_absent"), F.sum(C("maybe").cast("int")).alias("n_false"))


WANTED = "SELECT DISTINCT c_custkey AS key, c_custkey::VARCHAR AS item FROM customer"


@query(f"""WITH {LG}, {LAST}, f AS (SELECT DISTINCT pos FROM ({_positions('SELECT DISTINCT key::VARCHAR AS item FROM lg', 'item', _sized('SELECT count(DISTINCT key) AS n FROM lg', 0.01))})),
a AS (SELECT p.key, count(f.pos) = count(*) AS asked FROM ({_positions(WANTED, 'item', _sized('SELECT count(DISTINCT key) AS n FROM lg', 0.01))}) p LEFT JOIN f USING (pos) GROUP BY p.key)
SELECT a.key, l.value, l.key IS NOT NULL AS found, asked FROM a LEFT JOIN (SELECT * FROM last WHERE op = 'put') l ON l.key = a.key""")
def bloom_store_get(spark, d):
    """Lookups of all customers in a store behind a Bloom filter of its keys."""
    own = event_log(spark, d)
    keys = own.select("key").distinct()
    bits, hashes = sketches.bloom_size(max(1, keys.count()), 0.01)
    return segments.filtered_get(own, _customer_keys(spark, d), sketches.bloom_build(keys, "key", bits, hashes), bits, hashes)


SEGMENT_SIZE = _sized("SELECT max(n) AS n FROM (SELECT count(DISTINCT key) AS n FROM sg GROUP BY segment_id)", 0.01)


@query(f"""WITH {SG}, {LAST}, f AS (SELECT DISTINCT segment_id, pos FROM ({_positions('SELECT DISTINCT segment_id, key::VARCHAR AS item FROM sg', 'item', SEGMENT_SIZE)})),
p AS (SELECT DISTINCT key, pos FROM ({_positions(WANTED, 'item', SEGMENT_SIZE)})), m AS (SELECT key, segment_id FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM p) JOIN f USING (pos) GROUP BY key, segment_id, n HAVING count(*) = n)
SELECT p.key, l.value, l.key IS NOT NULL AS found, (SELECT count(*) FROM m WHERE m.key = p.key) AS n_maybe FROM (SELECT DISTINCT key FROM p) p LEFT JOIN (SELECT * FROM last WHERE op = 'put') l ON l.key = p.key""")
def lsm_bloom_get(spark, d):
    """Lookups of all customers that skip the segments whose filters rule them out."""
    own = event_segments(spark, d)
    return segments.guarded_get(own, _customer_keys(spark, d), *segments.segment_filters(own))


CHANGES = "SELECT user_id::VARCHAR AS item, sum(CASE WHEN event_type = 'purchase' THEN {gone} ELSE 1 END) AS d FROM events GROUP BY 1"


def _cbloom(gone: int) -> str:
    return f"WITH c AS ({CHANGES.format(gone=gone)}), f AS (SELECT pos, greatest(sum(d), 0)::BIGINT AS n FROM ({_positions('SELECT * FROM c', 'item')}) GROUP BY pos), p AS ({_positions('SELECT DISTINCT c_custkey::VARCHAR AS item FROM customer', 'item')}) SELECT item, min(coalesce(n, 0)) AS n FROM p LEFT JOIN f USING (pos) GROUP BY item"


def _counting(spark, d, gone):
    changes = table(spark, d, "events").select(C("user_id").cast("string").alias("item"), F.when(C("event_type") == "purchase", gone).otherwise(1).alias("delta"))
    return sketches.counting_count(table(spark, d, "customer").select(C("c_custkey").cast("string").alias("item")), "item", sketches.counting_build(changes, "item", "delta", BITS, HASHES), BITS, HASHES)


@query(_cbloom(1))
def cbloom_count(spark, d):
    return _counting(spark, d, 1)


@query(_cbloom(-1))
def cbloom_remove(spark, d):
    return _counting(spark, d, -1)


MERKLE = f"""WITH RECURSIVE lv AS (SELECT 0 AS level, list(sha256(coalesce(text, '')) ORDER BY doc_id) AS h, '{merkle.EMPTY}' AS pad FROM documents
UNION ALL SELECT level + 1, list_transform(range(0, (len(h) + 1) // 2), lambda i: sha256(unhex(h[2 * i + 1] || coalesce(h[2 * i + 2], pad)))), sha256(unhex(pad || pad)) FROM lv WHERE len(h) > 1)"""


def _leaves(spark, d):
    return merkle.leaves(table(spark, d, "documents"), "doc_id", "text")


@query(f"{MERKLE} SELECT h[1] AS root FROM lv WHERE len(h) = 1")
def merkle_root(spark, d):
    return merkle.root_of(_leaves(spark, d))


@query(f"{MERKLE} SELECT level, coalesce(h[xor(77 >> level, 1) + 1], pad) AS sibling FROM lv WHERE len(h) > 1")
def merkle_proof(spark, d):
    return merkle.proof(merkle.tree(_leaves(spark, d)), 77, table(spark, d, "documents").count())


@query("SELECT pos AS idx, pos % 74 <> 0 AS ok FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos % 37 = 0")
def merkle_verify_proofs(spark, d):
    """Proofs of every 37th document; every other one is held against a leaf that isn't its own."""
    nodes, n = merkle.tree(_leaves(spark, d)), table(spark, d, "documents").count()
    found = merkle.proofs(nodes, spark.range(0, n, 37).select(C("id").alias("idx")), n)
    forged = F.when(C("idx") % 74 == 0, F.sha2("leaf", 256)).otherwise(C("leaf"))
    return merkle.verify_proofs(found.withColumn("leaf", forged), merkle.root(nodes).first()["root"])


@query("SELECT true AS intact")
def merkle_verify(spark, d):
    root = merkle.root(merkle.tree(_leaves(spark, d))).first()["root"]
    return merkle.verify(table(spark, d, "documents"), "doc_id", "text", root)


@query("SELECT pos FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id FROM documents) WHERE doc_id % 50 = 7")
def merkle_diff(spark, d):
    own = table(spark, d, "documents").select("doc_id", "text")
    changed = own.withColumn("text", F.when(C("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(C("text")))
    return merkle.diff(merkle.leaves(own, "doc_id", "text"), merkle.leaves(changed, "doc_id", "text"))


# Partitioning.


@query(f"SELECT part, sum(c)::BIGINT AS n FROM (SELECT hash % 8 AS part, c FROM ({murmur('SELECT l_orderkey::VARCHAR AS k, count(*) AS c FROM lineitem GROUP BY 1', 'k', 'hash')})) GROUP BY part")
def part_hash(spark, d):
    keys = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"))  # each key is hashed once
    return keys.select(partitioning.hash_partition(C("l_orderkey"), 8).alias("part"), "c").groupBy("part").agg(F.sum("c").alias("n"))


@query("SELECT part, count(*) AS n FROM (SELECT (o_orderkey >= 1000)::INT + (o_orderkey >= 5000)::INT + (o_orderkey >= 9000)::INT AS part FROM orders) GROUP BY part")
def part_range(spark, d):
    return table(spark, d, "orders").select(partitioning.range_partition(C("o_orderkey"), [1000, 5000, 9000]).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, (c_custkey >= 100)::INT + (c_custkey >= 700)::INT AS first, (c_custkey + 300 >= 100)::INT + (c_custkey + 300 >= 700)::INT AS last FROM customer")
def part_range_span(spark, d):
    return table(spark, d, "customer").select("c_custkey", partitioning.range_span(C("c_custkey"), C("c_custkey") + 300, [100, 700]).alias("s")).select("c_custkey", "s.first", "s.last")


def _ring_sql(n: int, p: str = "") -> str:
    vnodes = f"SELECT 'node-' || o AS node, o AS ord, i, 'node-' || o || '#' || i AS vk FROM range({n}) a(o), range({partitioning.VNODES}) b(i)"
    return f"ring{p} AS (SELECT h AS hash, arg_max(node, struct_pack(o := ord, i := i)) AS node FROM (SELECT *, CASE WHEN u >= 2147483648 THEN u::BIGINT - 4294967296 ELSE u::BIGINT END AS h FROM ({murmur(vnodes, 'vk', 'u')})) GROUP BY h)"


KEYS = f"ks AS (SELECT key, CASE WHEN u >= 2147483648 THEN u::BIGINT - 4294967296 ELSE u::BIGINT END AS h FROM ({murmur('SELECT c_custkey AS key, c_custkey::VARCHAR AS ck FROM customer', 'ck', 'u')}))"


def _owner(p: str = "") -> str:
    return f"own{p} AS (SELECT key, coalesce(r.node, (SELECT arg_min(node, hash) FROM ring{p})) AS node FROM ks ASOF LEFT JOIN ring{p} r ON ks.h <= r.hash)"


def _customer_keys(spark, d):
    return table(spark, d, "customer").select(C("c_custkey").alias("key"))


@query(f"WITH {_ring_sql(8)}, {KEYS}, {_owner()} SELECT key, node FROM own")
def ring_lookup(spark, d):
    return partitioning.ring_lookup(_customer_keys(spark, d), partitioning.ring(nodes(spark, 8)))


@query(f"WITH {_ring_sql(8)}, {KEYS}, far AS (SELECT key, node, min((hash - h + 4294967296) % 4294967296) AS d FROM ks, ring GROUP BY key, node), r AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY d) AS k FROM far) SELECT key, k::INT AS k, node FROM r WHERE k <= 3")
def ring_replicas(spark, d):
    return partitioning.ring_replicas(_customer_keys(spark, d), partitioning.ring(nodes(spark, 8)), 3)


@query(f"WITH {_ring_sql(8)}, {_ring_sql(9, '9')}, {KEYS}, {_owner()}, {_owner('9')} SELECT own9.node, count(*) AS n_moved FROM own JOIN own9 USING (key) WHERE own.node <> own9.node GROUP BY own9.node")
def ring_rebalance(spark, d):
    """Where keys move when a ninth node joins: to it alone."""
    keys = _customer_keys(spark, d)
    old, new = partitioning.ring_lookup(keys, partitioning.ring(nodes(spark, 8))), partitioning.ring_lookup(keys, partitioning.ring(nodes(spark, 9)))
    return old.select("key", C("node").alias("old")).join(new, "key").where("old <> node").groupBy("node").agg(F.count("*").alias("n_moved"))


RDV = f"r AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY u DESC, ord) AS k FROM ({murmur('''SELECT c_custkey AS key, 'node-' || o AS node, o AS ord, c_custkey || ':node-' || o AS rk FROM customer, range(8) a(o)''', 'rk', 'u')}))"


@query(f"WITH {RDV} SELECT key, 1 AS k, node FROM r WHERE k = 1")
def rdv_lookup(spark, d):
    return partitioning.rendezvous(_customer_keys(spark, d), nodes(spark, 8))


@query(f"WITH {RDV} SELECT key, k::INT AS k, node FROM r WHERE k <= 3")
def rdv_topn(spark, d):
    return partitioning.rendezvous(_customer_keys(spark, d), nodes(spark, 8), 3)


# Transactions.


@query(f"WITH {TX} SELECT txn, begin_seq, end_seq, state FROM st")
def mvcc_txn_states(spark, d):
    return txn.states(transactions(spark, d))


@query(f"""WITH {TX}, rd AS (SELECT tx.seq, tx.txn, tx.key, begin_seq FROM tx JOIN st USING (txn) WHERE op = 'read'),
wr AS (SELECT tx.seq AS w_seq, tx.txn AS w_txn, tx.key, value, CASE WHEN state = 'committed' THEN end_seq END AS w_end FROM tx JOIN st USING (txn) WHERE op = 'write'),
best AS (SELECT rd.seq, arg_max(value, w_seq) AS value FROM rd JOIN wr USING (key) WHERE w_seq < rd.seq AND (w_txn = txn OR w_end < begin_seq) GROUP BY rd.seq)
SELECT rd.seq, txn, key, best.value FROM rd LEFT JOIN best USING (seq)""")
def mvcc_snapshot_read(spark, d):
    return txn.snapshot_reads(transactions(spark, d))


@query(f"""WITH {TX}, ok AS (SELECT * FROM st WHERE state = 'committed'), side AS (SELECT DISTINCT op, txn, key, begin_seq, end_seq FROM tx JOIN ok USING (txn) WHERE op IN ('read', 'write'))
SELECT DISTINCT r.txn AS reader, w.txn AS writer FROM side r JOIN side w USING (key) WHERE r.op = 'read' AND w.op = 'write' AND r.txn <> w.txn AND r.begin_seq < w.end_seq AND w.begin_seq < r.end_seq""")
def ssi_conflict_pairs(spark, d):
    return txn.conflict_pairs(transactions(spark, d))


@query(f"""WITH RECURSIVE {TX}, rq AS (SELECT begin_seq // 2000 AS store, * FROM st WHERE begin_seq IS NOT NULL AND end_seq IS NOT NULL), rw AS (SELECT DISTINCT op, key, rq.* FROM tx JOIN rq USING (txn) WHERE op IN ('read', 'write')),
cf AS (SELECT a.txn, list(DISTINCT b.txn) AS rivals FROM rw a JOIN rw b ON a.store = b.store AND a.key = b.key AND a.op <> b.op AND b.end_seq < a.end_seq AND b.end_seq > a.begin_seq GROUP BY a.txn),
{_fold_sql("SELECT store, end_seq AS seq, rq.txn, state, coalesce(rivals, []) AS rivals FROM rq LEFT JOIN cf ON cf.txn = rq.txn", "[]::BIGINT[] AS done", "CASE WHEN o.state = 'committed' AND NOT list_has_any(f.done, o.rivals) THEN list_append(f.done, o.txn) ELSE f.done END")}
SELECT store, txn, CASE WHEN list_contains(done, txn) THEN 'committed' ELSE 'aborted' END AS outcome FROM fold JOIN o USING (store, i)""")
def ssi_outcome(spark, d):
    return txn.ssi_outcome(transactions(spark, d))


# Replication.


def followers(spark):
    return spark.createDataFrame([("follower-0", 1000), ("follower-1", 5000), ("follower-2", 0)], "follower string, hwm long")


FW = "fw AS (SELECT * FROM (VALUES ('follower-0', 1000), ('follower-1', 5000), ('follower-2', 0)) t(follower, hwm))"


@query(f"WITH {LG}, {FW}, own AS (SELECT * FROM lg JOIN fw ON seq <= hwm) SELECT follower, key, value FROM (SELECT follower, key, arg_max(struct_pack(v := value), seq).v AS value, arg_max(op, seq) AS op FROM own GROUP BY follower, key) WHERE op = 'put'")
def repl_follower_state(spark, d):
    return replication.follower_state(event_log(spark, d), followers(spark))


@query(f"WITH {FW} SELECT follower, hwm FROM fw WHERE follower <> 'follower-1' UNION ALL SELECT 'follower-9', 0")
def repl_membership(spark, d):
    return replication.without_follower(replication.with_follower(replication.with_follower(followers(spark), "follower-9"), "follower-2"), "follower-1")


@query(f"WITH {LG}, {FW} SELECT follower, (SELECT coalesce(max(seq), 0) FROM lg) - hwm AS lag FROM fw")
def repl_lag(spark, d):
    return replication.lag(event_log(spark, d), followers(spark))


@query(f"WITH {LG} SELECT key, value, seq, op FROM lg WHERE seq > 900")
def repl_entries_after(spark, d):
    return replication.entries_after(event_log(spark, d), 900)


@query(f"WITH {LG}, {LAST} SELECT key, value FROM last WHERE op = 'put'")
def repl_leader_state(spark, d):
    return replication.leader_state(event_log(spark, d))


@query(f"WITH {CELLS} SELECT key, arg_max(value, version) AS value, max(version) AS version, count(DISTINCT replica) AS n_replicas, count(DISTINCT replica) >= 2 AS ok FROM cells GROUP BY key")
def quorum_read(spark, d):
    return replication.quorum_read(cells(spark, d), 2)


@query(f"""WITH {CELLS}, best AS (SELECT key, arg_max(value, version) AS value, max(version) AS version FROM cells GROUP BY key), held AS (SELECT replica, key, max(version) AS held FROM cells GROUP BY replica, key)
SELECT r.replica, best.key, best.value, best.version FROM best CROSS JOIN (SELECT DISTINCT replica FROM cells) r LEFT JOIN held ON held.replica = r.replica AND held.key = best.key WHERE held IS NULL OR held < version""")
def quorum_repair(spark, d):
    own = cells(spark, d)
    return replication.read_repair(own, own)


UP = "up AS (SELECT * FROM (VALUES ('replica-0', 0, 6000), ('replica-1', 2000, 1000000), ('replica-2', 500, 4000)) t(replica, version_from, version_to))"


@query(f"WITH {UP}, p AS (SELECT event_id AS version, replica, row_number() OVER (PARTITION BY event_id ORDER BY replica) AS k FROM events JOIN up ON event_id BETWEEN version_from AND version_to) SELECT version, replica, count(*) OVER (PARTITION BY version) >= 2 AS success FROM p WHERE k <= 2")
def quorum_write(spark, d):
    up = spark.createDataFrame([("replica-0", 0, 6000), ("replica-1", 2000, 1_000_000), ("replica-2", 500, 4000)], "replica string, version_from long, version_to long")
    return replication.quorum_write(table(spark, d, "events").select(C("event_id").alias("version")), up, 2)


@query("SELECT pos, seq FROM (SELECT *, max(seq) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT event_id AS pos, event_id - 3 * (event_id % 7) AS seq FROM events)) WHERE seq <= 0 OR seq <= before")
def repl_append_check(spark, d):
    return replication.refused_appends(table(spark, d, "events").select(C("event_id").alias("pos"), (C("event_id") - 3 * (C("event_id") % 7)).alias("seq")))


@query("SELECT 'replica-' || i AS replica, coalesce((SELECT arg_max(event_type <> 'error', event_id) FROM events WHERE user_id % 3 = i), true) AS available FROM range(4) t(i)")
def quorum_availability(spark, d):
    changes = table(spark, d, "events").select(C("event_id").alias("seq"), F.concat(F.lit("replica-"), (C("user_id") % 3).cast("string")).alias("replica"), (C("event_type") != "error").alias("available"))
    return replication.availability(spark.range(4).select(F.concat(F.lit("replica-"), C("id").cast("string")).alias("replica")), changes)


# Mergeable state and clocks.


def counts(spark, d):
    """Each replica's view: counts per node up to the replica's part of the log."""
    rows = table(spark, d, "events").withColumn("node", F.concat(F.lit("n"), (C("user_id") % 5).cast("string")))
    views = [rows.where(C("event_id") % 3 != i).groupBy("node").agg(F.count_if(C("event_type") == "purchase").alias("pos"), F.count_if(C("event_type") == "error").alias("neg")).withColumn("replica", F.lit(f"r{i}")) for i in range(3)]
    return views[0].unionByName(views[1]).unionByName(views[2])


CN = "cn AS (SELECT 'r' || i AS replica, 'n' || (user_id % 5) AS node, sum((event_type = 'purchase')::INT)::BIGINT AS pos, sum((event_type = 'error')::INT)::BIGINT AS neg FROM events, range(3) t(i) WHERE event_id % 3 <> i GROUP BY 1, 2)"


@query(f"WITH {CN} SELECT sum(n)::BIGINT AS value FROM (SELECT node, max(pos) AS n FROM cn GROUP BY node)")
def crdt_gcounter(spark, d):
    return mergeable.gcounter_value(counts(spark, d).select("replica", "node", C("pos").alias("n")))


@query(f"WITH {CN} SELECT sum(p - m)::BIGINT AS value FROM (SELECT node, max(pos) AS p, max(neg) AS m FROM cn GROUP BY node)")
def crdt_pncounter(spark, d):
    return mergeable.pncounter_value(counts(spark, d))


@query("SELECT DISTINCT user_id AS item FROM events WHERE event_id % 3 <> 1")
def crdt_gset(spark, d):
    rows = table(spark, d, "events").select(C("user_id").alias("item"), "event_id")
    return mergeable.gset_merge(rows.where("event_id % 3 = 0").select("item"), rows.where("event_id % 3 = 2").select("item"))


TG = "tg AS (SELECT user_id AS item, user_id || ':' || (event_id % 50) AS tag, event_type = 'error' AS removed FROM events)"


def tags(spark, d):
    return table(spark, d, "events").select(C("user_id").alias("item"), F.concat_ws(":", C("user_id").cast("string"), (C("event_id") % 50).cast("string")).alias("tag"), (C("event_type") == "error").alias("removed"))


@query(f"WITH {TG} SELECT DISTINCT item FROM (SELECT item, tag FROM tg GROUP BY item, tag HAVING NOT bool_or(removed))")
def crdt_orset(spark, d):
    return mergeable.orset_observed(tags(spark, d))


@query(f"WITH {TG} SELECT DISTINCT item, tag FROM tg WHERE NOT removed")
def crdt_orset_union(spark, d):
    own = tags(spark, d).where("not removed")
    return mergeable.orset_merge(own.where("item % 2 = 0").select("item", "tag"), own.where("item % 3 <> 1").select("item", "tag"), own.select("item", "tag"))


CK = "ck AS (SELECT user_id AS process, 'n' || (event_id % 4) AS node, count(*) AS n FROM events GROUP BY 1, 2)"


def clocks(spark, d):
    rows = table(spark, d, "events").groupBy(C("user_id").alias("process"), F.concat(F.lit("n"), (C("event_id") % 4).cast("string")).alias("node")).agg(F.count("*").alias("n"))
    return rows.groupBy("process").agg(F.map_from_entries(F.collect_list(F.struct("node", "n"))).alias("clock"))


@query(f"""WITH {CK}, p AS (SELECT DISTINCT process AS a, process + 1 AS b FROM ck WHERE process + 1 IN (SELECT process FROM ck)),
dn AS (SELECT a, b, n.node, coalesce(x.n, 0) - coalesce(y.n, 0) AS dif FROM p CROSS JOIN (SELECT DISTINCT node FROM ck) n LEFT JOIN ck x ON x.process = a AND x.node = n.node LEFT JOIN ck y ON y.process = b AND y.node = n.node)
SELECT a, b, CASE WHEN bool_or(dif < 0) AND bool_or(dif > 0) THEN 'concurrent' WHEN bool_or(dif < 0) THEN 'before' WHEN bool_or(dif > 0) THEN 'after' ELSE 'equal' END AS relation FROM dn GROUP BY a, b""")
def vclock_compare(spark, d):
    a = clocks(spark, d)
    b = a.select((C("process") - 1).alias("a"), C("process").alias("b"), C("clock").alias("other"))
    return a.withColumnRenamed("process", "a").join(b, "a").select("a", "b", mergeable.clock_relation(C("clock"), C("other")).alias("relation"))


@query(f"WITH {CK} SELECT process % 10 AS cluster, node, max(n) AS n FROM ck GROUP BY 1, 2")
def vclock_merge(spark, d):
    rows = clocks(spark, d).select((C("process") % 10).alias("cluster"), F.explode("clock").alias("node", "n"))
    return mergeable.clocks_merged(rows, "cluster")


@query("SELECT user_id AS process, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ts FROM events")
def lamport_local(spark, d):
    return mergeable.lamport(table(spark, d, "events").select(C("user_id").alias("process"), C("event_id").alias("seq"), F.lit(None).cast("long").alias("received")))


@query("""WITH e AS (SELECT user_id AS process, event_id AS seq, CASE WHEN event_type = 'click' THEN event_id % 97 END AS received, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT process, seq, (i + greatest(0, coalesce(max(received - (i - 1)) OVER (PARTITION BY process ORDER BY seq), 0)))::BIGINT AS ts FROM e""")
def lamport_receive(spark, d):
    return mergeable.lamport(table(spark, d, "events").select(C("user_id").alias("process"), C("event_id").alias("seq"), F.when(C("event_type") == "click", C("event_id") % 97).alias("received")))


@query("""WITH a AS (SELECT 'n' || user_id AS node, event_type AS state, event_id % 100 AS version, event_id FROM events), l AS (SELECT node, arg_max(state, event_id) AS state, arg_max(version, event_id) AS version FROM a WHERE event_id % 2 = 0 GROUP BY node),
r AS (SELECT node, arg_max(state, event_id) AS state, arg_max(version, event_id) AS version FROM a WHERE event_id % 2 = 1 GROUP BY node)
SELECT coalesce(l.node, r.node) AS node, CASE WHEN l.node IS NULL OR r.version > l.version THEN r.state ELSE l.state END AS state, CASE WHEN l.node IS NULL OR r.version > l.version THEN r.version ELSE l.version END AS version FROM l FULL JOIN r ON l.node = r.node""")
def gossip_merge(spark, d):
    own = table(spark, d, "events").select(F.concat(F.lit("n"), C("user_id").cast("string")).alias("node"), C("event_type").alias("state"), (C("event_id") % 100).alias("version"), "event_id")
    known = lambda parity: own.where(C("event_id") % 2 == parity).groupBy("node").agg(F.max(F.struct("event_id", "state", "version")).alias("s")).select("node", "s.state", "s.version")
    return mergeable.gossip_merge(known(0), known(1))


# Consensus.

VT = """rq AS (SELECT event_id AS seq, 'v' || (user_id % 5) AS voter, event_id // 50 AS term, 'c' || (user_id % 3) AS candidate, event_id % 7 AS last_term, event_id % 11 AS last_index FROM events),
vt AS (SELECT voter, term, arg_min(candidate, seq) AS candidate FROM rq WHERE last_term > 2 OR last_term = 2 AND last_index >= 4 GROUP BY voter, term)"""


@query(f"WITH {VT} SELECT term, candidate, count(DISTINCT voter) AS votes, 2 * count(DISTINCT voter) > 5 AS leader FROM vt GROUP BY term, candidate")
def raft_vote_tally(spark, d):
    requests = table(spark, d, "events").select(C("event_id").alias("seq"), F.concat(F.lit("v"), (C("user_id") % 5).cast("string")).alias("voter"), F.floor(C("event_id") / 50).cast("long").alias("term"), F.concat(F.lit("c"), (C("user_id") % 3).cast("string")).alias("candidate"), (C("event_id") % 7).alias("last_term"), (C("event_id") % 11).alias("last_index"))
    voters = spark.createDataFrame([(f"v{i}", 2, 4) for i in range(5)], "voter string, own_last_term long, own_last_index long")
    return consensus.tally(consensus.granted_votes(requests, voters), 5)


def _matches(spark):
    return spark.createDataFrame([("node-0", 950), ("node-1", 700), ("node-2", 810), ("node-3", 20), ("node-4", 999)], "node string, match_index long")


@query("SELECT coalesce(max(event_id), -1) AS commit_index FROM events WHERE event_id <= 810 AND event_id // 100 = 8")
def raft_commit_index(spark, d):
    own = table(spark, d, "events").select(C("event_id").alias("idx"), F.floor(C("event_id") / 100).cast("long").alias("term"))
    return consensus.commit_index(own, _matches(spark), 8)


@query("SELECT 'node-' || i AS node, min(event_id) AS first_conflict FROM events, range(1, 4) t(i) WHERE event_id >= 100 * i GROUP BY 1")
def raft_log_divergence(spark, d):
    own = table(spark, d, "events").select(C("event_id").alias("idx"), F.floor(C("event_id") / 100).cast("long").alias("term"))
    others = own.select("idx", "term", F.explode(F.array(*(F.lit(i) for i in (1, 2, 3)))).alias("i")).select(F.concat(F.lit("node-"), C("i").cast("string")).alias("node"), "idx", F.when(C("idx") >= 100 * C("i"), C("term") + 100).otherwise(C("term")).alias("term"))
    return consensus.divergence(own, others)


def _entries(spark, d):
    return table(spark, d, "events").select(C("event_id").alias("idx"), F.floor(C("event_id") / 100).cast("long").alias("term"), C("event_type").alias("command"))


@query("SELECT event_id AS idx, event_id // 100 AS term, event_type AS command FROM events WHERE event_id <= 810")
def raft_committed(spark, d):
    own = _entries(spark, d)
    return consensus.committed(own, consensus.commit_index(own.where("idx <= 810"), _matches(spark), 8))


@query("SELECT event_id AS idx, CASE WHEN event_id >= 600 THEN 9 ELSE event_id // 100 END AS term, event_type AS command FROM events WHERE event_id <= 800")
def raft_append_entries(spark, d):
    """A follower's entries from 600 on conflict with the leader's and go."""
    own = _entries(spark, d)
    sent = own.where("idx between 500 and 800").withColumn("term", F.when(C("idx") >= 600, 9).otherwise(C("term")))
    return consensus.append_entries(own.where("idx <= 950"), sent, 499, 4)


# Entries and orders.


@query("SELECT c_custkey AS key, c_name AS value FROM customer")
def csv_entry_read(spark, d):
    path = scratch_path(spark, "csv")
    serde.write_csv(table(spark, d, "customer").select(C("c_custkey").alias("key"), C("c_name").alias("value")), path)
    return serde.read_csv(spark, path, "key long, value string")


@query("SELECT n_nationkey::BIGINT AS key, n_name AS value FROM nation")
def bin_entry_read(spark, d):
    """Entries of one small binary file."""
    path = scratch_path(spark, "binary")
    rows = table(spark, d, "nation").select(serde.binary_entry(C("n_nationkey").cast("long"), C("n_name")).alias("e")).collect()
    files.write_bytes(spark, path, b"".join(bytes(r["e"]) for r in rows))
    return serde.read_binary(spark, path, "key long, value string")


@query("""SELECT doc_id, doc_id || ',' || CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS entry FROM documents""")
def csv_entry_encode(spark, d):
    return table(spark, d, "documents").select("doc_id", serde.csv_entry(C("doc_id"), C("text")).alias("entry"))


@query("""SELECT o_orderkey, upper(string_agg(substring(h, 17 - 2 * i, 2), '' ORDER BY i) || printf('%02X', length(o_orderpriority)) || hex(encode(o_orderpriority))) AS entry
FROM (SELECT o_orderkey, o_orderpriority, printf('%016X', o_orderkey) AS h FROM orders), range(1, 9) t(i) GROUP BY o_orderkey, o_orderpriority""")
def bin_entry_encode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.hex(serde.binary_entry(C("o_orderkey"), C("o_orderpriority"))).alias("entry"))


@model.key
@dataclasses.dataclass(frozen=True)
class OrderKey:
    customer: int
    order: int


@model.value
@dataclasses.dataclass(frozen=True)
class OrderEntry:
    key: OrderKey
    status: str
    marks: list[str]


@query("SELECT o_custkey AS customer, o_orderkey AS \"order\", o_orderstatus AS status, o_orderpriority || '|' || o_orderstatus AS marks FROM orders")
def typed_entry_round_trip(spark, d):
    """Orders as entries of a type, encoded and decoded."""
    rows = table(spark, d, "orders").select(F.struct(F.struct(C("o_custkey").alias("customer"), C("o_orderkey").alias("order")).alias("key"), C("o_orderstatus").alias("status"), F.array("o_orderpriority", "o_orderstatus").alias("marks")).alias("x"))
    back = model.decoded(rows.select(model.encoded(OrderEntry, C("x")).alias("e")), "e", OrderEntry)
    return back.select("key.customer", "key.order", "status", F.array_join("marks", "|").alias("marks"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey NULLS FIRST, o_orderkey NULLS FIRST) - 1 AS n FROM orders")
def composite_key_sort(spark, d):
    return sstable.place(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")
