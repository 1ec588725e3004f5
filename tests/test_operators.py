"""Behaviour of single operators on small relations."""

import dataclasses
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import hashing, partitioning, sketches
from tidelog.operators import consensus, log, merkle, mergeable, model, ordered, replication, segments, sstable, txn
from tidelog.sources import files, serde
from tidelog.streaming import follow

# Text, FNV-1a, Murmur3 with seed 0xc58f1a7b, xxHash32 with seed 0.
GOLDEN = [
    ("", 2166136261, 2183108998, 46947589),
    ("a", 3826002220, 562955188, 1426945110),
    ("abc", 440920331, 3390692450, 852579327),
    ("Hello", 4116459851, 2705304780, 4060533391),
    ("Hello, World!", 1525479220, 2703889694, 1074257488),
    ("The quick brown fox jumps over the lazy dog", 76545936, 1974739670, 3898516702),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def put_log(spark, entries):
    return spark.createDataFrame(entries, "key int, value string, seq long, op string")


def test_hashes(spark):
    df = spark.createDataFrame([(t,) for t, *_ in GOLDEN] + [(None,)], "t string")
    got = {r["t"]: (r["f"], r["m"], r["x"]) for r in df.select("t", hashing.fnv1a(F.col("t")).alias("f"), hashing.murmur3(F.col("t")).alias("m"), hashing.xxhash32(F.col("t")).alias("x")).collect()}
    assert got == {t: tuple(h) for t, *h in GOLDEN} | {None: (None, None, None)}


@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
@settings(max_examples=40, deadline=None)
def test_xxhash_many(texts):
    with np.errstate(over="ignore"):
        got = hashing.xxhash32_many(*hashing._bytes(pd.Series(texts)))
    assert got.tolist() == [xxhash.xxh32_intdigest(t.encode()) for t in texts]


def test_last_writer_wins(spark):
    own = put_log(spark, [(1, "a", 1, "put"), (2, "b", 2, "put"), (1, "c", 3, "put"), (2, None, 4, "del"), (2, "d", 5, "put"), (3, "e", 6, "put"), (3, None, 7, "del")])
    assert rows(log.live(own)) == [(1, "c", 3), (2, "d", 5)]
    assert rows(log.scan_range(own, 2, 1)) == []
    assert rows(log.multi_get(own, spark.createDataFrame([(1,), (9,)], "key int"))) == [(1, "c", True), (9, None, False)]
    assert rows(log.get(own, 3)) == []


def test_compaction_keeps_tombstones_over_older_segments(spark):
    own = put_log(spark, [(1, "a", 1, "put"), (1, None, 2, "del"), (2, "b", 3, "put"), (2, "c", 4, "put")]).withColumn("segment_id", F.col("seq") - 1)
    kept = segments.compact(own, [1, 2])
    assert rows(log.live(kept.select("key", "value", "seq", "op"))) == rows(log.live(own.drop("segment_id")))
    full = segments.compact(own, [0, 1, 2, 3])
    assert rows(full.select("key", "value")) == [(2, "c")]
    assert segments.compact(own, [1]) is own
    assert rows(segments.compact(full, [3]).select("key", "value")) == [(2, "c")]


def test_strategies(spark):
    def chosen(strategy, *sizes):
        return sorted(r["segment_id"] for r in strategy.choose(spark.createDataFrame(sizes, "segment_id long, n_rows long")).collect())

    assert chosen(segments.Full(3), (1, 1), (2, 1)) == [] and chosen(segments.Full(3), (3, 1), (1, 1), (2, 1)) == [1, 2, 3]
    assert chosen(segments.Leveled(2), (5, 1), (4, 1), (3, 1)) == [3, 4] and chosen(segments.Leveled(2), (5, 1)) == []
    assert chosen(segments.SizeTiered(2), (1, 100), (2, 5), (3, 110)) == [1, 3]
    assert chosen(segments.Levels(10, 10), (1, 90), (2, 5), (3, 4), (4, 3)) == [2, 3, 4] and chosen(segments.Levels(10, 10), (1, 90), (2, 5)) == []
    for bad in ({"capacity": 0}, {"threshold": -1}, {"bloom_rate": 1.0}):
        with pytest.raises(ValueError):
            segments.Options(**bad)
    assert segments.Options().compaction is None and segments.Options(threshold=3).compaction == segments.Full(3)


def test_flush_exact_and_roll(spark):
    own = spark.createDataFrame([("s", i, k) for i, k in enumerate([1, 1, 2, 3, 3, 1])], "store string, seq long, key int")
    assert [r[-1] for r in sorted(map(tuple, segments.flush_exact(own, 2).collect()))] == [0, 0, 0, 1, 1, 1]
    sized = spark.createDataFrame([("s", i, n) for i, n in enumerate([6, 6, 1, 20, 1])], "store string, seq long, size long")
    assert [r[-1] for r in sorted(map(tuple, segments.roll(sized, 10).collect()))] == [0, 0, 1, 1, 2]


def test_wal(spark):
    own = put_log(spark, [(i, f"v{i}", i, "put") for i in range(1, 6)])
    frames = segments.wal_frames(own, F.col("value"))
    assert frames.where("seq = 1").first()["crc"] == zlib.crc32(b"v1")
    bad = frames.withColumn("crc", F.when(F.col("seq") == 2, 0).otherwise(F.col("crc"))).withColumn("length", F.when(F.col("seq") == 5, 99).otherwise(F.col("length")))
    assert [r["seq"] for r in segments.recover(bad).orderBy("seq").collect()] == [1, 3, 4]


def test_sorted_tables(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "key int, value string")
    b = spark.createDataFrame([(2, None), (3, "c")], "key int, value string")
    assert rows(sstable.merge(a, b)) == [(1, "a"), (2, None), (3, "c")]
    own = spark.createDataFrame([(i, k) for i, k in enumerate([1, 3, 3, 2, 9])], "pos long, key int")
    assert sorted(r["pos"] for r in sstable.out_of_order(own).collect()) == [2, 3]
    index = spark.createDataFrame([(10, 0), (20, 7)], "key int, offset long")
    probes = spark.createDataFrame([(5,), (10,), (19,), (99,)], "key int")
    assert rows(sstable.floor_lookup(probes, index)) == [(10, 10, 0), (19, 10, 0), (5, None, None), (99, 20, 7)]


@pytest.mark.parametrize("slab", [1 << 24, 1 << 10])
def test_segment_filters_without_pairs(spark, monkeypatch, slab):
    """Every pair of key and segment against brute force: segments of one size, much smaller ones, a null key; no row is made for a pair."""
    monkeypatch.setattr(segments, "SLAB_BITS", slab)
    held = [(i, (i * 37 + j) % 900) for i in range(150) for j in range(20)] + [(200, k) for k in range(1000, 1400)] + [(300 + k, k) for k in range(70)]
    own = spark.createDataFrame([(s, k, f"v{n}", n, "del" if n % 11 == 0 else "put") for n, (s, k) in enumerate(held)], "segment_id long, key long, value string, seq long, op string")
    wanted = spark.createDataFrame([(None,), (5,), (5,), *((k,) for k in range(0, 3000, 3))], "key long")
    filters, bits, hashes = segments.segment_filters(own, 0.05)
    small = filters.where("positions is not null").count()
    assert (bits, hashes) == sketches.bloom_size(400, 0.05) and 0 < small < filters.count() == 221
    got = segments.guarded_get(own, wanted, filters, bits, hashes)
    every = sorted({k for _, k in held} | {r["key"] for r in wanted.where("key is not null").collect()})
    at = {r["key"]: set(r["positions"]) for r in sketches.with_positions(spark.createDataFrame([(k,) for k in every], "key long"), "key", bits, hashes).collect()}
    full, last = {}, {}
    for n, (s, k) in enumerate(held):
        full.setdefault(s, set()).update(at[k])
        last[k] = (n, None if n % 11 == 0 else f"v{n}")
    value = {k: v for k, (_, v) in last.items()}
    expected = {(k, value.get(k), value.get(k) is not None, 0 if k is None else sum(at[k] <= f for f in full.values())) for k in {r["key"] for r in wanted.collect()}}
    found = [tuple(r) for r in got.select("key", "value", "found", "n_maybe").collect()]
    assert len(found) == len(expected) and set(found) == expected
    big = own.where("segment_id < 150")
    plan = segments.guarded_get(big, wanted, *segments.segment_filters(big))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "pos#" not in plan  # no join by position


def test_bloom(spark):
    assert [sketches.bloom_size(*x) for x in ((10, 0.01), (100, 0.01), (1000, 0.01), (1000, 0.05), (500, 0.05))] == [(96, 7), (959, 7), (9586, 7), (6236, 4), (3118, 4)]
    hello = spark.createDataFrame([("Hello",)], "item string")
    assert sketches.with_positions(hello, "item", 959, 7).first()["positions"] == [304, 662, 61, 419, 777, 176, 534]
    changes = spark.createDataFrame([("x", 1), ("x", 1), ("x", -1), ("y", -1)], "item string, delta long")
    counted = sketches.counting_build(changes, "item", "delta", 959, 7)
    assert rows(sketches.counting_count(spark.createDataFrame([("x",), ("z",)], "item string"), "item", counted, 959, 7)) == [("x", 1), ("z", 0)]


@pytest.mark.parametrize("count", [1, 3, 9])
def test_rendezvous_where_keys_are(spark, monkeypatch, count):
    """Scores against brute force, with keys that come twice, a null key and tied nodes; keys and nodes aren't joined, sorted or ranked as rows."""
    monkeypatch.setattr(partitioning, "SCORES", 40)
    named = ["node-2", "node-0", "node-1", "node-0"]
    keys = [None, 7, 7, *range(100)]
    nodes = spark.createDataFrame([(n, i) for i, n in enumerate(named)], "node string, ord long").orderBy("node")
    found = partitioning.rendezvous(spark.createDataFrame([(k,) for k in keys], "key long"), nodes, count)
    score = lambda k, n: int(hashing.murmur3_array(pa.array([n if k is None else f"{k}:{n}"]))[0])
    expected = []
    for key in set(keys):
        ranked = sorted((-score(key, n), i, n) for i, n in enumerate(named) for _ in range(keys.count(key)))
        expected += [(key, k + 1, n) for k, (_, _, n) in enumerate(ranked[:count])]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Sort", "Window"))


def test_placement(spark):
    keys = spark.createDataFrame([("1",), ("2",), ("3",), ("Hello",)], "key string")
    three = spark.createDataFrame([(f"node-{i}", i) for i in range(3)], "node string, ord long")
    assert [r[0] for r in keys.select(partitioning.hash_partition(F.col("key"), 8)).collect()] == [6, 1, 1, 4]
    assert dict(rows(partitioning.ring_lookup(keys, partitioning.ring(three)))) == {"1": "node-0", "2": "node-0", "3": "node-2", "Hello": "node-2"}
    assert {k: n for k, _, n in rows(partitioning.rendezvous(keys, three))} == {"1": "node-1", "2": "node-1", "3": "node-0", "Hello": "node-0"}
    firsts = partitioning.ring_replicas(keys, partitioning.ring(three), 5)
    assert {(k, n) for k, i, n in rows(firsts) if i == 1} == set(rows(partitioning.ring_lookup(keys, partitioning.ring(three)))) and firsts.count() == 12
    at = spark.createDataFrame([(5,), (10,), (15,), (30,)], "k int").select(partitioning.range_partition(F.col("k"), [10, 20, 30]).alias("p"))
    assert [r["p"] for r in at.collect()] == [0, 1, 1, 3]
    with pytest.raises(ValueError):
        partitioning.range_partition(F.lit(1), [2, 2])


def test_merkle(spark):
    own = spark.createDataFrame([(i, f"block{i}") for i in (1, 2, 3)], "i int, b string")
    nodes = merkle.tree(merkle.leaves(own, "i", "b"))
    root = merkle.root(nodes).first()["root"]
    assert root == "9ee8b792d10261d1fdd36b88c24107082c460a71a26584af4c0d27a651106f56"
    leaf = {r["pos"]: r["hash"] for r in nodes.where("level = 0").collect()}
    for i in range(3):
        siblings = [r["sibling"] for r in merkle.proof(nodes, i, 3).orderBy("level").collect()]
        assert merkle.verify_proof(leaf[i], i, siblings, root) and not merkle.verify_proof(leaf[i], i ^ 1, siblings, root)
    one = merkle.tree(merkle.leaves(own.where("i = 1"), "i", "b"))
    assert merkle.root(one).first()["root"] == leaf[0]
    with pytest.raises(IndexError):
        merkle.proof(nodes, 3, 3)
    for n in (1, 2, 5, 9, 16):
        leaf = merkle.leaves(spark.range(n).select("id", F.col("id").cast("string").alias("b")), "id", "b")
        assert [r["root"] for r in merkle.root_of(leaf, 2).collect()] == [merkle.root(merkle.tree(leaf)).first()["root"]]


def test_write_skew_and_snapshots(spark):
    ops = [(1, 1, "begin", None, None), (2, 2, "begin", None, None), (3, 1, "read", "A", None), (4, 1, "write", "B", "x"), (5, 2, "read", "B", None), (6, 2, "write", "A", "y"), (7, 1, "commit", None, None), (8, 2, "commit", None, None), (9, 3, "begin", None, None), (10, 3, "read", "B", None)]
    own = spark.createDataFrame([("s", *o) for o in ops], "store string, seq long, txn long, op string, key string, value string")
    assert rows(txn.ssi_outcome(own).select("txn", "outcome")) == [(1, "committed"), (2, "aborted")]
    assert {r["seq"]: r["value"] for r in txn.snapshot_reads(own).collect()} == {3: None, 5: None, 10: "x"}


def test_quorum(spark):
    with pytest.raises(ValueError):
        replication.check_quorum(3, 1, 2)
    replication.check_quorum(3, 2, 2)
    own = spark.createDataFrame([("r0", "k", "old", 1), ("r1", "k", "new", 2)], "replica string, key string, value string, version long")
    assert rows(replication.quorum_read(own, 2)) == [("k", "new", 2, 2, True)]
    three = spark.createDataFrame([("r0",), ("r1",), ("r2",)], "replica string")
    assert rows(replication.read_repair(own, three)) == [("r0", "k", "new", 2), ("r2", "k", "new", 2)]


def test_merges_are_semilattice_joins(spark):
    a = spark.createDataFrame([("r", "n1", 3), ("r", "n2", 1)], "replica string, node string, n long")
    b = spark.createDataFrame([("q", "n1", 2), ("q", "n3", 5)], "replica string, node string, n long")
    ab, ba = mergeable.gcounter_merge(a.unionByName(b)), mergeable.gcounter_merge(b.unionByName(a))
    assert rows(ab) == rows(ba) == [("n1", 3), ("n2", 1), ("n3", 5)]
    again = ab.select(F.lit("x").alias("replica"), "node", "n")
    assert rows(mergeable.gcounter_merge(again.unionByName(a))) == rows(ab)
    tags = spark.createDataFrame([("i", "t1", True), ("i", "t2", False), ("j", "t3", False), ("j", "t3", True)], "item string, tag string, removed boolean")
    assert rows(mergeable.orset_observed(tags)) == [("i",)]


def test_clock_relations(spark):
    pairs = [({"a": 1}, {"a": 1}), ({"a": 1}, {"a": 2}), ({"a": 1, "b": 1}, {"a": 1}), ({"a": 1}, {"b": 1})]
    df = spark.createDataFrame(pairs, "x map<string,long>, y map<string,long>")
    assert [r[0] for r in df.select(mergeable.clock_relation(F.col("x"), F.col("y"))).collect()] == ["equal", "before", "after", "concurrent"]
    own = spark.createDataFrame([("p", 1, None), ("p", 2, 10), ("p", 3, 3), ("p", 4, None)], "process string, seq long, received long")
    assert [r["ts"] for r in mergeable.lamport(own).orderBy("seq").collect()] == [1, 11, 12, 13]
    mine = spark.createDataFrame([("n", "old", 1)], "node string, state string, version long")
    other = spark.createDataFrame([("n", "zzz", 1), ("m", "up", 4)], "node string, state string, version long")
    assert rows(mergeable.gossip_merge(mine, other)) == [("m", "up", 4), ("n", "old", 1)]


def test_commit_needs_a_majority_of_the_current_term(spark):
    own = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "idx long, term long")
    at = lambda *m: spark.createDataFrame([(str(i), x) for i, x in enumerate(m)], "node string, match_index long")
    got = lambda m, term: consensus.commit_index(own, m, term).first()["commit_index"]
    assert (got(at(2, 2, -1), 2), got(at(2, 1, -1), 2), got(at(2, -1, -1), 2), got(at(2, 1, 1), 1)) == (2, -1, -1, 1)


def test_entry_types():
    @model.key
    @dataclasses.dataclass(frozen=True)
    class Place:
        region: str
        number: int

    @model.value
    @dataclasses.dataclass(frozen=True)
    class Town:
        at: Place
        names: list[str]
        size: float

    # the annotations of local classes are evaluated here
    Town.__annotations__.update(at=Place, names=list[str], size=float)
    assert [f.nullable for f in model.schema(Place)] == [False, False] and model.schema(Place)["region"].metadata == {"key": True}
    assert model.schema(Town).simpleString() == "struct<at:struct<region:string,number:bigint>,names:array<string>,size:double>"
    assert model.classify(complex) == "unsupported"
    with pytest.raises(TypeError):
        model.key(model.value(Place))


@model.key
@dataclasses.dataclass(frozen=True)
class Spot:
    region: str
    number: int


@model.value
@dataclasses.dataclass(frozen=True)
class City:
    at: Spot
    names: list[str]
    spots: list[Spot]
    small: model.Byte
    open: bool


def test_typed_round_trip(spark):
    rows = [{"at": {"region": "é" * 90, "number": -5}, "names": ["a", ""], "spots": [{"region": "x", "number": 1 << 40}], "small": 200, "open": True}, {"at": {"region": "", "number": 0}, "names": [], "spots": [], "small": 0, "open": False}]
    df = spark.createDataFrame(rows, model.schema(City))
    coded = df.select(model.encoded(City, F.struct(*df.columns)).alias("e"))
    assert bytes(coded.collect()[1]["e"]) == b"\0" + bytes(8) + bytes(4) + bytes(4) + b"\0\0"
    assert [r.asDict(recursive=True) for r in model.decoded(coded, "e", City).collect()] == rows
    with pytest.raises(ValueError):
        model._read(model._layout(City), bytes(coded.collect()[0]["e"])[:-3], 0)


def test_csv_and_binary_round_trips(spark, tmp_path):
    entries = [(1, "plain"), (-2, 'a "quoted", text\nof two lines'), (3, "é" * 200), (1 << 40, "")]
    df = spark.createDataFrame(entries, "key long, value string")
    serde.write_csv(df, str(tmp_path / "csv"))
    assert {r["key"]: r["value"] or "" for r in serde.read_csv(spark, str(tmp_path / "csv"), "key long, value string").collect()} == dict(entries)
    blob = b"".join(bytes(r["e"]) for r in df.select(serde.binary_entry(F.col("key"), F.col("value")).alias("e")).collect())
    assert blob[:8] == struct.pack("<q", 1)
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/x.dat").write_bytes(blob)
    assert rows(serde.read_binary(spark, str(tmp_path / "bin"), "key long, value string")) == sorted(entries, key=repr)
    with pytest.raises(ValueError):
        list(serde.read_entries(blob[:-1] + b"\x05", ["long", "string"]))


def test_raw_files(spark, tmp_path):
    path = str(tmp_path / "raw")
    files.write_bytes(spark, path, b"ab")
    files.write_text(spark, path, "é", "append")
    files.write_text(spark, path, "no", "keep")
    assert files.read_text(spark, path).first()["text"] == "abé"
    with pytest.raises(FileExistsError):
        files.write_bytes(spark, path, b"")


def test_unknown_replica(spark):
    known = spark.createDataFrame([("r0",)], "replica string")
    with pytest.raises(Exception, match="unknown replica r9"):
        replication.availability(known, spark.createDataFrame([(1, "r9", True)], "seq long, replica string, available boolean")).collect()


@pytest.fixture(params=[True, False], ids=["adaptive", "fixed"])
def many_ranges(spark, request):
    """Several range partitions, with and without adaptive execution."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_places_over_many_ranges(many_ranges):
    """Numbers, offsets, running values and as-of lookups with a payload, against plain numpy."""
    spark, n = many_ranges, 300_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), (F.col("id") % 13).alias("size"))
    found = ordered.numbered(df, "key").where("n != key or payload is null").count(), ordered.numbered(df, "key").agg(F.count_distinct("n")).first()[0]
    assert found == (0, n)
    own = df.select("key", "size").toPandas().sort_values("key")
    at = ordered.offsets(df, "key", F.col("size")).select("key", "offset", "n", "payload").toPandas().sort_values("key")
    assert len(at) == n and at["offset"].tolist() == (own["size"].cumsum() - own["size"]).tolist() and at["n"].tolist() == list(range(n))
    big = df.withColumn("g", F.when(F.col("key") < n * 2 // 3, 1).otherwise(F.col("key") % 5))
    plain = big.select("key", "size", "g").toPandas().sort_values(["g", "key"])
    for how in ("sum", "max"):
        seen = ordered.running(big, "size", how, "key", group="g").select("g", "key", "seen", "payload").toPandas().sort_values(["g", "key"])
        assert seen["seen"].tolist() == getattr(plain.groupby("g")["size"], f"cum{how}")().tolist()
    index = df.where("key % 1000 = 17").select("key", F.col("size").alias("offset"))
    hit = sstable.floor_lookup(df.select("key"), index).toPandas().sort_values("key")
    expected = [None if k < 17 else (k - 17) // 1000 * 1000 + 17 for k in range(n)]
    assert hit["key"].tolist() == list(range(n)) and [None if pd.isna(x) else int(x) for x in hit["index_key"]] == expected
    swapped = spark.range(n).select(F.col("id").alias("pos"), F.when(F.col("id") % 50_000 == 5, F.col("id") - 9).otherwise(F.col("id")).alias("key"))
    assert sorted(r["pos"] for r in sstable.out_of_order(swapped).collect()) == [i for i in range(n) if i % 50_000 == 5]
    leaves = merkle.leaves(df, "key", "payload")
    assert leaves.agg(F.count_distinct("pos")).first()[0] == n


def test_files(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write(spark.range(3), path)
    assert files.exists(spark, path) and files.file_info(spark.read.parquet(path)).count() >= 1
    files.write(spark.range(9), path, "keep")
    assert spark.read.parquet(path).count() == 3
    assert files.delete(spark, path) and not files.delete(spark, path)
    with pytest.raises(FileNotFoundError):
        files.delete(spark, path, must_exist=True)
    (tmp_path / "f.txt").write_bytes("héllo".encode())
    assert bytes(files.read_bytes(spark, str(tmp_path / "f.txt"), 1, 2).first()["bytes"]) == "é".encode()
    assert files.read_text(spark, str(tmp_path / "f.txt")).first()["text"] == "héllo"


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    put_log(spark, [(1, "a", 1, "put"), (2, "b", 2, "put")]).coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema("key int, value string, seq long, op string").parquet(source)
    follow.follow(read(), str(tmp_path / "state"), str(tmp_path / "c1")).awaitTermination()
    put_log(spark, [(1, None, 3, "del"), (2, "c", 4, "put")]).coalesce(1).write.mode("append").parquet(source)
    follow.follow(read(), str(tmp_path / "state"), str(tmp_path / "c1")).awaitTermination()
    kinds = "key int, value string, seq long, op string"
    assert rows(follow.follower_state(spark, str(tmp_path / "state"), kinds).select("key", "value")) == [(2, "c")]
    for i in range(4):
        put_log(spark, [(7, f"v{i}", 10 + i, "put"), (2, None, 20 + i, "del")]).coalesce(1).write.mode("append").parquet(source)
        follow.follow(read(), str(tmp_path / "state"), str(tmp_path / "c1"), segments.Options(threshold=3)).awaitTermination()
    assert rows(follow.follower_state(spark, str(tmp_path / "state"), kinds).select("key", "value")) == [(7, "v3")]
    assert segments.read_segments(spark, str(tmp_path / "state"), kinds).select("segment_id").distinct().count() <= 3
    follow.flush_segments(read(), str(tmp_path / "segments"), str(tmp_path / "c2")).awaitTermination()
    assert rows(log.live(spark.read.parquet(str(tmp_path / "segments")).select("key", "value", "seq", "op"))) == [(7, "v3", 13)]
    seen = str(tmp_path / "gossip")
    spark.createDataFrame([("n", "up", 1), ("n", "down", 2)], "node string, state string, version long").coalesce(1).write.parquet(seen)
    follow.gossip(spark.readStream.schema("node string, state string, version long").parquet(seen), str(tmp_path / "known"), str(tmp_path / "c3")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "known/0"))) == [("n", "down", 2)]
