"""Groups of documents whose word-shingle sets have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash and the Golay code. At a similarity of 0.8 each SimHash bit differs with probability
0.151 at most, too often for keys of 64 bits, so a shingle's hash is stretched to TABLES pairs of 23-bit segments. A
segment is decoded by its counts, not only its bits, and a table's keys are the PROBES pairs of codewords that fit best.
Two documents at 0.8 share a key of a table with probability 0.356 (by simulation), so one of all with 1 - 0.644^TABLES:
0.99997, and more above. Keys that chance shares are dropped by CHECKED further SimHash bits within RADIUS. Each pair
left is verified on the shingle sets (as 64-bit hashes), so nothing below the limit is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import binary, materialize, mix, slices, trimmed
from tidelog.llm.components import connected_components
from tidelog.llm.golay import Golay, likeliest

LEAST_JACCARD = 0.8
TABLES, PROBES = 24, 4
#: At 0.8 each checked bit differs with probability 0.151 (0.188 for sets of 4 and 5 shingles), by chance with 0.5.
CHECKED, RADIUS = 128, 44
WORDS = CHECKED // 64 + -(-46 * TABLES // 64)
SLICE_BYTES = 2 << 20
#: Pairs of keys with more nodes are compared in cells of two blocks of about BLOCK nodes, without a row for each pair.
SMALL_KEY, BLOCK = 24, 512
#: Keys are counted where their bucket has over twice the mean; others are in a few of BUCKETS parts of the rows at most.
BUCKETS = 1 << 14
#: Shingles counted at once, in bytes; segments decoded at once.
CHUNK, DECODED = 255, 1024
STEPS = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of fewer words, all are one shingle; no words give none."""
    words = (text or b"").lower().split()  # bytes: lower() is A-Z only, split() at \\x20 and \\x09-\\x0D
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64))


def simhash_votes(own: np.ndarray) -> np.ndarray:
    """For each of 64 * WORDS SimHash bits, shingles without it less those with it; the bit is one if that is negative."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(own), CHUNK):
        bits = np.unpackbits(mix(own[i : i + CHUNK, None] + STEPS).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(0, np.uint8)
    return len(own) - 2 * ones


def golay_keys(votes: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """TABLES * PROBES keys of each row of votes: of each two segments, the pairs of codewords that fit best together."""
    parts = votes[:, CHECKED : CHECKED + 46 * TABLES].reshape(-1, 23).astype(np.float32)
    decoded = [likeliest(signs, parts[i : i + DECODED], PROBES) for i in range(0, len(parts), DECODED)]
    index, fit = (np.concatenate(x).reshape(-1, 2, PROBES) for x in zip(*decoded, strict=True))
    i, j = np.nonzero(np.add.outer(np.arange(PROBES), np.arange(PROBES)) < PROBES)
    best = np.argsort(-(fit[:, 0, i] + fit[:, 1, j]), axis=1, kind="stable")[:, :PROBES]
    pairs = np.take_along_axis(index[:, 0, i] << 12 | index[:, 1, j], best, 1).reshape(len(votes), TABLES, PROBES)
    return (np.arange(TABLES)[:, None] << 24 | pairs).reshape(len(votes), -1).astype(np.int32)


def _node(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(f"`{text_col}`").alias("text"))


def marked_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, mark`` (a hash of the text), ``node`` (a hash of the shingle set), its ``size``, checked bits ``lo, hi`` and ``keys`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Golay().signs()
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                sets = [shingle_set(t, width) for t in binary(part.column("text"))]
                votes = np.stack([simhash_votes(s) for s in sets])
                checked = np.packbits(votes[:, :CHECKED] < 0, axis=1, bitorder="little").view(np.int64)
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TABLES * PROBES)
                keys = pa.ListArray.from_arrays(ends, pa.array(golay_keys(votes, signs).ravel()))
                own = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(checked[:, 0]), pa.array(checked[:, 1])]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), *own, keys], ["id", "mark", "node", "size", "lo", "hi", "keys"])

    return _rows(docs, id_col, text_col).mapInArrow(trimmed(run), "id long, mark long, node long, size long, lo long, hi long, keys array<int>")


def near_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which columns of ``rows`` (key, node, size, lo, hi; sorted by key) are near another of their key, and how many each key has.

    Of keys with more than SMALL_KEY, all are.
    """
    key, node, size, *checked = rows
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    n = times[which]
    few = n <= SMALL_KEY
    found = ~few
    for step in range(1, n[few].max(initial=0)):
        at = np.flatnonzero((key[step:] == key[:-step]) & (node[step:] != node[:-step]) & few[step:])
        apart = sum(np.bitwise_count((x[at] ^ x[at + step]).view(np.uint64)).astype(np.int64) for x in checked)
        sized = np.minimum(size[at], size[at + step]) >= LEAST_JACCARD * np.maximum(size[at], size[at + step])
        at = at[(apart <= RADIUS) & sized]
        found[at] = found[at + step] = True
    return found, n


def near_keys(rows: DataFrame) -> DataFrame:
    """``key, node, n`` of the rows ``key, node, size, lo, hi`` that are near another of their key, which has n, or in one of over SMALL_KEY.

    Rows are compared where they are sorted by key, so only those that are near leave the task, not all that chance brings
    together. A task holds the rows of a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(rows: np.ndarray) -> pa.RecordBatch:
            found, n = near_rows(rows)
            return pa.RecordBatch.from_arrays([pa.array(rows[0, found].astype(np.int32)), pa.array(rows[1, found]), pa.array(n[found])], ["key", "node", "n"])

        held = np.empty((5, 0), np.int64)
        for b in batches:
            held = np.concatenate([held, np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in b.columns])], axis=1)
            whole = np.searchsorted(held[0], held[0, -1]) if held.size else 0
            yield kept(held[:, :whole])
            held = held[:, whole:]  # its last key may go on in the next batch
        yield kept(held)

    rows = rows.select("key", "node", "size", "lo", "hi").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(trimmed(run), "key int, node long, n long")


def shared_keys(marked: DataFrame) -> DataFrame:
    """``key, node, n`` of the keys that n nodes share; up to SMALL_KEY, only of nodes whose checked bits are near another's there."""
    nodes = materialize(marked.select("node", "size", "lo", "hi", "keys").dropDuplicates(["node"]), "shingle_nodes")
    keys = nodes.select(F.explode("keys").alias("key"), "node", "size", "lo", "hi")
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    counts = materialize(keys.groupBy(bucket).agg(F.count("*").alias("n")), "key_buckets")
    full = counts.where(F.col("n") > 2 * (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS).select("bucket")
    counted = keys.select("key", bucket).join(F.broadcast(full), "bucket", "left_semi")
    crowded = materialize(counted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_KEY), "golay_crowded")
    few = near_keys(keys.join(crowded, "key", "left_anti"))
    return few.unionByName(keys.select("key", "node").join(crowded, "key").select("key", "node", "n"))


def candidate_sets(docs: DataFrame, marked: DataFrame, crowd: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``node, own`` (the sorted hashes, as bytes) of every node that shares a key; one row of the table gives each."""
    own = marked.join(crowd.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("one"))
    own = own.select("node", F.col("one.id").alias("o_id"), F.col("one.mark").alias("o_mark"))
    rows = _rows(docs, id_col, text_col).join(own, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("mark") == F.col("o_mark"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([shingle_set(t, width).tobytes() for t in binary(part.column("text"))], pa.binary())], ["node", "own"])

    return materialize(rows.dropDuplicates(["node"]).mapInArrow(trimmed(run), "node long, own binary"), "shingle_sets")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(len(x) + len(y) - common, 1)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of similarity LEAST_JACCARD or more."""
    both = pairs.distinct().join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [jaccard(memoryview(x.as_buffer()), memoryview(y.as_buffer())) >= LEAST_JACCARD for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    shorter, longer = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
    return both.where(shorter >= LEAST_JACCARD * longer).select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def mixed_keys(crowd: DataFrame, joined: DataFrame) -> DataFrame:
    """``key, node, root, n`` of the keys whose n nodes aren't all of one group yet."""
    rooted = materialize(crowd.join(joined, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "shingle_roots")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    return materialize(rooted.join(mixed, "key"), "shingle_mixed")


def overlaps(nodes: np.ndarray, roots: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of nodes of different roots with similarity LEAST_JACCARD or more, by an inverted index.

    Only what is outside the commonest root is looked up, since a pair of two roots has such a node.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(number, kind="stable")]
    ends = np.cumsum(np.bincount(number))
    starts = np.append(0, ends[:-1])
    names, which, times = np.unique(roots, return_inverse=True, return_counts=True)
    edges = np.cumsum(sizes)
    a, b = [], []
    for i in np.flatnonzero(which != np.argmax(times)):
        common = np.zeros(len(sets), np.int64)
        for k in number[edges[i] - sizes[i] : edges[i]]:
            common[owner[starts[k] : ends[k]]] += 1
        near = np.flatnonzero((common >= LEAST_JACCARD * (sizes[i] + sizes - common)) & (roots != roots[i]))
        a.append(np.minimum(nodes[i], nodes[near]))
        b.append(np.maximum(nodes[i], nodes[near]))
    return np.concatenate(a or [nodes[:0]]), np.concatenate(b or [nodes[:0]])


def crossed(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified pairs ``(a, b)`` of different roots within each key; each two blocks of a key meet in a cell."""
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks)
    cells = mixed.withColumn("own_block", own).select("key", "node", "root", "own_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("at"))
    cells = cells.select("key", F.least("own_block", "at").alias("lo"), F.greatest("own_block", "at").alias("hi"), "node", "root").join(sets, "node")

    def run(cell: pa.Table) -> pa.Table:
        found = overlaps(cell["node"].to_numpy(), cell["root"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in cell["own"]])
        return pa.table(found, names=["a", "b"])

    return cells.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row per document: ``id``, ``mark`` (a hash of the text) and ``root``, which names its group.

    Documents are linked if the sets of their ``width``-word shingles (A-Z lower-cased) have a Jaccard similarity
    of LEAST_JACCARD or more; a group is what is connected. Texts without words are one group. Each key's nodes are
    tried first with the one that shares most keys, as it is the likeliest centre of a large group. All other pairs
    are compared only between groups.
    """
    marked = materialize(marked_sets(docs, id_col, text_col, width), "marked_sets")
    crowd = materialize(shared_keys(marked), "shared_keys")
    degree = crowd.groupBy("node").agg(F.sum("n").alias("degree"))
    crowd = materialize(crowd.select("key", "node").join(degree, "node"), "key_degrees")
    sets = candidate_sets(docs, marked, crowd, id_col, text_col, width)
    lead = crowd.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("lead")).select("key", F.col("lead.node").alias("lead"))
    stars = materialize(verified(crowd.join(lead, "key").where("node != lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")), sets), "shingle_stars")
    joined = connected_components(stars)
    mixed = mixed_keys(crowd, joined)
    small = mixed.where(F.col("n") <= SMALL_KEY)
    other = small.select("key", F.col("node").alias("b"), F.col("root").alias("s"))
    pairs = small.select("key", F.col("node").alias("a"), F.col("root").alias("r")).join(other, "key").where("a < b and r != s").select("a", "b")
    rest = verified(pairs, sets).unionByName(crossed(mixed.where(F.col("n") > SMALL_KEY), sets))
    joined = connected_components(stars.unionByName(materialize(rest, "shingle_rest")))
    return marked.select("id", "mark", "node").join(joined, "node", "left").select("id", "mark", F.coalesce("root", "node").alias("root"))
