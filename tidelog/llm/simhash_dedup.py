"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code decodes every 23-bit
vector to its codewords within distance 4: one when the nearest is within 2, else six. Two vectors at distance
2 or less have such a codeword in common (that nearest to a vector between them). Of three segments with two
errors at most in all, one is equal (pigeonhole) and any other has a common codeword, so three key tables, each
of one exact segment with the codeword indices of the next, find every pair within two bits. Pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import binary, materialize, slices, trimmed
from tidelog.llm.components import connected_components
from tidelog.llm.golay import Golay
from tidelog.llm.shingle_groups import similar_groups

SEED = 42
#: Buckets of more fingerprints than this are linked through common neighbours instead of pair by pair.
SMALL_BUCKET = 6
MASK23 = (1 << 23) - 1
SLICE_BYTES = 2 << 20


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of ``width``-word shingles; 0 for a text that is null or has no words."""
    words = (text or b"").lower().split()  # bytes: lower() is A-Z only, split() at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, mark, fp`` of every row; fp is the fingerprint as a signed long, mark a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", SLICE_BYTES):
                fps = np.array([fingerprint(t, width) for t in binary(b.column(2))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["id", "mark", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, mark long, fp long")


def fuzzy_keys(fps: DataFrame, column: str = "fp") -> DataFrame:
    """``(key, fp)``: the 3 to 18 keys of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for b in batches:
            for i in range(0, b.num_rows, 50_000):
                signed = np.asarray(b.column(0).slice(i, 50_000).to_numpy(zero_copy_only=False))
                fp = signed.view(np.uint64)
                parts = [((fp >> np.uint64(k)) & np.uint64(MASK23)).astype(np.int64) for k in (0, 23, 46)]
                rows, keys = [], []
                for t in range(3):
                    near = code.keys(parts[(t + 1) % 3])
                    key = (t << 35 | parts[t] << 12)[:, None] | near
                    first = np.ones(key.shape, bool)
                    first[:, 1:] = near[:, 1:] != near[:, :1]
                    rows.append(np.broadcast_to(signed[:, None], key.shape)[first])
                    keys.append(key[first])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rows))], ["key", "fp"])

    return fps.select(F.col(column).alias("fp")).mapInArrow(trimmed(run), "key long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect distinct fingerprints exactly as all pairs within two bits do.

    Buckets of up to SMALL_BUCKET give their verified pairs. In a larger bucket no pairs are made: each of its
    fingerprints is put at itself and its 64 neighbours at one bit. Two fingerprints within two bits meet at a
    point between them, and all that meet at a point are within two bits of each other, so each is linked to
    the smallest there.
    """
    keys = materialize(fuzzy_keys(fps), "golay_keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowd = materialize(keys.join(shared, "key"), "golay_shared")
    near = lambda x, y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= 2)
    pairs = (
        crowd.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.collect_list("fp").alias("g"))
        .select(F.explode(F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("e"))
        .select("e.a", "e.b")
    )
    points = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    at = crowd.where(F.col("n") > SMALL_BUCKET).select("fp").distinct().select("fp", F.explode(points).alias("z"))
    least = at.groupBy("z").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = at.join(least, "z").where("fp != m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return pairs.unionByName(star).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per document: ``id``, ``mark`` (a hash of the text), ``fp`` (signed long), ``component_id``.

    component_id is the smallest id reachable over fingerprints that differ in two bits at most. Null
    and word-less texts have fingerprint 0, which links like any other. Null ids are kept and are no candidates
    for component_id (null if a component has none other). Repeated rows are repeated in the result; an empty
    table gives an empty one. Columns other than these two aren't read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("low"))
    joined = connected_components(links(distinct.select("fp")))
    part = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    part = materialize(part, "parts")
    least = part.groupBy("root").agg(F.min("low").alias("component_id"))
    named = part.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("id", "mark", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One document of every group, that of the smallest id, with all its columns.

    Groups are those of ``shingle_groups.similar_groups``: candidates by SimHash and Golay keys, similarity 0.8 or
    more. Of rows equal in that id, that of the smallest text hash stays; of wholly equal ones, one. Rows without an id stay only if their group has
    no id at all, one of them.
    """
    groups = materialize(similar_groups(docs, id_col, text_col, width), "groups")
    texts = groups.groupBy("root", "id", "mark").agg(F.count("*").alias("n"))
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "mark", "n")).alias("one")).select("one.*")
    first = materialize(first.select(F.col("id").alias("__k_id"), F.col("mark").alias("__k_mark"), F.col("n").alias("__k_n")), "first")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__k_id")) & (F.xxhash64(text_col) == F.col("__k_mark"))
    kept = docs.join(first, same)
    plain = [F.col(f"`{c}`") for c in docs.columns]
    if first.where("__k_n > 1").isEmpty():
        return kept.select(*plain)
    twice = kept.where("__k_n > 1").dropDuplicates(["__k_id", "__k_mark"])
    return kept.where("__k_n = 1").select(*plain).unionByName(twice.select(*plain))


def op3_query(docs: DataFrame) -> DataFrame:
    """The contract's columns for a documents table; edge cases as in ``simhash_groups``."""
    found = simhash_groups(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
