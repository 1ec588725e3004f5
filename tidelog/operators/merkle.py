"""Hash trees over ordered blocks: SHA-256 leaves, padded to a power of two with the hash of nothing."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import numbered
from tidelog.scratch import materialize

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def leaves(blocks: DataFrame, order: str, block: str) -> DataFrame:
    """``pos, hash`` from 0; a null block is empty."""
    return numbered(blocks.select(order, block), order).select(F.col("n").alias("pos"), F.sha2(F.coalesce(F.col(block).cast("binary"), F.lit(b"")), 256).alias("hash"))


def tree(leaf: DataFrame) -> DataFrame:
    """``level, pos, hash`` of all levels, leaves at 0. Padding isn't stored as rows: an all-padding subtree's hash is a constant of its level.

    The loop runs once a level, over half the rows each time; each level is written, and the next one reads it.
    """
    leaf = materialize(leaf.select("pos", "hash"), "merkle")
    levels = max(leaf.count() - 1, 0).bit_length()
    pads = pad_hashes(levels)
    now, out = leaf, leaf.select(F.lit(0).alias("level"), "pos", "hash")
    for level in range(1, levels + 1):
        side = lambda bit: F.coalesce(F.max(F.when(F.col("pos") % 2 == bit, F.col("hash"))), F.lit(pads[level - 1]))  # noqa: B023, E731
        pair = now.groupBy(F.shiftright("pos", 1).alias("up")).agg(F.concat(side(0), side(1)).alias("both"))
        now = materialize(pair.select(F.col("up").alias("pos"), F.sha2(F.unhex("both"), 256).alias("hash")), "merkle")
        out = out.unionByName(now.select(F.lit(level).alias("level"), "pos", "hash"))
    return out


def root(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy().agg(F.max(F.struct("level", "hash")).alias("top")).select(F.col("top.hash").alias("root"))


def root_of(leaf: DataFrame, step: int = 10) -> DataFrame:
    """``root`` of leaves ``(pos, hash)`` without the levels between: each shuffle folds up to ``step`` levels, so a billion leaves take three.

    A group has 2 ** step hashes at most. No leaves have no root.
    """
    leaf = materialize(leaf.select("pos", "hash"), "merkle")
    levels, done, now = max(leaf.count() - 1, 0).bit_length(), 0, leaf
    pads = pad_hashes(levels)

    def fold(hashes: Column, level: int) -> Column:
        """Pairs of neighbours; a last one without a neighbour is paired with padding."""
        last = F.floor((F.size(hashes) - 1) / 2).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.unhex(F.concat(F.get(hashes, 2 * i), F.coalesce(F.get(hashes, 2 * i + 1), F.lit(pads[level])))), 256))

    while done < levels:
        k = min(step, levels - done)
        groups = now.groupBy(F.shiftright("pos", k).alias("up")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("h"))
        for level in range(done, done + k):
            groups = groups.select("up", fold(F.col("h"), level).alias("h"))
        now = groups.select(F.col("up").alias("pos"), F.get("h", 0).alias("hash"))
        done += k
    return now.select(F.col("hash").alias("root"))


def pad_hashes(levels: int) -> list[str]:
    out = [EMPTY]
    for _ in range(levels):
        out.append(sha256(bytes.fromhex(out[-1] * 2)).hexdigest())
    return out


def proof(nodes: DataFrame, index: int, n: int) -> DataFrame:
    """``level, sibling`` from the leaf up, for a block's number of n."""
    if not 0 <= index < n:
        raise IndexError(index)
    levels = max(n - 1, 0).bit_length()
    pads = pad_hashes(levels)
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(level, (index >> level) ^ 1, pads[level]) for level in range(levels)], "level int, pos long, pad string")
    return F.broadcast(wanted).join(nodes, ["level", "pos"], "left").select("level", F.coalesce("hash", "pad").alias("sibling"))


def proofs(nodes: DataFrame, indexes: DataFrame, n: int) -> DataFrame:
    """``idx, leaf, siblings``: proofs of many of a tree's n blocks; a block's number that isn't below n has none."""
    levels = max(n - 1, 0).bit_length()
    pads = F.array(*(F.lit(h) for h in pad_hashes(levels)))
    path = indexes.where(F.col("idx").between(0, n - 1)).select("idx", F.explode(F.sequence(F.lit(-1), F.lit(levels - 1))).alias("step"))  # step -1: the leaf itself
    wanted = path.select("idx", "step", F.greatest("step", F.lit(0)).alias("level"), F.when(F.col("step") < 0, F.col("idx")).otherwise(F.call_function("shiftright", F.col("idx"), F.greatest("step", F.lit(0))).bitwiseXOR(F.lit(1))).cast("long").alias("pos"))
    found = wanted.join(nodes, ["level", "pos"], "left").select("idx", "step", F.coalesce("hash", F.get(pads, F.col("level"))).alias("hash"))
    ordered = found.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("step", "hash"))).alias("p"))  # a hash a level
    return ordered.select("idx", F.get("p", F.lit(0))["hash"].alias("leaf"), F.transform(F.slice("p", 2, levels) if levels else F.array().cast("array<struct<step:int,hash:string>>"), lambda x: x["hash"]).alias("siblings"))


def verify_proofs(own: DataFrame, expected: str) -> DataFrame:
    """``idx, ok``: whether each leaf's hash, folded with its siblings by the bits of its number, gives the root."""
    step = lambda acc, other: F.struct(
        F.sha2(F.unhex(F.when(acc["at"] % 2 == 1, F.concat(other, acc["hash"])).otherwise(F.concat(acc["hash"], other))), 256).alias("hash"), F.floor(acc["at"] / 2).alias("at")
    )
    start = F.struct(F.col("leaf").alias("hash"), F.col("idx").cast("long").alias("at"))
    return own.select("idx", F.aggregate("siblings", start, step, lambda acc: acc["hash"] == expected).alias("ok"))


def verify(blocks: DataFrame, order: str, block: str, expected: str) -> DataFrame:
    """``intact``: whether the blocks have the expected root."""
    return root_of(leaves(blocks, order, block)).select((F.col("root") == expected).alias("intact"))


def verify_proof(leaf_hash: str, index: int, siblings: list[str], expected: str) -> bool:
    """Whether a leaf's hash, folded with its siblings by the bits of its number, gives the root."""
    for level, other in enumerate(siblings):
        pair = other + leaf_hash if index >> level & 1 else leaf_hash + other
        leaf_hash = sha256(bytes.fromhex(pair)).hexdigest()
    return leaf_hash == expected


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions of leaves ``(pos, hash)`` that differ or are in one tree only."""
    return a.join(b.select("pos", F.col("hash").alias("other")), "pos", "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("pos")
