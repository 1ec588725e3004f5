"""Fuzzy line de-duplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import binary, bitmap, in_bitmap, mix, slices, trimmed, word_hashes
from tidelog.llm.components import connected_components
from tidelog.scratch import materialize

#: Fingerprints are cut into BLOCKS blocks; all but RADIUS of them make a key, so that all pairs within RADIUS bits have one in common.
BLOCKS, RADIUS = 5, 3
#: Pairs with a common key are verified up to so many differing bits.
LIMIT = 12
LEAST_SIMILARITY = 0.8
#: A line's features are its words of over SHORT bytes, as shorter ones make unrelated lines alike; where these are fewer than FEW_WORDS, its overlapping runs of GRAM bytes.
SHORT, FEW_WORDS, GRAM = 3, 8, 5
SLICE_BYTES = 2 << 20
#: Distinct lines whose keys one task makes and adds up before they are shuffled.
TASK_KINDS = 100_000
#: A-Z is lower-cased, digits become 0, white space a space; ASCII punctuation goes later, unless a line has nothing else.
SPACES = b"\x09\x0b\x0c\x0d\x20"
FOLD = bytes(ord("0") if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else 32 if c in SPACES else c for c in range(256))
WORD, SPACE, NEWLINE, PUNCTUATION = range(4)
KIND = np.array([SPACE if c in SPACES else NEWLINE if c == 10 else PUNCTUATION if 32 < c < 127 and not chr(c).isalnum() else WORD for c in range(256)], np.uint8)
BYTE_LANES = np.uint64(0x0101010101010101)


def normalised(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all normalised lines, each with a line feed after it; first and last place of each, and each text's number of lines."""
    raw = np.frombuffer(b"".join((t or b"").translate(FOLD) + b"\n" for t in texts), np.uint8)
    kind = KIND[raw]
    ends = np.flatnonzero(kind == NEWLINE)
    sizes = np.diff(ends, prepend=-1)
    bare = np.add.reduceat(kind == WORD, ends - sizes + 1, dtype=np.int64) == 0
    data = raw[(kind != PUNCTUATION) | np.repeat(bare, sizes)]
    gap = (data == 32) | (data == 10)
    data = data[~((data == 32) & np.append(True, gap[:-1]))]
    data = data[~((data == 32) & np.append(data[1:] == 10, False))]
    end = np.flatnonzero(data == 10)
    return data, np.append(0, end[:-1] + 1), end, np.array([(t or b"").count(b"\n") + 1 for t in texts], np.int64)


def simhashes(features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints, as signed longs, of lines with ``sizes`` features each, one at least: a bit is set where over half of them have it.

    Each of eight sums counts eight bits, in a byte each, for up to 255 features; of longer lines the parts' counts are added up.
    """
    if not len(sizes):
        return np.empty(0, np.int64)
    parts = -(-sizes // 255)
    own = np.cumsum(parts) - parts
    first = np.repeat(np.cumsum(sizes) - sizes, parts) + 255 * (np.arange(parts.sum()) - np.repeat(own, parts))
    ones = np.stack([np.add.reduceat(features >> np.uint64(k) & BYTE_LANES, first).view(np.uint8).reshape(-1, 8) for k in range(8)], axis=2).reshape(-1, 64)
    if len(ones) > len(sizes):
        ones = np.add.reduceat(ones, own, axis=0, dtype=np.int64)
    return np.packbits(2 * ones.astype(np.int64) > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """SimHashes of non-empty normalised lines: of their longer words, or if these are few, of their runs of GRAM bytes."""
    at, stop, words = word_hashes(data, (data == 32) | (data == 10))
    longer = stop - at > SHORT
    at, words = at[longer], words[longer]
    n_words = np.searchsorted(at, end) - np.searchsorted(at, start)
    out = np.empty(len(start), np.int64)
    many = n_words >= FEW_WORDS
    out[many] = simhashes(words[np.repeat(many, n_words)], n_words[many])
    few, stop = start[~many], end[~many]
    n = np.maximum(stop - few - GRAM + 1, 1)
    place = np.repeat(few, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    grams = np.zeros(len(place), np.uint64)
    last = np.repeat(stop, n)
    for k in range(GRAM):
        grams = grams << np.uint64(8) | data[np.minimum(place + k, last)]
    out[~many] = simhashes(mix(grams + np.uint64(1)), n)
    return out


def line_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[int]:
    raw = data.tobytes()
    return [xxhash.xxh3_64_intdigest(raw[s:e]) - (1 << 63) for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, bit-parallel over whole strings (Myers), after cutting equal ends; with ``most``, any number on the same side of it."""
    start, high = 0, min(len(a), len(b))
    while start < high:  # the longest equal start, by halving
        middle = (start + high + 1) // 2
        start, high = (middle, high) if a[start:middle] == b[start:middle] else (start, middle - 1)
    a, b = a[start:], b[start:]
    end, high = 0, min(len(a), len(b))
    while end < high:
        middle = (end + high + 1) // 2
        end, high = (middle, high) if a[len(a) - middle : len(a) - end] == b[len(b) - middle : len(b) - end] else (end, middle - 1)
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if most is not None and max(len(a), len(b)) <= most:  # even if nothing else were equal
        return max(len(a), len(b))
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for left, c in enumerate(b, 1 - len(b)):
        same = at.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(across | up) & full, up & across
        score += bool(plus & top) - bool(minus & top)
        if most is not None and score + left > most:  # even if all that is left were equal
            return score + left
        plus = plus << 1 | 1
        minus <<= 1
        vertical = same | down
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical & full
    return score


def similar(a: str, b: str) -> bool:
    """Whether the edit similarity, 1 - distance / greater length, is LEAST_SIMILARITY or more."""
    longer = max(len(a), len(b))
    most = int((1 - LEAST_SIMILARITY) * longer + 1e-9)
    return abs(len(a) - len(b)) <= most and edit_distance(a, b, most) <= most


def marked_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, lines`` of every row: a hash of the text, and the hash and fingerprint of each line (hash 0: a line without a character)."""
    pair = pa.struct([("h", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                data, start, end, counts = normalised(binary(part.column("text")))
                some = start < end
                h, fp = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
                h[some] = line_hashes(data, start[some], end[some])
                fp[some] = fingerprints(data, start[some], end[some])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays([pa.array(h), pa.array(fp)], fields=list(pair)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), lists], ["id", "mark", "lines"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{text_col}`").alias("mark"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, mark long, lines array<struct<h:long,fp:long>>")


def _masks() -> list[int]:
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _choices() -> list[tuple[int, ...]]:
    return list(combinations(range(BLOCKS), BLOCKS - RADIUS))


def block_keys(fp: np.ndarray) -> np.ndarray:
    """A column of keys for each choice of blocks; fingerprints that agree in the chosen blocks have equal keys."""
    masks = _masks()
    chosen = [sum(masks[i] for i in own) for own in _choices()]
    bits = fp.view(np.uint64)[:, None] & np.array(chosen, np.uint64)
    return mix(bits + np.arange(1, len(chosen) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def first_key(n: Column, differing: Column) -> Column:
    """Whether key number n is the first that two fingerprints have in common, given the bits in which they differ: every block that it leaves out before its last one differs."""
    mask = [F.lit(m - (1 << 64) if m >> 63 else m) for m in _masks()]
    out = F.lit(True)
    for k, own in enumerate(_choices()):
        for i in range(own[-1]):
            if i not in own:
                out = out & ((n != k) | (differing.bitwiseAND(mask[i]) != 0))
    return out


def keyed(kinds: DataFrame, wanted: bytes | None = None) -> DataFrame:
    """``key, n_key, h, fp, times``: a row for each key of each line, numbered by choice, or only for keys that may be in a bitmap."""
    shared = None if wanted is None else kinds.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 5000):
                part = b.slice(i, 5000)
                keys = block_keys(part.column("fp").to_numpy())
                row, number = np.divmod(np.arange(keys.size), keys.shape[1])
                keys = keys.ravel()
                if shared is not None:
                    hit = in_bitmap(shared.value, keys)
                    row, number, keys = row[hit], number[hit], keys[hit]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(number, pa.int32()), *(part.column(c).take(pa.array(row)) for c in ("h", "fp", "times"))], ["key", "n_key", "h", "fp", "times"])

    return kinds.select("h", "fp", "times").mapInArrow(trimmed(run), "key long, n_key int, h long, fp long, times long")


def candidates(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` within LIMIT bits that are alone with a key, and the ``keyed`` rows of keys that three lines or more have.

    One aggregate over the keys finds both: of two lines it keeps both hashes, and the xor of their fingerprints.
    """
    counted = keyed(kinds).select("key", "h", "fp").groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b"), F.bit_xor("fp").alias("differing"))
    counted = materialize(counted.where("n > 1"), "line_keys")
    pairs = counted.where((F.col("n") == 2) & (F.bit_count("differing") <= LIMIT)).select("a", "b").distinct()
    crowded = counted.where("n > 2").select("key")
    crowd = keyed(kinds, bitmap(crowded, "key")).join(crowded, "key", "left_semi")
    return materialize(pairs, "line_pairs"), materialize(crowd, "line_crowd")


def _near(x: str, y: str):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= LIMIT


def star_pairs(crowd: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of each key's most frequent line with its other lines within LIMIT."""
    lead = crowd.groupBy("key").agg(F.max(F.struct("times", "h", "fp")).alias("lead")).select("key", F.col("lead.h").alias("lead"), F.col("lead.fp").alias("lead_fp"))
    return crowd.join(lead, "key").where((F.col("h") != F.col("lead")) & _near("fp", "lead_fp")).select(F.least("h", "lead").alias("a"), F.greatest("h", "lead").alias("b"))


def other_pairs(crowd: DataFrame, joined: DataFrame) -> DataFrame:
    """All pairs ``(a, b)`` within LIMIT whose lines aren't connected yet, each from the first key they have in common; between others a link adds nothing."""
    rooted = crowd.join(joined, crowd.h == joined.node, "left").select("key", "n_key", "h", "fp", F.coalesce("root", "h").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rooted = materialize(rooted.join(mixed, "key", "left_semi"), "line_roots")
    a = rooted.select("key", "n_key", F.col("h").alias("a"), F.col("fp").alias("x"), F.col("root").alias("r"))
    b = rooted.select(F.col("key").alias("key_b"), F.col("h").alias("b"), F.col("fp").alias("y"), F.col("root").alias("s"))
    near = (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.col("r") != F.col("s")) & _near("x", "y")
    return a.join(b, near & first_key(F.col("n_key"), F.col("x").bitwiseXOR(F.col("y")))).select("a", "b")


def contracted(joined: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` after more edges ``(a, b)``: only the roots of their ends are connected anew."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    joined = materialize(joined.unionByName(ends.join(joined, "node", "left_anti").select("node", F.col("node").alias("root"))), "line_joined")
    of = lambda x, r: joined.select(F.col("node").alias(x), F.col("root").alias(r))
    again = connected_components(edges.join(of("a", "r"), "a").join(of("b", "s"), "b").select("r", "s").distinct(), "r", "s").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return joined.join(again, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def line_texts(docs: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """``h, line`` of the wanted lines, once each. A bitmap keeps most others, and repeats within a batch, out of the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                data, start, end, _ = normalised(binary(part.column("text")))
                start, end = start[start < end], end[start < end]
                h, first = np.unique(np.array(line_hashes(data, start, end), np.int64), return_index=True)
                hit = in_bitmap(shared.value, h)
                raw = data.tobytes()
                lines = pa.array([raw[start[i] : end[i]] for i in first[hit].tolist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(h[hit]), lines], ["h", "line"])

    found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(trimmed(run), "h long, line string")
    return materialize(found.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")), "line_texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose normalised lines have an edit similarity of LEAST_SIMILARITY or more."""
    both = pairs.distinct().join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    both = both.where(F.least(F.length("x"), F.length("y")) >= LEAST_SIMILARITY * F.greatest(F.length("x"), F.length("y")) - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [similar(x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def linked(kinds: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``node, root`` of every line that is linked to another; root is the smallest hash of what is connected."""
    pairs, crowd = candidates(kinds)
    wanted = materialize(crowd.select("h").union(pairs.select("a")).union(pairs.select("b")).distinct(), "line_wanted")
    texts = line_texts(docs, wanted, text_col)
    joined = connected_components(materialize(verified(star_pairs(crowd).unionByName(pairs), texts), "line_stars"))
    rest = materialize(verified(other_pairs(crowd, joined), texts), "line_rest")
    return joined if rest.isEmpty() else contracted(joined, rest)


def line_groups(marked: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The lines that are in a group with another occurrence: ``id, mark, pos, line_group, keep``.

    ``marked`` are the distinct ``marked_lines`` of ``docs``, so rows equal in id and text count once here.
    """
    lines = marked.select("id", "mark", F.posexplode("lines").alias("pos", "line")).select("id", "mark", "pos", "line.h", "line.fp").where("h != 0")
    lines = materialize(lines, "lines")
    kinds = lines.groupBy("h").agg(F.first("fp").alias("fp"), F.count("*").alias("times"))
    kinds = materialize(kinds, "line_kinds")
    kinds = kinds.repartition(max(1, -(-kinds.count() // TASK_KINDS)))
    joined = linked(kinds, docs, text_col)
    named = kinds.join(joined, kinds.h == joined.node, "left").where("times > 1 or root is not null").select("h", F.coalesce("root", "h").alias("line_group"))
    grouped = materialize(lines.select("id", "mark", "pos", "h").join(named, "h").select("id", "mark", "pos", "line_group"), "grouped_lines")
    first = grouped.groupBy("line_group").agg(F.min(F.struct("id", "mark", "pos")).alias("first"))
    return grouped.join(first, "line_group").select("id", "mark", "pos", "line_group", F.struct("id", "mark", "pos").eqNullSafe(F.col("first")).alias("keep"))


def removed_lines(marked: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``id, mark, removed``: sorted numbers (from 0) of the lines to go, of the texts that lose any."""
    lost = line_groups(marked, docs, text_col).where("not keep")
    return lost.groupBy("id", "mark").agg(F.array_sort(F.collect_list("pos")).alias("removed"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (id, text): ``id, mark, n_rows, n_lines, removed, copied``.

    Lines are the same if their normal forms are (by 64-bit hash): A-Z lower-cased, digits as 0, white space
    collapsed, and without ASCII punctuation, unless there is nothing else. They are linked if their edit similarity
    is LEAST_SIMILARITY or more and their fingerprints differ in RADIUS bits at most, or in LIMIT bits and agree in
    enough blocks; a group is what is connected. Of each group the occurrence of the smallest (id, mark, pos) is kept,
    null ids first; ``removed`` are the numbers of the others. Of rows equal in id and text, one is such an
    occurrence, and the others lose all lines that aren't empty, ``copied``. Null texts have one empty line, which
    is never removed. An empty table gives an empty one.
    """
    marked = marked_lines(docs, id_col, text_col).groupBy("id", "mark").agg(F.count("*").alias("n_rows"), F.first("lines").alias("lines"))
    marked = materialize(marked, "marked_lines")
    lost = removed_lines(marked, docs, text_col).select(F.col("id").alias("l_id"), F.col("mark").alias("l_mark"), "removed")
    some = F.filter(F.transform("lines", lambda x, i: F.when(x["h"] != 0, i)), lambda i: i.isNotNull())
    rows = marked.select("id", "mark", "n_rows", F.size("lines").alias("n_lines"), F.when(F.col("n_rows") > 1, some).otherwise(F.array().cast("array<int>")).alias("copied"))
    found = rows.join(lost, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("mark") == F.col("l_mark")), "left")
    return found.select("id", "mark", "n_rows", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "copied")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents without the lines that ``judged`` removes; columns stay as they are, and null texts null."""
    own = materialize(judged(docs, id_col, text_col).where("size(removed) > 0 or n_rows > 1"), "lost_lines")
    own = own.select(*(F.col(c).alias(f"__l_{c}") for c in own.columns))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__l_id")) & (F.xxhash64(f"`{text_col}`") == F.col("__l_mark"))
    plain = [F.col(f"`{c}`") for c in docs.columns]

    def without(rows: DataFrame, gone: str) -> DataFrame:
        left = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")
        return rows.select(*(F.when(F.size(gone) > 0, left).otherwise(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))

    kept = docs.join(own, same, "left")
    if own.where("__l_n_rows > 1").isEmpty():
        return without(kept, "__l_removed")
    again = docs.join(own.where("__l_n_rows > 1"), same)
    one = materialize(again.dropDuplicates(["__l_id", "__l_mark"]).select(*plain), "first_rows")
    others = again.select(*plain).exceptAll(one)
    single = without(kept.where("coalesce(__l_n_rows, 1) = 1"), "__l_removed")
    return single.unionByName(without(one.join(own, same), "__l_removed")).unionByName(without(others.join(own, same), "__l_copied"))


def op7_query(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` (their numbers from 0, comma-joined) of every row, by ``judged``.

    A null text has 0 lines, an empty one 1. Rows equal in doc_id and text are told apart only by their order here.
    """
    none = F.col("mark") == F.xxhash64(F.lit(None).cast("string"))
    rows = judged(docs).select("id", F.when(none, 0).otherwise(F.col("n_lines")).alias("n_lines"), "removed", "copied", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("k"))
    lost = F.when(F.col("k") == 1, F.col("removed")).otherwise(F.col("copied"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size(lost).cast("long").alias("n_removed"), F.array_join(lost.cast("array<string>"), ",").alias("removed"))
