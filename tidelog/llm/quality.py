"""Document quality: measures of each text, and lines that too many documents of a host repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import binary, materialize, slices, trimmed

#: White space and UTF-8 continuation bytes: what is left of a text without them has one byte per code point in words.
NOT_COUNTED = b"\x20\x09\x0a\x0b\x0c\x0d" + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: A line that more documents of one host than this repeat is removed from all its documents.
LINE_DOCS = 20
#: A document is depleted when the words of the removed lines leave less than this share of its words.
LEAST_LEFT = 0.2

SLICE_BYTES = 2 << 20
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words that are in a WINDOW-word window found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    mixed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + (mixed[j : j + n] ^ mixed[j : j + n] >> np.uint64(31))
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at: dict[tuple[bytes, ...], list[int]] = {}
    for i in np.flatnonzero(maybe).tolist():  # equal hashes are only candidates
        at.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for places in at.values():
        if len(places) > 1:
            np.add.at(edge, places, 1)
            np.add.at(edge, np.array(places) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[tuple[int, ...], list[int], list[int]]:
    """The five measures; hash and word count of every line (hash 0 where it has no word)."""
    text = text or b""
    words = text.split()
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    dup = 0
    hashes, counts = [], []
    for line in lines:
        own = line.lower().split()
        hashes.append(xxhash.xxh3_64_intdigest(b" ".join(own)) - (1 << 63) if own else 0)
        counts.append(len(own))
        if own:
            dup += line in seen
            seen.add(line)
    own = (len(words), len(text.translate(None, NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), dup, repeat_words(words))
    return own, hashes, counts


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``id, host, mark`` (a hash of the text, which tells rows of one id apart), the measures and ``lines``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("h", pa.int64()), ("w", pa.int32())])
        for batch in batches:
            for b in slices(batch, "text", SLICE_BYTES):
                found = [measure(t) for t in binary(b.column("text"))]
                ends = np.cumsum([0, *(len(x[1]) for x in found)], dtype=np.int32)
                pairs = pa.StructArray.from_arrays([pa.array([h for x in found for h in x[1]], pa.int64()), pa.array([c for x in found for c in x[2]], pa.int32())], fields=list(kind))
                own = [pa.array([x[0][i] for x in found], pa.int64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("mark"), *own, pa.ListArray.from_arrays(pa.array(ends), pairs)], ["id", "host", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).alias("host"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), f"id long, host string, mark long, {MEASURES}, lines array<struct<h:long,w:int>>")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row per document: ``id, host, mark``, the measures, ``base_failed``, ``removed`` (line numbers from 0), ``kept``.

    Lines are compared lower-cased (A-Z) with white space collapsed. A line is removed where more than
    ``line_docs`` distinct documents of its host have it; documents of equal text are one. A document is kept if
    it passes the base rules and keeps ``least_left`` of its words. A null text has no words and fails; a null
    host is a host of its own; repeated rows are repeated; no rows give no rows.
    """
    rows = materialize(measured(docs, id_col, text_col, host_col), "measured")
    lines = rows.select("id", "host", "mark", F.posexplode("lines").alias("pos", "line")).select("id", "host", "mark", "pos", "line.h", "line.w").where("w > 0")
    often = lines.select("host", "h", "mark").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > line_docs).select(F.col("host").alias("o_host"), F.col("h").alias("o_h"))
    hit = lines.join(often, F.col("host").eqNullSafe(F.col("o_host")) & (F.col("h") == F.col("o_h")))
    lost = hit.select("id", "host", "mark", "pos", "w").distinct().groupBy("id", "host", "mark").agg(F.sum("w").alias("gone"), F.array_sort(F.collect_set("pos")).alias("removed"))
    lost = lost.select(F.col("id").alias("l_id"), F.col("host").alias("l_host"), F.col("mark").alias("l_mark"), "gone", "removed")
    same = F.col("id").eqNullSafe(F.col("l_id")) & F.col("host").eqNullSafe(F.col("l_host")) & (F.col("mark") == F.col("l_mark"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = F.col("n_words") - F.coalesce("gone", F.lit(0)) < least_left * F.col("n_words")
    return rows.drop("lines").join(lost, same, "left").select(
        "id", "host", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), (~failed & ~depleted).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """The kept documents, without their removed lines; all columns stay, under their names."""
    own = judge(docs, id_col, text_col, host_col, **limits).where("kept").groupBy("id", "host", "mark").agg(F.first("removed").alias("removed"))
    own = own.select(*(F.col(c).alias(f"__q_{c}") for c in own.columns))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__q_id")) & F.col(f"`{host_col}`").eqNullSafe(F.col("__q_host")) & (F.xxhash64(text_col) == F.col("__q_mark"))
    left = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains("__q_removed", i)), "\n")
    joined = docs.join(own, same)
    return joined.select(*(F.when(F.size("__q_removed") > 0, left).otherwise(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op4_query(docs: DataFrame) -> DataFrame:
    """The contract's columns and ``n_removed_lines``; a row per row of documents, edge cases as in ``judge``."""
    return judge(docs).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.size("removed").cast("long").alias("n_removed_lines"))
