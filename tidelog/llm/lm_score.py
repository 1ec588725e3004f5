"""Language-model scores: prediction by partial matching over bytes, and a smoothed word model as its base.

The byte model is a trie of contexts of up to ORDER symbols, the 256 bytes and a mark for both ends of a text, with
escape method C and exclusion. It is nowhere as a whole. Each block of documents asks for its distinct runs of
ORDER + 1 symbols. These meet in shards by the last two symbols of their context, so that a shard has all runs of
each of its contexts of two symbols or more; it adds up their counts and answers with code lengths. Contexts of one
symbol and none are a table of 257 by 257 counts. Words are counted in shards in the same way. So what is gathered
grows with the corpus, but each task holds one block or one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidelog.llm.common import binary, materialize, mix, slices, trimmed, word_hashes

#: Context symbols of the longest contexts. A run has 9 bits a symbol, and DOC_BITS are left for a document's number in a slice.
ORDER, DOC_BITS = 5, 10
MARK = 256
SYMBOLS = MARK + 1
SLICE_BYTES = 1 << 20
#: Mean bytes of a block's texts, and of the text whose runs or words one shard counts.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 48 << 20
#: Runs or words that a block keeps apart before it adds them up.
PENDING = 3_000_000
#: White space that parts words.
GAP = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def _mask(symbols: int) -> np.uint64:
    return np.uint64((1 << 9 * symbols) - 1)


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The run that ends at each byte and at each text's end, before the first text symbol filled up with marks, and how many each text has."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    symbols = np.frombuffer(b"".join(b"\0" * ORDER + t + b"\0" for t in texts), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes + ORDER)
    pads = ((ends - sizes)[:, None] - np.arange(1, ORDER + 1)).ravel()
    symbols[pads] = MARK
    symbols[ends - 1] = MARK
    runs = symbols[ORDER:].copy()
    for k in range(1, ORDER + 1):
        runs |= symbols[ORDER - k : len(symbols) - k] << np.uint64(9 * k)
    inside = np.ones(len(symbols), bool)
    inside[pads] = False
    return runs[inside[ORDER:]], sizes


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after another, and how many each text has."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    start, _, hashes = word_hashes(data, GAP[data])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def run_logs(runs: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 probability of the last symbol of each run after its others.

    Runs are sorted and distinct, with their counts in training (0: none); ``low`` has the counts of symbols by the
    symbol before. A symbol that isn't found after a context escapes to the next shorter one, where the symbols found
    so far are excluded; as those are among what follows the shorter context, their counts there are a sum for each context.
    """
    seen = counts > 0
    tables = {ORDER: (runs[seen], counts[seen])}
    for k in range(ORDER - 1, 1, -1):
        tables[k] = added(tables[k + 1][0] & _mask(k + 1), tables[k + 1][1])
    out, left = np.zeros(len(runs)), np.ones(len(runs), bool)
    gone_n, gone_kinds = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)

    def descend(n: np.ndarray, kinds: np.ndarray, below: np.ndarray, own: np.ndarray) -> None:
        """n, kinds, below: a context's symbols, how many kinds, and their count after the shorter context; own: the count of the run."""
        nonlocal left, gone_n, gone_kinds
        now, escape = n - gone_n, np.where(kinds < SYMBOLS, kinds - gone_kinds, 0)
        some = left & (now > 0)
        found = some & (own > 0)
        out[found] += np.log10(own[found] / (now + escape)[found])
        missed = some & ~found
        out[missed] += np.log10(escape[missed] / (now + escape)[missed])
        left &= ~found
        gone_n, gone_kinds = np.where(n > 0, below, gone_n), np.where(n > 0, kinds, gone_kinds)

    for k in range(ORDER, 1, -1):
        table, times = tables[k]
        if not len(table):
            continue
        first = np.flatnonzero(np.append(True, table[1:] >> np.uint64(9) != table[:-1] >> np.uint64(9)))
        context = table[first] >> np.uint64(9)
        shorter = tables[k - 1][1][np.searchsorted(tables[k - 1][0], table & _mask(k))] if k > 2 else low[(table >> np.uint64(9) & _mask(1)).astype(np.int64), (table & _mask(1)).astype(np.int64)]
        wanted = runs & _mask(k + 1)
        at = np.minimum(np.searchsorted(context, wanted >> np.uint64(9)), len(context) - 1)
        known = context[at] == wanted >> np.uint64(9)
        of = lambda x: np.where(known, x[at], 0)  # noqa: B023, E731
        place = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        descend(of(np.add.reduceat(times, first)), of(np.diff(first, append=len(table))), of(np.add.reduceat(shorter, first)), np.where(table[place] == wanted, times[place], 0))
    before, last, every = (runs >> np.uint64(9) & _mask(1)).astype(np.int64), (runs & _mask(1)).astype(np.int64), low.sum(0)
    descend(low.sum(1)[before], (low > 0).sum(1)[before], ((low > 0) * every).sum(1)[before], low[before, last])
    whole = np.ones(len(runs), np.int64)
    descend(whole * every.sum(), whole * (every > 0).sum(), 0 * whole, every[last])
    out[left] -= np.log10(SYMBOLS - (every > 0).sum())
    return out


def _lower(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [(x or b"").lower() for x in binary(column)]


def _totals(rows: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Counts of training symbols by the symbol before, and numbers of rows, bytes, training texts and training words."""
    names = ("rows", "bytes", "texts", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums = np.zeros(1 << 18, np.int64), np.zeros(len(names), np.int64)
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                texts = _lower(part.column("text"))
                train = [t for t, held in zip(texts, part.column("held_out").to_pylist(), strict=True) if not held]
                sums += np.array([len(texts), sum(map(len, texts)), len(train), 0])
                if train:
                    raw = np.frombuffer(b"".join(t + b"\0" for t in train), np.uint8).astype(np.int32)
                    raw[np.cumsum([len(t) + 1 for t in train]) - 1] = MARK
                    pairs += np.bincount(np.append(MARK, raw[:-1]) << 9 | raw, minlength=len(pairs))
                    space = np.append(GAP, True)[raw]
                    sums[3] += int((~space & np.append(True, space[:-1])).sum())
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1 - np.arange(len(names)))), pa.array(np.append(pairs[at], sums))], ["code", "n"])

    low, sums = np.zeros((512, 512), np.int64), dict.fromkeys(names, 0)
    for r in rows.select("held_out", "text").mapInArrow(trimmed(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # SYMBOLS squared rows and four at most
        if r["code"] < 0:
            sums[names[-1 - r["code"]]] = r["n"]
        else:
            low[r["code"] >> 9, r["code"] & 511] = r["n"]
    return low[:SYMBOLS, :SYMBOLS], sums


class _Asked:
    """The distinct codes of one block's texts so far, with their counts in training texts."""

    def __init__(self) -> None:
        self.codes, self.counts, self.size = [], [], 0

    def add(self, codes: np.ndarray, train: bool) -> None:
        own, n = np.unique(codes, return_counts=True)
        self.codes.append(own)
        self.counts.append(n if train else np.zeros_like(n))
        self.size += len(own)
        if self.size > PENDING:
            self.codes, self.counts = ([x] for x in self.done())
            self.size = len(self.codes[0])

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        return added(np.concatenate(self.codes), np.concatenate(self.counts)) if self.codes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _requests(rows: DataFrame, shards: int) -> DataFrame:
    """``shard, block, codes, counts``: what each block asks each shard. Shards of runs are numbered from 0, those of words follow."""

    def ask(block: int, kinds: list[_Asked]) -> Iterator[pa.RecordBatch]:
        for k, asked in enumerate(kinds):
            codes, counts = asked.done()
            shard = (mix(codes if k else codes >> np.uint64(9) & _mask(2)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            some = np.flatnonzero(np.diff(edges))
            ends = pa.array(np.append(edges[some], len(codes)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (codes.view(np.int64), counts)]
            yield pa.RecordBatch.from_arrays([pa.array(some + k * shards, pa.int32()), pa.array(np.full(len(some), block, np.int64)), *lists], ["shard", "block", "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kinds = None, [_Asked(), _Asked()]
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                blocks, held, texts = part.column("block").to_numpy(), part.column("held_out").to_numpy(zero_copy_only=False).astype(bool), _lower(part.column("text"))
                for block in dict.fromkeys(blocks.tolist()):  # a block's rows follow each other
                    if block != current:
                        if current is not None:
                            yield from ask(current, kinds)
                        current, kinds = block, [_Asked(), _Asked()]
                    for train in (True, False):
                        own = [texts[i] for i in np.flatnonzero((blocks == block) & (held != train)).tolist()]
                        if own:
                            kinds[0].add(runs_of(own)[0], train)
                            kinds[1].add(words_of(own)[0], train)
        if current is not None:
            yield from ask(current, kinds)

    return rows.select("block", "held_out", "text").mapInArrow(trimmed(run), "shard int, block long, codes array<long>, counts array<long>")


def _replies(requests: DataFrame, shards: int, low: np.ndarray) -> DataFrame:
    """``block, codes, logs, times``: log10 probabilities of runs, or counts of words; a row without a block has a shard's number of known words."""
    shared = requests.sparkSession.sparkContext.broadcast(low)  # SYMBOLS squared numbers

    def answer(table: pa.Table) -> pa.Table:
        words = table["shard"][0].as_py() >= shards
        asked = [np.asarray(x.values).view(np.uint64) for x in table["codes"]]
        codes, counts = added(np.concatenate(asked), np.concatenate([np.asarray(x.values) for x in table["counts"]]))
        values = counts if words else run_logs(codes, counts, shared.value).astype(np.float32)
        found = [values[np.searchsorted(codes, x)] for x in asked]
        blocks, lists = table["block"].to_pylist(), [x.view(np.int64) for x in asked]
        if words:
            blocks, lists, found = [*blocks, None], [*lists, np.empty(0, np.int64)], [*found, np.array([(counts > 0).sum()])]
        none = [None] * len(blocks)
        columns = [pa.array(blocks, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(none if words else found, pa.list_(pa.float32())), pa.array(found if words else none, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, ["block", "codes", "logs", "times"])

    return requests.groupBy("shard").applyInArrow(answer, "block long, codes array<long>, logs array<float>, times array<long>")


def _table(replies: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their values from a block's replies; parts of a block may have asked for the same."""
    own = replies.filter(pa.compute.is_valid(replies[column]))
    if not own.num_rows:
        return np.empty(0, np.uint64), np.empty(0)
    codes, values = (np.concatenate([np.asarray(x.values) for x in own[c]]) for c in ("codes", column))
    codes, first = np.unique(codes.view(np.uint64), return_index=True)
    return codes, values[first].astype(np.float64)


def score_texts(texts: list[bytes], runs: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Per text: the sum of its runs' logs; number of words, of known ones, and the sum of log10(count + 1)."""
    own, sizes = runs_of(texts)
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    both = np.sort(own << np.uint64(DOC_BITS) | text)  # equal runs follow each other, each with its text
    own, text = both >> np.uint64(DOC_BITS), (both & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    logs = np.repeat(runs[1][np.searchsorted(runs[0], own[first])], np.diff(first, append=len(own)))
    hashes, n_words = words_of(texts)
    times = words[1][np.searchsorted(words[0], hashes)] if len(hashes) else np.empty(0)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    summed = lambda at, x: np.bincount(at, x, minlength=len(texts))
    return summed(text, logs), n_words, summed(text_of, times > 0).astype(np.int64), summed(text_of, np.log10(times + 1))


def _blocks(docs: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """``id, held_out, text, file, row``: a row's place in its file stays, however the file is split among tasks."""
    rows = [F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").alias("text")]
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(*rows, *place)
    except AnalysisException:  # not the rows of Parquet files
        return materialize(docs.select(*rows), "texts").select("id", "held_out", "text", *place)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per document: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out`` is a boolean Column; rows where it is not true train both models. Texts are lower-cased (A-Z).
    ``score`` is the byte model's log10 probability of the text and its end, ``base_score`` the word model's of
    its words and the end; words are told apart by a 64-bit hash. A null text is empty; repeated rows train and are
    scored as often as they occur. With no training rows the byte model is uniform and no word is known; an empty
    table gives an empty one. A block's name comes from its rows' places in the files, so a lost executor or other
    splits don't change it.
    """
    rows = _blocks(docs, id_col, text_col, F.lit(False) if held_out is None else held_out)
    low, n = _totals(rows)
    each = max(1, BLOCK_BYTES * n["rows"] // max(1, n["bytes"]))
    rows = rows.select("id", "held_out", "text", F.xxhash64("file", F.floor(F.col("row") / each)).alias("block"))
    shards = max(1, n["bytes"] // SHARD_BYTES)
    replies = materialize(_replies(_requests(rows, shards), shards, low), "replies", **{"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"})
    kinds = replies.where("block is null").agg(F.coalesce(F.sum(F.get("times", F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    n_train, n_all = n["texts"], n["words"] + n["texts"]
    floor = float(np.log10(n_all + kinds + (n_train > 0) + 1))
    end = float(np.log10(n_train + 1))

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        runs, words = _table(answers, "logs"), _table(answers, "times")
        found = []
        for batch in block.select(["text"]).combine_chunks().to_batches(max_chunksize=1 << DOC_BITS):
            found += [score_texts(_lower(part.column("text")), runs, words) for part in slices(batch, "text", SLICE_BYTES)]
        own, n_words, n_known, logs = (np.concatenate(x) for x in zip(*found, strict=True))
        n_tokens = n_words + 1
        columns = [block["id"], block["held_out"], pa.array(n_tokens, pa.int64()), pa.array(n_known + (n_train > 0), pa.int64()), pa.array(np.full(len(own), n_all, np.int64)), pa.array(logs + end - n_tokens * floor), pa.array(own)]
        return pa.Table.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = rows.groupBy("block").cogroup(replies.where("block is not null").groupBy("block"))
    return both.applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_query(docs: DataFrame) -> DataFrame:
    """The contract's columns for a documents table; edge cases as in ``scores``, and a null doc_id counts as an empty one for the fold."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return scores(docs, held_out=held_out).withColumnRenamed("id", "doc_id")
