"""Byte-level BPE by recursive DuckDB queries inside each partition.

A word's bytes are rows (word, position, token). A recursive query joins neighbouring tokens to the merge table,
and contracts each word's pair of least rank, leftmost first, until no word has a pair left. Decoding joins ids to
the vocabulary and aggregates their bytes in order. Words of over LONG bytes, whose rounds would each go over all
their rows, are contracted one after another with a heap of their pairs, to the same tokens.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import binary, slices, trimmed

SLICE_BYTES = 3 << 20
#: Ids that one decoding query takes, or one text's.
DECODED_IDS = 400_000
#: Words whose ids a Python worker keeps for later texts; beyond it, the least used ones are forgotten and found anew.
KEPT_WORDS = 400_000
#: Rounds of a recursive query; words that aren't done go into another one, so its rows stay few.
ROUNDS = 32
#: Bytes of new words in one recursive query, so that its rows and hash tables fit the engine's memory; a longer word has one to itself.
QUERY_BYTES = 112 << 10

#: Longest word, in bytes, that goes into a recursive query.
LONG = 256

#: step: a token of word w from byte i to e after round n. Of each word, the pair of neighbouring tokens with the least rank
#: is contracted, of equal ones the leftmost; words without a pair are done and aren't carried on.
CONTRACT = f"""
WITH RECURSIVE step AS (
  SELECT w, i, e, tok, 0 AS n FROM fresh
  UNION ALL (
  WITH pairs AS MATERIALIZED (
      SELECT a.w, a.i, b.i AS j, b.e, m.r, (m.r::BIGINT << 32) | a.i AS place
      FROM step a JOIN step b ON b.i = a.e JOIN merges m ON m.a = a.tok AND m.b = b.tok WHERE a.n < {ROUNDS}),
    due AS (SELECT w, min(place) AS place FROM pairs GROUP BY w),
    chosen AS MATERIALIZED (SELECT p.w, p.i, p.j, p.e, p.r FROM pairs p JOIN due ON p.w = due.w AND p.place = due.place)
  SELECT s.w, s.i, coalesce(l.e, s.e), coalesce(l.r, s.tok), s.n + 1
  FROM step s JOIN chosen c ON c.w = s.w LEFT JOIN chosen l ON l.i = s.i
  WHERE s.i <> c.j
  )
)
SELECT * FROM step
"""
DECODE = "SELECT d, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS bytes FROM ids t JOIN vocabulary v ON v.id = t.id GROUP BY d ORDER BY d"


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))) or {bytes([b]) for b in range(256)} - set(ranks.values()):
        raise ValueError("ranks must count from 0 and include every single byte")
    return [ranks[i] for i in range(len(ranks))]


class Coder:
    """The vocabulary, its tables in DuckDB, and the ids of words met so far."""

    def __init__(self, tokens: tuple[bytes, ...], pattern: str) -> None:
        self.split = regex.compile(pattern).findall
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        merges = [(self.rank[t[:k]], self.rank[t[k:]], r) for t, r in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        a, b, r = (np.array(x, np.int32) for x in zip(*merges, strict=True)) if merges else (np.empty(0, np.int32),) * 3
        self.table("merges", a=a, b=b, r=r)
        self.table("vocabulary", id=np.arange(len(tokens), dtype=np.int32), hex=pa.array([t.hex() for t in tokens], pa.string()))
        self.known: dict[str, int] = {}
        self.ids, self.n_ids = np.empty(1 << 16, np.int32), 0
        self.first, self.count, self.uses = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), np.zeros(1 << 14, np.int64)

    def table(self, name: str, **columns) -> None:
        given = pa.table(columns)
        self.db.register("given", given)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def forget(self) -> None:
        """Keep the words used most, half of KEPT_WORDS at most."""
        uses = self.uses[: len(self.known)]
        least = max(2, int(np.partition(uses, -(KEPT_WORDS // 2))[-(KEPT_WORDS // 2)]) + 1 if len(uses) > KEPT_WORDS // 2 else 2)
        kept = np.flatnonzero(uses >= least)
        words = list(self.known)
        counts = self.count[kept]
        ends = np.cumsum(counts, dtype=np.int64)
        ids = self.ids[np.repeat(self.first[kept] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        self.known, self.n_ids = {}, 0
        old = uses[kept] // 2
        self._keep([words[i] for i in kept.tolist()], ids, counts)
        self.uses[: len(old)] = old

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        k, n = len(self.known), self.n_ids
        while n + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while k + len(words) > len(self.first):
            self.first, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.uses))
        self.ids[n : n + len(ids)] = ids
        self.first[k : k + len(words)] = n + np.cumsum(counts) - counts
        self.count[k : k + len(words)] = counts
        self.uses[k : k + len(words)] = 0
        self.known.update(zip(words, range(k, k + len(words)), strict=True))
        self.n_ids += len(ids)

    def learn(self, words: list[str]) -> None:
        """Find the ids of new words; a word that is a token is that token."""
        raw = [x.encode() for x in words]
        whole = [(w, self.rank[x]) for w, x in zip(words, raw, strict=True) if x in self.rank]
        self._keep([w for w, _ in whole], np.array([r for _, r in whole], np.int32), np.ones(len(whole), np.int32))
        rest = [(w, x) for w, x in zip(words, raw, strict=True) if x not in self.rank]
        for w, x in rest:
            if len(x) > LONG:
                ids = self._contract_long(x)
                self._keep([w], ids, np.array([len(ids)], np.int32))
        rest = [(w, x) for w, x in rest if len(x) <= LONG]
        start = 0
        while start < len(rest):
            stop, size = start, 0
            while stop < len(rest) and (stop == start or size + len(rest[stop][1]) <= QUERY_BYTES):
                size += len(rest[stop][1])
                stop += 1
            self._keep([w for w, _ in rest[start:stop]], *self._contract([x for _, x in rest[start:stop]]))
            start = stop

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and how many each has."""
        sizes = np.array([len(x) for x in words])
        data = np.frombuffer(b"\0".join(words), np.uint8)  # a gap, so that no word's end is the next one's start
        inside = np.ones(len(data), bool)
        inside[np.cumsum(sizes + 1)[:-1] - 1] = False
        i = np.flatnonzero(inside).astype(np.int32)
        state = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "i": i, "e": i + 1, "tok": self.byte[data[i]]})
        done = []
        while len(state):
            self.table("fresh", **{c: state[c] for c in state.column_names})
            out = self.db.sql(CONTRACT).to_arrow_table()
            w, n = out["w"].to_numpy(), out["n"].to_numpy()
            last = np.zeros(len(words), n.dtype)
            np.maximum.at(last, w, n)
            final = n == last[w]  # a word's rows of its last round
            more = final & (n == ROUNDS)
            done.append(out.filter(pa.array(final & ~more)).select(["w", "i", "tok"]))
            state = out.filter(pa.array(more)).drop_columns(["n"])
        out = pa.concat_tables(done)
        order = np.argsort(out["i"].to_numpy(), kind="stable")
        return out["tok"].to_numpy()[order], np.bincount(out["w"].to_numpy(), minlength=len(words)).astype(np.int32)

    def _contract_long(self, word: bytes) -> np.ndarray:
        """Token ids of one word, by a heap of (rank, place) of its neighbouring tokens."""
        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next and the last token begin
        rank = self.rank.get
        due = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(due)
        gone = bytearray(n + 1)
        gone[n] = 1

        def offer(i: int, stop: int) -> None:
            if (r := rank(word[i:stop])) is not None:
                heapq.heappush(due, (r, i, stop))

        while due:
            _, i, stop = heapq.heappop(due)
            j = after[i]
            if gone[i] or j >= n or after[j] != stop:  # a token of the pair was contracted meanwhile
                continue
            gone[j], after[i] = 1, stop
            if stop < n:
                before[stop] = i
                offer(i, after[stop])
            if before[i] >= 0:
                offer(before[i], stop)
        starts = [i for i in range(n) if not gone[i]]
        return np.array([self.rank[word[i : after[i]]] for i in starts], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has."""
        cut = [self.split(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.forget()
        known = self.known
        new = [w for w in set(chain.from_iterable(cut)) if w not in known]
        if new:
            self.learn(new)
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64)
        self.uses[: len(known)] += np.bincount(at, minlength=len(known))
        counts = self.count[at].astype(np.int64)
        ends = np.cumsum(counts)
        where = np.repeat(self.first[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        words = np.cumsum([0, *map(len, cut)])
        totals = np.concatenate([[0], ends])[words]
        return self.ids[where], np.diff(totals)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        self.table("ids", d=np.repeat(np.arange(len(counts), dtype=np.int32), counts), pos=np.arange(len(ids), dtype=np.int64), id=ids)
        out: list[bytes] = [b""] * len(counts)
        found = self.db.sql(DECODE).to_arrow_table()
        if sum(counts) and len(found) != int((counts > 0).sum()):
            raise ValueError("an id is not in the vocabulary")
        for d, x in zip(found["d"].to_pylist(), found["bytes"].to_pylist(), strict=True):
            out[d] = x
        return out


@lru_cache(maxsize=2)
def _coder(tokens: tuple[bytes, ...], pattern: str) -> Coder:
    return Coder(tokens, pattern)


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows of about ``most`` ids in all, one row at least."""
    start = 0
    while start < len(sizes):
        stop, size = start, 0
        while stop < len(sizes) and (stop == start or size + sizes[stop] <= most):
            size += sizes[stop]
            stop += 1
        yield slice(start, stop)
        start = stop


def _decoded(coder: Coder, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.array([x for part in _parts(sizes, DECODED_IDS) for x in coder.decode(ids[ends[part.start] : ends[part.stop]], sizes[part])], pa.binary())


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``id, ids``: the token ids of each whole text; a null text is empty. With ``decoded``, also ``bytes``, decoded from the ids by the same workers.

    Matches of ``pattern`` are encoded separately, without special tokens; text between matches is left out.
    Repeated rows are repeated; no rows give no rows. Texts are coded in slices of about SLICE_BYTES, a longer text in one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for b in batches:
            for part in slices(b, "text", SLICE_BYTES):
                ids, counts = coder.encode([t or "" for t in part.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                columns = {"id": part.column("id"), "ids": lists} | ({"bytes": _decoded(coder, ids, counts)} if decoded else {})
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, ids array<int>" + ", bytes binary" * decoded)


def decode(encoded: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """``id, ids, bytes``: the bytes that the ids stand for; null ids are empty, ids outside the vocabulary an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(tuple(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for b in batches:
            sizes = b.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            own = b.column("ids").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), _decoded(coder, own, sizes)], ["id", "ids", "bytes"])

    return encoded.select("id", "ids").mapInArrow(trimmed(run), "id long, ids array<int>, bytes binary")


def op1_query(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's columns; a null text has no tokens, repeated rows are repeated, an empty table gives an empty one."""
    coded = encode(docs, read_ranks(path), pattern, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
