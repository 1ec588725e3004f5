"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into windows of WINDOW bytes. In each, one recurrence reads forward and one backward; both states
at a byte give that byte's language probabilities, and a document's are the mean over all its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import binary, trimmed

WINDOW = 48
HIDDEN = 8
PAD = 256
#: The network is fitted on this many rows of each language at most, and on so many windows of each.
ROWS_A_LANGUAGE, WINDOWS_A_ROW = 400, 4
EPOCHS, BATCH, RATE, SEED = 14, 512, 0.02, 7
#: With few windows, batches are smaller and epochs more, for so many steps at least.
LEAST_STEPS = 160
WINDOWS_AT_ONCE = 4096
SLICE_BYTES = 4 << 20
UNKNOWN = "und"
ASCII_NO_LETTERS = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalpha())


class BiGru:
    """Both directions are stacked on the first axis of the weights; the second one reads its windows reversed."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.hidden = hidden
        self.p = {"e": draw(2, 257, 3 * hidden, scale=0.5), "u": draw(2, hidden, 3 * hidden, scale=hidden**-0.5), "b": np.zeros((2, 1, 3 * hidden), np.float32), "v": draw(2, hidden, classes, scale=hidden**-0.5), "c": np.zeros(classes, np.float32)}
        self.p["e"][:, PAD] = 0

    def states(self, x: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States (2, steps, windows, hidden) of windows x (windows, steps); the second direction's in reading order."""
        e, u, b, k = self.p["e"], self.p["u"], self.p["b"], self.hidden
        n, steps = x.shape
        both = np.stack([x.T, x.T[::-1]])
        h = np.zeros((2, n, k), np.float32)
        out = np.empty((2, steps, n, k), np.float32)
        for t in range(steps):
            a = np.stack([e[0][both[0, t]], e[1][both[1, t]]])
            g = h @ u + b
            gates = 0.5 + 0.5 * np.tanh(0.5 * (a[..., : 2 * k] + g[..., : 2 * k]))
            z, r = gates[..., :k], gates[..., k:]
            new = np.tanh(a[..., 2 * k :] + r * g[..., 2 * k :])
            if kept is not None:
                kept.append((h, g[..., 2 * k :], z, r, new))
            h = new + z * (h - new)
            out[:, t] = h
        return out

    def label(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (steps, windows, classes) of every byte."""
        v = self.p["v"]
        logits = states[0] @ v[0] + states[1, ::-1] @ v[1] + self.p["c"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(-1, keepdims=True)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Sums of the byte probabilities of each window (windows, classes), without padding.

        The same network as ``states`` and ``label``, with features first so that every operation runs along
        the windows, and with the gates' halves folded into the weights.
        """
        e, u, b, v, k = self.p["e"], self.p["u"], self.p["b"], self.p["v"], self.hidden
        n, steps = x.shape
        read = np.ascontiguousarray(x.T).astype(np.intp)
        out = np.empty((2, steps, k, n), np.float32)
        a, g = np.empty((n, 3 * k), np.float32), np.empty((3 * k, n), np.float32)
        for way in (0, 1):
            half = np.r_[np.full(2 * k, 0.5, np.float32), np.ones(k, np.float32)]
            table = (e[way] + np.r_[b[way, 0, : 2 * k], np.zeros(k, np.float32)]) * half
            weights, bias = np.ascontiguousarray((u[way] * half).T), b[way, 0, 2 * k :, None]
            h = np.zeros((k, n), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.take(table, read[t], axis=0, out=a, mode="clip")
                np.dot(weights, h, out=g)
                gates, new, own = g[: 2 * k], g[2 * k :], out[way, t]
                gates += a.T[: 2 * k]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                new += bias
                new *= gates[k:]
                new += a.T[2 * k :]
                np.tanh(new, out=new)
                np.subtract(h, new, out=own)
                own *= gates[:k]
                own += new
                h = own
        total = np.zeros((len(self.p["c"]), n), np.float32)
        for t in range(steps):
            p = v[0].T @ out[0, t] + v[1].T @ out[1, t] + self.p["c"][:, None]
            p -= p.max(0)
            np.exp(p, out=p)
            p *= (read[t] != PAD) / p.sum(0)
            total += p
        return total.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes that are no padding, and its gradients by backpropagation through time."""
        k, (n, steps) = self.hidden, x.shape
        kept: list = []
        states = self.states(x, kept)
        p = self.label(states)
        mask = (x.T != PAD).astype(np.float32)
        weight = mask / mask.sum()
        loss = -float((np.log(p[:, np.arange(n), y] + 1e-9) * weight).sum())
        p[:, np.arange(n), y] -= 1
        d_logits = p * weight[..., None]
        v, u = self.p["v"], self.p["u"]
        both_d = np.stack([d_logits, d_logits[::-1]])
        grad = {"v": np.einsum("dtnh,dtnc->dhc", states, both_d), "c": d_logits.sum((0, 1)), "u": np.zeros_like(u), "b": np.zeros_like(self.p["b"])}
        d_in = np.empty((2, steps, n, 3 * k), np.float32)
        d_next = np.zeros((2, n, k), np.float32)
        for t in range(steps - 1, -1, -1):
            h, gn, z, r, new = kept[t]
            d = d_next + both_d[:, t] @ v.transpose(0, 2, 1)
            d_new = d * (1 - z) * (1 - new * new)
            dz = d * (h - new) * z * (1 - z)
            dr = d_new * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, d_new * r], -1)
            d_in[:, t] = np.concatenate([dz, dr, d_new], -1)
            grad["u"] += h.transpose(0, 2, 1) @ dg
            grad["b"] += dg.sum(1, keepdims=True)
            d_next = d * z + dg @ u.transpose(0, 2, 1)
        grad["e"] = np.zeros_like(self.p["e"])
        for way, read in enumerate((x.T, x.T[::-1])):
            order = np.argsort(read.ravel(), kind="stable")
            byte, first = np.unique(read.ravel()[order], return_index=True)
            grad["e"][way, byte] = np.add.reduceat(d_in[way].reshape(-1, 3 * k)[order], first)
        grad["e"][:, PAD] = 0
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        batch = min(batch, max(32, len(x) // 8))
        epochs = max(epochs, -(-LEAST_STEPS * batch // max(1, len(x))))
        r, step, loss = np.random.default_rng(SEED), 0, 0.0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order, losses = r.permutation(len(x)), []
            for i in range(0, len(x), batch):
                own, grad = self.gradients(x[order[i : i + batch]], y[order[i : i + batch]])
                losses.append(own)
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    s[k] = 0.99 * s[k] + 0.01 * grad[k] ** 2
                    self.p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
            loss = float(np.mean(losses))
        return loss


def windows(text: bytes) -> np.ndarray:
    """All bytes of a text, WINDOW a row, the last row padded."""
    rows = -(-len(text) // WINDOW)
    out = np.full(rows * WINDOW, PAD, np.int16)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, WINDOW)


def has_letter(text: bytes) -> bool:
    return len(text.translate(None, ASCII_NO_LETTERS)) > 0 or any(map(str.isalpha, text.decode("utf-8", "replace")))


def sample_windows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, list[str]]:
    """Windows of ROWS_A_LANGUAGE rows at most of each language, taken by hash, and their languages.

    A hash threshold for each language leaves about twice the bound before any row is ranked, so no language's
    rows meet in one task. WINDOWS_A_ROW windows of a row are taken from anywhere in its whole text.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    counts = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()
    share = F.lit(0.0)
    for r in counts:  # a number for each language
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 2 * ROWS_A_LANGUAGE / r["count"]))).otherwise(share)
    few = rows.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003 < share)
    ranked = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= ROWS_A_LANGUAGE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, parts = [], []
            for lang, text, h in zip(b.column("lang").to_pylist(), binary(b.column("text")), b.column("h").to_pylist(), strict=True):
                starts = np.random.default_rng(abs(h)).integers(0, max(1, len(text) - WINDOW + 1), WINDOWS_A_ROW)
                for s in sorted(set(starts.tolist())) if text else ():
                    langs.append(lang)
                    parts.append(text[s : s + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    found = ranked.select("lang", "text", "h").mapInArrow(cut, "lang string, part binary").toArrow().to_pydict()  # bounded, see above
    order = sorted(range(len(found["lang"])), key=lambda i: (found["lang"][i], found["part"][i]))
    x = np.concatenate([windows(found["part"][i]) for i in order]) if order else np.empty((0, WINDOW), np.int16)
    return x, [found["lang"][i] for i in order]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[BiGru, list[str]]:
    """A network fitted on ``sample_windows`` and the languages its classes stand for (none if there are no labelled texts)."""
    x, langs = sample_windows(labelled, id_col, text_col, lang_col)
    classes = sorted(set(langs))
    net = BiGru(max(1, len(classes)))
    if len(classes) > 1:
        net.fit(x, np.array([classes.index(c) for c in langs]))
    return net, classes


def document_probabilities(net: BiGru, texts: list[bytes]) -> np.ndarray:
    """Mean of the byte probabilities of each text (zeros where it is empty)."""
    cut = [windows(t) for t in texts]
    x = np.concatenate(cut) if cut else np.empty((0, WINDOW), np.int16)
    sums = np.zeros((len(x) + 1, len(net.p["c"])))
    for i in range(0, len(x), WINDOWS_AT_ONCE):
        part = x[i : i + WINDOWS_AT_ONCE]
        sums[i : i + len(part)] = net.pooled(part)
    rows = np.array([len(c) for c in cut], np.int64)
    total = np.add.reduceat(sums, np.cumsum(rows) - rows)[: len(texts)] * (rows > 0)[:, None] if len(texts) else sums[:0]
    return total / np.maximum([len(t) for t in texts], 1)[:, None]


def identify(docs: DataFrame, net: BiGru, classes: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score``: the likeliest language of each whole text and its pooled probability.

    A null text, one without letters, or no learned language gives ``und`` and 0. Repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in binary(b.column("text"))]
            pred, score = [], []
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= SLICE_BYTES):
                    size += len(texts[stop])
                    stop += 1
                p = document_probabilities(net, texts[start:stop])
                for t, own in zip(texts[start:stop], p, strict=True):
                    known = bool(classes) and has_letter(t)
                    pred.append(classes[int(own.argmax())] if known else UNKNOWN)
                    score.append(min(1.0, float(own.max())) if known else 0.0)
                start = stop
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "id long, lang_pred string, score double")


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def op2_query(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of documents; edge cases as in ``identify``, and a null doc_id counts as an empty one for the fold."""
    net, classes = train(docs.where(~is_held_out()))
    return identify(docs, net, classes).select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "lang_pred", "score")
