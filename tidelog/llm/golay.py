"""The binary Golay code: codewords near 23-bit segments of a SimHash."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101


def _syndromes() -> np.ndarray:
    """Remainder modulo the generator of the 12 low and of the 11 high bits of a vector."""
    of = np.zeros((2, 4096), np.int64)
    for part in (0, 1):
        for x in range(4096 if part == 0 else 2048):
            r = x << 12 * part
            for bit in range(22, 10, -1):
                if r >> bit & 1:
                    r ^= GOLAY << bit - 11
            of[part, x] = r
    return of


def _errors(of: np.ndarray) -> np.ndarray:
    """For each syndrome, six error vectors of weight 4 or less with it; where there is one, it is repeated."""
    found: dict[int, list[int]] = {}
    for weight in range(5):
        for at in combinations(range(23), weight):
            e = sum(1 << i for i in at)
            found.setdefault(int(of[0, e & 4095] ^ of[1, e >> 12]), []).append(e)
    return np.array([(found[s] * 6)[:6] for s in range(2048)], np.int64)


class Golay:
    """Codeword indices (12 bits) within distance 4 of 23-bit vectors."""

    def __init__(self) -> None:
        self.of = _syndromes()
        self.errors = _errors(self.of)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """An array of six columns; a single index is repeated."""
        s = self.of[0, x & 4095] ^ self.of[1, x >> 12]
        return (x[:, None] ^ self.errors[s]) >> 11

    def signs(self) -> np.ndarray:
        """Each codeword, by index, as a column: -1 where it has a one, and 1 elsewhere."""
        first = np.arange(4096, dtype=np.int64) << 11
        words = first | self.of[0, first & 4095] ^ self.of[1, first >> 12]
        return (1 - 2 * (words >> np.arange(23)[:, None] & 1)).astype(np.float32)


def likeliest(signs: np.ndarray, votes: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Soft decoding: indices of the ``many`` codewords that agree best with each row of 23 votes, and how well.

    A vote is how far a SimHash count is from half, negative if its bit is one: bits near half count little.
    """
    fit = votes @ signs
    rows = np.arange(len(fit))
    index, value = np.empty((len(fit), many), np.int64), np.empty((len(fit), many), np.float32)
    for i in range(many):
        index[:, i] = fit.argmax(1)
        value[:, i] = fit[rows, index[:, i]]
        fit[rows, index[:, i]] = -np.inf
    return index, value
