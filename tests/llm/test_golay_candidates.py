"""The pipeline's near duplicates: candidates by SimHash and Golay codewords."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidelog.llm import shingle_groups
from tidelog.llm.golay import Golay

MASK = (1 << 64) - 1


def codewords():
    """All multiples of the generator polynomial, by their upper 12 bits."""
    found = {}
    for m in range(4096):
        word = 0
        for i in range(12):
            if m >> i & 1:
                word ^= 0b110001110101 << i
        found[word >> 11] = word
    assert len(found) == 4096 and min(bin(w).count("1") for w in found.values() if w) == 7
    return np.array([[-1 if found[m] >> i & 1 else 1 for i in range(23)] for m in range(4096)])


def stretched(h, k):
    """Word k of a shingle's hash."""
    h = h + k * 0x9E3779B97F4A7C15 & MASK
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


@pytest.mark.parametrize("size", [1, 2, 9, 300])
def test_keys_by_brute_force(size):
    """Votes are counted bit by bit; the keys are pairs of codewords, and none fits better than the worst of them."""
    r = random.Random(size)
    own = [r.getrandbits(64) for _ in range(size)]
    bits = 64 * shingle_groups.WORDS
    votes = np.zeros(bits, int)
    for h in own:
        whole = sum(stretched(h, k) << 64 * k for k in range(shingle_groups.WORDS))
        votes += [-1 if whole >> i & 1 else 1 for i in range(bits)]
    got = shingle_groups.simhash_votes(np.array(own, np.uint64))
    assert got.tolist() == votes.tolist()
    keys = shingle_groups.golay_keys(got[None], Golay().signs())[0].reshape(shingle_groups.TABLES, -1)
    words = codewords()
    for t, of in enumerate(keys.tolist()):
        assert len(set(of)) == shingle_groups.PROBES and {k >> 24 for k in of} == {t}
        at = shingle_groups.CHECKED + 46 * t
        fits = [np.sort(words @ votes[i : i + 23])[::-1] for i in (at, at + 23)]
        best = np.sort(np.add.outer(fits[0][:4], fits[1][:4]).ravel())[::-1][: shingle_groups.PROBES]
        mine = [words[k >> 12 & 4095] @ votes[at : at + 23] + words[k & 4095] @ votes[at + 23 : at + 46] for k in of]
        assert sorted(mine, reverse=True) == best.tolist()


@pytest.mark.parametrize(("common", "one", "two"), [(4, 0, 1), (40, 5, 5), (160, 0, 40)])
def test_pairs_at_the_limit(common, one, two):
    """Of 300 pairs of similarity 0.8, all share a key and are near in the checked bits; a table alone finds about a third."""
    r = np.random.default_rng(common)
    tables = 0
    for _ in range(300):
        x = r.integers(0, 1 << 63, common + one + two, np.uint64)
        a, b = (shingle_groups.simhash_votes(s) for s in (x[: common + one], np.append(x[:common], x[common + one :])))
        a_keys, b_keys = (set(k.tolist()) for k in shingle_groups.golay_keys(np.stack([a, b]), Golay().signs()))
        assert a_keys & b_keys
        assert ((a < 0) != (b < 0))[: shingle_groups.CHECKED].sum() <= shingle_groups.RADIUS
        tables += len({k >> 24 for k in a_keys & b_keys})
    assert 0.3 < tables / 300 / shingle_groups.TABLES < 0.42


def test_stage_links_through_the_keys(spark, monkeypatch):
    """Near copies go by the keys; without keys all unequal shingle sets stay."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words[::-1])), (4, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda: sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept() == [1, 3]
    by_keys = shingle_groups.shared_keys
    monkeypatch.setattr(shingle_groups, "shared_keys", lambda marked: by_keys(marked).where("false"))
    assert kept() == [1, 2, 3]
