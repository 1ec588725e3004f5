"""Operators on what narrower versions of them left out."""

import random

import pytest

import corpus_pipeline
from tidelog.llm import shingle_groups, simhash_dedup


def word_shingles(text, width=5):
    words = (text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


@pytest.mark.parametrize(("small", "block"), [(24, 512), (1, 2)])
def test_near_copies(spark, monkeypatch, small, block):
    """The pipeline's stage keeps one document of each group connected by shingle similarity 0.8 or more."""
    monkeypatch.setattr(shingle_groups, "SMALL_KEY", small)
    monkeypatch.setattr(shingle_groups, "BLOCK", block)
    r = random.Random(8)
    rows = []
    for _ in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 200))]
        for _ in range(4):
            own = list(words)
            for _ in range(r.randrange(6)):
                own[r.randrange(len(own))] = f"x{r.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
    r.shuffle(rows)
    sets = {i: word_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    expected = {find(i) for i in sets}
    assert len(links) > 60 and 40 < len(expected) < 140
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, df, "").collect()} == expected


def test_one_id_in_two_groups(spark):
    """Each group keeps a document, even if the smallest id of both is that of two texts."""
    one, two = ("".join(f"{c}{i} " for i in range(30)) for c in "pq")
    df = spark.createDataFrame([(1, one), (1, two), (2, one + "more"), (3, two + "more")], "doc_id long, text string")
    assert sorted(map(tuple, simhash_dedup.keep_one(df).collect())) == [(1, one), (1, two)]
