"""The pipeline's near duplicates: keys that unrelated texts share by chance."""

import random

import pytest

from tidelog.llm import shingle_groups

SCHEMA = "key int, node long, size long, lo long, hi long"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def checked(r, like=None, flips=0):
    """lo, hi of 128 random bits, or of another's with some bits turned."""
    x = r.getrandbits(128) if like is None else (like[0] % (1 << 64)) | (like[1] % (1 << 64)) << 64
    for i in r.sample(range(128), flips):
        x ^= 1 << i
    return signed(x % (1 << 64)), signed(x >> 64)


def near(x, y):
    apart = sum(bin((a ^ b) % (1 << 64)).count("1") for a, b in zip(x[3:], y[3:], strict=True))
    return x[1] != y[1] and apart <= shingle_groups.RADIUS and min(x[2], y[2]) >= shingle_groups.LEAST_JACCARD * max(x[2], y[2])


@pytest.mark.parametrize("rows_at_once", [1, 7, 10_000])
def test_near_rows_by_brute_force(spark, rows_at_once):
    """However Arrow cuts the rows, those near another of their key are found, at the radius and the least size, too."""
    r = random.Random(rows_at_once)
    rows = [(-5, 1, 4, 0, 0), (-5, 2, 5, -1 << 20, 0), (-6, 1, 4, 0, 0), (-6, 2, 5, signed((1 << 45) - 1), 0), (-7, 1, 3, 0, 0), (-7, 2, 4, 0, 0), (-8, 3, 0, 0, 0), (-8, 4, 0, 0, 0), (-9, 5, 9, 0, 0), (-9, 5, 9, 0, 0)]
    for key in range(300):
        first = checked(r)
        for _ in range(r.randrange(1, 25)):
            own = checked(r, first, r.choice((0, 40, 44, 45, 50))) if r.random() < 0.3 else checked(r)
            rows.append((key, r.randrange(60), r.randrange(80, 130), *own))
    r.shuffle(rows)
    by_key = {}
    for x in rows:
        by_key.setdefault(x[0], []).append(x)
    expected = sorted((k, x[1], len(g)) for k, g in by_key.items() for x in g if any(near(x, y) for y in g))
    assert 300 < len(expected) < len(rows) / 2 and {-5, -8} == {k for k, _, _ in expected if k < 0}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    try:
        assert sorted(map(tuple, shingle_groups.near_keys(spark.createDataFrame(rows, SCHEMA)).collect())) == expected
        assert shingle_groups.near_keys(spark.createDataFrame([], SCHEMA)).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def joined_rows(plan):
    """Rows that the joins of a finished plan made."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return joined_rows(plan.plan())
    below = sum(joined_rows(plan.children().apply(i)) for i in range(plan.children().size()))
    return below + (plan.metrics().apply("numOutputRows").value() if "Join" in name else 0)


def test_chance_makes_no_rows(spark, monkeypatch):
    """Four times as many unrelated texts give four times the rows of joins and tables, not sixteen; the near pair is found."""
    written = []
    write = shingle_groups.materialize

    def counted(df, name):
        done = write(df, name)
        written.append(done.count() + joined_rows(df._jdf.queryExecution().executedPlan()))
        return done

    monkeypatch.setattr(shingle_groups, "materialize", counted)
    made = []
    for many in (500, 2000):
        r = random.Random(many)
        rows = [(k, 100, *checked(r), [t << 24 | r.randrange(40_000) for t in range(24) for _ in range(4)]) for k in range(many)]
        rows.append((many, 100, *checked(r, rows[7][2:4], 30), rows[7][4][:1]))
        marked = spark.createDataFrame(rows, "node long, size long, lo long, hi long, keys array<int>")
        written.clear()
        found = shingle_groups.shared_keys(marked)
        got = found.collect()
        made.append(sum(written) + joined_rows(found._jdf.queryExecution().executedPlan()))
        assert {x["node"] for x in got} >= {7, many} and len(got) < many / 10
    assert made[1] < 5 * made[0]


@pytest.mark.parametrize("buckets", [1, 1 << 14])
def test_crowded_keys_give_all(spark, monkeypatch, buckets):
    """Whether a key's bucket is counted or not, keys of up to SMALL_KEY give their near rows and larger ones all."""
    monkeypatch.setattr(shingle_groups, "BUCKETS", buckets)
    r = random.Random(3)
    most = shingle_groups.SMALL_KEY
    rows = [(k, 100, *checked(r), [1 << 24 | k % 900, 2 << 24 | k // most, *([5] if k <= most else []), *([6] if k < most else []), *([7] if k % 4 == 0 else [])]) for k in range(2000)]
    rows.append((2000, 100, *checked(r, rows[30][2:4], 30), [1 << 24 | 30, 2 << 24]))
    marked = spark.createDataFrame(rows, "node long, size long, lo long, hi long, keys array<int>")
    by_key = {}
    for x in rows:
        for key in x[4]:
            by_key.setdefault(key, []).append((key, *x[:4]))
    expected = sorted((k, x[1], len(g)) for k, g in by_key.items() for x in g if len(g) > most or any(near(x, y) for y in g))
    assert {len(by_key[k]) for k in (5, 6, 7, 2 << 24)} == {most, most + 1, 500} and {(1 << 24 | 30, k, 4) for k in (30, 2000)} <= set(expected)
    assert sorted(map(tuple, shingle_groups.shared_keys(marked).collect())) == expected
