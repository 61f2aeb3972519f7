import random

import pytest
from pyspark.sql import functions as F

from askloom.operators import ordered as O
from askloom.staging import discard, stage


@pytest.fixture(scope="module")
def rows(spark):
    """A key with a third of all rows, null keys, ties in the value, nulls."""
    rng = random.Random(2)
    data = [(rng.choice([1, 1, 1, 1, None, *range(2, 12)]), i, rng.choice([None, *range(-5, 40)])) for i in range(5000)]
    return data, spark.createDataFrame(data, "k int, at long, v long").repartition(13)


def test_running_aggregates(spark, rows, monkeypatch):
    data, table = rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = O.running(table, ["k"], ["at"], {"s": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v")), "n": ("sum", F.lit(1))})
        parts = O.ranged(table, ["k", "at"], "seen")
        assert parts.where("k = 1").select(O.PART).distinct().count() > 1  # the frequent key is spread
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state, want = {}, []
    for k, at, v in sorted(data, key=lambda r: r[1]):
        s, lo, hi, n = state.get(k, (None, None, None, 0))
        if v is not None:
            s, lo, hi = (s or 0) + v, v if lo is None else min(lo, v), v if hi is None else max(hi, v)
        state[k] = s, lo, hi, n + 1
        want.append((k, at, v, *state[k]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["k", "at", "v", "s", "least", "most", "n"]


def test_percentiles(rows):
    data, table = rows
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    table = table.withColumn("w", F.col("at") * 1.5)
    got = {(r.k, r.measure): r for r in O.percentiles(table, ["k"], ["v", "w"], qs).collect()}
    for k in {r[0] for r in data}:
        for measure, xs in (("v", sorted(float(v) for a, _, v in data if a == k and v is not None)), ("w", sorted(at * 1.5 for a, at, _ in data if a == k))):
            r = got[k, measure]
            want = []
            for q in qs:
                at = (len(xs) - 1) * q
                lo = int(at)
                want.append(xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (at - lo))
            assert r.n == len(xs) and r.mean == pytest.approx(sum(xs) / len(xs)) and list(r.points) == pytest.approx(want)
    assert O.percentiles(table.where("false"), [], ["v"], qs).count() == 0
    one = O.percentiles(table.where("at = 3"), [], ["w"], [0.5], places=1).first()
    assert (one.measure, one.n, one["mean"], list(one.points)) == ("w", 1, 4.5, [4.5])


@pytest.mark.parametrize("spread", [1, 7, 10**15])
def test_nth(spark, monkeypatch, spread):
    monkeypatch.setattr(O, "FEW", 20)
    monkeypatch.setattr(O, "FAN", 8)
    rng = random.Random(spread)
    xs = [rng.randrange(-spread, spread) for _ in range(700)] + [5] * 300
    table = stage(spark.createDataFrame([(x,) for x in [*xs, None]], "x long"), "numbers")
    xs.sort()
    for n in (1, 2, 350, 699, 1000):
        assert O.nth(table, "x", n) == xs[n - 1]
    assert O.nth(table, "x", 1001) is None and O.nth(table, "x", 0) is None and O.nth(table.where("false"), "x", 1) is None
    discard(table)


def test_upto(spark):
    data = [(s, line, (s * 7 + line) % 3 == 0) for s in range(5) for line in range(40)]
    table = spark.createDataFrame(data, "shard int, line long, fine boolean").repartition(7)
    for n in (0, 1, 20, 66, 67, 10_000):
        seen, want = 0, []
        for r in data:
            if seen >= n:
                break
            want.append(r)
            seen += r[2]
        assert sorted(map(tuple, O.upto(table, ("shard", "line"), F.col("fine"), n).collect())) == want
