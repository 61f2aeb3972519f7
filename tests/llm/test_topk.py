import numpy as np
import pytest
from pyspark.sql import functions as F

from askloom.llm import exact_topk as K


def brute(rows, k, every):
    valid = {(i, tuple(np.floor(64 * np.array(v, float)).astype(int).tolist())) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q, a in valid:
        if q % every == 0:
            score = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in valid if i != q)
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(score[:k], 1)}
    return out


@pytest.mark.parametrize(("blocks", "cells"), [(8192, 256), (30, 256), (30, 3)])
def test_matches_brute_force(spark, monkeypatch, blocks, cells):
    monkeypatch.setattr(K, "BLOCK", blocks)
    monkeypatch.setattr(K, "fitted", lambda sample, fit=K.fitted: fit(sample, cells))
    monkeypatch.setattr(K, "QUERIES", 4)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6).astype(np.float32)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # one vector many times
    rows += [(5, rows[5][1]), (400, None), (401, [None, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, [1.0, -1.0]), (405, []), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    got = K.top_k(df, F.col("id") % 10 == 0, k=8)
    assert {(r.query_id, r.rank, r.id, r.score) for r in got.collect()} == brute(rows, 8, 10)


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, -0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in K.top_k(one, F.col("id") == 0).collect()] == [(0, 1, 1, 64 * 32 - 32 * 32)]
    assert K.top_k(one, F.col("id") == 9).count() == 0
    assert K.top_k(spark.createDataFrame([], one.schema), F.col("id") == 0).count() == 0


@pytest.mark.parametrize("cells", [256, 4])
def test_bounds_hold(monkeypatch, cells):
    monkeypatch.setattr(K, "STEP", 6)
    rng = np.random.default_rng(2)
    m, q = rng.integers(-50, 50, (300, 5)), rng.integers(-50, 50, (20, 5))
    starts = K.fitted(rng.integers(-40, 40, (200, 4)), cells)  # a dimension less, and values beyond the sample's
    a = K.Approximation(*K.Approximation.of(m, starts), starts)
    lower, upper = a.bounds(q)
    exact = q @ m.T
    assert (lower <= exact).all() and (exact <= upper).all() and a.cells.max() < cells
    got = list(a.candidates(q, 7))
    assert [i for i, *_ in got] == list(range(20))
    for i, c, lo, up in got:
        assert set(np.flatnonzero(exact[i] >= np.sort(exact[i])[-7])) <= set(c.tolist())
    if cells == 256:
        assert sum(len(c) for _, c, _, _ in got) < 20 * 300


def test_few_exact_vectors_are_read(spark):
    """Only what the bounds leave is read exactly: of 2000 vectors the 21 best of each query and their ties."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 0.3, 16)]) for i in range(2000)], "vec_id long, embedding array<float>")
    rows = K.usable(df, "vec_id", "embedding")
    units = K.stage(rows.withColumn("uid", F.col("id")).withColumn("ids", F.array("id")), "t")
    asked = K.stage(rows.where("id % 20 = 0").select("v", F.col("id").alias("key")), "t")
    left = K.bounded(units, asked, 21)
    assert left.count() <= 100 * 21 * 1.3 and left.select("key").distinct().count() == 100


def test_wide_vectors_come_in_smaller_blocks(spark):
    """A thousand dimensions, and vectors of very different widths: blocks are bounded by components."""
    assert K.rows_of(8) == K.rows_of(K.WIDTH) == K.BLOCK and K.rows_of(8 * K.WIDTH) == K.BLOCK // 8 and K.rows_of(10**9) == 256
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 1024 if i % 3 else 1 + i % 7)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = {(r.query_id, r.rank, r.id, r.score) for r in K.top_k(df, F.col("id") % 100 == 0, k=3).collect()}
    padded = [(i, v + [0.0] * (1024 - len(v))) for i, v in rows]
    assert got == brute(padded, 3, 100)


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1e300, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit 64 bits"):
        K.top_k(df, F.col("id") == 0).collect()
    fine = spark.createDataFrame([(0, [2.0**23, 0.0]), (1, [2.0**24, 1.0]), (2, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.id, r.score) for r in sorted(K.top_k(fine, F.col("id") == 0).collect(), key=lambda r: r.rank)] == [(1, 2**59), (2, -(2**35))]
