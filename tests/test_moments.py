from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwave.plans.moments import gram, keyed_sums


def philox(counter, key, rounds=10):
    """Philox 2x32 one number at a time."""
    left, right = counter
    for _ in range(rounds):
        product = 0xD256D193 * left
        left, right = (product >> 32) ^ key ^ right, product & 0xFFFFFFFF
        key = (key + 0x9E3779B9) & 0xFFFFFFFF
    return left, right


def multipliers(unit, seed, draws):
    digits = hashlib.md5(f"{seed}|{unit}".encode()).hexdigest()
    key, right = int(digits[:8], 16), int(digits[8:16], 16)
    bits = [b for block in range((draws + 1) // 2) for b in philox((block, right), key)][:draws]
    share = (5**0.5 + 1) / (2 * 5**0.5)
    return np.array([(1 - 5**0.5) / 2 if b / 2**32 < share else (1 + 5**0.5) / 2 for b in bits])


def test_generator_against_published_vectors():
    assert philox((0, 0), 0) == (0xFF1DAE59, 0x6CD10DF2)
    assert philox((0xFFFFFFFF, 0xFFFFFFFF), 0xFFFFFFFF) == (0x2C3F628B, 0xAB4FD7AD)
    assert philox((0x243F6A88, 0x85A308D3), 0x13198A2E) == (0xDD7CE038, 0xF62A4C12)


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 11 == 0 else i % 3, "ab"[i % 2], [float(v) for v in rng.normal(size=4)], float(rng.random())) for i in range(500)]
    return rows, spark.createDataFrame(rows, "unit long, g int, h string, v array<double>, w double").repartition(7)


def test_gram_by_groups_and_weights(units):
    rows, df = units
    got = {}
    for r in gram(df, "v", ("g", "h"), F.col("w")).collect():
        got[r.g, r.h, r.i, r.j] = r.m
    for g, h in {(r[1], r[2]) for r in rows}:
        z = np.array([r[3] for r in rows if (r[1], r[2]) == (g, h)])
        w = np.array([r[4] for r in rows if (r[1], r[2]) == (g, h)])
        want = (z * w[:, None]).T @ z
        assert np.allclose([[got[g, h, i, j] for j in range(4)] for i in range(4)], want, rtol=1e-12)
    plain = {(r.i, r.j): r.m for r in gram(df, "v").collect()}
    z = np.array([r[3] for r in rows])
    assert np.allclose([[plain[i, j] for j in range(4)] for i in range(4)], z.T @ z, rtol=1e-12)


def test_products_of_missing_vectors_and_empty_tables(spark, units):
    _, df = units
    holes = df.withColumn("v", F.when(F.col("unit") % 2 == 0, F.col("v")))
    even = {(r.i, r.j): r.m for r in gram(df.filter("unit % 2 = 0"), "v").collect()}
    assert {(r.i, r.j): pytest.approx(r.m, rel=1e-12) for r in gram(holes, "v").collect()} == even
    none = df.limit(0)
    assert gram(none, "v", ("h",)).collect() == [] and keyed_sums(none, "v", 4, 10, 1).collect() == []


def test_no_row_is_multiplied(units):
    _, df = units
    for out in (gram(df, "v", ("g",)), keyed_sums(df, "v", 4, 100, 1, ("g",))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("MapInArrow") :]
        assert "Generate" not in below


@pytest.mark.parametrize("draws", [1, 2, 7, 200])
def test_multiplier_sums(units, draws):
    rows, df = units
    want = {}
    for unit, g, _, v, _ in rows:
        want[g] = want.get(g, 0) + np.outer(multipliers(unit, 9, draws), v)
    for shape in (df, df.repartition(2, "h")):  # the sums belong to the units, not to the partitions
        got = {(r.g, r.draw, r.idx): r.q for r in keyed_sums(shape, "v", 4, draws, 9, ("g",)).collect()}
        assert len(got) == 4 * draws * 4
        for g, total in want.items():
            mine = [[got[g, d, k] for k in range(4)] for d in range(1, draws + 1)]
            assert np.allclose(mine, total, rtol=1e-9, atol=1e-9)


def test_multipliers_have_mean_zero_and_variance_one():
    drawn = np.concatenate([multipliers(u, 5, 500) for u in range(200)])
    assert abs(drawn.mean()) < 0.01 and abs(drawn.var() - 1) < 0.01
