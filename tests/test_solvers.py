"""Solvers hold the identities that define their results."""

from __future__ import annotations

import numpy as np
from conftest import DATA

from tidewell.operators import simulate, solvers
from tidewell.plans import solved


def test_tilt_reaches_the_mean():
    rng = np.random.default_rng(0)
    for _ in range(20):
        w, x = rng.random(20) * (rng.random(20) > 0.2), np.sort(rng.random(20) * 1000)
        mean = x[w > 0].min() * 0.3 + x[w > 0].max() * 0.7
        t = solvers.tilt(w, x, mean)
        assert np.isclose(t.sum(), 1) and np.isclose(t @ x, mean, rtol=1e-6)
    assert solvers.tilt(np.ones(3), np.arange(3.0), 5.0) is None


def test_shrunk_covariance_whitens():
    x = np.random.default_rng(1).standard_normal((500, 4)) @ np.diag([1, 2, 3, 4])
    s = solvers.shrunk_covariance(x)
    assert np.allclose(s, s.T) and np.allclose(np.diag(s), [1, 4, 9, 16], rtol=0.25)


def test_implied_growth_discounts_to_the_price(spark):
    for r in solved.implied(spark, DATA).collect():
        if r.implied_growth is not None:
            t = np.arange(1, 6)
            grown = ((1 + r.implied_growth) / (1 + r.cost)) ** t
            assert np.isclose(r.base * (grown.sum() + grown[-1] / r.cost), r.price, rtol=1e-6)


def test_simulation_is_repeatable(spark):
    a, b = (sorted(map(tuple, solved.simulated(spark, DATA).collect())) for _ in range(2))
    assert a == b and all(r[4] is None or r[4] < r[5] < r[6] for r in a)


def test_isotonic_rises(spark):
    rng = np.random.default_rng(2)
    s = rng.random(2000)
    df = spark.createDataFrame([(float(x), int(rng.random() < x)) for x in s], "s double, y int")
    table = simulate.isotonic(df, "s", "y")
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(table[:-1], table[1:], strict=True)) and abs(table[len(table) // 2][1] - table[len(table) // 2][0]) < 0.15
