"""Exact quantiles, counts over growing and shrinking histories, isotonic fits and purged folds against plain versions."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from datetime import date, timedelta

import numpy as np
import pytest

from tidewell.operators import quantiles, simulate, windows

POINTS = [0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]


def plain(values, points=POINTS):
    v = sorted(x for x in values if x is not None and math.isfinite(x))
    if not v:
        return None
    at = [(p * (len(v) - 1)) for p in points]
    return [v[int(k)] if k == int(k) else (math.ceil(k) - k) * v[math.floor(k)] + (k - math.floor(k)) * v[math.ceil(k)] for k in at]


@pytest.fixture(scope="module")
def table():
    rng, rows = np.random.default_rng(0), []
    for g, n in (("a", 700), ("b", 30), (None, 300), ("c", 1), ("d", 200)):
        for i in range(n):
            x = float(rng.integers(0, 4)) if g == "d" else float(rng.normal() * 10.0 ** rng.integers(-3, 6))
            y = None if i % 3 == 0 else 1e300 if i == 7 else -1e308 if i == 8 else float(rng.integers(0, 50))
            rows.append((g, float("nan") if i == 5 else x, y, int(rng.integers(0, 9)) if i % 50 else None))
    return rows


@pytest.mark.parametrize(("cells", "few"), [(256, 60), (1024, 10**6)])
def test_percentiles(spark, table, cells, few):
    df = spark.createDataFrame(table, "g string, x double, y double, f int")
    got = {r.g: (r.x, r.y) for r in quantiles.percentiles(df, ["g"], ["x", "y"], POINTS, cells, few).collect()}
    assert got == {g: (plain(r[1] for r in table if r[0] == g), plain(r[2] for r in table if r[0] == g)) for g in {r[0] for r in table}}
    one = quantiles.percentiles(df, [], ["x", "y"], POINTS, cells, few).first()
    assert (one.x, one.y) == (plain(r[1] for r in table), plain(r[2] for r in table))
    earlier = {r.f: (r.n, r.x) for r in quantiles.percentiles_of_earlier(df, "f", "x", 0.3, cells, few).collect()}
    past = {f: [r[1] for r in table if r[3] is not None and r[3] < f and math.isfinite(r[1])] for f in range(9)}
    assert earlier == {f: (len(v), (plain(v, [0.3]) or [None])[0]) for f, v in past.items()}


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double, f int")
    assert quantiles.percentiles(df, [], ["x"], [0.5]).collect()[0].x is None
    assert quantiles.percentiles(df, ["g"], ["x"], [0.5]).count() == 0
    assert quantiles.percentiles_of_earlier(df, "f", "x", 0.5).count() == 0


def test_versions_are_taken_off(spark):
    """Reissues, withdrawals, moves between buckets, several rows of a day, ties, NaN and nulls."""
    rng, rows = np.random.default_rng(4), []
    for i in range(400):
        x = [None, float("nan"), None][int(rng.integers(0, 3))] if rng.random() < 0.1 else float(rng.integers(0, 12))
        rows.append((i, "ab"[int(rng.integers(0, 2))], int(rng.integers(0, 60)), int(rng.integers(0, 50)), x))
    rows.sort(key=lambda r: (r[3], r[0]))
    want, current, known = {}, {}, {"a": [], "b": []}
    for day in sorted({r[3] for r in rows}):
        today = [r for r in rows if r[3] == day]
        for i, b, _, _, x in today:
            v = sorted(known[b])
            want[i] = (bisect_left(v, x) + bisect_right(v, x)) / (2 * len(v)) if x is not None and x == x and len(v) >= 5 else None
        for _, b, k, _, x in today:
            if k in current:
                known[current[k][0]].remove(current.pop(k)[1])
            if x is not None and x == x:
                current[k] = (b, x)
                known[b].append(x)
    df = spark.createDataFrame(rows, "id int, b string, k int, t int, x double")
    got = windows.versioned_percentile(df, "b", ["k"], "t", "x", "id", 5)
    assert got.columns == [*df.columns, "pct"]
    got = {r.id: r.pct for r in got.collect()}
    assert got.keys() == want.keys() and all((got[i] is None) == (x is None) and (x is None or abs(got[i] - x) < 1e-12) for i, x in want.items())


def isotonic(pairs):
    pools = []
    for x in sorted({x for x, _ in pairs}):
        y = [b for a, b in pairs if a == x]
        pools.append([x, x, sum(y), len(y)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, high, s, n = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + s, pools[-1][3] + n]
    return pools


@pytest.mark.parametrize("ties", [True, False])
def test_isotonic_is_pooling(spark, ties):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 60, 900) / 60 if ties else rng.random(900)
    pairs = [(float(a), int(rng.random() < a)) for a in x]
    df = spark.createDataFrame([*pairs, (None, 1), (0.5, None), (float("nan"), 1)], "s double, y int")
    got = [tuple(r) for r in simulate.isotonic_pools(df.repartition(5), "s", "y").orderBy("low").collect()]
    want = [(a, b, n, s / n) for a, b, s, n in isotonic(pairs)]
    assert got == want
    at = sorted(set(np.quantile([a for a, _ in pairs], np.linspace(0, 1, 51)).tolist()))
    ends = [(a, v) for low, high, _, v in want for a in sorted({low, high})]
    curve = simulate.isotonic(df, "s", "y")
    assert np.allclose([a for a, _ in curve], at) and np.allclose([b for _, b in curve], np.interp(at, *zip(*ends, strict=True)))
    assert simulate.isotonic(df.where("false"), "s", "y") == []


def test_purged_folds(spark):
    start = date(2020, 1, 1)
    days = [start + timedelta(i) for i in range(0, 700, 2)]
    df = spark.createDataFrame([(i, days[i * 7 % len(days)]) for i in range(500)] + [(900, start + timedelta(1))], "id int, day date")
    rows = simulate.purged_folds(df, "day", spark.createDataFrame([(d,) for d in days], "day date"), 4, 3).collect()
    fold = {r.day: r.fold for r in rows}
    held = {d for d in fold if d in set(days)}
    for r in rows:
        if r.day not in held:
            assert r.left_out is None
            continue
        at = days.index(r.day)
        near = {fold[d] for d in days[max(0, at - 3) : at + 4] if d in held}
        assert r.left_out == sorted(near) and r.fold in near


def test_wide_correlations(spark):
    """500 columns at once with gaps, a constant, a large mean, infinities, and columns never known together."""
    from tidewell.operators import describe

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 120)) @ rng.normal(size=(120, 120)) * 0.1 + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5], x[7, 6] = 3.25, np.inf
    x[:150, 8], x[150:, 9] = np.nan, np.nan
    names = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{n} double" for n in names))
    got = {(r.a, r.b): r.r for r in describe.correlations(df, names, known=20).collect()}
    want = {}
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            if both.sum() >= 20 and 5 not in (i, j):
                want[names[i], names[j]] = np.corrcoef(x[both, i], x[both, j])[0, 1]
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items()) and ("c8", "c9") not in got
    top = describe.correlations(df, names, known=20, top=10).collect()
    assert [(r.a, r.b) for r in top] == sorted(want, key=lambda k: -abs(want[k]))[:10]
