"""Frames of trailing rows against numpy, with values that must not spoil other frames, and bars that were not traded."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.frames import Frames, trend
from tidewell.operators import panel, scans

SPANS = (1, 2, 3, 7, 16, 20, 33)
PLAIN = {"sum": (F.sum, np.sum), "avg": (F.avg, np.mean), "max": (F.max, np.max), "min": (F.min, np.min), "var_pop": (F.var_pop, np.var), "stddev_pop": (F.stddev_pop, np.std), "stddev_samp": (F.stddev_samp, lambda v: v.std(ddof=1) if len(v) > 1 else None), "trend": (trend, lambda v: ((np.arange(len(v)) - (len(v) - 1) / 2) * v).mean())}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(0)
    x = {k: rng.normal(size=70).tolist() for k in range(3)}
    for i in (10, 11, 30):
        x[1][i] = None
    x[2][10], x[2][25], x[2][40] = float("nan"), 1e17, float("inf")
    return x


@pytest.mark.parametrize("name", PLAIN)
def test_rolls(spark, values, name):
    agg, plain = PLAIN[name]
    df = spark.createDataFrame([(k, i, x) for k, v in values.items() for i, x in enumerate(v)], "k int, i int, x double")
    wanted = {f"n{n}_{least}": (F.col("x"), n, agg, least) for n in SPANS for least in ((None, 1) if name != "trend" else (None,))}
    for r in Frames("k", order="i").roll(df, **wanted).collect():
        for out, (_, n, _, least) in wanted.items():
            frame = values[r.k][max(0, r.i - n + 1) : r.i + 1]
            known = np.array([x for x in frame if x is not None])
            if any(not abs(x) < 1e15 for x in known):
                assert r[out] is None or not math.isnan(r[out]) or name in ("max", "min")
                continue
            want = plain(known) if len(known) >= (least or n) else None
            assert (r[out] is None) == (want is None) and (want is None or abs(r[out] - want) < 1e-12 * max(1, abs(want))), (r.k, r.i, out)


def test_frames_do_not_subtract(spark):
    """A row of 1e17 leaves the sums of later frames as they are without it, to the last bit."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    with_it = x.copy()
    with_it[40] = 1e17
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, with_it, strict=True))], "i int, a double, b double").withColumn("k", F.lit(0))
    out = Frames("k", order="i").roll(df, a50=(F.col("a"), 50, F.sum), b50=(F.col("b"), 50, F.sum)).where("i >= 90").collect()
    assert len(out) == 210 and all(r.a50 == r.b50 for r in out)


def walk(rows=320, seed=3):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, rows)))
    o, span = c * np.exp(rng.normal(0, 0.01, rows)), np.abs(rng.normal(0, 0.01, rows))
    return [[float(x) for x in r] for r in zip(o, np.maximum(o, c) * (1 + span), np.minimum(o, c) * (1 - span), c, rng.integers(1, 1000, rows), rng.integers(1, 10**6, rows), strict=True)]


SCHEMA = "code int, day int, o double, h double, l double, c double, v double, va double"
BUILDERS = [panel.moving_averages, panel.channels, panel.momentum, panel.volatility, panel.volume, panel.candles, scans.recursive_indicators]


def values_of(df, days):
    new = [c for c in df.columns if c.startswith(("tx_", "vol_", "semi"))]
    rows = {r.day: [r[c] for c in new] for r in df.collect()}
    return [[None if x is None else round(x, 7) for x in rows[d]] for d in days], rows


@pytest.mark.parametrize("build", BUILDERS, ids=lambda b: b.__name__)
def test_untraded_rows_are_passed_over(spark, build):
    """Rows without a trade count for nothing and have no indicators; repaired prices are taken for what they are repaired to."""
    bars = walk()
    plain = spark.createDataFrame([(1, i, *b) for i, b in enumerate(bars)], SCHEMA)
    held, at = [], {}
    for i, b in enumerate(bars):
        at[i] = len(held)
        held.append(tuple(b))
        if i % 20 == 7:
            held += [(b[0], b[1], b[2], bad, 5.0, 5.0) for bad in (None, 0.0, float("nan"), float("inf"), -3.0)]
    odd = spark.createDataFrame([(1, i, *b) for i, b in enumerate(held)], SCHEMA)
    want, _ = values_of(build(plain), range(len(bars)))
    got, rows = values_of(build(odd), [at[i] for i in range(len(bars))])
    assert got == want
    assert len(rows) == len(held) and all(x is None for d, r in rows.items() if d not in at.values() for x in r)
    assert not any(isinstance(x, float) and math.isnan(x) for r in rows.values() for x in r)


def test_bars_are_repaired(spark):
    nan = float("nan")
    rows = [(1, 0, 0.0, None, nan, 10.0, None, 1.0), (1, 1, 12.0, 11.0, 11.5, 10.0, -1.0, 1.0), (1, 2, 9.0, 11.0, 8.0, 10.0, 3.0, 1.0), (1, 3, 9.0, 11.0, 8.0, nan, 3.0, 1.0)]
    got = {r.day: (r.traded, r.o, r.h, r.l, r.v) for r in panel.clean_bars(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == (True, 10.0, 10.0, 10.0, 0.0) and got[1] == (True, 12.0, 12.0, 10.0, 0.0) and got[2] == (True, 9.0, 11.0, 8.0, 3.0) and not got[3][0]
    assert panel.moving_averages(spark.createDataFrame(rows, SCHEMA)).columns[:8] == ["code", "day", "o", "h", "l", "c", "v", "va"]
