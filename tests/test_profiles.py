"""Auctions of a day and features of profiles over windows against plain versions."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import compare, profile


def day_of(ticks, close):
    """Of one day's (minute, half, price, shares) in order: the four parts, and amounts and numbers by size outside of auctions."""
    am = [h == "01" if h in ("01", "02") else m < 720 for m, h, _, _ in ticks]
    first = {side: next((t for t, a in zip(ticks, am, strict=True) if a == side), None) for side in (True, False)}
    parts, amounts, counts = dict.fromkeys(compare.SESSION_PARTS, 0.0), [0.0] * 3, [0] * 3
    for (m, _, p, s), a in zip(ticks, am, strict=True):
        opens = first[a][0] == m and first[a][2] == p
        late = m >= (690 if a else close)
        part = "opening" if opens and a == any(am) else "morning" if a else "closing" if late else "afternoon"
        parts[part] += s
        if not opens and not late:
            size = 0 if p * s < 200 else 2 if p * s >= 800 else 1
            amounts[size] += p * s
            counts[size] += 1
    return parts, amounts, counts


def test_auction_sessions(spark):
    rng, rows, want = np.random.default_rng(0), [], {}
    for k in range(3):
        for d in range(5):
            n = int(rng.integers(1, 40))
            minutes = sorted(rng.integers(540 if (k + d) % 4 else 740, 940, n).tolist())
            ticks = [(m, [None, "01", "02"][0 if m % 7 else 1 + (m >= 720)], float(rng.integers(1, 4)), float(rng.integers(1, 300))) for m in minutes]
            rows += [(k, datetime(2024, 11, 3 + d) + timedelta(minutes=m), i, h, p, s) for i, (m, h, p, s) in enumerate(ticks)]
            want[k, date(2024, 11, 3 + d)] = day_of(ticks, 925 if d >= 2 else 900)
    rows += [(9, datetime(2024, 11, 3, 10), 0, None, 1.0, 2.5), (9, datetime(2024, 11, 4, 10), 0, None, None, 2.0), (None, datetime(2024, 11, 3), 0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, o int, half string, p double, s double")
    got = {(r.k, r.day): r for r in profile.auction_sessions(df, "k", "ts", "p", "s", "o", "half", edges=(200.0, 800.0)).collect()}
    assert len(got) == 17 and all(got[9, date(2024, 11, d)].status == "invalid" and got[9, date(2024, 11, d)].opening is None for d in (3, 4))
    for at, (parts, amounts, counts) in want.items():
        r = got[at]
        assert r.status == "ok" and {c: r[c] for c in parts} == parts
        assert [r.small_amount, r.medium_amount, r.large_amount] == amounts and [r.n_small, r.n_medium, r.n_large] == counts


def area_of(bins, part):
    """The ends of the value area of {bin: shares}: to the side that holds more, below first."""
    top = min(b for b, s in bins.items() if s == max(bins.values()))
    low = high = top
    held, total = bins[top], sum(bins.values())
    while held < part * total:
        below, above = (bins.get(b, 0.0) if inside else -1.0 for b, inside in ((low - 1, low > min(bins)), (high + 1, high < max(bins))))
        if below < 0 and above < 0:
            break
        low, high, held = (low - 1, high, held + below) if below >= above else (low, high + 1, held + above)
    return top, low, high


def test_profile_features(spark):
    rng = np.random.default_rng(1)
    days = [date(2024, 1, 1) + timedelta(i) for i in range(9)]
    trades = [(1, d, float(p), float(s)) for d in days for p, s in zip(rng.integers(900, 1100, 25), rng.integers(1, 9, 25), strict=True)]
    close = {d: next(p for _, e, p, _ in reversed(trades) if e == d) for d in days}
    parts = {d: [float(x) for x in rng.integers(0, 50, 4)] for d in days}
    bars = spark.createDataFrame([(1, d, close[d]) for d in days], "code int, day date, c double")
    sessions = spark.createDataFrame([(1, d, "invalid" if d == days[4] else "ok", *parts[d]) for d in days], "code int, day date, status string, opening double, morning double, afternoon double, closing double")
    df = spark.createDataFrame(trades, "code int, day date, p double, s double")
    got = {r.day: r for r in compare.profile_features(df, sessions, bars, "code", "day", "p", "s", (1, 3), 20.0).collect()}
    assert len(got) == 9 and len(got[days[0]]) == 2 + 2 * 11
    for i, d in enumerate(days):
        for n in (1, 3):
            held = days[max(0, i - n + 1) : i + 1]
            if i + 1 < n or days[4] in held:
                assert all(got[d][f"{m}_{n}d"] is None for m in ("poc_gap", "value_low_gap", "opening_share"))
                continue
            own, c = [(p, s) for _, e, p, s in trades if e in held], close[d]
            bins, total = {}, sum(s for _, s in own)
            for p, s in own:
                bins[p // 20] = bins.get(p // 20, 0.0) + s
            top, low, high = area_of(bins, 0.7)
            mid = lambda b: (b + 0.5) * 20
            want = {"poc_gap": mid(top) / c - 1, "vwap_gap": sum(p * s for p, s in own) / total / c - 1, "value_low_gap": low * 20 / c - 1, "value_high_gap": (high + 1) * 20 / c - 1, "poc_share": bins[top] / total, "above_close_share": sum(s for b, s in bins.items() if mid(b) > c) / total, "near_close_share": sum(s for b, s in bins.items() if c * 0.98 <= mid(b) <= c * 1.02) / total}
            whole = sum(sum(parts[e]) for e in held)
            want |= {f"{name}_share": sum(parts[e][j] for e in held) / whole for j, name in enumerate(compare.SESSION_PARTS)}
            assert all(np.isclose(got[d][f"{m}_{n}d"], x) for m, x in want.items()), (d, n)


def test_profile_distance(spark):
    a = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (2, 0, 1.0), (3, 0, 0.0)], "k int, b int, s double")
    b = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 0, 5.0), (3, 0, 1.0)], "k int, b int, s double")
    assert {r.k: r.distance for r in profile.profile_distance(a, b, ["k"], "b", "s").collect()} == {1: 0.5, 2: 0.0}
    assert profile.profile_distance(a, b.where(F.lit(False)), ["k"], "b", "s").count() == 0


def test_profile_windows_in_small_batches(spark):
    """Keys and sessions that go on in the next batch, trades without a bar, bars without trades and prices that are unknown; and nothing is shuffled but trades and bars, once."""
    rng = np.random.default_rng(5)
    days = [date(2024, 1, 1) + timedelta(i) for i in range(12)]
    trades = [(int(k), days[int(d)], None if p < 905 else float(p), float(s)) for k, d, p, s in zip(rng.integers(0, 4, 150), rng.integers(0, 11, 150), rng.integers(900, 1000, 150), rng.integers(1, 9, 150), strict=True) if d != 5]
    bars = [(k, d, float(rng.integers(900, 1000))) for k in range(4) for d in days if (k + d.day) % 6]
    df, marks = spark.createDataFrame(trades, "code int, day date, p double, s double"), spark.createDataFrame(bars, "code int, day date, c double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = compare.profile_windows(df, marks, "code", "day", "p", "s", (1, 4), 20.0)
        assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0 and out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
        got = {(r.code, r.day, r.span): r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    n_found = 0
    for k in range(4):
        own = sorted((d, c) for key, d, c in bars if key == k)
        for i, (d, c) in enumerate(own):
            for n in (1, 4):
                held = [(p, s) for key, e, p, s in trades if key == k and i + 1 >= n and e in [x for x, _ in own[i + 1 - n : i + 1]]]
                assert ((k, d, n) in got) == bool(held)
                if held:
                    r, total, bins = got[k, d, n], sum(s for _, s in held), {}
                    for p, s in held:
                        bins[None if p is None else p // 20] = bins.get(None if p is None else p // 20, 0.0) + s
                    top = max(bins, key=lambda b: (bins[b], -1e9 if b is None else -b))
                    known, mid, n_found = {b: s for b, s in bins.items() if b is not None}, lambda b: (b + 0.5) * 20, n_found + 1
                    assert r.shares == total and r.poc == (None if top is None else mid(top))
                    assert np.isclose(r.above, sum(s for b, s in known.items() if mid(b) > c) / total * 100) and np.isclose(r.near, sum(s for b, s in known.items() if c * 0.98 <= mid(b) <= c * 1.02) / total * 100)
                    assert (r.vwap is None) == (not known) and (r.vwap is None or np.isclose(r.vwap, sum(p * s for p, s in held if p is not None) / total))
    assert n_found > 50


def test_profile_features_join_sessions_only(spark):
    """A key's bars meet their sessions in one join; neither features nor windows are joined or grouped again."""
    bars, df = spark.createDataFrame([], "code int, day date, c double"), spark.createDataFrame([], "code int, day date, p double, s double")
    sessions = spark.createDataFrame([], "code int, day date, status string, opening double, morning double, afternoon double, closing double")
    plan = compare.profile_features(df, sessions, bars, "code", "day", "p", "s", (1, 5), 20.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 1 and "Aggregate" not in plan and "MapInArrow" in plan
