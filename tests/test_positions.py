"""A log of trades in full, the next row after, and joins that must be one to one."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from tidewell.operators import asof, positions

D = date(2024, 1, 1)
LOG = "entry string, seq long, kind string, key string, pick date, day date, price double, shares double, percent double, ref string"


def at(n):
    return None if n is None else D + timedelta(n)


def entry(name, seq, kind, key="a", pick=None, day=None, price=1.0, shares=None, percent=None, ref=None):
    return (name, seq, kind, key, at(pick), at(day), price, shares, percent, ref)


def test_settled_log(spark):
    log = [
        entry("buy-00001", 1, "buy", pick=0, day=1, price=10.0, shares=300.0),
        entry("buy-00002", 2, "buy", day=5, price=11.0),
        entry("buy-00003", 3, "buy", pick=0, day=1, price=12.0),  # again
        entry("buy-00004", 4, "buy", pick=4, price=13.0, shares=-1.0),  # begins on its pick
        entry("buy-00005", 5, "buy"),  # neither pick nor day
        entry("buy-00006", 6, "buy", key=None, day=3),
        entry("sell-0001", 7, "sell", day=6, price=20.0),  # the newest: 00002
        entry("sell-0002", 8, "sell", pick=0, day=7, price=21.0),  # by its pick: 00001
        entry("sell-0003", 9, "sell", day=2, price=22.0),  # 00001 is closed, 00004 begins later
        entry("sell-0004", 10, "sell", key="b", day=9),
        entry("goal-0001", 11, "target", day=5, percent=8.0),  # the newest by then, closed or not: 00002
        entry("goal-0002", 12, "target", day=4, percent=9.0),  # 00004
        entry("goal-0003", 13, "target", day=4, percent=51.0),
        entry("goal-0004", 14, "target", day=0, percent=5.0),
        entry("void-0001", 15, "cancel", ref=" SELL-9999 "),
        entry("sell-9999", 16, "sell", day=9),
        entry("void-0002", 17, "cancel", ref="sell"),  # too short
        entry("odd", 18, "note"),
        entry("none", 19, None),
    ]
    got = {r.entry: r for r in positions.settled_log(spark.createDataFrame(log, LOG)).collect()}
    issues = {"buy-00003": "buy_repeated", "buy-00005": "buy_incomplete", "buy-00006": "buy_incomplete", "sell-0003": "sell_unmatched", "sell-0004": "sell_unmatched", "goal-0003": "target_incomplete", "goal-0004": "target_unmatched", "sell-9999": "cancelled", "void-0002": "short_ref", "odd": "unknown_kind", "none": "unknown_kind"}
    assert len(got) == len(log) and {e: r.issue for e, r in got.items() if r.issue} == issues
    held = {e: (r.pick, r.bought, r.price, r.shares, r.sold, r.sold_price, [(t.day, t.percent) for t in r.targets], r.entries) for e, r in got.items() if r.entries}
    assert held == {
        "buy-00001": (at(0), at(1), 10.0, 300.0, at(7), 21.0, [], ["buy-00001", "sell-0002"]),
        "buy-00002": (None, at(5), 11.0, 100.0, at(6), 20.0, [(at(5), 8.0)], ["buy-00002", "sell-0001", "goal-0001"]),
        "buy-00004": (at(4), None, 13.0, 100.0, None, None, [(at(4), 9.0)], ["buy-00004", "goal-0002"]),
    }
    assert positions.settled_log(spark.createDataFrame([], LOG)).count() == 0


def test_next_after(spark):
    rng = np.random.default_rng(0)
    right = [(int(k), at(int(d)), float(x)) for k, d, x in zip(rng.integers(0, 3, 60), rng.integers(0, 40, 60), rng.integers(0, 5, 60), strict=True)] + [(0, None, 9.0)]
    left = [(i, int(rng.integers(0, 4)), at(int(rng.integers(-3, 42)))) for i in range(80)] + [(99, 1, None)]
    got = {r.i: (r.next_t, r.next_x) for r in asof.next_after(spark.createDataFrame(left, "i int, k int, t date"), spark.createDataFrame(right, "k int, t date, x double"), ["k"], "t", "t", ["x"], 6).collect()}
    for i, k, t in left:
        later = min(((d, x) for a, d, x in right if a == k and d is not None and t is not None and d > t), default=(None, None))
        assert got[i] == (later if later[0] and (later[0] - t).days <= 6 else (None, None))


def test_one_to_one(spark):
    one = spark.createDataFrame([(1, 2), (2, 3), (None, 4), (None, 5)], "k int, a int")
    other = spark.createDataFrame([(1, 7), (3, 8)], "k int, b int")
    assert sorted((r.k or 0, r.a, r.b or 0) for r in asof.one_to_one(one, other, ["k"]).collect()) == [(0, 4, 0), (0, 5, 0), (1, 2, 7), (2, 3, 0)]
    for a, b, side in ((one.union(one.where("k = 1")), other, "left"), (one, other.union(other), "right")):
        with pytest.raises(Exception, match=f"not one to one: {side}"):
            asof.one_to_one(a, b, ["k"]).collect()
