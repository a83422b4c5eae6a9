"""Edge cases and brute-force versions of the operators that SQL parity doesn't reach."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalar
from tidewell.operators import asof, facts, rank, scans, similar
from tidewell.sources.tables import table_or_empty


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_scalar_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 2.0), (None, 1.0), (0.0, 0.0)], "a double, b double")
    rows = df.select(scalar.safe_ratio(F.col("a"), F.col("b")), scalar.symmetric_change(F.col("a"), F.col("b")), scalar.clip_to_null(F.col("a"), -0.5, 2.0), scalar.band(F.col("b"), [0.0, 1.0, 2.0])).collect()
    assert [tuple(r) for r in rows] == [(None, 100.0, 1.0, 1), (-0.5, -100.0, None, 3), (None, None, None, 2), (None, None, 0.0, 1)]


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([("a", day(5)), ("a", day(8)), ("b", day(5)), (None, day(5))], "k string, t date")
    right = spark.createDataFrame([("a", day(5), 1), ("a", day(5), 2), ("a", day(2), 7), ("b", day(6), 9)], "k string, u date, x int")
    got = {(r.k, r.t): r.x for r in asof.asof_join(left, right, ["k"], "t", "u", ["x"]).collect()}
    assert got == {("a", day(5)): 2, ("a", day(8)): 2, ("b", day(5)): None, (None, day(5)): None}
    strict = {(r.k, r.t): r.x for r in asof.asof_join(left, right, ["k"], "t", "u", ["x"], strict=True).collect()}
    assert strict[("a", day(5))] == 7 and strict[("a", day(8))] == 2
    near = {(r.k, r.t): r.x for r in asof.asof_join(left, right, ["k"], "t", "u", ["x"], tolerance_days=2).collect()}
    assert near[("a", day(8))] is None and near[("a", day(5))] == 2


def test_asof_ignores_later_rows(spark):
    left = spark.createDataFrame([("a", day(i)) for i in range(10)], "k string, t date")
    right = spark.createDataFrame([("a", day(i), i) for i in range(0, 10, 3)], "k string, u date, x int")
    whole = {r.t: r.x for r in asof.asof_join(left, right, ["k"], "t", "u", ["x"]).collect()}
    cut = {r.t: r.x for r in asof.asof_join(left, right.where(F.col("u") <= F.lit(day(4))), ["k"], "t", "u", ["x"]).collect()}
    assert all(whole[day(i)] == cut[day(i)] for i in range(5))


def test_upsert_refuses_a_clash(spark):
    old = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(ValueError, match="different rows"):
        facts.keyed_upsert(old, spark.createDataFrame([(1, "y"), (1, "z")], "k int, v string"), ["k"])
    assert [tuple(r) for r in facts.keyed_upsert(old, spark.createDataFrame([(1, "y"), (1, "y")], "k int, v string"), ["k"]).collect()] == [(1, "y")]


def test_rank_rules(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 3.0), ("g", None), ("h", 5.0)], "g string, x double")
    rows = sorted((r.g, r.x is None, r.x or 0, r.r, r.s, r.p) for r in df.select("g", "x", rank.average_rank(["g"], "x").alias("r"), rank.rank_share(["g"], "x").alias("s"), rank.rank_position(["g"], "x").alias("p")).collect())
    assert rows == [("g", False, 1.0, 1.5, 0.5, 0.25), ("g", False, 1.0, 1.5, 0.5, 0.25), ("g", False, 3.0, 3.0, 1.0, 1.0), ("g", True, 0, None, None, None), ("h", False, 5.0, 1.0, None, 0.5)]


def test_ema_by_hand():
    x = np.array([np.nan, 4.0, 8.0, 2.0])
    assert np.allclose(scans.span(x, 3), [np.nan, 4, 6, 4], equal_nan=True)
    assert np.allclose(scans.wilder(x, 4), [np.nan, 4, 5, 4.25], equal_nan=True)


def test_rsi_by_hand():
    """The averages start with the first change, not with one of 0 before it."""
    c = np.array([10.0, 12, 11, 11, 14])
    up, down = [2, 1, 0.5, 1.75], [0, 0.5, 0.25, 0.125]
    assert np.allclose(scans.rsi(c, 2), [np.nan, np.nan, *(100 * u / (u + d) for u, d in zip(up[1:], down[1:], strict=True))], equal_nan=True)
    assert scans.rsi(np.full(5, 3.0), 2).tolist()[2:] == [50, 50, 50]


def test_supertrend_and_fisher_by_hand():
    h, low, c, atr = (np.array(x, float) for x in ([11, 12, 13, 9, 9], [9, 10, 11, 7, 7], [11, 11, 12, 7, 8], [np.nan, 1, 1, 1, 1]))
    # from the row with a range on: up, floor 8; floor 9; the close 7 leaves that floor, so the ceiling 11 of that row; it stays
    assert np.allclose(scans.supertrend(h, low, c, atr), [np.nan, 8, 9, 11, 11], equal_nan=True)
    y = scans.fisher(np.array([1.0, 2, 3, 3]), 2)
    x = [0.33, 0.33 + 0.67 * 0.33, 0.67 * (0.33 + 0.67 * 0.33)]
    f = [np.arctanh(x[0]), np.arctanh(x[1]) + 0.5 * np.arctanh(x[0])]
    assert np.allclose(y, [np.nan, *f, np.arctanh(x[2]) + 0.5 * f[1]], equal_nan=True)
    top = scans.fisher(np.arange(40.0), 2)
    assert np.isclose(top[-1], 2 * np.arctanh(0.999), rtol=1e-3)


def test_rank_correlation():
    x = np.random.default_rng(1).integers(0, 5, 60).astype(float)
    want = pd.Series(x).rolling(9).apply(lambda w: pd.Series(w).rank().corr(pd.Series(range(9))) if len(set(w)) > 1 else 0.0, raw=True)
    assert np.allclose(scans.rank_correlation(x, 9)[8:], 100 * want[8:])


def test_scan_has_no_look_ahead():
    rng = np.random.default_rng(2)
    c = 100 + np.cumsum(rng.standard_normal(200))
    bars = [c, c + rng.random(200), c - rng.random(200), c, rng.integers(1, 9, 200).astype(float)]
    for name, build in scans.GROUPS.items():
        whole, cut, one = (build(scans.Key(*(x[:n] for x in bars))) for n in (200, 150, 1))
        assert tuple(whole) and set(whole) == set(scans.COLUMNS[name]) == set(one)
        assert all(np.allclose(whole[c][:150], cut[c], equal_nan=True) for c in whole)


def test_nearest_is_brute_force(spark):
    v = np.random.default_rng(3).standard_normal((60, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    got = {(r.query_id, r.place): r.id for r in similar.nearest(df, df.where("id % 20 = 0"), "id", "vec", 3, apart=2).collect()}
    for q in (0, 20, 40):
        d = ((v - v[q]) ** 2).sum(1)
        d[[i for i in range(60) if abs(i - q) <= 2]] = np.inf
        assert [got[q, p] for p in (1, 2, 3)] == list(np.argsort(d, kind="stable")[:3])


def test_missing_table_is_empty(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    assert table_or_empty(spark, f"file://{tmp_path}/none*", schema).count() == 0
    spark.range(2).selectExpr("id AS a").write.parquet(f"file://{tmp_path}/t_1")
    assert sorted(map(tuple, table_or_empty(spark, f"file://{tmp_path}/t_*", schema).collect())) == [(0, None), (1, None)]


def test_storage_by_day_and_year(spark, tmp_path):
    from tidewell.sources import sinks

    days = spark.createDataFrame([(day(0), "b", 1), (day(0), "a", 2), (day(1), "a", 3)], "t date, k string, x int")
    sinks.write_days(days, f"file://{tmp_path}/days", "t", ["k"])
    sinks.write_days(spark.createDataFrame([(day(1), "c", 9)], "t date, k string, x int"), f"file://{tmp_path}/days", "t", ["k"], parts=2)
    assert sorted((r.t, r.k, r.x) for r in spark.read.parquet(f"file://{tmp_path}/days").collect()) == [(day(0), "a", 2), (day(0), "b", 1), (day(1), "c", 9)]
    first = spark.createDataFrame([("a", day(0), 1), ("b", day(400), 1)], "k string, t date, v int")
    for _ in range(2):  # a repeated write changes nothing
        sinks.upsert_years(first, f"file://{tmp_path}/years", ["k"], "t", ["v"])
    sinks.upsert_years(spark.createDataFrame([("a", day(3), 2), ("c", day(5), 1)], "k string, t date, v int"), f"file://{tmp_path}/years", ["k"], "t", ["v"])
    assert sorted((r.k, r.t, r.v) for r in spark.read.parquet(f"file://{tmp_path}/years").collect()) == [("a", day(3), 2), ("b", day(400), 1), ("c", day(5), 1)]
    published = spark.createDataFrame([(day(0), 1), (day(9), 1)], "t date, v int")
    fresh = spark.createDataFrame([(day(0), 5), (day(10), 5)], "t date, v int")
    assert sorted(map(tuple, sinks.frozen(published, fresh, "t").collect())) == [(day(0), 1), (day(9), 1), (day(10), 5)]
    assert sorted(map(tuple, sinks.first_snapshot(published, fresh, "t", 5).collect())) == [(day(9), 1), (day(10), 5)]
    listing = spark.createDataFrame([("f", 1, 1), ("g", 2, 1), ("h", 3, 1)], "name string, size int, time int")
    assert [r.name for r in sinks.changed_entries(listing, spark.createDataFrame([("f", 1, 1), ("g", 2, 2)], "name string, size int, time int"), "name", ["size", "time"]).orderBy("name").collect()] == ["g", "h"]
