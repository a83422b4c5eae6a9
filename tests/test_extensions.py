"""Operators without a SQL twin, file sources, and edges that the tables of the queries don't have."""

from __future__ import annotations

import datetime
import gzip
import io
import math
import zipfile
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tidewell.operators import asof, compare, conditions, judge, positions, scoring, similar, valuation
from tidewell.plans import judgements
from tidewell.sources import files, sinks


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def precision(score, label, weight):
    """Weighted average precision, tied scores together."""
    area = n = p = 0.0
    for s in sorted(set(score.tolist()), reverse=True):
        at = score == s
        gain = (weight * label)[at].sum()
        n, p = n + weight[at].sum(), p + gain
        area += gain * p / n if n else 0
    return area / p


def test_bootstrap_is_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), float(rng.integers(0, 40)), int(rng.random() < 0.3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, s double, y int")
    keys = np.array([r.k for r in df.select(F.xxhash64("id").alias("k"), "id").orderBy("id").collect()], np.int64).view(np.uint64)
    weights = judge._weights(keys, 5, 3)
    assert (weights[:, 0] == 1).all() and abs(weights[:, 1:].mean() - 1) < 0.1
    score, label = (np.array([r[i] for r in rows]) for i in (1, 2))
    for ranges in (64, 3, 1):
        got = {r.draw: r.average_precision for r in judge.bootstrap_precision(df, "s", "y", "id", 5, 3, ranges).collect()}
        assert len(got) == 5 and all(np.isclose(got[d], precision(score, label, weights[:, d])) for d in got)
    assert judge.bootstrap_precision(df.where("false"), "s", "y", "id", 5).count() == 0


def test_paired_difference_sees_the_better_score(spark):
    r = judgements.paired(spark, DATA).first()
    assert r.n == 99 and r.low > 0 and r.share_positive == 1.0


def test_calibration_rises(spark):
    rows = sorted(judgements.calibration(spark, DATA).collect())
    assert all(a.high <= b.low + 1e-9 for a, b in zip(rows[:-1], rows[1:], strict=True)) and sum(r.n for r in rows) == 1500


def test_next_scheduled_is_brute_force(spark):
    rng = np.random.default_rng(2)
    entries = [(int(k), day(int(p)), day(int(p + d))) for k, p, d in zip(rng.integers(0, 3, 120), rng.integers(0, 900, 120), rng.integers(-5, 400, 120), strict=True)]
    rows = [(i, int(rng.integers(0, 4)), day(int(rng.integers(0, 1300)))) for i in range(200)] + [(900, None, day(3)), (901, 1, None)]
    left = spark.createDataFrame(rows, "id int, k int, t date")
    got = {r.id: r.next_due for r in asof.next_scheduled(left, spark.createDataFrame(entries, "k int, published date, due date"), "k", "t", "published", "due", ["id", "k", "t"]).collect()}
    want = {i: min((d for e, p, d in entries if e == k and t is not None and p <= t <= d), default=None) for i, k, t in rows}
    assert got == want


def test_nearest_with_ties_and_nulls(spark):
    rows = [(i, [float(i // 3), 0.0]) for i in range(30)] + [(30, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    got = sorted((r.query_id, r.place, r.id) for r in similar.nearest(df, df.where("id IN (0, 30)"), "id", "v", 4).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)]
    assert similar.nearest(df, df.where("false"), "id", "v", 4).count() == 0
    w = sorted((r.place, r.id, r.distance) for r in similar.nearest(df, df.where("id = 3"), "id", "v", 2, "wasserstein").collect())
    assert w == [(1, 4, 0.0), (2, 5, 0.0)]


def test_text_rules(spark):
    df = spark.createDataFrame([(" halted ",), ("",), (None,), ("halted, then limited",), ("unheard of",)], "t string")
    level = conditions.keyword_level(F.col("t"), [("halted", 3), ("limited", 1)])
    assert [r[0] for r in df.select(level).collect()] == [3.0, 0.0, 0.0, 3.0, None]
    assert [r[0] for r in df.select(conditions.first_class(F.col("t"), [("a", "hal"), ("b", "un")])).collect()] == ["a", "(empty)", "(empty)", "a", "b"]
    assert conditions.column_kinds(["ret_5", "n_up", "x"], [("^ret_", "clip"), ("^n_", "log")]) == {"ret_5": "clip", "n_up": "log", "x": "plain"}


def test_scores_by_hand(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(scoring.technical_score(F.lit(x))) for x in (40.0, 80.0, 90.0, 97.0, 98.0)] == [3.0, 6.0, 8.0, 9.3125, 10.0]
    assert [value(scoring.credit_score(F.lit(x))) for x in (-1.0, 0.5, 3.0, 10.0, 15.0, 30.0)] == [None, 10.0, 7.0, 2.0, 1.0, 0.0]
    assert value(scoring.progress_score(F.lit(0.984 * 30), F.lit(1), F.lit(30.0), F.lit("seasonal"))) == pytest.approx(5.0)
    assert value(scoring.progress_score(F.lit(0.853 * 25), F.lit(1), F.lit(None).cast("double"), F.lit("linear"))) == pytest.approx(5.0)
    assert value(scoring.progress_score(F.lit(99.0), F.lit(4), F.lit(30.0), F.lit("seasonal"))) is None
    points = F.array(*(F.lit(float(i // 2)) for i in range(101)))
    assert [value(scoring.on_grid(F.lit(x), points)) for x in (-1.0, 0.0, 0.5, 50.0, 60.0)] == [0.0, 0.5, 1.5, 100.0, 100.0]
    assert value(judge.sign_test(F.lit(8), F.lit(2))) == pytest.approx(0.109375) and value(judge.sign_test(F.lit(0), F.lit(0))) is None


def test_sign_test_of_many(spark):
    counts = [(8, 2), (2, 8), (5, 5), (1, 0), (7, 6), (864, 842), (842, 864), (1500, 1500), (900, 0), (52_000, 51_300), (None, 3), (0, 0)]
    got = [r[0] for r in spark.createDataFrame(counts, "w long, l long").coalesce(1).select(judge.sign_test(F.col("w"), F.col("l"))).collect()]
    for (w, l), p in zip(counts[:9], got, strict=False):
        assert p == pytest.approx(min(1.0, float(Fraction(2 * sum(math.comb(w + l, i) for i in range(max(w, l), w + l + 1)), 2 ** (w + l)))), rel=1e-11)
    assert got[5] == got[6] and got[9] == pytest.approx(math.erfc(699 / math.sqrt(2 * 103_300)), rel=1e-3) and got[10:] == [None, None]


def test_peer_prices(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(g), float(m), 100.0 + i) for i, (g, m) in enumerate(zip(rng.integers(0, 4, 90), rng.integers(-2, 12, 90), strict=True))]
    out = valuation.peer_prices(spark.createDataFrame(rows, "id int, g int, m double, price double").withColumn("g", F.when(F.col("g") > 0, F.col("g"))), ["g"], "id", "m", "price", 5)
    assert "join" not in out._jdf.queryExecution().optimizedPlan().toString().lower()  # nothing that may be broadcast
    got = {r.id: r for r in out.collect()}
    assert sorted(got) == [i for i, _, m, _ in rows if m > 0]
    for i, r in got.items():
        peers = np.array([m for j, g, m, _ in rows if j != i and g == rows[i][1] and m > 0])
        assert r.peers == len(peers) and np.allclose([r.low, r.p10, r.p50, r.p90, r.high, r["mean"], r.deviation], np.array([*np.quantile(peers, [0, 0.1, 0.5, 0.9, 1]), peers.mean(), peers.std()]) * r.price / r.m)


@pytest.mark.parametrize("kind", ["squared", "wasserstein"])
def test_nearest_among_copies_in_tiles(spark, monkeypatch, kind):
    """Ties go by id however many copies there are, and no task holds distances of more pairs than a tile's, however many queries a block has."""
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (700, 4)).astype(float)
    x[rng.permutation(700)[:300]] = [1.0, 0.0, -1.0, 1.0]
    x[5], x[9] = [1e25, 0.0, 0.0, 1.0], [np.nan, 0.0, 0.0, 0.0]
    order = rng.permutation(700)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in order], "id long, v array<double>").coalesce(2)
    scan = similar._best_of(type("Sent", (), {"value": (np.arange(700), x)}), 4, kind, 2)
    shapes, rough = [], similar._rough
    monkeypatch.setattr(similar, "_rough", lambda *a: shapes.append((out := rough(*a))[0].shape) or out)
    [found] = list(scan(iter([pa.RecordBatch.from_arrays([pa.array(order), pa.array(list(x[order]))], names=["id", "v"])])))
    assert max(a * b for a, b in shapes) <= similar.QUERIES * similar.ROWS < 700 * 700
    spread = {(r.query_id, r.place): (r.id, r.distance) for r in similar.nearest(df, df, "id", "v", 4, kind, 2).collect()}
    y = x if kind == "squared" else np.sort(x, 1)
    for i in range(700):
        far = ((y - y[i]) ** 2).sum(1) if kind == "squared" else np.abs(y - y[i]).mean(1)
        far[np.abs(np.arange(700) - i) <= 2] = np.inf
        want = [j for j in np.lexsort((np.arange(700), far)) if np.isfinite(far[j])][:4]
        assert [spread[i, p][0] for p in range(1, 5) if (i, p) in spread] == want
    assert sorted(zip(*(found[n].to_pylist() for n in ("query_id", "id", "distance")), strict=True)) == sorted((q, *v) for (q, _), v in spread.items())


def test_flow_stops_at_a_loss(spark):
    steps = [("operating", F.lit(30.0)), ("ordinary", F.lit(None).cast("double")), ("net", F.lit(-5.0)), ("never", F.lit(1.0))]
    got = spark.range(1).select(valuation.flow(F.lit(100.0), steps)).first()[0]
    assert [tuple(r) for r in got] == [("operating", 30.0, 70.0, None, False), ("net", -5.0, 30.0, None, True)]
    assert spark.range(1).select(valuation.flow(F.lit(0.0), steps)).first()[0] is None


def test_sells_close_the_newest_buy(spark):
    log = [("a", day(0), "buy", 1, 10.0), ("a", day(1), "buy", 2, 11.0), ("a", day(2), "sell", 3, 12.0), ("a", day(3), "sell", 4, 13.0), ("a", day(4), "sell", 5, 14.0), ("b", day(0), "sell", 6, 1.0), ("b", None, "buy", 7, 1.0)]
    got = sorted(map(tuple, positions.matched_positions(spark.createDataFrame(log, "k string, t date, kind string, entry int, price double"), "k", "t", "kind", "entry", "price").collect()))
    assert got == [("a", 1, day(0), 10.0, day(3), 13.0), ("a", 2, day(1), 11.0, day(2), 12.0)]


def test_mahalanobis(spark):
    x = np.random.default_rng(3).standard_normal((200, 3)) @ np.array([[1, 0.5, 0], [0, 2, 0], [0, 0, 0.1]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(200, None, 1.0, 1.0)], "i int, a double, b double, c double")
    got = {r.i: r.distance for r in judge.unusual(df, ["a", "b", "c"]).collect()}
    d = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x.T)), d))
    assert got[200] is None and np.allclose([got[i] for i in range(200)], want)


def test_quantile_vector(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([5.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(compare.quantile_vector(F.col("v"), 2)).collect()] == [[1.5, 2.5], [5.0, 5.0], None]


SCHEMA = StructType([StructField("code", StringType()), StructField("n", LongType()), StructField("x", DoubleType())])


def test_titled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Some report\nas of 2020\ncode,n,x\n1301,5,2.5\n1302,-,\n")
    got = [tuple(r) for r in files.titled_csv(spark, f"file://{tmp_path}/a.csv", SCHEMA, "^[0-9]{4},").collect()]
    assert got == [("1301", 5, 2.5), ("1302", None, None)]


def test_zipped_csv_and_gzip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("facts_1.csv", "code,n,x\n1301,5,2.5\n1302,bad,\n")
        z.writestr("facts_2.csv", "n,code\n7,1303\n")
        z.writestr("readme.txt", "code,n,x\n1,1,1\n")
    (tmp_path / "b.zip").write_bytes(b"not an archive")
    (tmp_path / "c.zip").write_bytes((tmp_path / "a.zip").read_bytes().replace(b"1301,5,2.5", b"1301,5,2.6"))
    read = files.zipped_csv(spark, f"file://{tmp_path}/*.zip", SCHEMA, "facts_*.csv").collect()
    assert sorted((r.file[-5:], r.member, r.problem) for r in read if r.problem) == [("b.zip", None, "broken archive"), ("c.zip", "facts_1.csv", "BadZipFile")]
    got = sorted((r.member, r.code, r.n, r.x) for r in read if r.problem is None and r.file.endswith("a.zip"))
    assert got == [("facts_1.csv", "1301", 5, 2.5), ("facts_1.csv", "1302", None, None), ("facts_2.csv", "1303", 7, None)]
    whole = io.BytesIO()
    with gzip.GzipFile(fileobj=whole, mode="wb") as f:
        f.write(b"x" * 100_000)
    (tmp_path / "c.gz").write_bytes(whole.getvalue())
    (tmp_path / "d.gz").write_bytes(whole.getvalue()[:-20])
    got = {r.file.rsplit("/", 1)[1]: (r.ok, r.size) for r in files.gzip_check(spark, f"file://{tmp_path}/*.gz").collect()}
    assert got == {"c.gz": (True, 100_000), "d.gz": (False, None)}


def test_pruned_reads(spark, tmp_path):
    df = spark.createDataFrame([(k, datetime.datetime(2020, 1, d), d) for k in (1, 2) for d in range(1, 8)], "k int, t timestamp, x int")
    sinks.write_days(df, f"file://{tmp_path}/d", "t", ["k"])
    out = files.read_days(spark, f"file://{tmp_path}/d", "2020-01-03", "2020-01-04", "k", [2], ["date", "x"])
    assert sorted(map(tuple, out.collect())) == [(datetime.date(2020, 1, 3), 3), (datetime.date(2020, 1, 4), 4)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [In(k, [2])]" in plan or "EqualTo(k,2)" in plan
