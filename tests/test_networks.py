"""Similar past cases and recurrence networks against plain versions."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.operators import cases, recurrence, similar, solvers

DAY = date(2020, 1, 1)


def test_nearest_before(spark, monkeypatch):
    """Only cases that were complete before the day, ties by id, nulls left out, queries in several blocks."""
    monkeypatch.setattr(cases, "BLOCK_BYTES", 200)
    rng = np.random.default_rng(0)
    pool = [(i, DAY + timedelta(int(rng.integers(0, 40))), [float(x) for x in rng.integers(0, 4, 3)]) for i in range(120)]
    queries = [(i, DAY + timedelta(int(rng.integers(-2, 45))), [float(x) for x in rng.integers(0, 4, 3)]) for i in range(25)]
    a = spark.createDataFrame([*pool, (900, None, [0.0] * 3), (901, DAY, None)], "id long, done date, v array<double>")
    b = spark.createDataFrame([*queries, (902, DAY, None)], "id long, day date, v array<double>")
    got = {}
    for r in cases.nearest_before(a, b, "id", "done", "day", "v", 7).collect():
        got.setdefault(r.query_id, {})[r.place] = (r.distance, r.id)
    for i, day, v in queries:
        want = sorted((sum(abs(x - y) for x, y in zip(v, w, strict=True)), j) for j, done, w in pool if done < day)[:7]
        assert [got.get(i, {})[p] for p in range(1, len(want) + 1)] == want and len(got.get(i, {})) == len(want)


def test_statuses_and_scales(spark):
    rng = np.random.default_rng(1)
    vec = lambda: sorted(rng.normal(size=4).tolist())
    rows = [(i, DAY + timedelta(i), DAY + timedelta(i + 5) if i < 50 else None, vec(), vec() if i != 20 else None, float(rng.normal() * 10), bool(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, day date, done date, shape array<double>, flow array<double>, y double, hit boolean")
    days = spark.createDataFrame([(DAY + timedelta(i),) for i in (2, 20, 30, 55, 70)], "day date")
    got = {r.day: r for r in cases.similar_cases(df, df, days, "id", "day", "done", "shape", "flow", "y", "hit", k=5, least=20, pairs=10).collect()}
    status = {(d - DAY).days: (r.status, r.n_pool, r.id) for d, r in got.items()}
    assert status == {2: ("pool_small", 0, None), 20: ("no_candidates", 15, None), 30: ("ok", 24, 30), 55: ("ok", 49, 55), 70: ("no_candidates", 49, None)}
    r = got[DAY + timedelta(55)]
    mean = lambda a, b: float(np.mean(np.abs(np.array(a) - np.array(b))))
    q = rows[55]
    near = sorted((mean(q[3], p[3]) + mean(q[4], p[4]), i) for i, p in enumerate(rows[:50]) if i != 20)[:5]  # no pair before the first day: both scales are 1
    y = [rows[i][5] for _, i in near]
    assert r.n == 5 and np.allclose([r.p10, r.p25, r.p50, r.p75, r.p90], np.quantile(y, [0.1, 0.25, 0.5, 0.75, 0.9])) and np.isclose(r.hit_share, 100 * np.mean([rows[i][6] for _, i in near]))
    assert np.isclose(r.shape_distance + r.flow_distance, np.mean([d for d, _ in near]))


def nearest_rows(x, k, apart):
    out = set()
    for i in range(len(x)):
        d = sorted((int(((x[i] - x[j]) ** 2).sum()), j) for j in range(len(x)) if abs(i - j) > apart)[:k]
        out |= {(i, j, far, place) for place, (far, j) in enumerate(d, 1)}
    return out


@pytest.mark.parametrize("tile", [7, 1024])
def test_networks(spark, monkeypatch, tile):
    monkeypatch.setattr(recurrence, "TILE", tile)
    rng = np.random.default_rng(2)
    x = {"a": rng.integers(-3, 4, (60, 3)), "b": rng.integers(-300, 300, (25, 3)), "c": rng.integers(0, 2, (4, 3))}
    y = {e: [None if i > len(v) - 6 else float(rng.normal() * 12) for i in range(len(v))] for e, v in x.items()}
    rows = [(e, 10 + 3 * i, s.tolist(), y[e][i]) for e, v in x.items() for i, s in enumerate(v)] + [("a", 11, None, 1.0)]
    df = recurrence.numbered(spark.createDataFrame(rows, "e string, t int, s array<long>, y double"), "e", "t", "s")
    edges = recurrence.neighbours(df, "e", "t", "s", 4, 5)
    got = {}
    for r in edges.collect():
        got.setdefault(r.e, set()).add((r.i, r.j, r.d2, r.place))
    want = {e: nearest_rows(v, 4, 5) for e, v in x.items()}
    assert got == {e: w for e, w in want.items() if w}
    for r in recurrence.network_summary(df, edges, "e", [1, 4], 5, "y", 10.0).collect():
        own = [w for w in want[r.e] if w[3] <= r.k]
        n, links = len(x[r.e]), {frozenset(w[:2]) for w in own}
        degree = [sum(i in link for link in links) for i in range(n)]
        kth = {i: max(w[2] for w in own if w[0] == i) for i in {w[0] for w in own}}
        mine = sorted(w[1] for w in own if w[0] == n - 1)
        known = [y[r.e][j] for j in mine if y[r.e][j] is not None]
        assert (r.n, r.edges, r.isolated, r.degree_median) == (n, len(links), degree.count(0), float(np.median(degree)))
        assert r.kth2 == kth.get(n - 1) and (r.kth2 is None or np.isclose(r.kth_share, 100 * np.mean([(v < r.kth2) + (v == r.kth2) / 2 for v in kth.values()])))
        assert (r.degree or 0, r.periods or 0) == (len(mine), sum(a == mine[0] or a - b > 5 for a, b in zip(mine, [mine[0], *mine[:-1]], strict=True)) if mine else 0)
        assert (r.near_hit is None) == (not known) and (not known or np.isclose(r.near_hit, np.mean([v >= 10 for v in known])) and np.isclose(r.near_median, np.median(known)))


def test_whitening_by_sums(spark):
    """Means, shrinkage and turned states from sums are those from whole matrices."""
    rng = np.random.default_rng(5)
    x = {"a": rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)) + 7, "b": rng.normal(size=(6, 4))}
    rows = [(e, i, v.tolist()) for e, m in x.items() for i, v in enumerate(m)]
    df = spark.createDataFrame([*rows, ("a", 99, None)], "e string, i int, v array<double>")
    got = {(r.e, r.i): r.state for r in recurrence.states(df, "e", "v").collect()}
    assert got["a", 99] is None and len(got) == 87
    for e, m in x.items():
        values, vectors = np.linalg.eigh(solvers.shrunk_covariance(m))
        want = (m - m.mean(0)) @ (vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T)
        assert all(np.allclose(got[e, i], want[i] * 1000, atol=0.51) for i in range(len(m)))


def test_unchanged_entities_are_carried_over(spark):
    rows = [("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 5.0), ("c", 1, None)]
    first = recurrence.digests(spark.createDataFrame(rows, "e string, t int, x double"), "e", ["t", "x"])
    stored = first.withColumn("result", F.lit("old"))
    again = recurrence.digests(spark.createDataFrame([*reversed(rows[:2]), ("b", 1, 5.5), ("d", 1, 0.0)], "e string, t int, x double"), "e", ["t", "x"])
    new, kept = recurrence.to_build(again, stored, "e")
    assert {r.e for r in new.collect()} == {"b", "d"} and [(r.e, r.result) for r in kept.collect()] == [("a", "old")]


def test_nearest_before_in_tiles(monkeypatch):
    """Pairs are compared by tiles, however many queries a block has: not one row of the pool at a time."""
    rng = np.random.default_rng(4)
    q, x, gates, done = rng.normal(size=(900, 24)), rng.normal(size=(1300, 24)), np.sort(rng.integers(0, 50, 900)), rng.integers(0, 50, 1300)
    calls, rough = [], similar._rough
    monkeypatch.setattr(similar, "_rough", lambda *a: calls.append(1) or rough(*a))
    sent = type("Sent", (), {"value": (np.arange(900), gates, q)})
    [found] = list(cases._best_before(sent, 7)(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(1300)), pa.array(done), pa.array(list(x))], names=["id", "done", "v"])])))
    assert 0 < len(calls) <= -(-900 // similar.QUERIES) * -(-1300 // similar.ROWS)
    far = np.abs(q[:, None, :] - x[None, :, :]).sum(-1)
    far[gates[:, None] <= done[None, :]] = np.inf
    want = {(i, int(j)) for i in range(900) for j in np.argsort(far[i])[:7] if np.isfinite(far[i, j])}
    assert set(zip(found["query_id"].to_pylist(), found["id"].to_pylist(), strict=True)) == want
