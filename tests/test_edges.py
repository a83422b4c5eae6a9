"""Medians of the best over all in each draw against the tables written out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import edges, judge


def median(values, weights):
    order = np.argsort(values, kind="stable")
    v, w = np.asarray(values)[order], np.asarray(weights)[order]
    v, w = v[w > 0], w[w > 0]
    upto, half = np.cumsum(w), w.sum() / 2
    low = v[np.flatnonzero(upto >= half - 1e-9)[0]]
    high = v[min(np.flatnonzero(upto > half + 1e-9)[:1].tolist() or [len(v) - 1])]
    return (low + high) / 2


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("cells", [8, 1024])
def test_edges(spark, monkeypatch, ties, cells):
    monkeypatch.setattr(edges, "CELLS", cells)
    rng = np.random.default_rng(3)
    day, score, x = rng.integers(0, 30, 400), rng.normal(size=400), rng.normal(size=400) * 10.0 ** rng.integers(-2, 3, 400)
    if ties:
        score, x = rng.integers(0, 6, 400).astype(float), rng.integers(0, 9, 400).astype(float)
    df = spark.createDataFrame([(int(d), float(s), float(v)) for d, s, v in zip(day, score, x, strict=True)] + [(None, 1.0, 1.0), (1, None, 2.0), (1, 2.0, float("nan"))], "d int, s double, x double")
    hashes = {r.d: r.h for r in df.where("d IS NOT NULL").select("d", F.xxhash64("d").alias("h")).distinct().collect()}
    w = judge._weights(np.array([hashes[d] for d in day], np.int64).view(np.uint64), 12, 5)
    got = {r.draw: r for r in edges.edge_draws(df, "d", "s", "x", 7.0, 12, 40, 5).collect()}
    for b in range(12):
        n = int(w[:, b].sum())
        top = max(1, int(n * 7.0 / 100))
        weight, left = np.zeros(400), float(top)
        for s in sorted(set(score), reverse=True):
            at = score == s
            here = w[at, b].sum()
            weight[at] = w[at, b] * (min(1.0, left / here) if here else 0)
            left = max(0.0, left - here)
        best, every = median(x, weight), median(x, w[:, b])
        assert got[b].n == n and np.isclose(got[b].top_median, best) and np.isclose(got[b].all_median, every) and np.isclose(got[b].diff, best - every)
    if not ties:
        order = np.argsort(score, kind="stable")
        assert np.isclose(got[0].diff, np.median(x[order[-28:]]) - np.median(x))
    few = edges.edge_draws(df, "d", "s", "x", 7.0, 3, 1000).collect()
    assert all(r["diff"] is None for r in few) and edges.edge_draws(df.where("false"), "d", "s", "x", 5.0, 2).count() == 2
