"""k-means and logits by aggregates against whole matrices, and AUC and average precision over ranges of scores."""

from __future__ import annotations

import hashlib

import numpy as np

from tidewell.operators import evaluate, learners


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (3, 3), (0, 4))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0)], "id int, a double, b double")
    order = sorted(range(len(x)), key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())
    centres = x[order[:4]]
    for _ in range(6):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[at == k].mean(0) if (at == k).any() else centres[k] for k in range(4)])
    got = learners.kmeans(df, ["a", "b"], "id", 4, 6)
    assert np.allclose(got, centres)
    cell = {r.id: r.cell for r in df.select("id", learners.nearest_centre(["a", "b"], got).alias("cell")).collect()}
    assert cell[900] is None and all(cell[i] == k for i, k in enumerate(((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)))
    assert learners.kmeans(df.where("false"), ["a", "b"], "id", 3) == [] and len(learners.kmeans(df.where("id < 2"), ["a", "b"], "id", 3)) == 2


def test_logit_out_of_fold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * [1, 20, 0.1] + [0, 5, 3]
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 5) / 15)))).astype(int)
    known = np.where(rng.random(x.shape) < 0.05, np.nan, x)
    rows = [(i, i % 4, *(None if np.isnan(v) else float(v) for v in known[i]), int(y[i])) for i in range(200)] + [(900, 1, 0.0, 5.0, 3.0, None)]
    df = spark.createDataFrame(rows, "id int, f int, a double, b double, c double, y int")
    got = {r.id: r.oof for r in learners.out_of_fold_chances(df, "f", ["a", "b", "c"], "y", ridge=0.5, rounds=25).collect()}
    z = np.nan_to_num((known - np.nanmean(known, 0)) / np.nanstd(known, 0))
    z = np.column_stack([np.ones(200), z])
    for f in range(4):
        out, w = np.arange(200) % 4 != f, np.zeros(4)
        penalty = np.diag([1e-9, 0.5, 0.5, 0.5])
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[out] @ w))
            w += np.linalg.solve((z[out] * (p * (1 - p))[:, None]).T @ z[out] + penalty, z[out].T @ (y[out] - p) - penalty @ w)
        assert all(abs(got[i] - 1 / (1 + np.exp(-z[i] @ w))) < 1e-6 for i in range(200) if i % 4 == f)
    assert got[900] is not None
    assert all(r.oof is None for r in learners.out_of_fold_chances(df.where("y = 1"), "f", ["a"], "y").collect())


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(s), int(rng.random() < s / 40)) for g, s in zip(rng.integers(0, 2, 600), rng.integers(0, 40, 600), strict=True)]
    df = spark.createDataFrame([*rows, (0, None, 1), (7, 1.0, 1)], "g int, s double, y int")

    def plain(rows):
        one, zero = [s for s, y in rows if y], [s for s, y in rows if not y]
        found, area, last = 0, 0.0, 0
        for s in sorted({s for s, _ in rows}, reverse=True):
            n, p = sum(a >= s for a, _ in rows), sum(a >= s and y for a, y in rows)
            area, last, found = area + (p - last) * p / n, p, p
        return np.mean([[(a > b) + (a == b) / 2 for b in zero] for a in one]), area / found

    whole = [(s, y) for _, s, y in rows] + [(1.0, 1)]
    assert np.isclose(evaluate.auc(df, [], "s", "y").first().auc, plain(whole)[0]) and np.isclose(evaluate.average_precision(df, [], "s", "y").first().average_precision, plain(whole)[1])
    auc = {r.g: r.auc for r in evaluate.auc(df, ["g"], "s", "y").collect()}
    for g in (0, 1):
        assert np.isclose(auc[g], plain([(s, y) for k, s, y in rows if k == g])[0])
    assert auc[7] is None
