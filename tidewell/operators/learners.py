"""Small learners whose passes are aggregates: cells by k-means, and chances by a logit fitted outside of each row's own fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _written(x: float) -> Column:
    return F.lit(float(x))


def nearest_centre(columns: list[str], centres: list[list[float]]) -> Column:
    """The number of the centre nearest to the columns, ties to the lower; null where one is."""
    far = [sum((F.pow(F.col(c).cast("double") - _written(x), 2) for c, x in zip(columns, centre, strict=True)), F.lit(0.0)) for centre in centres]
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    every = F.array(*far)
    return F.when(known, F.array_position(every, F.array_min(every)) - 1)


def kmeans(df: DataFrame, columns: list[str], key: str, k: int, rounds: int = 20, seed: int = 0) -> list[list[float]]:
    """The centres of k cells, in the order of their start: the k rows with the smallest hash of seed and key.

    A round is one aggregate: rows find their centre where they are read and are summed by it, so that k rows are shuffled for each task. A centre
    without rows stays. It ends after ``rounds`` or when no centre moves. Rows with a null column don't count; fewer rows give fewer cells.
    """
    rows = df.select(F.col(key).alias("_k"), *(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    start = rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_k").cast("string"))), *columns).limit(k).collect()
    centres = [[r[c] for c in columns] for r in start]
    for _ in range(rounds if centres else 0):
        means = {r.cell: [r[f"_m{i}"] for i in range(len(columns))] for r in rows.groupBy(nearest_centre(columns, centres).alias("cell")).agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns))).collect()}
        moved = [means.get(i, centre) for i, centre in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return centres


def _terms(columns: list[str], centre: dict[str, float], scale: dict[str, float]) -> list[Column]:
    """The constant and the columns on their deviation; an unknown value is the mean."""
    return [F.lit(1.0), *(F.coalesce((F.col(c).cast("double") - _written(centre[c])) / _written(scale[c]), F.lit(0.0)) for c in columns)]


def logit_by_fold(df: DataFrame, fold: str, columns: list[str], label: str, ridge: float = 1.0, rounds: int = 10) -> dict[object, tuple[list[float], dict[str, float], dict[str, float]]]:
    """For each fold the weights of a logistic regression on the rows of all others (constant first), and the columns' means and deviations.

    Newton's steps with a ridge on the columns. A step is one aggregate for all folds: each row adds to the gradient and the curvature of
    every fold but its own, where it is read; what is shuffled is a row for each task. Rows without a label or fold don't count. A fold
    whose others hold one label only has none.
    """
    known = df.where(F.col(label).isNotNull() & F.col(fold).isNotNull())
    shape = known.agg(*(f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    centre = {c: shape[f"m_{c}"] or 0.0 for c in columns}
    scale = {c: shape[f"s_{c}"] or 1.0 for c in columns}
    y, x = F.col(label).cast("double"), _terms(columns, centre, scale)
    totals = {r[0]: (r.n, r.p) for r in known.groupBy(fold).agg(F.count("*").alias("n"), F.sum(y).alias("p")).collect()}
    n, p = (sum(t[i] for t in totals.values()) for i in (0, 1))
    folds = sorted((f for f, (a, b) in totals.items() if 0 < p - b < n - a), key=str)
    weights, size = {f: np.zeros(len(x)) for f in folds}, len(x)
    for _ in range(rounds if folds else 0):
        sums = []
        for i, f in enumerate(folds):
            z = sum((xi * _written(w) for xi, w in zip(x, weights[f], strict=True)), F.lit(0.0))
            chance = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
            out = F.col(fold) != F.lit(f)
            sums += [F.sum(F.when(out, (y - chance) * x[a])).alias(f"g{i}_{a}") for a in range(size)]
            sums += [F.sum(F.when(out, chance * (1 - chance) * x[a] * x[b])).alias(f"h{i}_{a}_{b}") for a in range(size) for b in range(a, size)]
        row, largest = known.agg(*sums).first(), 0.0
        for i, f in enumerate(folds):
            penalty = np.diag([1e-9] + [ridge] * (size - 1))
            gradient = np.array([row[f"g{i}_{a}"] for a in range(size)]) - penalty @ weights[f]
            curve = np.array([[row[f"h{i}_{min(a, b)}_{max(a, b)}"] for b in range(size)] for a in range(size)]) + penalty
            step = np.linalg.solve(curve, gradient)
            weights[f] += step
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-10:
            break
    return {f: (w.tolist(), centre, scale) for f, w in weights.items()}


def out_of_fold_chances(df: DataFrame, fold: str, columns: list[str], label: str, name: str = "oof", ridge: float = 1.0, rounds: int = 10) -> DataFrame:
    """df with the chance of the label by the logit that its fold was left out of; null where there is none."""
    chance = F.lit(None).cast("double")
    for f, (w, centre, scale) in logit_by_fold(df, fold, columns, label, ridge, rounds).items():
        z = sum((x * _written(v) for x, v in zip(_terms(columns, centre, scale), w, strict=True)), F.lit(0.0))
        chance = F.when(F.col(fold) == F.lit(f), 1 / (1 + F.exp(-z))).otherwise(chance)
    return df.withColumn(name, chance)
