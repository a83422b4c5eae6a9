"""Numeric solvers over one row or one small group, as vectorised Python: tilted distributions, implied growth, simulated values, whitened states."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewell.session import ship

#: Steps of a bisection, paths of a simulation.
STEPS, PATHS = 100, 1024


def tilt(weights: np.ndarray, x: np.ndarray, mean: float) -> np.ndarray | None:
    """weights * exp(t * x), scaled to sum 1, with the t at which the mean of x is ``mean``: the closest distribution with that mean.

    Null where the mean lies outside of what the weighted points reach.
    """
    some = weights > 0
    if not some.any() or not x[some].min() < mean < x[some].max():
        return weights / weights.sum() if some.any() and np.isclose(x[some], mean).all() else None
    scale = np.abs(x[some] - mean).max()
    z = (x - mean) / scale

    def at(t: float) -> np.ndarray:
        e = np.where(some, t * z, -np.inf)
        w = np.where(some, weights * np.exp(e - e.max()), 0.0)
        return w / w.sum()

    low, high = -1.0, 1.0
    while at(low) @ z > 0 and low > -1e6:
        low *= 2
    while at(high) @ z < 0 and high < 1e6:
        high *= 2
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle) @ z < 0 else (low, middle)
    return at((low + high) / 2)


def tilted_profile(bins: DataFrame, key: str, price: str, shares: str, mean: DataFrame, mean_col: str) -> DataFrame:
    """The shares by price of each key, tilted so that their mean price is the key's known one (null where it can't be)."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(price, kind="stable").reset_index(drop=True)
        w = tilt(rows[shares].to_numpy(np.float64), rows[price].to_numpy(np.float64), float(rows[mean_col].iloc[0]))
        return rows.assign(tilted=pd.Series([None] * len(rows) if w is None else w, dtype="float64"))

    ship(bins.sparkSession)
    both = bins.select(key, F.col(price).cast("double").alias(price), F.col(shares).cast("double").alias(shares)).join(mean.select(key, F.col(mean_col).cast("double").alias(mean_col)), key)
    return both.groupBy(key).applyInPandas(work, both.withColumn("tilted", F.lit(None).cast("double")).schema)


def implied_growth(df: DataFrame, price: str, base: str, cost: str, years: int = 5, name: str = "implied_growth") -> DataFrame:
    """df with the yearly growth of ``base`` over some years, and for ever none after, that discounts to the price; null beyond -50 % to 50 %.

    A polynomial in growth that rises with it, so its root is found by halving, for all rows of a batch at once.
    """

    @F.pandas_udf(DoubleType())
    def solve(p: pd.Series, b: pd.Series, k: pd.Series) -> pd.Series:
        p, b, k = (s.to_numpy(np.float64) for s in (p, b, k))
        t = np.arange(1, years + 1)

        def value(g: np.ndarray) -> np.ndarray:
            grown = (1 + g[:, None]) ** t / (1 + k[:, None]) ** t
            return b * (grown.sum(1) + grown[:, -1] / k)

        low, high = np.full(len(p), -0.5), np.full(len(p), 0.5)
        with np.errstate(all="ignore"):
            ok = (b > 0) & (k > 0) & (p >= value(low)) & (p <= value(high))
            for _ in range(STEPS):
                middle = (low + high) / 2
                less = value(middle) < p
                low, high = np.where(less, middle, low), np.where(less, high, middle)
        return pd.Series((low + high) / 2).where(ok)

    ship(df.sparkSession)
    return df.withColumn(name, solve(F.col(price).cast("double"), F.col(base).cast("double"), F.col(cost).cast("double")))


def simulated_value(df: DataFrame, key: str, base: str, cost: str, growth: float, spread: float, years: int = 5, paths: int = PATHS) -> DataFrame:
    """df with sim_low, sim_median and sim_high: 10, 50 and 90 % of discounted values over paths of random growth, seeded by the SHA-256 of the key."""

    @F.pandas_udf("low double, median double, high double")
    def simulate(k: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows, t = [], np.arange(1, years + 1)
        for name, base_value, rate in zip(k.astype(str), b, c, strict=True):
            if not (base_value == base_value and rate == rate and base_value > 0 and rate > 0):
                rows.append((None, None, None))
                continue
            rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")))
            level = base_value * np.cumprod(1 + growth + spread * rng.standard_normal((paths, years)), axis=1)
            value = (level / (1 + rate) ** t).sum(1) + level[:, -1] / rate / (1 + rate) ** years
            rows.append(tuple(np.quantile(value, [0.1, 0.5, 0.9])))
        return pd.DataFrame(rows, columns=["low", "median", "high"], dtype="float64")

    ship(df.sparkSession)
    out = df.withColumn("_s", simulate(F.col(key), F.col(base).cast("double"), F.col(cost).cast("double")))
    return out.select(*df.columns, *(F.col(f"_s.{c}").alias(f"sim_{c}") for c in ("low", "median", "high")))


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Ledoit and Wolf's covariance: the sample's, drawn to a multiple of the identity by the share that their 2004 paper derives."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    target = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / p / n**2, target)
    share = noise / target if target > 0 else 1.0
    return share * mu * np.eye(p) + (1 - share) * s


def whitened(df: DataFrame, group: str, id_col: str, vector: str) -> DataFrame:
    """group, id and state: each group's vectors, centred and turned so that their shrunk covariance is the identity, to three decimals."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id_col, kind="stable").reset_index(drop=True)
        x = np.stack(rows[vector].to_numpy()).astype(np.float64)
        values, vectors = np.linalg.eigh(shrunk_covariance(x))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
        return rows[[group, id_col]].assign(state=list(np.round((x - x.mean(0)) @ root, 3)))

    ship(df.sparkSession)
    schema = f"{group} {df.schema[group].dataType.simpleString()}, {id_col} {df.schema[id_col].dataType.simpleString()}, state array<double>"
    return df.select(group, id_col, vector).groupBy(group).applyInPandas(work, schema)
