"""Medians of resampled tables: what the best rows by score have over all, with whole days drawn at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.judge import _weights
from tidewell.session import shared_folder, ship

#: Cells that all open ranges are split into together, and weights that are multiplied at once.
CELLS, AT_ONCE = 1024, 1 << 21


class _Share:
    """What part of a row a draw takes, by its score: all over the draw's border, a share at it, nothing under it. Without borders all of each."""

    def __init__(self, borders: np.ndarray | None = None, shares: np.ndarray | None = None):
        self.borders, self.shares = borders, shares
        self.known = None if borders is None else np.unique(borders[np.isfinite(borders)])

    def classes(self, score: np.ndarray) -> np.ndarray:
        """Twice the number of borders under a score, and one more if it is a border."""
        return np.zeros(len(score), np.int64) if self.known is None else np.searchsorted(self.known, score, "left") + np.searchsorted(self.known, score, "right")

    def of(self, classes: np.ndarray) -> np.ndarray:
        if self.known is None:
            return np.ones((len(classes), 1))
        own = 2 * np.searchsorted(self.known, self.borders) + 1
        return np.where(classes[:, None] > own[None, :], 1.0, np.where(classes[:, None] == own[None, :], self.shares[None, :], 0.0)) * np.isfinite(self.borders)[None, :]


def weighted_at(rows: DataFrame, column: str, draws: int, seed: int, share: _Share, target: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of a list of targets (one or more for each draw, draw = position % draws) the smallest value whose rows up to it weigh ``target`` or more (``over``: more), what smaller values weigh, and what that value weighs.

    rows: day (a hash), score, x, finite. Ranges that a target falls into are split into cells, until each holds one value: a round is one pass in which
    tasks add up their rows by cell, day and class of score, and multiply by the draws' weights of days. What comes back is a row for each cell
    and draw with a weight. Targets that nothing reaches give NaN.
    """
    n = len(target)
    ends = rows.agg(F.min(column), F.max(column)).first()
    low, high, before = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n)
    weight = np.full(n, np.nan)
    if ends[0] is None:
        return low, before, weight
    low[:], high[:] = ends
    live, first = np.ones(n, bool), True
    while live.any() and (first or (low[live] < high[live]).any()):
        first = False
        opened = np.unique(np.stack([low[live], high[live]], 1), axis=0)
        lows, highs = opened[:, 0], opened[:, 1]
        parts = max(2, CELLS // len(lows))

        def add(batches: Iterator[pa.RecordBatch], lows: np.ndarray = lows, highs: np.ndarray = highs, parts: int = parts) -> Iterator[pa.RecordBatch]:
            least, most = np.full(len(lows) * parts, np.inf), np.full(len(lows) * parts, -np.inf)
            held: list[np.ndarray] = []
            counts: list[np.ndarray] = []
            for batch in batches:
                day, score, x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                at = np.searchsorted(lows, x, "right") - 1
                some = (at >= 0) & (x <= highs[np.maximum(at, 0)])
                day, score, x, at = day[some], score[some], x[some], at[some]
                width = highs[at] / 2 - lows[at] / 2
                cell = at * parts + np.minimum((x / 2 - lows[at] / 2) / np.where(width > 0, width, 1) * parts, parts - 1).astype(np.int64)
                np.minimum.at(least, cell, x)
                np.maximum.at(most, cell, x)
                keys, each = np.unique(np.stack([cell, day.view(np.int64), share.classes(score)], 1), axis=0, return_counts=True)
                held.append(keys)
                counts.append(each)
            total = np.zeros((len(least), draws))
            if held:
                keys, where = np.unique(np.concatenate(held), axis=0, return_inverse=True)
                each = np.bincount(where.ravel(), weights=np.concatenate(counts), minlength=len(keys))
                step = max(1, AT_ONCE // draws)
                for at in range(0, len(keys), step):
                    some = keys[at : at + step]
                    np.add.at(total, some[:, 0], each[at : at + step, None] * _weights(some[:, 1].view(np.uint64), draws, seed) * share.of(some[:, 2]))
            cell, draw = np.nonzero(total)
            some = np.flatnonzero(np.isfinite(least))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cell, some])), pa.array(np.concatenate([draw, np.full(len(some), -1)])), pa.array(np.concatenate([total[cell, draw], np.zeros(len(some))])), pa.array(np.concatenate([np.zeros(len(cell)), least[some]])), pa.array(np.concatenate([np.zeros(len(cell)), most[some]]))], names=["cell", "draw", "w", "a", "b"])

        found = rows.select("day", "score", column).mapInArrow(add, "cell long, draw long, w double, a double, b double").groupBy("cell", "draw").agg(F.sum("w").alias("w"), F.min("a").alias("a"), F.max("b").alias("b")).toPandas()
        table, least, most = np.zeros((len(lows) * parts, draws)), np.full(len(lows) * parts, np.nan), np.full(len(lows) * parts, np.nan)
        own = found[found.draw >= 0]
        table[own.cell, own.draw] = own.w
        ranges = found[found.draw < 0]
        least[ranges.cell], most[ranges.cell] = ranges.a, ranges.b
        for i in np.flatnonzero(live):
            base = int(np.searchsorted(lows, low[i], "right") - 1) * parts
            cells = base + np.flatnonzero(np.isfinite(least[base : base + parts]))
            each = table[cells, i % draws]
            upto = before[i] + np.cumsum(each)
            ok = np.flatnonzero((upto > target[i] + 1e-9) if over[i] else (upto >= target[i] - 1e-9))
            ok = ok[each[ok] > 0] if len(ok) else ok
            if not len(ok):
                low[i], live[i] = np.nan, False
                continue
            at = int(ok[0])
            before[i], weight[i] = upto[at] - each[at], each[at]
            low[i], high[i] = least[cells[at]], most[cells[at]]
            live[i] = low[i] < high[i]
    return low, before, weight


def edge_draws(df: DataFrame, day: str, score: str, value: str, percent: float = 5.0, draws: int = 1000, least: int = 40, seed: int = 0) -> DataFrame:
    """draw (0: as observed), n, top_median, all_median and diff: the median value of the best ``percent`` by score, and of all, with days drawn with replacement.

    A draw counts each day Poisson(1) times, by a hash of the day, since rows of one day aren't independent. Of rows tied at the border of the best each
    counts by the share of them that fits. Draws of fewer than ``least`` rows are null. Rows without a day, or a finite score and value, are left
    out. interval() of judge.py makes the interval. See weighted_at() for how medians are found without gathering rows.
    """
    spark = df.sparkSession
    ship(spark)
    shared_folder(spark)
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < F.lit(float("inf"))), F.col(c).cast("double"))
    rows = df.where(F.col(day).isNotNull()).select(F.xxhash64(day).alias("day"), finite(score).alias("score"), finite(value).alias("x")).na.drop().checkpoint()
    days = rows.groupBy("day").count().toPandas()  # a row a day
    n = days["count"].to_numpy() @ _weights(days["day"].to_numpy().view(np.uint64), draws, seed) if len(days) else np.zeros(draws)
    top = np.maximum(1, np.floor(n * percent / 100 + 1e-9))
    border, under, tied = weighted_at(rows, "score", draws, seed, _Share(), n - top, np.ones(draws, bool))
    with np.errstate(invalid="ignore"):
        share = np.clip((top - (n - under - tied)) / tied, 0.0, 1.0)
    medians = []
    for kind, size in ((_Share(border, share), top), (_Share(), n)):
        picked = rows if kind.known is None or not len(kind.known) else rows.where(F.col("score") >= float(kind.known[0]))
        found, _, _ = weighted_at(picked, "x", draws, seed, kind, np.tile(size / 2, 2), np.repeat([False, True], draws))
        low, high = found[:draws], found[draws:]
        medians.append(np.where(np.isfinite(high), (low + high) / 2, low))
    good = (n >= least) & np.isfinite(medians[0]) & np.isfinite(medians[1])
    value_of = lambda x, i: float(x[i]) if good[i] else None
    return spark.createDataFrame([(i, int(n[i]), value_of(medians[0], i), value_of(medians[1], i), value_of(medians[0] - medians[1], i)) for i in range(draws)], "draw int, n long, top_median double, all_median double, diff double")
