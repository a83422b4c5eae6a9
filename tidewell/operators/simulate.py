"""Replays: outcomes of entries, slot-limited portfolios, permutation tests, folds, and isotonic fits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import percentiles
from tidewell.operators.rank import average_rank
from tidewell.session import ship


def entry_outcome(bars: DataFrame, horizon: int = 20, rise: float = 0.1) -> DataFrame:
    """bars with entry (next open), hit_after (rows until a high reaches entry * (1 + rise)), mfe, mae and status: hit, expired, holding or no_entry."""
    w = Window.partitionBy("code").orderBy("day")
    ahead = w.rowsBetween(1, horizon)
    out = bars.withColumns({"entry": F.lead("o").over(w), "_h": F.collect_list("h").over(ahead), "_top": F.max("h").over(ahead), "_low": F.min("l").over(ahead)})
    at = F.array_position(F.transform("_h", lambda x: x >= F.col("entry") * (1 + rise)), True)
    out = out.withColumns({"hit_after": F.when(at > 0, at), "mfe": (F.col("_top") / F.col("entry") - 1) * 100, "mae": (F.col("_low") / F.col("entry") - 1) * 100})
    status = F.when(F.col("entry").isNull(), "no_entry").when(F.col("hit_after").isNotNull(), "hit").when(F.size("_h") < horizon, "holding").otherwise("expired")
    return out.withColumn("status", status).drop("_h", "_top", "_low")


def slots(candidates: DataFrame, book: str, order: list[str], start: str, end: str, n: int) -> DataFrame:
    """The candidates of each book that a portfolio of n slots takes, first come first served; a slot is free again after its end.

    A scan of each book's candidates in order: what is taken depends on all that was taken before.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        busy: list = []
        taken = []
        for s, e in zip(rows[start], rows[end], strict=True):
            busy = [b for b in busy if b >= s]
            ok = len(busy) < n and e is not None and e == e
            if ok:
                busy.append(e)
            taken.append(ok)
        return rows[taken]

    ship(candidates.sparkSession)
    return candidates.groupBy(book).applyInPandas(work, candidates.schema)


def permutation_test(df: DataFrame, stratum: str, label: str, value: str, tie: str, draws: int, seed: int = 0) -> DataFrame:
    """draw (0: as observed) and diff: the mean of value where label is 1 less that where it is 0, labels being shuffled within strata.

    A draw gives label 1 to the rows of a stratum with the smallest hashes of seed, draw and tie, as many as have it. Rows are summed by the
    hash's leading bits before anything is shuffled; only rows in the range that the border falls into are ranked. Rows with a
    null in stratum, label or value are left out.
    """
    known = df.where(F.col(stratum).isNotNull() & F.col(label).isNotNull() & F.col(value).isNotNull()).select(F.col(stratum).alias("s"), F.col(label).cast("int").alias("y"), F.col(value).cast("double").alias("x"), F.col(tie).cast("string").alias("t"))
    sizes = known.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("k"), F.sum("x").alias("total"), F.sum(F.when(F.col("y") == 1, F.col("x")).otherwise(0.0)).alias("seen"))
    drawn = known.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), "t")))
    drawn = drawn.withColumn("cell", F.conv(F.substring("h", 1, 2), 16, 10).cast("int"))
    cells = drawn.groupBy("s", "draw", "cell").agg(F.count("*").alias("m"), F.sum("x").alias("sx")).join(sizes.select("s", "k"), "s")
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("s", "draw").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("ahead", ahead)
    whole = cells.where(F.col("ahead") + F.col("m") <= F.col("k")).groupBy("draw").agg(F.sum("sx").alias("one"))
    border = cells.where((F.col("ahead") < F.col("k")) & (F.col("ahead") + F.col("m") > F.col("k"))).select("s", "draw", "cell", (F.col("k") - F.col("ahead")).alias("more"))
    ranked = drawn.join(border, ["s", "draw", "cell"]).withColumn("r", F.row_number().over(Window.partitionBy("s", "draw").orderBy("h", "t")))
    rest = ranked.where(F.col("r") <= F.col("more")).groupBy("draw").agg(F.sum("x").alias("one"))
    observed = sizes.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("total").alias("total"), F.sum("seen").alias("seen"))
    ones = whole.union(rest).groupBy("draw").agg(F.sum("one").alias("one")).union(observed.select(F.lit(0), F.col("seen")))
    ones = df.sparkSession.range(draws + 1).select(F.col("id").cast("int").alias("draw")).join(ones, "draw", "left").crossJoin(F.broadcast(observed))
    one = F.coalesce("one", F.lit(0.0))
    return ones.select("draw", F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), one / F.col("k") - (F.col("total") - one) / (F.col("n") - F.col("k"))).alias("diff"))


def block_folds(df: DataFrame, on: str, folds: int, seed: int = 0) -> DataFrame:
    """df with fold: months are blocks, dealt within each year to the folds in the order of a hash."""
    months = df.select(F.trunc(on, "month").alias("_m")).distinct()
    w = Window.partitionBy(F.year("_m")).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_m").cast("string"))))
    months = months.select("_m", ((F.row_number().over(w) - 1) % folds).alias("fold"))
    return df.join(months, F.trunc(on, "month") == F.col("_m")).drop("_m")


def purged_folds(df: DataFrame, on: str, sessions: DataFrame, folds: int, purge: int, seed: int = 0) -> DataFrame:
    """df with fold, the one that it validates (block_folds()), and left_out: the folds, in order, whose training leaves it out.

    These are its own, and those with a validation day within ``purge`` sessions before or after. sessions: on, one row a session; each
    validation day of a fold is widened to the sessions around it, what overlaps is merged, and rows of these sessions are
    left out. Sessions and folds are few; rows of df meet one row each. A day that is no session has a null left_out.
    """
    index = sessions.select(on).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(on)))  # one row a session
    dealt = block_folds(df, on, folds, seed)
    days = dealt.select(on, "fold").distinct().join(index, on)
    near = days.select("fold", F.explode(F.sequence(F.col("_i") - purge, F.col("_i") + purge)).alias("_i")).distinct().groupBy("_i").agg(F.array_sort(F.collect_set("fold")).alias("left_out"))  # folds of a session
    return dealt.join(F.broadcast(index.join(near, "_i", "left").select(on, F.coalesce("left_out", F.array().cast("array<int>")).alias("left_out"))), on, "left")


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.select(*by, average_rank(by, a).alias("_a"), average_rank(by, b).alias("_b"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("rho"))


def pooled(rows: DataFrame) -> DataFrame:
    """Rows (low, high, s, n), in order within each partition, with adjacent violators pooled: means s / n rise within a partition."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, s, n = [], [], [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b, sum_, count = row
                while s and s[-1] * count >= sum_ * n[-1]:  # the mean before is no smaller
                    a, sum_, count = low.pop(), sum_ + s.pop(), count + n.pop()
                    high.pop()
                low.append(a)
                high.append(b)
                s.append(sum_)
                n.append(count)
        for at in range(0, len(s), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000], t) for x, t in ((low, pa.float64()), (high, pa.float64()), (s, pa.float64()), (n, pa.int64()))], names=["low", "high", "s", "n"])

    return rows.select("low", "high", "s", "n").mapInArrow(pool, "low double, high double, s double, n long")


def isotonic_pools(df: DataFrame, score: str, label: str) -> DataFrame:
    """low, high, n and value: the stretches of score over which the isotonic fit of label is constant, by pooling adjacent violators.

    Labels are summed by score first, so that ties count together. Each range of scores is pooled by itself, then the pools of all ranges
    are pooled in one task: pooling may begin with any stretches, and with labels 0 and 1 about n ** (2 / 3) pools of n rows are the
    most there can be. Rows without a score or label, and scores that aren't finite, are left out.
    """
    x = F.col(score).cast("double")
    per = df.where(F.col(label).isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))).groupBy(x.alias("low")).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count("*").alias("n"))
    ranges = pooled(per.select("low", F.col("low").alias("high"), "s", "n").repartitionByRange("low").sortWithinPartitions("low"))
    return pooled(ranges.repartition(1).sortWithinPartitions("low")).select("low", "high", "n", (F.col("s") / F.col("n")).alias("value"))


def isotonic(df: DataFrame, score: str, label: str, points: int = 51) -> list[tuple[float, float]]:
    """The isotonic fit of label at ``points`` quantiles of the score, equal ones once: a table that calibrated() reads.

    Between two pools the fit is linear. Empty without a row that has both.
    """
    x = F.when(F.col(label).isNotNull(), F.col(score))
    at = percentiles(df.select(x.alias("x")), [], ["x"], [i / (points - 1) for i in range(points)]).first().x
    if at is None:
        return []
    pools, row, at = isotonic_pools(df, score, label), F.struct("low", "high", "value"), sorted(set(at))
    sides = [(F.max_by(row, F.when(F.col("low") <= q, F.col("low"))), F.min_by(row, F.when(F.col("low") > q, F.col("low")))) for q in at]
    found = pools.agg(*(c.alias(f"{name}{i}") for i, pair in enumerate(sides) for name, c in zip("ab", pair, strict=True))).first()
    out = []
    for i, q in enumerate(at):
        a, b = found[f"a{i}"], found[f"b{i}"]
        value = a.value if b is None or q <= a.high else a.value + (b.value - a.value) * (q - a.high) / (b.low - a.high)
        out.append((q, value))
    return out


def calibrated(x: Column, table: list[tuple[float, float]]) -> Column:
    """The table at x, linearly between its points and constant beyond them."""
    from tidewell.functions.scalar import piecewise

    return piecewise(x, table) if len(table) > 1 else F.lit(table[0][1] if table else None)
