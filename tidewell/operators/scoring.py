"""Axis scores from metrics, and rule-based selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import clamp, piecewise


def linear_score(x: Column, low: float, high: float) -> Column:
    """0 at low, 10 at high, clamped."""
    return clamp((x - low) / (high - low) * 10, 0.0, 10.0)


def axes(df: DataFrame, high_ratio: str, volume_trend: str, growth: str, turnover: str) -> DataFrame:
    """df with axis_high, axis_volume, axis_growth, axis_liquidity, score (mean of the known axes), n_axes and zone.

    Fixed values: the knots of the high ratio (80, 90, 98 percent) and the bounds of each axis.
    """
    high = piecewise(F.col(high_ratio), [(80, 0.0), (90, 5.0), (98, 10.0)])
    volume = clamp(5 + (F.col(volume_trend) - 100) / 100 * 5, 0.0, 10.0)
    names = ["axis_high", "axis_volume", "axis_growth", "axis_liquidity"]
    out = df.withColumns(dict(zip(names, [high, volume, linear_score(F.col(growth), 0.0, 50.0), linear_score(F.log10(F.col(turnover)), 3.0, 7.0)], strict=True)))
    known = F.filter(F.array(*names), lambda x: x.isNotNull())
    out = out.withColumn("n_axes", F.size(known).cast("long")).withColumn("score", F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)))
    zone = F.when(F.col(high_ratio) >= 98, "top").when(F.col(high_ratio) >= 90, "near").when(F.col(high_ratio) >= 80, "middle").when(F.col(high_ratio).isNotNull(), "low")
    return out.withColumn("zone", zone)


def daily_picks(df: DataFrame, by: str, ready: Column, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each day by score, on days on which every row is ready."""
    out = df.withColumn("_all", F.min(F.coalesce(ready, F.lit(False)).cast("int")).over(Window.partitionBy(by)))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), tie)))
    return out.where(F.col("_all") == 1).where(F.col("place") <= k).drop("_all")


def first_of_month(df: DataFrame, on: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(F.trunc(on, "month")).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


#: The points of the distribution of progress over its benchmark, by basis and quarter, at these shares.
PROGRESS_SHARES = (0.01, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.99)
PROGRESS_POINTS = {
    "seasonal": {
        1: (-2.138, -0.211, 0.193, 0.548, 0.742, 0.877, 0.984, 1.087, 1.221, 1.431, 1.888, 2.460, 4.271),
        2: (-2.070, 0.076, 0.440, 0.718, 0.856, 0.944, 1.014, 1.087, 1.178, 1.324, 1.644, 2.048, 3.086),
        3: (-1.169, 0.367, 0.640, 0.830, 0.918, 0.975, 1.024, 1.072, 1.134, 1.229, 1.443, 1.766, 2.678),
    },
    "linear": {
        1: (-12.436, -2.246, -0.696, 0.186, 0.504, 0.709, 0.853, 0.979, 1.108, 1.294, 1.693, 2.262, 4.704),
        2: (-8.606, -1.080, 0.028, 0.543, 0.745, 0.865, 0.952, 1.026, 1.110, 1.225, 1.465, 1.773, 3.400),
        3: (-4.571, -0.116, 0.441, 0.757, 0.884, 0.962, 1.019, 1.073, 1.132, 1.212, 1.368, 1.624, 3.089),
    },
}
#: What a volume score is worth at each level of institutional interest.
VOLUME_DECAY = {"mega": 1.0, "high": 1.0, "moderate": 0.85, "low": 0.65, "cap_low": 0.7, "none": 0.35}
AXES = ("eps", "sales", "roe", "margin", "technical", "volume", "supply", "progress")


def share_at(x: Column, points: tuple[float, ...], shares: tuple[float, ...]) -> Column:
    """The share of a distribution, given by points, that lies up to x: linear between them, 0 below the first and 1 over the last."""
    inside = piecewise(x, list(zip(points, shares, strict=True)))
    return F.when(x < points[0], 0.0).when(x > points[-1], 1.0).otherwise(inside)


def liquidity_tier(turnover: Column) -> Column:
    return F.when(turnover >= 30, "mega").when(turnover >= 10, "high").when(turnover >= 5, "moderate").when(turnover >= 1, "low").when(turnover.isNotNull(), "none")


def institutional_level(turnover: Column, cap: Column) -> Column:
    """The tier, but "cap_low" where the market value is under 100."""
    return F.when(cap < 100, "cap_low").otherwise(liquidity_tier(turnover))


def technical_score(ratio: Column) -> Column:
    """The knots at 80, 90 and 98 percent of the high; from 98 on it is 10."""
    low = F.greatest(ratio / 80 * 6, F.lit(0.0))
    return F.when(ratio >= 98, 10.0).when(ratio >= 90, 8 + (ratio - 90) / 8 * 1.5).when(ratio >= 80, 6 + (ratio - 80) / 10 * 2).when(ratio.isNotNull(), low)


def credit_score(ratio: Column) -> Column:
    """10 up to a ratio of 1, 7 at 3, 2 at 10 and 0 from 20 on; null for a negative one."""
    return F.when(ratio >= 0, piecewise(ratio, [(1, 10.0), (3, 7.0), (10, 2.0), (20, 0.0)]))


def progress_score(progress: Column, quarter: Column, benchmark: Column, basis: Column, mode: str = "table") -> Column:
    """Ten times the share of past progress, on its benchmark, that this one exceeds; or by pace: 5 at an even pace, a point for 2 percent.

    The benchmark counts where its basis is seasonal or floor and it is over 0; else an even pace does. Null but for the quarters 1 to 3.
    """
    if mode == "pace":
        return F.when(quarter.between(1, 3), clamp(5 + (progress - quarter * 25) / 2, 0.0, 10.0))
    own = F.coalesce(basis.isin("seasonal", "floor") & (benchmark > 0), F.lit(False))
    out = F.lit(None).cast("double")
    for q in (1, 2, 3):
        seasonal = share_at(progress / benchmark, PROGRESS_POINTS["seasonal"][q], PROGRESS_SHARES)
        even = share_at(progress / (q * 25.0), PROGRESS_POINTS["linear"][q], PROGRESS_SHARES)
        out = F.when(quarter == q, 10 * F.when(own, seasonal).otherwise(even)).otherwise(out)
    return F.when(progress.isNotNull(), out)


def eight_axes(df: DataFrame, progress_mode: str = "table") -> DataFrame:
    """df with the eight axis scores (axis_*), coverage, total (mean of the known), strict (the sum over eight), tier, level and zone.

    Columns: eps_growth, sales_growth, roe, op_margin, high_ratio, volume_trend, credit_ratio, progress, quarter, benchmark, basis, turnover, cap.
    """
    c = F.col
    level = institutional_level(c("turnover"), c("cap"))
    decay = F.lit(1.0)
    for name, share in VOLUME_DECAY.items():
        decay = F.when(level == name, share).otherwise(decay)
    scores = {
        "eps": linear_score(c("eps_growth"), 0.0, 50.0), "sales": linear_score(c("sales_growth"), 0.0, 40.0), "roe": linear_score(c("roe"), 5.0, 25.0), "margin": linear_score(c("op_margin"), 0.0, 20.0), "technical": technical_score(c("high_ratio")),
        "volume": clamp(clamp(5 + (c("volume_trend") - 100) / 100 * 5, 0.0, 10.0) * decay, 0.0, 10.0), "supply": credit_score(c("credit_ratio")), "progress": progress_score(c("progress"), c("quarter"), c("benchmark"), c("basis"), progress_mode),
    }
    out = df.withColumns({f"axis_{a}": scores[a] for a in AXES} | {"tier": liquidity_tier(c("turnover")), "level": level})
    known = F.filter(F.array(*(f"axis_{a}" for a in AXES)), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    zone = F.when(c("high_ratio") >= 98, "BREAKOUT").when(c("high_ratio") >= 90, "HANDLE").when(c("high_ratio") >= 80, "BASE").when(c("high_ratio").isNotNull(), "CORRECTION")
    return out.withColumns({"coverage": F.size(known).cast("long"), "total": F.when(F.size(known) > 0, total / F.size(known)), "strict": F.when(F.size(known) > 0, total / 8), "zone": zone})


def decisions(df: DataFrame, by: str, percentiles: list[str], score: str, tie: str, line: float, least: int, top: int) -> DataFrame:
    """df with p_min (null if one is unknown), n_day, passed, rank (of those that passed) and picked: among the first ``top`` of a day with ``least`` rows or more."""
    known = F.lit(True)
    for p in percentiles:
        known = known & F.col(p).isNotNull()
    out = df.withColumn("p_min", F.when(known, F.least(*percentiles))).withColumn("n_day", F.count("*").over(Window.partitionBy(by)))
    out = out.withColumn("passed", F.coalesce(F.col("p_min") >= line, F.lit(False)))
    place = F.row_number().over(Window.partitionBy(by, "passed").orderBy(F.col("p_min").desc_nulls_last(), F.col(score).desc(), tie))
    out = out.withColumn("rank", F.when(F.col("passed"), place))
    return out.withColumn("picked", F.coalesce(F.col("passed") & (F.col("n_day") >= least) & (F.col("rank") <= top), F.lit(False)))


def day_verdicts(decided: DataFrame, by: str, least: int, strong: int, quiet: int) -> DataFrame:
    """For each day its rows, those that passed and those that cannot be judged, whether to buy, the verdict, and the kind of day by the number of rows."""
    out = decided.groupBy(by).agg(F.count("*").alias("n"), F.count_if("passed").alias("n_pass"), F.count_if(F.col("p_min").isNull()).alias("n_missing"))
    verdict = F.when(F.col("n") < least, "skip").when(F.col("n_missing") > 0, "unknown").when(F.col("n_pass") == 0, "none passed").otherwise("buy")
    kind = F.when(F.col("n") >= strong, "strong").when(F.col("n") >= quiet, "ok").when(F.col("n") >= least, "quiet").otherwise("skip")
    return out.withColumns({"verdict": verdict, "buy": verdict == "buy", "kind": kind})


def radar(percentiles: list[str], scale: float = 20.0) -> dict[str, Column]:
    """mean, low and agree (1 less the deviation on ``scale``) of percentiles, from 0 to 1; null where one is unknown."""
    known = F.lit(True)
    for p in percentiles:
        known = known & F.col(p).isNotNull()
    n = len(percentiles)
    mean = sum((F.col(p) for p in percentiles), F.lit(0.0)) / n
    deviation = F.sqrt(sum((F.pow(F.col(p) - mean, 2) for p in percentiles), F.lit(0.0)) / n)
    unit = lambda x: F.when(known, clamp(x, 0.0, 1.0))
    return {"mean": unit(mean / 100), "low": unit(F.least(*percentiles) / 100), "agree": unit(1 - deviation / scale)}


def border_shape(percentiles: list[str], line: float = 95.0, low: float = 85.0) -> Column:
    """What a row that just misses the rule looks like: all but one over the line and how far that one is, or the band of the least; null for others."""
    known = F.lit(True)
    for p in percentiles:
        known = known & F.col(p).isNotNull()
    over = sum(((F.col(p) >= line).cast("int") for p in percentiles), F.lit(0))
    least, n = F.least(*percentiles), len(percentiles)
    two = F.when(least >= 90, "two_high").when(least >= low, "two_middle").otherwise("two_low")
    rest = F.when(least >= 90, "least_90").when(least >= low, "least_85")
    return F.when(known & (over < n), F.when(over == n - 1, two).otherwise(rest))


def laggard(percentiles: list[str]) -> Column:
    """The name of the smallest percentile, the first of equal ones; null where one is unknown."""
    known = F.lit(True)
    for p in percentiles:
        known = known & F.col(p).isNotNull()
    least = F.least(*percentiles)
    out = F.lit(None).cast("string")
    for p in reversed(percentiles):
        out = F.when(F.col(p) == least, p).otherwise(out)
    return F.when(known, out)


def exit_plan(close: Column, gain: float) -> Column:
    """The price to leave at; null without a price over 0."""
    return F.when(close > 0, close * (1 + gain / 100))


def on_grid(x: Column, points: Column) -> Column:
    """The percentile of x on an array of 101 points of a distribution, linear between them, of equal points the middle; 0 and 100 beyond the ends."""
    below, upto = F.size(F.filter(points, lambda p: p < x)), F.size(F.filter(points, lambda p: p <= x))
    a, b = F.get(points, below - 1), F.get(points, below)
    between = below - 1 + F.when(b > a, (x - a) / (b - a)).otherwise(0.0)
    return F.when(x.isNull(), None).when(below == 0, F.when(upto > 0, (upto - 1) / 2).otherwise(0.0)).when(below == 101, 100.0).when(upto > below, (below + upto - 1) / 2).otherwise(between).cast("double")
