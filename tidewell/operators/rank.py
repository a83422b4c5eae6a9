"""Ranks and empirical distributions, each with its own rule for ties and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import percentiles


def average_rank(by: list[str], x: str, descending: bool = False) -> Column:
    """Rank from 1, ties sharing the mean of theirs; null for null."""
    order = F.col(x).desc_nulls_last() if descending else F.col(x).asc_nulls_last()
    return F.when(F.col(x).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(x).over(Window.partitionBy(*by, x)) - 1) / 2)


def rank_share(by: list[str], x: str) -> Column:
    """Average rank / n, null where n < 2."""
    n = F.count(x).over(Window.partitionBy(*by))
    return F.when(n >= 2, average_rank(by, x) / n)


def rank_position(by: list[str], x: str) -> Column:
    """(average rank - 1) / (n - 1), 0.5 for a single value."""
    n = F.count(x).over(Window.partitionBy(*by))
    return F.when(n == 1, F.when(F.col(x).isNotNull(), F.lit(0.5))).otherwise((average_rank(by, x) - 1) / (n - 1))


def grade(by: list[str], x: str, grades: int) -> Column:
    return F.least(F.floor(rank_position(by, x) * grades), F.lit(grades - 1)).cast("long")


def share_below(df: DataFrame, history: DataFrame, x: str, value: str, name: str, buckets: int = 1000) -> DataFrame:
    """df with 100 * (values of history under x) / (all of them), to one decimal.

    Both sides are sorted together by value, in ranges of the history's quantiles: counts within a range add to those of the ranges before, so
    that no task holds all values.
    """
    edges = history.agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    slot = F.lit(0)
    edges = sorted(set(edges))
    slot = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)) if edges else F.array().cast("array<double>"), lambda e: e < F.col("_v")))
    h = history.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    per = h.select("_v", slot.alias("_slot")).groupBy("_slot", "_v").agg(F.count("*").alias("_n"))
    sums = per.groupBy("_slot").agg(F.sum("_n").alias("_s"))
    ahead = sums.select("_slot", F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    total = F.broadcast(sums.agg(F.sum("_s").alias("_total")))
    rows = df.withColumn("_v", F.col(x).cast("double")).withColumn("_slot", slot)
    both = rows.select("_slot", "_v", F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_n"), F.struct(*df.columns).alias("_row")).unionByName(per.select("_slot", "_v", F.lit(1).alias("_side"), "_n", F.lit(None).cast(rows.select(F.struct(*df.columns)).schema[0].dataType).alias("_row")))
    w = Window.partitionBy("_slot").orderBy("_v", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_below", F.sum("_n").over(w)).where("_row IS NOT NULL").join(F.broadcast(ahead), "_slot", "left").join(total)
    below = F.col("_below") + F.coalesce("_before", F.lit(0))
    return out.select("_row.*", F.when(F.col("_v").isNotNull() & (F.col("_total") > 0), F.round(100.0 * below / F.col("_total"), 1)).alias(name))


def top_with_ties(df: DataFrame, by: list[str], score: str, k: int, target: str) -> DataFrame:
    """Precision of the first k by score in each group, ties at the border counting by the share of them that fits."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc())
    tied = Window.partitionBy(*by, score)
    out = df.where(F.col(score).isNotNull()).select(*by, F.col(target).cast("double").alias("_t"), F.rank().over(order).alias("_r"), F.count("*").over(tied).alias("_m"))
    weight = F.greatest(F.least((k - F.col("_r") + 1) / F.col("_m"), F.lit(1.0)), F.lit(0.0))
    return out.withColumn("_w", weight).groupBy(*by).agg((F.sum(F.col("_w") * F.col("_t")) / F.sum("_w")).alias("precision"), F.sum("_w").alias("n_taken"))


def quantile_bands(df: DataFrame, x: str, bands: int) -> list[float]:
    """Inner edges of equal-frequency bands, with linear interpolation, equal ones once."""
    values = percentiles(df, [], [x], [i / bands for i in range(bands + 1)]).first()[0] or []
    return sorted(set(values))


def banded(df: DataFrame, x: str, edges: list[float], name: str) -> DataFrame:
    """df with the number of the band (edges[i], edges[i + 1]] that x lies in, the lowest edge included."""
    n = F.lit(0)
    for e in edges[1:-1]:
        n = n + (F.col(x) > e).cast("int")
    return df.withColumn(name, F.when(F.col(x).between(edges[0], edges[-1]), n) if edges else F.lit(None).cast("int"))
