"""Availability by calendar, manifests of fetched days, and facts compared with those of earlier years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nth_session_of_next_week(days: DataFrame, on: str, n: int) -> DataFrame:
    """week (its Monday) and available: the n-th session of the following week, or a weekday count where the calendar ends."""
    sessions = days.select(F.col(on).alias("d")).distinct()
    w = Window.partitionBy(F.trunc("d", "week")).orderBy("d")
    nth = sessions.withColumn("k", F.row_number().over(w)).where(F.col("k") == n).select(F.date_sub(F.trunc("d", "week"), 7).alias("week"), F.col("d").alias("at"))
    weeks = sessions.select(F.trunc("d", "week").alias("week")).distinct()
    return weeks.join(nth, "week", "left").select("week", F.coalesce("at", F.date_add("week", 7 + n - 1)).alias("available"))


def week_last_day(days: DataFrame, on: str) -> DataFrame:
    """The last day of each ISO week."""
    return days.groupBy(F.trunc(on, "week").alias("week")).agg(F.max(on).alias("last_day"))


def confirmed_days(candidates: DataFrame, fetched: DataFrame, on: str, today: Column, lag_days: int) -> DataFrame:
    """The candidate days that count as fetched: they gave rows, or are older than the source's publication lag."""
    got = fetched.groupBy(on).agg(F.count("*").alias("n_rows"))
    out = candidates.select(on).distinct().join(got, on, "left")
    return out.select(on, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.coalesce("n_rows", F.lit(0)) > 0).alias("has_rows"), (F.col("n_rows").isNotNull() | (F.datediff(today, on) >= lag_days)).alias("confirmed"))


def missing_days(candidates: DataFrame, done: DataFrame, on: str) -> DataFrame:
    return candidates.select(on).distinct().join(done.select(on).distinct(), on, "left_anti")


def against_year(facts: DataFrame, entity: str, year: str, value: str, guard: str, back: int) -> DataFrame:
    """facts with prev: the value ``back`` years before, null where the guard column differs; and change, symmetric between -200 and 200."""
    before = facts.select(entity, (F.col(year) + back).alias(year), F.col(value).alias("_v"), F.col(guard).alias("_g"))
    out = facts.join(before, [entity, year], "left").withColumn("prev", F.when(F.col(guard).eqNullSafe(F.col("_g")), F.col("_v"))).drop("_v", "_g")
    middle = (F.abs(value) + F.abs("prev")) / 2
    return out.withColumn("change", F.when(middle > 0, (F.col(value) - F.col("prev")) / middle * 100))


def peers(df: DataFrame, by: list[str], key: str, value: str, least: int) -> DataFrame:
    """by, key, value with the number and mean of the group's other values, null where fewer than ``least``; from sums, without a self-join."""
    w = Window.partitionBy(*by)
    others = F.count(value).over(w) - F.col(value).isNotNull().cast("int")
    total = F.sum(value).over(w) - F.coalesce(F.col(value), F.lit(0))
    return df.select(*by, key, value, others.alias("n_peers"), F.when(others >= least, total / others).alias("peer_mean"))


def month_end(df: DataFrame, key: str, on: str, value: str, within: int) -> DataFrame:
    """The last row of each key and month that lies within so many days of the month's end."""
    last = df.groupBy(key, F.last_day(on).alias("month_end")).agg(F.max_by(value, on).alias(value), F.max(on).alias(on))
    return last.where(F.datediff("month_end", on) <= within)


def exact_or_asof_limit(df: DataFrame, key: str, on: str, value: str, rows: int) -> DataFrame:
    """df with the value carried forward over at most ``rows`` rows."""
    w = Window.partitionBy(key).orderBy(on).rowsBetween(-rows, 0)
    return df.withColumn("filled", F.last(value, ignorenulls=True).over(w))
