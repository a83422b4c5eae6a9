"""Top-k, samples and orders, each with a total order so that equal scores give equal results in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import percentiles_of_earlier


def _place(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))


def _hash(seed: int, *parts: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts)))


def top_percent(df: DataFrame, score: str, tie: str, percent: float) -> DataFrame:
    """The best percent of all rows by score (one at least): the border is found by count, so that only rows about it are ranked."""
    some = df.where(F.col(score).isNotNull())
    n = some.count()
    k = max(1, int(n * percent / 100)) if n else 0
    best = some.orderBy(F.col(score).desc(), F.col(tie)).limit(k)
    return best


def top_percent_within(df: DataFrame, by: list[str], score: str, tie: str, percent: float) -> DataFrame:
    """The best percent of each group by score (one at least)."""
    some = df.where(F.col(score).isNotNull())
    n = F.count("*").over(Window.partitionBy(*by))
    return some.withColumns({"_n": n, "_p": _place(by, F.col(score).desc(), F.col(tie))}).where(F.col("_p") <= F.greatest(F.floor(F.col("_n") * percent / 100), F.lit(1))).drop("_n", "_p")


def best_per_day(df: DataFrame, on: str, score: str, key: str, seed: int = 0) -> DataFrame:
    """The best row of each day; among equal scores a hash of seed and key draws."""
    order = F.struct(F.col(score), _hash(seed, key))
    return df.where(F.col(score).isNotNull()).groupBy(on).agg(F.max_by(F.struct(*(c for c in df.columns if c != on)), order).alias("_r")).select(on, "_r.*")


def over_earlier_folds(df: DataFrame, fold: str, score: str, share: float, least: int) -> DataFrame:
    """Rows whose score is over the ``share`` quantile of all earlier folds' scores, of which there must be ``least``, with that threshold."""
    lines = percentiles_of_earlier(df, fold, score, share).where(F.col("n") >= least).select(F.col(fold).alias("_f"), F.col("x").alias("threshold"), F.col("n").alias("_n"))  # a row for each fold
    return df.join(F.broadcast(lines), F.col(fold) == F.col("_f")).where(F.col(score) > F.col("threshold")).drop("_f", "_n")


def rule_order(df: DataFrame, by: list[str], rule: str, score: str, rank: str, tie: str) -> DataFrame:
    """df with order: by the rule's least percentile, those without one last, then by score and rank."""
    return df.withColumn("order", _place(by, F.col(rule).desc_nulls_last(), F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(rank).asc_nulls_last(), F.col(tie)))


def near_misses(df: DataFrame, by: list[str], rule: str, low: float, line: float, tie: str) -> DataFrame:
    """Rows that the rule misses by little, with their place."""
    return df.where((F.col(rule) >= low) & (F.col(rule) < line)).withColumn("place", _place(by, F.col(rule).desc(), F.col(tie)))


def passed_and_extras(df: DataFrame, by: list[str], key: str, passed: Column, order: Column, rank: str, top: int) -> DataFrame:
    """Of each key one row: where it passed, in that order, and after these the others of the first ``top`` ranks."""
    rows = df.withColumn("_ok", F.coalesce(passed, F.lit(False))).where(F.col("_ok") | (F.col(rank) <= top))
    one = rows.withColumn("_p", _place([*by, key], F.col("_ok").desc(), order, F.col(rank))).where("_p = 1")
    place = _place(by, F.col("_ok").desc(), F.when(F.col("_ok"), order), F.col(rank).asc_nulls_last(), F.col(key))
    return one.withColumn("place", place).withColumnRenamed("_ok", "by_rule").drop("_p")


def newest_keys(df: DataFrame, key: str, on: str, order: list[Column], n: int) -> DataFrame:
    """n distinct keys, those of the newest days first, each with its newest row."""
    one = df.withColumn("_p", _place([key], F.col(on).desc(), *order)).where("_p = 1").drop("_p")
    return one.orderBy(F.col(on).desc(), *order, key).limit(n)


def sample_per_class(df: DataFrame, label: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each class, drawn by a hash of seed and key."""
    return df.withColumn("_p", _place([label], _hash(seed, key), F.col(key))).where(F.col("_p") <= n).drop("_p")


def recent_whole_days(df: DataFrame, on: str, rows: int) -> DataFrame:
    """The rows of the newest days that hold ``rows`` together; a day counts whole."""
    days = df.groupBy(on).agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.col(on).desc()).rowsBetween(Window.unboundedPreceding, -1))  # one row a day
    wanted = days.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).where(F.col("_ahead") < rows).select(on)
    return df.join(F.broadcast(wanted), on)


def sample_days(df: DataFrame, on: str, n: int, seed: int = 0) -> DataFrame:
    """The rows of n days drawn by a hash."""
    days = df.select(on).distinct().orderBy(_hash(seed, on)).limit(n)
    return df.join(F.broadcast(days), on, "left_semi")


def every_nth_from_end(df: DataFrame, by: list[str], on: str, step: int, keep_first: bool = True) -> DataFrame:
    """Each step-th row counted back from a key's last; its first row stays too."""
    back, first = _place(by, F.col(on).desc()), _place(by, F.col(on))
    out = df.withColumns({"_b": back, "_f": first})
    return out.where(((F.col("_b") - 1) % step == 0) | ((F.col("_f") == 1) & F.lit(keep_first))).drop("_b", "_f")


def last_of_kind(df: DataFrame, by: list[str], on: str, tie: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("_p", _place(by, F.col(on).desc(), F.col(tie).desc())).where(F.col("_p") <= n).drop("_p")


def first_by_source(df: DataFrame, key: list[str], priority: Column, tie: str) -> DataFrame:
    """Of each key the row of the best source: the smallest priority, then tie."""
    return df.withColumn("_p", _place(key, priority, F.col(tie))).where("_p = 1").drop("_p")


def cheapest_first(df: DataFrame, by: list[str], price: str, values: list[str], tie: str) -> DataFrame:
    """df with the median of the known values, price / median, and place by it, those without one last."""
    known = F.array_sort(F.array_compact(F.array(*(F.col(v).cast("double") for v in values))))
    n, at = F.size(known), lambda i: F.get(known, i)
    middle = F.when(n > 0, (at(F.floor((n - 1) / 2).cast("int")) + at(F.floor(n / 2).cast("int"))) / 2)
    out = df.withColumn("median_value", middle).withColumn("ratio", F.when(F.col("median_value") > 0, F.col(price) / F.col("median_value")))
    return out.withColumn("place", _place(by, F.col("ratio").asc_nulls_last(), F.col(tie)))


def top_contributions(df: DataFrame, contributions: dict[str, str], groups: dict[str, str], k: int) -> DataFrame:
    """df with the k columns of the largest absolute contribution (name and value), and the sum of each group of columns."""
    parts = F.array(*(F.struct(F.abs(F.col(c)).alias("size"), F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in contributions.items()))
    top = F.slice(F.sort_array(parts, asc=False), 1, k)
    out = df.withColumn("top", F.transform(top, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))))
    for g in sorted(set(groups.values())):
        out = out.withColumn(f"sum_{g}", sum((F.coalesce(F.col(contributions[n]), F.lit(0.0)) for n in contributions if groups[n] == g), F.lit(0.0)))
    return out
