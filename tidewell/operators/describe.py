"""Profiles of tables, correlations, grids and nested records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import percentiles
from tidewell.session import ship

_SUMS = ("n", "a", "b", "aa", "bb", "ab")


def _finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, nulls, distinct values, zeros, mean, quartiles, extremes, and values beyond three quartile ranges, in a few passes over the table: quartiles are exact (percentiles())."""
    quartiles = percentiles(df, [], columns, [0.25, 0.5, 0.75]).first()
    parts = []
    for c in columns:
        q1, q2, q3 = quartiles[c] or [None] * 3
        out = F.count_if((F.col(c) < q1 - 3 * (q3 - q1)) | (F.col(c) > q3 + 3 * (q3 - q1))) if q1 is not None else F.lit(0)
        x = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("name"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_null"), F.countDistinct(c).alias("n_unique"), F.count_if(x == 0).alias("n_zero"), F.avg(x).alias("mean"), F.min(x).alias("low"), *(F.lit(v).cast("double").alias(n) for n, v in (("q25", q1), ("q50", q2), ("q75", q3))), F.max(x).alias("high"), out.cast("long").alias("n_outlier")).alias(f"_{c}"))
    one = df.agg(*parts)
    return one.select(F.explode(F.array(*(f"_{c}" for c in columns))).alias("p")).select("p.*")


def correlations(df: DataFrame, columns: list[str], least: float = 0.0, known: int = 2, top: int | None = None) -> DataFrame:
    """a, b and r: Pearson's correlation of each pair of columns over the rows where both are known, in the order of the columns.

    One pass, however many columns: a task keeps, for all pairs at once, sums, squares, products and counts of rows where both are known, by
    products of its batches with their masks, around a first row's values so that large means don't cancel. A row for each pair and task is
    shuffled. Pairs under ``known`` rows, and of a column that is constant there, have none; ``least`` is the smallest absolute r, and ``top``
    keeps the so many largest. Values that aren't finite are not known.
    """
    names, width = list(columns), len(columns)
    first, second = np.triu_indices(width, 1)
    centre = np.array([x if x is not None else 0.0 for x in df.agg(*(F.avg(_finite(F.col(c))).alias(f"_{i}") for i, c in enumerate(names))).first()], np.float64)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, width, width))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], 1) if batch.num_rows else np.zeros((0, width))
            seen = np.isfinite(x)
            x, m = np.where(seen, x - centre, 0.0), seen.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        part = total[:, first, second]
        some = np.flatnonzero(part[0])
        columns = [pa.array(first[some], pa.int32()), pa.array(second[some], pa.int32()), *(pa.array(v[some]) for v in part)]
        for at in range(0, len(some), 50_000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], names=["i", "j", *_SUMS])

    ship(df.sparkSession)
    parts = df.select(*(_finite(F.col(c)).alias(f"_{i}") for i, c in enumerate(names))).mapInArrow(gram, "i int, j int, " + ", ".join(f"{n} double" for n in _SUMS))
    sums = parts.groupBy("i", "j").agg(*(F.sum(n).alias(n) for n in _SUMS))
    name = F.array(*(F.lit(c) for c in names))
    a_dev, b_dev = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    flat = lambda dev, squares: dev <= 1e-12 * squares  # noqa: E731  what rounding leaves of a constant
    r = F.when(~(flat(a_dev, F.col("aa")) | flat(b_dev, F.col("bb"))), (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(a_dev * b_dev))
    rows = sums.where(F.col("n") >= known).select("i", "j", name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("r"))
    rows = rows.where(F.col("r").isNotNull() & (F.abs("r") >= least))
    rows = rows if top is None else rows.orderBy(F.abs("r").desc(), "i", "j").limit(top)
    return rows.select("a", "b", "r")


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """bin and n, values beyond the ends counting in the first and the last bin."""
    at = F.least(F.greatest(F.floor((F.col(x) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    return df.where(F.col(x).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def calendar_grid(df: DataFrame, key: str, on: str, values: list[str], limit: int) -> DataFrame:
    """A row for each day from a key's first to its last, values carried forward over at most ``limit`` days."""
    span = df.groupBy(key).agg(F.explode(F.sequence(F.min(on), F.max(on))).alias(on))
    w = Window.partitionBy(key).orderBy(on).rowsBetween(-limit, 0)
    full = span.join(df.select(key, on, *values), [key, on], "left")
    return full.select(key, on, *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values))


def pivoted(df: DataFrame, index: str, name: str, value: str, names: list[str]) -> DataFrame:
    return df.groupBy(index).pivot(name, names).agg(F.sum(value))


def weighted_by_group(df: DataFrame, by: str, group: str, value: Column, weight: Column) -> DataFrame:
    """Weighted means for each group, and over all of them, of one scan."""
    d = df.select(by, group, (value * weight).alias("_vw"), F.when(value.isNotNull(), weight).alias("_w"))
    out = d.groupingSets([[by, group], [by]], by, group).agg(F.sum("_vw").alias("_a"), F.sum("_w").alias("_b"), F.grouping(group).alias("_g"))
    return out.select(by, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(group)).alias(group), F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")).alias("mean"))


def turn_stats(conversations: DataFrame) -> DataFrame:
    """Nested records: the turns of each conversation as an array, and what is computed within it."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", F.length("text").alias("len")))).alias("turns"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["len"])
    user = F.filter("turns", lambda x: x["role"] == "user")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.size(user).cast("long").alias("n_user"), F.array_max(F.transform("turns", lambda x: x["len"])).cast("long").alias("longest"), total(F.col("turns")).cast("long").alias("n_chars"), (total(user) / F.when(total(F.col("turns")) > 0, total(F.col("turns")))).alias("user_share"), F.element_at("turns", 1)["role"].alias("first_role"))


def code_runs(df: DataFrame, code: str) -> DataFrame:
    """Runs of consecutive hexadecimal codes: gaps and islands."""
    n = df.select(F.conv(code, 16, 10).cast("long").alias("n")).distinct()
    n = n.withColumn("_i", F.col("n") - F.row_number().over(Window.partitionBy(F.shiftright("n", 20)).orderBy("n")))
    return n.groupBy("_i", F.shiftright("n", 20).alias("_b")).agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count("*").alias("size")).select("first", "last", "size")
