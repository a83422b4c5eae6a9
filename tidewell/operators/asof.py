"""Joins by time: as of, within intervals, and counts in trailing windows."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewell.session import ship


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], strict: bool = False, tolerance_days: int | None = None, prefix: str = "") -> DataFrame:
    """left with the values of the latest right row of its key at or before (strict: before) its time, and that row's time as prefix + right_on.

    One sort of both sides together by key and time; nothing is broadcast and no row is multiplied. Of right rows with one time the
    largest values count. Older matches than tolerance_days are null. by may be empty only for a right side that every key shares:
    use asof_calendar() then.
    """
    names = [f"{prefix}{c}" for c in (right_on, *values)]
    payload = F.struct(F.col(right_on).alias(right_on), *(F.col(v).alias(v) for v in values))
    r = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), payload.alias("_r"))
    r = r.groupBy(*by, "_t").agg(F.max("_r").alias("_r")).select(*by, "_t", F.lit(1 if strict else 0).alias("_side"), "_r", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    lt = left.select(*by, F.col(left_on).cast(right.schema[right_on].dataType).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(lt).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    ok = F.col("_t").isNotNull()
    if tolerance_days is not None:
        ok = ok & (F.datediff("_t", F.col(f"_m.{right_on}")) <= tolerance_days)
    return out.select("_l.*", *(F.when(ok, F.col(f"_m.{c}")).alias(n) for c, n in zip((right_on, *values), names, strict=True)))


def next_after(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], within_days: int | None = None, prefix: str = "next_") -> DataFrame:
    """left with the values of the first right row of its key after its time, and that row's time as prefix + right_on; null where there is none yet.

    One sort of both sides together by key and time, the latest first; no row is multiplied. Of right rows with one time the smallest values
    count. Rows further off than within_days are none.
    """
    names = [f"{prefix}{c}" for c in (right_on, *values)]
    payload = F.struct(F.col(right_on).alias(right_on), *(F.col(v).alias(v) for v in values))
    r = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), payload.alias("_r"))
    r = r.groupBy(*by, "_t").agg(F.min("_r").alias("_r")).select(*by, "_t", F.lit(1).alias("_side"), "_r", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    lt = left.select(*by, F.col(left_on).cast(right.schema[right_on].dataType).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    w = Window.partitionBy(*by).orderBy(F.col("_t").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)  # a row before a right row of its time
    out = r.unionByName(lt).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_l IS NOT NULL")
    ok = F.col("_t").isNotNull()
    if within_days is not None:
        ok = ok & (F.datediff(F.col(f"_m.{right_on}"), "_t") <= within_days)
    return out.select("_l.*", *(F.when(ok, F.col(f"_m.{c}")).alias(n) for c, n in zip((right_on, *values), names, strict=True)))


def one_to_one(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """The join of both sides by columns, which fails if a key is there twice on either: no row is lost or multiplied unnoticed.

    Rows are counted where they are joined, in the job that uses the result: nothing is read twice, and the job fails with the name of the
    side. Null keys match nothing and may repeat.
    """
    again = lambda df, name: df.withColumn(f"_{name}", F.when(F.greatest(*(F.col(c).isNull() for c in by), F.lit(False)), F.lit(1)).otherwise(F.count("*").over(Window.partitionBy(*by))))
    both = again(left, "left").join(again(right, "right"), by, how)
    once = (F.coalesce("_left", F.lit(1)) == 1) & (F.coalesce("_right", F.lit(1)) == 1)
    checked = both.where(F.when(once, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not one to one: "), F.when(F.col("_left") > 1, F.lit("left")).otherwise(F.lit("right")), F.lit(" has repeated keys"))).cast("boolean")))
    return checked.drop("_left", "_right")


def asof_calendar(left: DataFrame, right: DataFrame, left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """asof_join() with a series that all keys share, by days: the series is filled forward over the calendar, then joined on the day.

    right has one row for each day at most; the filled calendar is as long as the span of days, whatever left holds.
    """
    span = left.agg(F.min(left_on).alias("a"), F.max(left_on).alias("b")).crossJoin(right.agg(F.min(right_on).alias("c")))
    days = span.select(F.explode(F.sequence(F.least("a", "c"), F.col("b"))).alias("_day"))
    filled = days.join(right.withColumnRenamed(right_on, "_day"), "_day", "left")
    by_year = Window.partitionBy(F.lit(0)).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.select("_day", *(F.last(v, ignorenulls=True).over(by_year).alias(v) for v in values))
    return left.join(filled, left[left_on] == filled["_day"], "left").drop("_day")


def count_within(df: DataFrame, by: list[str], on: str, days: int, event: Column, name: str) -> DataFrame:
    """df with the number of its key's events in the days (t - days, t]."""
    day = F.datediff(F.col(on), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*by).orderBy(day).rangeBetween(-(days - 1), 0)
    return df.withColumn(name, F.coalesce(F.sum(event.cast("long")).over(w), F.lit(0)))


def next_scheduled(left: DataFrame, schedule: DataFrame, by: str, on: str, published: str, due: str, keep: list[str]) -> DataFrame:
    """For each row (keep names its columns): the earliest due date among its key's entries published by then and not yet past.

    Rows and entries of a key meet by year, an entry in each year that it is open in. A task reads its keys and years in the order of time, one
    after the other, and keeps the open entries of one in a heap by due date: no row is joined with all entries of its key, and
    no group is gathered. Repeated rows count once.
    """
    rows = left.select(*keep).distinct()
    entries = schedule.where((F.col(published) <= F.col(due)) & F.col(by).isNotNull()).select(F.col(by).alias("_k"), F.col(published).alias("_t"), F.col(due).alias("_due")).distinct()
    entries = entries.withColumn("_y", F.explode(F.sequence(F.year("_t"), F.year("_due")))).withColumn("_row", F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType))
    asked = rows.select(F.col(by).alias("_k"), F.col(on).alias("_t"), F.lit(None).cast(schedule.schema[due].dataType).alias("_due"), F.year(on).alias("_y"), F.struct("*").alias("_row"))
    shape = StructType([StructField("_row", rows.select(F.struct("*")).schema[0].dataType), StructField("next_due", schedule.schema[due].dataType)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list = []
        place: object = ()
        for batch in batches:
            found: list = []
            for key, year, at, until in zip(*(batch[c].to_pylist() for c in ("_k", "_y", "_t", "_due")), strict=True):
                if (key, year) != place:
                    place, opened = (key, year), []
                if until is not None:
                    heappush(opened, until)
                    continue
                while at is not None and opened and opened[0] < at:
                    heappop(opened)
                found.append(opened[0] if at is not None and opened else None)
            yield pa.RecordBatch.from_arrays([batch["_row"].filter(batch["_due"].is_null()), pa.array(found, batch["_due"].type)], names=["_row", "next_due"])

    ship(left.sparkSession)
    both = asked.unionByName(entries).repartition("_k", "_y").sortWithinPartitions("_k", "_y", "_t", F.col("_due").isNull())  # an entry before the rows of its day
    return both.mapInArrow(scan, shape).select("_row.*", "next_due")


def within_intervals(rows: DataFrame, intervals: DataFrame, by: str, on: str, start: str, end: str) -> DataFrame:
    """The rows whose time lies in [start, end) of an interval of their key."""
    i = intervals.select(F.col(by).alias("_k"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    return rows.join(i, (rows[by] == i["_k"]) & (rows[on] >= i["_a"]) & (rows[on] < i["_b"]), "left_semi")


def live_total(intervals: DataFrame, by: list[str], start: str, end: str, value: str) -> DataFrame:
    """by, day and total: the sum of the values that are valid after each change, value being valid from start up to end."""
    up = intervals.select(*by, F.col(start).alias("day"), F.col(value).alias("d"))
    down = intervals.where(F.col(end).isNotNull()).select(*by, F.col(end).alias("day"), (-F.col(value)).alias("d"))
    steps = up.union(down).groupBy(*by, "day").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*by, "day", F.sum("d").over(w).alias("total"))


def session_index(days: DataFrame, on: str) -> DataFrame:
    """Each distinct day with its number in the calendar, and the next session."""
    w = Window.partitionBy(F.lit(0)).orderBy(on)
    return days.select(on).distinct().select(on, F.row_number().over(w).alias("session"), F.lead(on).over(w).alias("next_session"))
