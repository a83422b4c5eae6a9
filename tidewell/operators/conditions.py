"""Rules on rows: what a text or a number counts as, which rows are complete, eligible or excluded, and labels from thresholds.

Each is an expression, or a plan of one join by key; a condition on a null is null unless a rule says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS_OF_YEAR = 365.25


def segment_start(bars: DataFrame, segments: DataFrame, key: str, on: str, traded: Column, inside: Column) -> DataFrame:
    """key, first_row, was_inside, start and known: from when a key counts outside of a segment.

    start: the first row of a key that never was in the segment; else its first traded row after the last time that it was, if it is listed
    outside of it later; else null. known: the start is in the data, that is, the key left the segment, or begins after the data do.
    """
    s = segments.select(F.col(key), F.col(on).alias("_t"), inside.alias("_in"))
    last = s.groupBy(key).agg(F.max(F.when(F.col("_in"), F.col("_t"))).alias("_last"), F.max(F.when(~F.col("_in"), F.col("_t"))).alias("_out"))
    rows = bars.select(key, F.col(on).alias("_t"), traded.alias("_traded")).join(last, key, "left")
    per = rows.groupBy(key).agg(F.min("_t").alias("first_row"), F.max("_last").alias("_last"), F.max("_out").alias("_out"), F.min(F.when(F.col("_traded") & (F.col("_t") > F.col("_last")), F.col("_t"))).alias("_after"))
    data = F.broadcast(bars.agg(F.min(on).alias("_begin")))
    was = F.col("_last").isNotNull()
    start = F.when(~was, F.col("first_row")).when(F.col("_out") > F.col("_last"), F.col("_after"))
    return per.join(data).select(key, "first_row", was.alias("was_inside"), start.alias("start"), ((was & start.isNotNull()) | (~was & (F.col("first_row") > F.col("_begin")))).alias("known"))


def years_since(rows: DataFrame, starts: DataFrame, key: str, on: str, cap: float) -> DataFrame:
    """rows with years since the start of segment_start(), at most ``cap``.

    A key whose start is not in the data has ``cap`` once the data themselves are so old, else null; so have keys that are still inside, and
    rows before the start.
    """
    begin = F.broadcast(starts.agg(F.min("first_row").alias("_begin")))
    s = starts.select(key, "start", "known", "was_inside")
    years = lambda since: F.datediff(F.col(on), since) / DAYS_OF_YEAR
    own = F.when(years(F.col("start")) >= 0, F.least(years(F.col("start")), F.lit(cap)))
    value = F.when(F.col("was_inside") & F.col("start").isNull(), F.lit(None)).when(F.col("known"), own).when(years(F.col("_begin")) >= cap, F.lit(cap))
    return rows.join(s, key, "left").join(begin).withColumn("years", value.cast("double")).drop("start", "known", "was_inside", "_begin")


def encoded(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a category as a number: its own if every value is one, else its place among the sorted distinct values; null for null."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("_v")).distinct()
    codes = values.select("_v", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_v")) - 1).cast("double").alias("_i"), F.col("_v").try_cast("double").alias("_x"))
    numeric = F.broadcast(values.agg((F.count(F.col("_v").try_cast("double")) == F.count("*")).alias("_all")))
    table = codes.join(numeric).select("_v", F.when(F.col("_all"), F.col("_x")).otherwise(F.col("_i")).alias(name))
    return df.join(table, F.col(column).cast("string") == F.col("_v"), "left").drop("_v")


def not_among(column: Column, excluded: list) -> Column:
    """Rows whose value is not excluded; an unknown value stays."""
    return ~column.isin(*excluded) | column.isNull()


def common_share(code: Column) -> Column:
    """Codes of five characters end in 0 for common shares; codes of another length are common."""
    return (F.length(code) != 5) | code.endswith("0")


def complete(columns: list[str]) -> Column:
    """1.0 where all columns hold a value, else 0.0."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return F.when(ok, 1.0).otherwise(0.0)


def last_positive(columns: list[str]) -> Column:
    """Whether all of the columns, the last few periods, are over 0; false where one is unknown."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c) > 0, F.lit(False))
    return ok


def thresholds(volatility: Column, horizon: int, rise: float, end_rise: float, times_sigma: float | None) -> tuple[Column, Column]:
    """What a rise must reach, and where it must end: fixed, or times the volatility (percent a row) over the horizon."""
    need = F.lit(rise) if times_sigma is None else times_sigma * volatility / 100 * F.sqrt(F.lit(float(horizon)))
    return need, F.lit(end_rise) if times_sigma is None else F.lit(end_rise / rise) * need


def material_label(rise: Column, end: Column, trend: Column, need: Column, end_need: Column, tolerance: float = 1e-12) -> Column:
    """Whether the rise was reached, its end is high enough and the trend holds; null where any of these is unknown."""
    reach = lambda x, t: (x >= t) | (F.abs(x - t) <= tolerance)
    known = rise.isNotNull() & end.isNotNull() & trend.isNotNull() & need.isNotNull()
    return F.when(known, reach(rise, need) & reach(end, end_need) & (trend == 1))


def actual_only(period: Column, periods: list[str], figures: list[str]) -> Column:
    """Disclosures of a known period that hold an actual figure, rather than a forecast."""
    return F.coalesce(period.isin(*periods), F.lit(False)) & F.coalesce(*(F.col(c) for c in figures)).isNotNull()


def keyword_level(text: Column, levels: list[tuple[str, int]], none: tuple[str, ...] = ("", "-")) -> Column:
    """The level of the first keyword that a text holds; 0 for an empty one, null for one without any."""
    t = F.trim(F.coalesce(text, F.lit("")))
    out = F.when(t.isin(*none), 0)
    for word, level in levels:
        out = out.when(t.contains(word), level)
    return out.cast("double")


def flag_of(text: Column, yes: list[str], no: list[str]) -> Column:
    """1 for a text of yes, 0 for one of no, else null."""
    t = F.trim(text)
    return F.when(t.isin(*yes), 1.0).when(t.isin(*no), 0.0)


def annual_percent(fee: Column, days: Column, price: Column) -> Column:
    """A fee for so many days (1 if none are named) as percent of the price a year."""
    return F.when(price > 0, fee / F.when(days > 0, days).otherwise(1) / price * 365 * 100)


def first_class(text: Column, patterns: list[tuple[str, str]], empty: str = "(empty)", other: str = "other") -> Column:
    """The name of the first pattern that a text matches."""
    out = F.when(text.isNull() | (F.trim(text) == ""), empty)
    for name, pattern in patterns:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def eligible_balance(balances: DataFrame, key: str, on: str, published: str, as_of: Column, snapshot: Column, estimated_before: Column, estimate: Column, tie: str) -> DataFrame:
    """Of each key the latest balance that was available as of a day, with available and basis.

    Available is when it was published; without that, the day of a snapshot that held it; without that, an estimate for days before
    daily publication began. Others count for nothing. Equal ones go by tie.
    """
    basis = F.when(F.col(published).isNotNull(), "published").when((F.col(on) <= snapshot) & (snapshot <= as_of), "snapshot").when(F.col(on) < estimated_before, "estimate")
    available = F.when(F.col(published).isNotNull(), F.col(published)).when((F.col(on) <= snapshot) & (snapshot <= as_of), snapshot).when(F.col(on) < estimated_before, estimate)
    ok = balances.withColumns({"available": available, "basis": basis}).where((F.col(on) <= as_of) & (F.col(on) <= F.col("available")) & (F.col("available") <= as_of))
    return ok.groupBy(key).agg(F.max_by(F.struct(*(c for c in ok.columns if c != key)), F.struct(on, "available", tie)).alias("_r")).select(key, "_r.*")


def least_of(columns: list[str]) -> Column:
    """The smallest of the columns, null where one is unknown."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.least(*(F.col(c) for c in columns)))


def column_kinds(names: list[str], rules: list[tuple[str, str]], other: str = "plain") -> dict[str, str]:
    """The kind of each column by the first rule whose pattern its name matches."""
    import re

    return {n: next((kind for pattern, kind in rules if re.search(pattern, n)), other) for n in names}


def between_runs(df: DataFrame, on: str, previous: Column, current: Column, label: str) -> DataFrame:
    """Labelled rows that are new since the previous run: (previous, current]."""
    return df.where((F.col(on) > previous) & (F.col(on) <= current) & F.col(label).isNotNull())
