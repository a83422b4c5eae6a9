"""Features from feeds of dated events and yearly reports, as they were known on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.asof import asof_join


def count_in_windows(rows: DataFrame, events: DataFrame, key: str, on: str, at: str, windows: dict[str, int]) -> DataFrame:
    """rows with, for each name, how many of its key's events lie in the days (t - n, t]. One sort of both sides; no row is multiplied."""
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    e = events.where(F.col(at).isNotNull()).groupBy(F.col(key).alias("_k"), number(at).alias("_t")).agg(F.count("*").alias("_n")).withColumn("_row", F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType))
    r = rows.select(F.col(key).alias("_k"), number(on).alias("_t"), F.lit(0).cast("long").alias("_n"), F.struct("*").alias("_row"))
    by = Window.partitionBy("_k").orderBy("_t")
    out = e.unionByName(r).withColumns({name: F.sum("_n").over(by.rangeBetween(-(n - 1), 0)) for name, n in windows.items()})
    return out.where("_row IS NOT NULL").select("_row.*", *windows)


def event_features(rows: DataFrame, events: DataFrame, key: str, on: str, at: str, values: list[str], windows: dict[str, int], clip: int | None = None) -> DataFrame:
    """rows with the values of the key's latest event up to the day, days (since then, at most ``clip``), and counts of events in trailing days."""
    out = asof_join(rows, events, [key], on, at, values, prefix="_e_")
    days = F.datediff(on, f"_e_{at}")
    out = out.withColumn("days", days if clip is None else F.least(days, F.lit(clip))).drop(f"_e_{at}")
    for v in values:
        out = out.withColumnRenamed(f"_e_{v}", v)
    return count_in_windows(out, events, key, on, at, windows) if windows else out


def recent_flags(rows: DataFrame, events: DataFrame, key: str, on: str, at: str, windows: dict[str, int], begin: Column) -> DataFrame:
    """rows with 1 or 0 for each name: whether an event lies in its trailing days; null for days before the feed began."""
    out = count_in_windows(rows, events, key, on, at, windows)
    return out.withColumns({n: F.when(F.col(on) >= begin, (F.col(n) > 0).cast("int")) for n in windows})


def revised(disclosures: DataFrame, key: str, period: str, order: list[str], value: str) -> DataFrame:
    """disclosures with revision: percent on the value of the key's disclosure before of the same period, null without one over 0."""
    before = F.lag(value).over(Window.partitionBy(key, period).orderBy(*order))
    return disclosures.withColumn("revision", F.when(before > 0, F.col(value) / before * 100 - 100))


def yearly_lags(facts: DataFrame, key: str, year: str, values: list[str], guards: list[str], lags: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """facts with value_y1, ...: the values of earlier years of the key, null where a guard (basis, standard) differs from this year's.

    One row for each key and year: the first that was filed should be taken before. One sort, whatever the number of lags.
    """
    by = Window.partitionBy(key).orderBy(year)
    new = {}
    for k in lags:
        before = lambda c, k=k: F.max(c).over(by.rangeBetween(-k, -k))
        same = F.lit(True)
        for g in guards:
            same = same & (F.coalesce(before(F.struct(F.col(g).alias("g")))["g"], F.col(g)).eqNullSafe(F.col(g)))
        new |= {f"{v}_y{k}": F.when(same, before(v)) for v in values}
    return facts.withColumns(new)


def symmetric(a: Column, b: Column) -> Column:
    """(a - b) / mean size, between -2 and 2; null where both are 0."""
    size = (F.abs(a) + F.abs(b)) / 2
    return F.when(size > 0, (a - b) / size)


def level_changes(name: str) -> dict[str, Column]:
    """Changes of a level and its yearly lags: yoy1 to yoy3, chg2y, chg3y, accel, recovery3, dip3, vshape3, high4. The last four need all years."""
    y = [F.col(name), *(F.col(f"{name}_y{k}") for k in (1, 2, 3))]
    whole = y[0].isNotNull() & y[1].isNotNull() & y[2].isNotNull() & y[3].isNotNull()
    peak, prior = F.greatest(*y[1:]), F.greatest(*y[2:])
    yoy = [symmetric(y[k], y[k + 1]) for k in range(3)]
    out = {f"yoy{k + 1}": v for k, v in enumerate(yoy)} | {"chg2y": symmetric(y[0], y[2]), "chg3y": symmetric(y[0], y[3]), "accel": yoy[0] - yoy[1]}
    out |= {"recovery3": F.when(whole, symmetric(y[0], peak)), "dip3": F.when(whole, F.least(symmetric(y[1], prior), F.lit(0.0))), "vshape3": F.when(whole, ((y[1] < prior) & (y[0] > y[1])).cast("int")), "high4": F.when(whole, (y[0] > peak).cast("int"))}
    return {f"{name}_{k}": v for k, v in out.items()}


def ratio_changes(name: str) -> dict[str, Column]:
    return {name: F.col(name)} | {f"{name}_chg{k}y": F.col(name) - F.col(f"{name}_y{k}") for k in (1, 2, 3)}


def capital_efficiency(df: DataFrame, days: Column, comparable: Column) -> DataFrame:
    """df with turnover days and returns from this year's and last year's (_y1) balances, on their averages where the two can be compared.

    Columns: receivables, inventories, payables, equity, debt, cash with _y1; revenue, cost, operating, pretax, tax. dso, dio, dpo, ccc,
    nwc_share, op_margin, tax_rate, turnover and roic; null where a base is not over 0.
    """
    over = lambda c: F.when(F.col(c) > 0, F.col(c))
    mean = lambda c: F.when(comparable & (F.col(c) >= 0) & (F.col(f"{c}_y1") >= 0), (F.col(c) + F.col(f"{c}_y1")) / 2)
    rec, inv, pay, rev, cost = mean("receivables"), mean("inventories"), mean("payables"), over("revenue"), over("cost")
    rate = F.col("tax") / over("pretax")
    rate = F.when(rate.between(0, 1), rate)
    capital = lambda s: F.when(F.col(f"equity{s}") > 0, F.col(f"equity{s}") + F.col(f"debt{s}") - F.col(f"cash{s}"))
    now, before = capital(""), capital("_y1")
    invested = F.when(comparable & (now > 0) & (before > 0), (now + before) / 2)
    dso, dio, dpo = rec / rev * days, inv / cost * days, pay / cost * days
    return df.withColumns({"dso": dso, "dio": dio, "dpo": dpo, "ccc": dso + dio - dpo, "nwc_share": (rec + inv - pay) / rev, "op_margin": F.col("operating") / rev, "tax_rate": rate, "turnover": rev / invested, "roic": F.col("operating") * (1 - rate) / invested})


def relative_position(rows: DataFrame, reference: DataFrame, on: str, end: str, group: str, metrics: list[str], least: int, least_group: int) -> DataFrame:
    """rows with market_<metric> and group_<metric>: where each metric lies among the reference of the last month end before the day.

    The place is (values under it + values up to it) / 2n of the reference, null where the reference, or the group's part of it, has too few
    rows. Rows and reference are sorted together by month end and metric.
    """
    ends = F.broadcast(reference.select(F.col(end).alias("_end")).distinct())  # month ends: a row a month
    order = Window.partitionBy(F.lit(0)).orderBy("_end")
    spans = F.broadcast(ends.withColumn("_next", F.lead("_end").over(order)))
    out = rows.join(spans, (F.col(on) > F.col("_end")) & (F.col("_next").isNull() | (F.col(on) <= F.col("_next"))), "left").drop("_next")
    shape = out.select(F.struct("*")).schema[0].dataType
    both = out.select("_end", F.col(group).alias("_g"), *(F.col(m).cast("double").alias(f"_m_{m}") for m in metrics), F.lit(0).alias("_ref"), F.struct("*").alias("_row"))
    both = both.unionByName(reference.select(F.col(end).alias("_end"), F.col(group).alias("_g"), *(F.col(m).cast("double").alias(f"_m_{m}") for m in metrics), F.lit(1).alias("_ref"), F.lit(None).cast(shape).alias("_row")))

    def place(keys: list[str], m: str, least: int) -> Column:
        known = F.when(F.col(f"_m_{m}").isNotNull(), F.col("_ref")).otherwise(0)
        up_to = F.sum(known).over(Window.partitionBy(*keys).orderBy(f"_m_{m}").rangeBetween(Window.unboundedPreceding, 0))
        equal = F.sum(known).over(Window.partitionBy(*keys, f"_m_{m}"))
        n, size = F.sum(known).over(Window.partitionBy(*keys)), F.sum("_ref").over(Window.partitionBy(*keys))
        return F.when(F.col("_end").isNotNull() & F.col(f"_m_{m}").isNotNull() & (size >= least) & (n > 0), (2 * up_to - equal) / (2 * n))

    for m in metrics:
        both = both.withColumns({f"market_{m}": place(["_end"], m, least), f"group_{m}": F.when(F.col("_g").isNotNull(), place(["_end", "_g"], m, least_group))})
    return both.where("_row IS NOT NULL").select("_row.*", *(f"{kind}_{m}" for m in metrics for kind in ("market", "group"))).drop("_end")


def progress_benchmark(facts: DataFrame, key: str, year: str, quarter: str, cumulative: str, floor: float = 0.5) -> DataFrame:
    """facts with benchmark (percent of the full year that the quarter should have reached) and basis.

    seasonal: last year's share of the same quarter; floor: half of an even pace, where that share is smaller; linear: an even pace, where last
    year is unknown or not over 0. One sort by key and year.
    """
    by = Window.partitionBy(key).orderBy(year)
    last = by.rangeBetween(-1, -1)
    part = F.max(F.when(F.col(quarter) == 1, F.col(cumulative))).over(last)
    for q in (2, 3, 4):
        part = F.when(F.col(quarter) == q, F.max(F.when(F.col(quarter) == q, F.col(cumulative))).over(last)).otherwise(part)
    whole = F.max(F.when(F.col(quarter) == 4, F.col(cumulative))).over(last)
    even = F.col(quarter) * 25.0
    out = facts.withColumns({"_part": part, "_whole": whole})
    share = F.when((F.col("_part") > 0) & (F.col("_whole") > 0), F.col("_part") / F.col("_whole") * 100)
    out = out.withColumns({"benchmark": F.when(share.isNull(), even).otherwise(F.greatest(share, even * floor)), "basis": F.when(share.isNull(), "linear").when(share < even * floor, "floor").otherwise("seasonal")})
    return out.drop("_part", "_whole")


def trailing_year(facts: DataFrame, key: str, year: str, quarter: str, cumulative: str) -> DataFrame:
    """facts with ttm: this year so far, and last year's whole less its part up to the same quarter; the whole for a fourth quarter."""
    last = Window.partitionBy(key).orderBy(year).rangeBetween(-1, -1)
    at = lambda q: F.max(F.when(F.col(quarter) == q, F.col(cumulative))).over(last)
    same = F.when(F.col(quarter) == 1, at(1)).when(F.col(quarter) == 2, at(2)).when(F.col(quarter) == 3, at(3))
    return facts.withColumn("ttm", F.when(F.col(quarter) == 4, F.col(cumulative)).otherwise(F.col(cumulative) + at(4) - same))


def latest_published(facts: DataFrame, key: str, on: str, published: Column, as_of: Column) -> DataFrame:
    """Of each key the latest row by ``on`` that was published up to a day."""
    known = facts.withColumn("_p", published).where(F.col("_p") <= as_of)
    return known.groupBy(key).agg(F.max_by(F.struct(*(c for c in facts.columns if c != key)), F.struct(on, "_p")).alias("_r")).select(key, "_r.*")


def apart(events: DataFrame, key: str, on: str, days: int) -> DataFrame:
    """The events of each key that are more than ``days`` after the last one kept: a scan of the key's distinct days."""
    per = events.groupBy(key).agg(F.array_sort(F.collect_set(on)).alias("_days"))
    kept = F.aggregate("_days", F.array().cast("array<date>"), lambda a, d: F.when((F.size(a) == 0) | (F.datediff(d, F.element_at(a, -1)) > days), F.concat(a, F.array(d))).otherwise(a))
    return per.select(key, F.explode(kept).alias(on))
