"""Scenario valuation as projections over a grid: residual income, dividends, discounted cash flow, and statistics over scenarios."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import aggregated


def residual_income(book: Column, roe: Column, cost: Column, fade: Column, years: int) -> Column:
    """Book value plus discounted excess returns, the excess fading by ``fade`` each year and all of it kept in the book; null if book <= 0."""
    step = lambda a, t: F.struct((a["b"] * (1 + cost + a["x"])).alias("b"), (a["x"] * fade).alias("x"), (a["v"] + a["b"] * a["x"] / F.pow(1 + cost, t)).alias("v"))
    start = F.struct(book.cast("double").alias("b"), (roe - cost).cast("double").alias("x"), book.cast("double").alias("v"))
    return F.when(book > 0, F.aggregate(F.sequence(F.lit(1), F.lit(years)), start, step, lambda a: a["v"]))


def dividend_discount(dividend: Column, growth: Column, cost: Column, years: int, terminal_growth: Column) -> Column:
    """Dividends growing for some years, then for ever at the terminal rate; null unless cost is over that."""
    paid = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda a, t: a + dividend * F.pow((1 + growth) / (1 + cost), t))
    last = dividend * F.pow((1 + growth) / (1 + cost), F.lit(years)) * (1 + terminal_growth) / (cost - terminal_growth)
    return F.when(cost > terminal_growth, paid + last)


def cash_flow_value(sales: Column, margin: Column, tax: Column, growth: Column, reinvest: Column, cost: Column, years: int) -> Column:
    """Discounted free cash flow over some years, then the last year's profit for ever (new capital earning its cost adds nothing)."""
    profit = lambda t: sales * F.pow(1 + growth, t) * margin * (1 - tax)
    flows = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda a, t: a + profit(t) * (1 - reinvest) / F.pow(1 + cost, t))
    return F.when(cost > 0, flows + profit(F.lit(years)) / cost / F.pow(1 + cost, F.lit(years)))


def grid(df: DataFrame, **values: list[float]) -> DataFrame:
    """df with a row for each combination of the values, as columns: exploded in place, nothing is joined."""
    for name, v in values.items():
        df = df.withColumn(name, F.explode(F.array(*(F.lit(float(x)) for x in v))))
    return df


def scenario_stats(df: DataFrame, by: list[str], value: str, least: float = 0.8) -> DataFrame:
    """min, max, mean, median and std of the scenarios' values, null where fewer than a share ``least`` of them is known."""
    g = aggregated(df, by, [F.count("*").alias("_n"), F.count(value).alias("n_valid"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")], {"median": (value, 0.5)})
    ok = F.col("n_valid") >= least * F.col("_n")
    return g.select(*by, "n_valid", *(F.when(ok, F.col(c)).alias(c) for c in ("low", "high", "mean", "median", "std")))


def asset_stress(df: DataFrame, hair: dict[str, tuple[float, ...]], net: str, cap: str, price: str) -> DataFrame:
    """df with stats of the price at net assets less haircuts: n, low, high, mean, median and deviation over all combinations of the cuts.

    hair: column and the shares of it that may be lost. A net under 0 counts as 0; null without assets or market value.
    """
    values = F.array(*(F.greatest(F.col(net) - sum((F.col(c) * cut for c, cut in zip(hair, cuts, strict=True)), F.lit(0.0)), F.lit(0.0)) for cuts in product(*hair.values())))
    ready = (F.col(cap) > 0) & (F.col(price) > 0) & F.col(net).isNotNull()
    for c in hair:
        ready = ready & (F.col(c) >= 0)
    out = df.withColumn("_v", F.when(ready, F.array_sort(F.transform(values, lambda v: v / F.col(cap) * F.col(price)))))
    n = F.size("_v")
    mean = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v) / n
    middle = (F.get("_v", F.floor((n - 1) / 2).cast("int")) + F.get("_v", F.floor(n / 2).cast("int"))) / 2
    return out.withColumns({"low": F.get("_v", F.lit(0)), "high": F.get("_v", n - 1), "mean": mean, "median": middle}).withColumn("deviation", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, v: a + F.pow(v - F.col("mean"), 2)) / n)).drop("_v")


def peer_prices(df: DataFrame, by: list[str], key: str, multiple: str, price: str, least: int) -> DataFrame:
    """df with peers (others of the group with a multiple over 0) and the price at their multiples: low, high, mean, deviation, p10, p50, p90.

    Means come from sums, places from the group's order with the row itself left out: for a row that stands at a place or before it, that is the next
    one's value. So a group needs three values for each place, which windows over it look up: nothing is joined. Null under ``least`` peers.
    """
    known = df.where(F.col(multiple) > 0)
    w = Window.partitionBy(*by)
    known = known.withColumns({"_i": F.row_number().over(w.orderBy(multiple, key)) - 1, "_n": F.count("*").over(w) - 1, "_s": F.sum(multiple).over(w), "_q": F.sum(F.pow(F.col(multiple), 2)).over(w)})
    x = F.col(multiple)
    mean = (F.col("_s") - x) / F.col("_n")
    square = (F.col("_q") - x * x) / F.col("_n") - mean * mean
    places = {"low": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "high": 1.0}
    at = lambda p: F.lit(p) * (F.col("_n") - 1)
    known = known.withColumns({f"_{n}{j}": F.max(F.when(F.col("_i") == F.floor(at(p)) + j, x)).over(w) for n, p in places.items() for j in range(3)})

    def value(n: str, p: float) -> Column:
        place = F.floor(at(p))
        part = at(p) - place
        below = F.when(F.col("_i") <= place, F.col(f"_{n}1")).otherwise(F.col(f"_{n}0"))
        above = F.when(F.col("_i") <= place + 1, F.col(f"_{n}2")).otherwise(F.col(f"_{n}1"))
        return F.when(part > 0, below * (1 - part) + above * part).otherwise(below)

    scale = F.col(price) / x
    enough = F.col("_n") >= least
    out = known.withColumns({n: F.when(enough, value(n, p) * scale) for n, p in places.items()})
    return out.withColumns({"peers": F.col("_n"), "mean": F.when(enough, mean * scale), "deviation": F.when(enough, F.sqrt(F.greatest(square, F.lit(0.0))) * scale)}).drop("_i", "_n", "_s", "_q", *(f"_{n}{j}" for n in places for j in range(3)))


def reasons(rules: dict[str, Column], separator: str = "; ") -> Column:
    """All the reasons that hold, in their order, as one text; empty where none does."""
    return F.concat_ws(separator, *(F.when(rule, text) for text, rule in rules.items()))


def flow(sales: Column, steps: list[tuple[str, Column]]) -> Column:
    """From sales down to the last known profit: an array of (name, value, out, gain, loss), one for each known step, up to the first that is not over 0.

    out is what went since the step before, gain what came in instead; a step at a loss takes all that was left. Null without sales over 0.
    """
    known = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in steps)), lambda s: s["value"].isNotNull())
    row = "array<struct<name: string, value: double, out: double, gain: double, loss: boolean>>"
    start = F.struct(F.array().cast(row).alias("all"), sales.cast("double").alias("left"), F.lit(False).alias("end"))

    def step(a: Column, s: Column) -> Column:
        loss = s["value"] <= 0
        went = F.when(loss, a["left"]).when(a["left"] > s["value"], a["left"] - s["value"])
        came = F.when(~loss & (a["left"] < s["value"]), s["value"] - a["left"])
        one = F.struct(s["name"].alias("name"), s["value"].alias("value"), went.alias("out"), came.alias("gain"), loss.alias("loss"))
        return F.when(a["end"], a).otherwise(F.struct(F.concat(a["all"], F.array(one)).alias("all"), s["value"].alias("left"), loss.alias("end")))

    return F.when((sales > 0) & (F.size(known) > 0), F.aggregate(known, start, step, lambda a: a["all"]))
