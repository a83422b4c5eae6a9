"""Ticks to bars and sessions, and volume by price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_of(ts: Column) -> Column:
    """The parts of a trading day by the time of a tick."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.when(minute < 9 * 60, "before").when(minute < 11 * 60 + 30, "morning").when(minute < 12 * 60 + 30, "break").when(minute < 15 * 60 + 25, "afternoon").otherwise("close")


def session_buckets(ticks: DataFrame, code: str, ts: str, price: str, shares: Column) -> DataFrame:
    t = ticks.select(code, F.col(ts).cast("date").alias("day"), session_of(F.col(ts)).alias("session"), F.col(price).alias("p"), shares.alias("s"))
    return t.groupBy(code, "day", "session").agg(F.count("*").alias("n"), F.sum("s").alias("shares"), F.when(F.sum("s") > 0, F.sum(F.col("p") * F.col("s")) / F.sum("s")).alias("vwap"))


#: Noon, the morning's last auction, the closing auction's time before and from a day on (minutes of the day), and the edges of
#: small and large trades.
NOON, MORNING_END, CLOSE_BEFORE, CLOSE_FROM, CLOSE_SINCE = 12 * 60, 11 * 60 + 30, 15 * 60, 15 * 60 + 25, "2024-11-05"
SMALL, LARGE = 1e6, 1e7


def auction_sessions(ticks: DataFrame, code: str, ts: str, price: str, shares: str, order: str, half: str | None = None, close_since: str = CLOSE_SINCE, edges: tuple[float, float] = (SMALL, LARGE)) -> DataFrame:
    """A row for each key and day: shares at the opening, in the morning, in the afternoon and at the close, and amounts and numbers of small, medium and large trades outside of auctions.

    A half of the day (half: 01 or 02; else by noon) opens with an auction: its first trade by ``order`` and those of the same time and price right
    there. What trades from the morning's end on is its last auction, and from the closing auction's time on, which moved at
    ``close_since``, the close. The day opens with the first auction that it has. status is invalid, and all else null, on a day
    with a price or number of shares that isn't finite and over 0, or shares that aren't whole. Windows are over one key's day.
    """
    side = F.lit(None).cast("string") if half is None else F.col(half).cast("string")
    t = ticks.where(F.col(code).isNotNull() & F.col(ts).isNotNull()).select(F.col(code).alias("k"), F.col(ts).cast("date").alias("day"), F.col(ts).alias("ts"), F.col(price).cast("double").alias("p"), F.col(shares).cast("double").alias("s"), F.col(order).alias("o"), side.alias("half"))
    t = t.repartition("k", "day").withColumn("m", F.hour("ts") * 60 + F.minute("ts"))  # one exchange for all that follows
    t = t.withColumns({"am": F.when(F.col("half") == "01", True).when(F.col("half") == "02", False).otherwise(F.col("m") < NOON), "v": F.col("p") * F.col("s")})
    first = Window.partitionBy("k", "day", "am").orderBy("o")
    t = t.withColumns({"opens": (F.col("ts") == F.first("ts").over(first)) & F.col("p").eqNullSafe(F.first("p").over(first)), "has_am": F.max("am").over(Window.partitionBy("k", "day"))})
    close = F.when(F.col("day") >= F.lit(close_since).cast("date"), CLOSE_FROM).otherwise(CLOSE_BEFORE)
    t = t.withColumns({"day_open": F.col("opens") & (F.col("am") == F.col("has_am")), "late_am": F.col("am") & (F.col("m") >= MORNING_END), "late_pm": ~F.col("am") & (F.col("m") >= close)})
    t = t.withColumn("closes", F.col("late_pm") & ~F.col("day_open"))
    normal = ~(F.col("opens") | F.col("late_am") | F.col("late_pm"))
    bad = lambda x: x.isNull() | F.isnan(x) | (x <= 0) | (x >= F.lit(float("inf")))
    odd = F.max((bad(F.col("p")) | bad(F.col("s")) | (F.col("s") % 1 != 0)))
    held = lambda c, x="s": F.sum(F.when(c, F.col(x)).otherwise(0.0))
    small, large = normal & (F.col("v") < edges[0]), normal & (F.col("v") >= edges[1])
    sums = {"opening": held(F.col("day_open")), "morning": held(F.col("am") & ~F.col("day_open")), "afternoon": held(~F.col("am") & ~F.col("closes") & ~F.col("day_open")), "closing": held(F.col("closes"))}
    for name, c in (("small", small), ("medium", normal & ~small & ~large), ("large", large)):
        sums |= {f"{name}_amount": held(c, "v"), f"n_{name}": F.count_if(c)}
    out = t.groupBy("k", "day").agg(odd.alias("odd"), *(c.alias(n) for n, c in sums.items()))
    return out.select(F.col("k").alias(code), "day", F.when(F.col("odd"), "invalid").otherwise("ok").alias("status"), *(F.when(~F.col("odd"), F.col(n)).alias(n) for n in sums))


def profile_distance(a: DataFrame, b: DataFrame, keys: list[str], bin_col: str, shares: str) -> DataFrame:
    """keys and distance of the groups that both sides have: half of the summed differences of their shares by bin, from 0 (alike) to 1 (apart)."""
    part = lambda df, sign: df.select(*keys, F.col(bin_col).alias("_b"), F.col(shares).cast("double").alias("_s"), F.lit(sign).alias("_sign"))
    both = part(a, 1).union(part(b, -1)).groupBy(*keys, "_b").agg(*(F.coalesce(F.sum(F.when(F.col("_sign") == g, F.col("_s"))), F.lit(0.0)).alias(n) for g, n in ((1, "_x"), (-1, "_y"))))
    total = both.groupBy(*keys).agg(F.sum("_x").alias("_tx"), F.sum("_y").alias("_ty")).where("_tx > 0 AND _ty > 0")
    total = total.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_tx", "_ty")
    joined = both.join(total, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return joined.groupBy(*keys).agg((F.sum(F.abs(F.col("_x") / F.col("_tx") - F.col("_y") / F.col("_ty"))) / 2).alias("distance"))


def minute_bars(ticks: DataFrame, key: list[str], ts: str, price: str, shares: Column, tie: str, width: str = "1 minute") -> DataFrame:
    order = F.struct(F.col(ts), F.col(tie))
    t = ticks.select(*key, F.window(ts, width).start.alias("at"), F.col(price).alias("p"), shares.alias("s"), order.alias("ord"))
    return t.groupBy(*key, "at").agg(F.min_by("p", "ord").alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", "ord").alias("c"), F.sum("s").alias("v"))


def value_area(bins: str, poc: Column, held_there: Column, total: Column, area: float) -> Column:
    """lo, hi and held of an array of (bin, s) in order of bin: from the fullest bin to whichever neighbouring side holds more, below first, until ``area`` of the total is held."""
    held = lambda lo, hi: F.aggregate(F.filter(bins, lambda x: (x["bin"] >= lo) & (x["bin"] <= hi)), F.lit(0.0), lambda a, x: a + x["s"])
    at = lambda i: held(i, i)
    first, last = F.element_at(bins, 1)["bin"], F.element_at(bins, -1)["bin"]

    def grow(a: Column, _: Column) -> Column:
        below, above = F.when(a["lo"] > first, at(a["lo"] - 1)).otherwise(-1.0), F.when(a["hi"] < last, at(a["hi"] + 1)).otherwise(-1.0)
        done = (a["held"] >= area * total) | ((below < 0) & (above < 0))
        down = below >= above
        return F.when(done, a).otherwise(F.struct((a["lo"] - F.when(down, 1).otherwise(0)).alias("lo"), (a["hi"] + F.when(down, 0).otherwise(1)).alias("hi"), (a["held"] + F.when(down, below).otherwise(above)).alias("held")))

    steps = F.sequence(F.lit(1), F.greatest((last - first).cast("int"), F.lit(1)))
    return F.aggregate(steps, F.struct(poc.alias("lo"), poc.alias("hi"), held_there.cast("double").alias("held")), grow)


def volume_profile(trades: DataFrame, key: str, price: str, shares: str, bins: int = 36, area: float = 0.7) -> DataFrame:
    """key with n_bins, vwap, poc (middle of the fullest bin, the lower of two), value_low and value_high.

    Bins have a width of 1, 2 or 5 times a power of ten, the least that spans the range in ``bins``. The value area grows from the fullest bin to
    whichever neighbouring side holds more, below first, until it holds ``area`` of the shares.
    """
    t = trades.select(F.col(key).alias("k"), F.col(price).alias("p"), F.col(shares).cast("double").alias("s")).where("p IS NOT NULL AND s > 0")
    raw = (F.max("p") - F.min("p")) / bins
    base = F.pow(F.lit(10.0), F.floor(F.log10("raw")))
    grid = t.groupBy("k").agg(raw.alias("raw"), (F.sum(F.col("p") * F.col("s")) / F.sum("s")).alias("vwap"))
    grid = grid.select("k", "vwap", F.when(F.col("raw") <= 0, 1.0).when(F.col("raw") <= base, base).when(F.col("raw") <= 2 * base, 2 * base).when(F.col("raw") <= 5 * base, 5 * base).otherwise(10 * base).alias("width"))
    binned = t.join(grid, "k").groupBy("k", "vwap", "width", F.floor(F.col("p") / F.col("width")).alias("bin")).agg(F.sum("s").alias("s"))
    rows = binned.groupBy("k", "vwap", "width").agg(F.sort_array(F.collect_list(F.struct("bin", "s"))).alias("b"), F.max(F.struct(F.col("s"), (-F.col("bin")).alias("m"))).alias("top"), F.sum("s").alias("total"))
    poc = -F.col("top.m")
    rows = rows.withColumn("va", value_area("b", poc, F.col("top.s"), F.col("total"), area))
    return rows.select(F.col("k").alias(key), F.size("b").cast("long").alias("n_bins"), "width", "vwap", ((poc + 0.5) * F.col("width")).alias("poc"), (F.col("va.lo") * F.col("width")).alias("value_low"), ((F.col("va.hi") + 1) * F.col("width")).alias("value_high"))


def top_bin(trades: DataFrame, key: str, bin_col: Column, shares: str) -> DataFrame:
    binned = trades.groupBy(key, bin_col.alias("bin")).agg(F.sum(shares).alias("s"))
    return binned.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("s").desc(), "bin"))).where("n = 1").drop("n")
