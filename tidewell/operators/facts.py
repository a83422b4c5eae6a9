"""Versioned facts: cumulative figures to single quarters, trailing sums, changes on the year before, and reissues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalar import clip_to_null, symmetric_change


def latest_version(facts: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """One row for each key: the last by the columns ``by``."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in by))
    return facts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def known_at(facts: DataFrame, asof: Column, key: list[str], published: str, by: list[str]) -> DataFrame:
    """What was known at a time: of each key the latest version published before it, so that later reissues change nothing."""
    return latest_version(facts.where(F.col(published) < asof), key, by)


def quarterly(cumulative: DataFrame, entity: str, year: str, quarter: str, value: str) -> DataFrame:
    """Adds single (this quarter alone), ttm (last four contiguous quarters), yoy (percent on the same quarter a year before) and rising (quarters in a row that single rose, from -4 to 4).

    cumulative has one row for each entity, year and quarter (1 to 4), value adding up within a year. The first quarter stands for
    itself; any other needs the one before it.
    """
    w = Window.partitionBy(entity).orderBy(year, quarter)
    index = F.col(year) * 4 + F.col(quarter)
    out = cumulative.withColumn("_i", index)
    contiguous = (F.lag("_i").over(w) == F.col("_i") - 1)
    out = out.withColumn("single", F.when(F.col(quarter) == 1, F.col(value)).when(contiguous, F.col(value) - F.lag(value).over(w)))
    four = w.rowsBetween(-3, 0)
    whole = (F.count("single").over(four) == 4) & (F.min("_i").over(four) == F.col("_i") - 3)
    out = out.withColumn("ttm", F.when(whole, F.sum("single").over(four)))
    wq = Window.partitionBy(entity, quarter).orderBy(year)
    base = F.when(F.lag(year).over(wq) == F.col(year) - 1, F.lag("single").over(wq))
    out = out.withColumn("yoy", F.when(base > 0, (F.col("single") / base - 1) * 100))
    rose = F.when(contiguous, F.signum(F.col("single") - F.lag("single").over(w)))
    out = out.withColumn("_s", rose)
    steps = F.array(*(F.lag("_s", k).over(w) for k in range(4)))
    # from this quarter back: how many steps in a row have the sign of the last one
    run = F.aggregate(steps, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & F.coalesce(x == F.col("_s"), F.lit(False)), 1).otherwise(0)).alias("n"), (a["on"] & F.coalesce(x == F.col("_s"), F.lit(False))).alias("on")), lambda a: a["n"])
    return out.withColumn("rising", (run * F.col("_s")).cast("long")).drop("_i", "_s")


def lag_available(df: DataFrame, key: str, on: str, value: str, k: int, max_days: int, name: str) -> DataFrame:
    """df with the k-th value before this row among the non-null ones, null if it is more than max_days older."""
    some = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(on)
    back = some.select(key, on, F.lag(value, k).over(w).alias("_v"), F.lag(on, k).over(w).alias("_t"))
    back = back.select(key, on, F.when(F.datediff(on, "_t") <= max_days, F.col("_v")).alias(name))
    return df.join(back, [key, on], "left")


def reissue_windows(facts: DataFrame, key: list[str], published: str) -> DataFrame:
    """Keys that were published more than once, from the first to the last time."""
    return facts.groupBy(*key).agg(F.min(published).alias("first_published"), F.max(published).alias("last_published"), F.count("*").alias("versions")).where("last_published > first_published")


def keyed_upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and new together, new rows replacing old ones of their key; exact repeats count once.

    A new batch that holds one key with different values is refused.
    """
    new = new.distinct()
    clash = new.groupBy(*key).count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"the batch has different rows for the key {[clash[0][k] for k in key]}")
    return old.join(new.select(*key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and the new rows of keys that it lacks: the first write of a key stays."""
    return old.unionByName(new.join(old.select(*key).distinct(), key, "left_anti").select(old.columns))


def replace_window(old: DataFrame, fresh: DataFrame, on: str) -> DataFrame:
    """The old rows before the first fresh time, and the fresh rows."""
    first = fresh.agg(F.min(on).alias("_first"))
    return old.join(F.broadcast(first), F.col("_first").isNull() | (F.col(on) < F.col("_first"))).select(old.columns).unionByName(fresh.select(old.columns))


def conflicts(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of keys with one value (once each), and the keys with several, which belong nowhere."""
    rows = df.distinct()
    several = rows.groupBy(*key).count().where("count > 1").select(*key, F.col("count").alias("n_values"))
    return rows.join(several.select(*key), key, "left_anti").select(df.columns), several


def table_diff(a: DataFrame, b: DataFrame, key: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """For each value column: rows on either side only, and among common keys those equal within a relative tolerance, changed, and null on one side."""
    both = a.select(*key, F.lit(True).alias("_a"), *(F.col(v).alias(f"a_{v}") for v in values)).join(b.select(*key, F.lit(True).alias("_b"), *(F.col(v).alias(f"b_{v}") for v in values)), key, "outer")
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(f"a_{v}").cast("double").alias("x"), F.col(f"b_{v}").cast("double").alias("y")) for v in values))).alias("p")
    rows = both.select("_a", "_b", pairs).select("_a", "_b", "p.*")
    common = F.col("_a") & F.col("_b")
    near = F.col("x").eqNullSafe(F.col("y")) | F.coalesce(F.abs(F.col("x") - F.col("y")) <= tolerance * F.greatest(F.abs("x"), F.abs("y")), F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("name").agg(n(F.col("_b").isNull()).alias("only_a"), n(F.col("_a").isNull()).alias("only_b"), n(common & near).alias("same"), n(common & ~near & F.col("x").isNotNull() & F.col("y").isNotNull()).alias("changed"), n(common & (F.col("x").isNull() != F.col("y").isNull())).alias("null_on_one_side"))


def split_adjusted(df: DataFrame, key: str, on: str, price: str, factor: str) -> DataFrame:
    """df with adjusted: the price times the product of all later factors of its key (null factors are 1)."""
    w = Window.partitionBy(key).orderBy(F.col(on).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("adjusted", F.col(price) * F.coalesce(F.product(F.coalesce(F.col(factor), F.lit(1.0))).over(w), F.lit(1.0)))


def book_ratios(panel: DataFrame, entity: str, year: str, quarter: str, disclosed: str, factor: Column | None = None) -> DataFrame:
    """panel with what an entity's disclosures say about cash, flows, growth from within, dividends and shares; null where a part is missing.

    panel: cash, cfo, cfi, cff (since the year's start), roe and payout (percent), sales_ttm, equity, dps, bps, shares, and standard (the
    accounting standard). factor brings shares and bps to today's units (the splits since the disclosure). cash_last is the last cash of
    this and the three disclosures before; cash_chg1 and cash_chg2 its symmetric change on the one known before, and that one's own.
    Changes on the year go to the same quarter of the entity's fiscal year before among those that it has; _p1 is the same a year earlier.
    """
    f = F.lit(1.0) if factor is None else F.coalesce(factor.cast("double"), F.lit(1.0))
    by, same = Window.partitionBy(entity).orderBy(disclosed, year, quarter), Window.partitionBy(entity, quarter).orderBy(year)
    recent = lambda c: F.last(c, ignorenulls=True).over(by.rowsBetween(-3, 0))
    known = Window.partitionBy(entity, F.col("cash").isNull()).orderBy(disclosed, year, quarter)
    earlier = lambda k: F.when(F.col("cash").isNotNull(), F.lag("cash", k).over(known))
    growth, turnover = F.col("roe") * (1 - F.col("payout") / 100), F.when(F.col("equity") > 0, F.col("sales_ttm") / F.col("equity"))
    out = panel.withColumns({"_c1": earlier(1), "_c2": earlier(2), "sustainable_growth": clip_to_null(growth, -500, 500), "equity_turnover": clip_to_null(turnover, 0, 100), "_shares": F.col("shares") * f, "_bps": F.col("bps") / f, "_fcf": F.col("cfo") + F.col("cfi")})
    out = out.withColumns({"cash_last": recent("cash"), "_c1": recent("_c1"), "_c2": recent("_c2")})
    new = {"cash_chg1": symmetric_change(F.col("cash_last"), F.col("_c1")), "cash_chg2": symmetric_change(F.col("_c1"), F.col("_c2"))}
    for c in ("sustainable_growth", "equity_turnover"):
        new |= {f"{c}_chg1": F.col(c) - F.lag(c).over(by), f"{c}_chg2": F.lag(c).over(by) - F.lag(c, 2).over(by)}
    back = lambda c, k: F.lag(c, k).over(same) if k else F.col(c)
    for c, name in (("cfo", "cfo"), ("_fcf", "fcf"), ("cfi", "cfi"), ("cff", "cff"), ("dps", "dividend")):
        new |= {f"{name}_yoy{p}": symmetric_change(back(c, k), back(c, k + 1)) for k, p in ((0, ""), (1, "_p1"))}
    for c, name, low, high in (("_bps", "bps", -100, 300), ("_shares", "shares", -50, 200)):
        new |= {f"{name}_yoy{p}": clip_to_null(F.when(back(c, k + 1) > 0, (back(c, k) - back(c, k + 1)) / back(c, k + 1) * 100), low, high) for k, p in ((0, ""), (1, "_p1"))}
    new |= {"dividend_up": (F.col("dps") > F.lag("dps").over(same)).cast("double"), "foreign_standard": F.when(F.col("standard").isin("JP", "IFRS", "US", "Foreign"), (F.col("standard") != "JP").cast("double"))}
    return out.withColumns(new).drop("_c1", "_c2", "_shares", "_bps", "_fcf")
