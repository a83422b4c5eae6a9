"""Summaries: rates by group, ladders of thresholds, statistics of returns and trades, overlaps of sets, and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.quantiles import aggregated, percentiles


def key_choices(df: DataFrame, choices: dict[str, list[str]]) -> DataFrame:
    """For each choice of key: rows, distinct rows, and distinct keys, which a key must equal that tells all rows apart."""
    one = df.agg(F.count("*").alias("n"), F.countDistinct(F.struct(*df.columns)).alias("d"), *(F.countDistinct(F.struct(*key)).alias(f"k{i}") for i, key in enumerate(choices.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col("n").alias("n_rows"), F.col("d").alias("n_distinct"), F.col(f"k{i}").alias("n_keys")) for i, name in enumerate(choices)))).alias("r")).select("r.*")


def missing_by(df: DataFrame, by: Column, columns: list[str]) -> DataFrame:
    """period, name and share: how much of each column is missing."""
    per = df.groupBy(by.alias("period")).agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return per.select("period", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("share")) for c in columns))).alias("r")).select("period", "r.*")


def label_rates(df: DataFrame, groups: list[str], label: str, value: str) -> DataFrame:
    """Rows, labelled rows, the rate and quartiles of value for each group, each subtotal and over all (null stands for all)."""
    # a cube by hand: the bit of a group that stands for all is set
    levels = df.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 ** len(groups) - 1).cast("long"))))
    levels = levels.withColumns({g: F.when(F.shiftright("level", len(groups) - 1 - i) % 2 == 0, F.col(g)) for i, g in enumerate(groups)})
    plain = [F.count("*").alias("n"), F.count(label).alias("n_known"), F.avg(F.col(label).cast("double")).alias("rate")]
    return aggregated(levels, [*groups, "level"], plain, {"q25": (value, 0.25), "q50": (value, 0.5), "q75": (value, 0.75)})


def coverage(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows and, for each column, how many hold a value and their median, for each group."""
    return aggregated(df, by, [F.count("*").alias("n"), *(F.count(c).alias(f"n_{c}") for c in columns)], {f"median_{c}": (c, 0.5) for c in columns})


def funnel(df: DataFrame, steps: dict[str, Column], label: str) -> DataFrame:
    """step, name, n and rate: rows left after each condition together with all before it, and the share of label 1 among them. One pass."""
    ok, parts = F.lit(True), []
    for i, (name, condition) in enumerate(steps.items()):
        ok = ok & F.coalesce(condition, F.lit(False))
        parts.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.count_if(ok).alias("n"), F.avg(F.when(ok, F.col(label).cast("double"))).alias("rate")))
    return df.agg(*(p.alias(f"_{i}") for i, p in enumerate(parts))).select(F.explode(F.array(*(f"_{i}" for i in range(len(parts))))).alias("r")).select("r.*")


def ladder(df: DataFrame, value: str, label: str, lines: list[float | None]) -> DataFrame:
    """line, n, share and rate of the rows at or over each line (null: all)."""
    parts = []
    for i, t in enumerate(lines):
        ok = F.lit(True) if t is None else F.coalesce(F.col(value) >= t, F.lit(False))
        parts.append(F.struct(F.lit(t).cast("double").alias("line"), F.count_if(ok).alias("n"), (F.count_if(ok) / F.count("*")).alias("share"), F.avg(F.when(ok, F.col(label).cast("double"))).alias("rate")).alias(f"_{i}"))
    return df.agg(*parts).select(F.explode(F.array(*(f"_{i}" for i in range(len(lines))))).alias("r")).select("r.*")


def returns_of(df: DataFrame, by: list[str], end: str, best: str, hit: float = 0.1) -> DataFrame:
    """n, means and medians of the end and the best return, the share whose best reaches ``hit``, and of those that end under -hit."""
    rate = lambda c: F.avg(c.cast("double"))
    plain = [F.count("*").alias("n"), F.avg(end).alias("end_mean"), F.avg(best).alias("best_mean"), rate(F.col(best) >= hit).alias("hit_share"), rate(F.col(end) < -hit).alias("loss_share")]
    return aggregated(df, by, plain, {"end_median": (end, 0.5), "best_median": (best, 0.5)})


def overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """n, n_a, n_b, both, neither, what both would be if the sets were independent, and the share of each that lies in the other."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    n, x, y, z = F.count("*"), F.count_if(a), F.count_if(b), F.count_if(a & b)
    return df.agg(n.alias("n"), x.alias("n_a"), y.alias("n_b"), z.alias("n_both"), F.count_if(~a & ~b).alias("n_neither"), (x * y / n).alias("expected"), F.try_divide(z, x).alias("b_in_a"), F.try_divide(z, y).alias("a_in_b"))


def matched_series(series: DataFrame, name: str, references: DataFrame, reference: str, on: str, value: str, least: int) -> DataFrame:
    """For each series the reference that it moves with most: best, r, the second's r and the gap. At least so many common days.

    References are few: a day's are one array, which a series' row of that day meets once. Pairs are made of it and summed where rows are
    read, so that what is shuffled is a row for each series, reference and task. A reference's values of one day count by their mean.
    """
    names = [r[0] for r in references.select(reference).where(F.col(reference).isNotNull()).distinct().orderBy(reference).collect()]
    label = F.array(*(F.lit(n) for n in names)) if names else F.array().cast(f"array<{references.schema[reference].dataType.simpleString()}>")
    day = references.where(F.col(value).isNotNull()).groupBy(on).agg(*(F.avg(F.when(F.col(reference) == F.lit(n), F.col(value).cast("double"))).alias(f"_{i}") for i, n in enumerate(names)))
    refs = day.select(on, F.array(*(f"_{i}" for i in range(len(names)))).cast("array<double>").alias("_ys"))
    both = series.where(F.col(value).isNotNull()).select(F.col(name).alias("_of"), on, F.col(value).cast("double").alias("_x")).join(refs, on)
    each = both.select("_of", "_x", F.posexplode("_ys").alias("_i", "_y")).where("_y IS NOT NULL")
    r = each.groupBy("_of", "_i").agg(F.corr("_x", "_y").alias("r"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("r").isNotNull())
    r = r.select(F.col("_of").alias(name), label[F.col("_i")].alias(reference), "r")
    top = r.withColumn("_p", F.row_number().over(Window.partitionBy(name).orderBy(F.col("r").desc(), reference)))
    best = top.groupBy(name).agg(F.max(F.when(F.col("_p") == 1, F.col(reference))).alias("best"), F.max(F.when(F.col("_p") == 1, F.col("r"))).alias("r"), F.max(F.when(F.col("_p") == 2, F.col("r"))).alias("second"))
    return best.withColumn("gap", F.col("r") - F.col("second"))


def complete_ratio(df: DataFrame, on: str, member: str, part: str, whole: str, members: int) -> DataFrame:
    """part over whole in percent, summed over all members, of the days on which enough of them are there."""
    return df.groupBy(on).agg(F.countDistinct(member).alias("n"), F.sum(part).alias("_a"), F.sum(whole).alias("_b")).where(F.col("n") >= members).select(on, "n", F.when(F.col("_b") > 0, F.col("_a").cast("double") / F.col("_b").cast("double") * 100).alias("ratio"))


def flows(df: DataFrame, on: Column, kind: str, value: str, names: list[str]) -> DataFrame:
    """on with total and, for each kind, its sum and its share of the total: a fixed pivot, of one shuffle."""
    per = df.groupBy(on.alias("on")).agg(F.sum(value).alias("total"), *(F.sum(F.when(F.col(kind) == n, F.col(value))).alias(n) for n in names))
    return per.select("on", "total", *(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names), *(F.when(F.col("total") > 0, F.coalesce(F.col(n), F.lit(0)).cast("double") / F.col("total").cast("double") * 100).alias(f"share_{n}") for n in names))


def holders(df: DataFrame, key: str, nested: str, name: str, share: str, classes: dict[str, str]) -> DataFrame:
    """Statistics of an array of records for each row: number, largest, total and concentration of the shares, and the share of holders whose name matches."""
    h = F.filter(nested, lambda x: x[share].isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x[share])
    squares = F.aggregate(h, F.lit(0.0), lambda s, x: s + x[share] * x[share])
    some = F.size(h) > 0
    by_class = {c: total(_matching(h, name, pattern)) for c, pattern in classes.items()}
    return df.select(key, F.size(h).cast("long").alias("n_holders"), F.when(some, F.array_max(F.transform(h, lambda x: x[share]))).alias("largest"), F.when(some, total(h)).alias("total"), F.when(some & (total(h) > 0), squares / (total(h) * total(h))).alias("concentration"), *(F.when(some, v).alias(f"share_{c}") for c, v in by_class.items()))


def _matching(h: Column, name: str, pattern: str) -> Column:
    return F.filter(h, lambda x: x[name].rlike(pattern))


def trade_statistics(df: DataFrame, by: list[str], ret: str, hit: Column, days: int, slots: int, month: int = 21) -> DataFrame:
    """n, mean, median, win, se, hit, worst, trades a month, and the return a month where a trade takes one of ``slots`` parts."""
    known = df.where(F.col(ret).isNotNull())
    months = max(days, 1) / month
    return aggregated(known, by, [
        F.count("*").alias("n"), F.avg(ret).alias("mean"), (F.avg((F.col(ret) > 0).cast("double")) * 100).alias("win"), F.when(F.count("*") > 1, F.stddev_samp(ret) / F.sqrt(F.count("*"))).alias("se"),
        (F.avg(hit.cast("double")) * 100).alias("hit"), F.min(ret).alias("worst"), (F.count("*") / months).alias("per_month"), (F.sum(ret) / slots / months).alias("monthly"),
    ], {"median": (ret, 0.5)})


def session_blocks(days: DataFrame, on: str, length: int, step: int) -> DataFrame:
    """block, first and last: runs of ``length`` sessions, one every ``step``. One row a session is held."""
    d = days.select(on).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(on)) - 1)
    last = F.lead(on, length - 1).over(Window.partitionBy(F.lit(0)).orderBy("_i"))
    return d.withColumn("_last", last).where((F.col("_i") % step == 0) & F.col("_last").isNotNull()).select((F.col("_i") / step).cast("long").alias("block"), F.col(on).alias("first"), F.col("_last").alias("last"))


def place_in(df: DataFrame, by: list[str], value: str, at: Column) -> DataFrame:
    """n, the 10, 50 and 90 % points of value, and where ``at`` (an aggregate or literal) lies: the share under it and half of the share equal to it."""
    x = df.where(F.col(value).isNotNull())
    rank = F.avg(F.when(F.col(value) < at, 100.0).when(F.col(value) == at, 50.0).otherwise(0.0)).alias("rank")
    return aggregated(x, by, [F.count("*").alias("n"), rank], {f"p{int(p * 100)}": (value, p) for p in (0.1, 0.5, 0.9)})


def percentile_table(df: DataFrame, by: list[str], value: str, points: list[float], least: int) -> DataFrame:
    """by, n and the percentiles of value as one array, of groups with enough values."""
    known = df.where(F.col(value).isNotNull())
    found = percentiles(known, by, [value], points).select(*(F.col(k).alias(f"_b_{k}") for k in by), F.col(value).alias("points"))
    return known.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least).join(found, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in by]).select(*by, "n", "points")


def size_buckets(trades: DataFrame, by: list[str], amount: str, edges: tuple[float, float], auction: Column) -> DataFrame:
    """Amounts and numbers of small, medium and large trades outside of auctions, the auctions' amount, and the large ones' share."""
    out = trades.withColumn("_k", F.when(F.coalesce(auction, F.lit(False)), "auction").when(F.col(amount) < edges[0], "small").when(F.col(amount) < edges[1], "medium").otherwise("large"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("_k") == k, F.col(amount))), F.lit(0.0))
    named = ("small", "medium", "large", "auction")
    per = out.groupBy(*by).agg(*(of(k).alias(k) for k in named), *(F.count_if(F.col("_k") == k).alias(f"n_{k}") for k in named))
    open_ = F.col("small") + F.col("medium") + F.col("large")
    return per.withColumn("large_share", F.when(open_ > 0, F.col("large") / open_ * 100))


def density(df: DataFrame, x: str, y: str, x_edges: tuple[float, float, int], y_edges: tuple[float, float, int], least: int) -> DataFrame:
    """Counts on a grid, ends folded in; cells of fewer than ``least`` count as 0, as if they were not to be seen."""
    at = lambda c, e: F.least(F.greatest(F.floor((F.col(c) - e[0]) / ((e[1] - e[0]) / e[2])), F.lit(0)), F.lit(e[2] - 1)).cast("int")
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(at(x, x_edges).alias("bin_x"), at(y, y_edges).alias("bin_y")).agg(F.count("*").alias("n"))
    return cells.withColumn("shown", F.when(F.col("n") >= least, F.col("n")).otherwise(F.lit(0).cast("long")))


def composition_spread(df: DataFrame, fold: str, group: str) -> DataFrame:
    """For each group the smallest and largest share of it in a fold, and their difference. A fold without the group has 0 of it."""
    per = df.groupBy(fold, group).agg(F.count("*").alias("_n"))
    sizes = per.groupBy(fold).agg(F.sum("_n").alias("_total"))
    grid = F.broadcast(sizes).crossJoin(per.select(group).distinct()).join(per, [fold, group], "left")
    share = F.coalesce("_n", F.lit(0)) / F.col("_total")
    return grid.groupBy(group).agg(F.min(share).alias("low"), F.max(share).alias("high")).withColumn("spread", F.col("high") - F.col("low"))


def agreement(columns: list[str], line: float) -> Column:
    """How many of the columns reach the line."""
    return F.size(F.filter(F.array(*columns), lambda x: x >= line)).cast("long")


def ledger(df: DataFrame, on: str, name: str, value: str, names: list[str]) -> DataFrame:
    """on with the last known value of each name up to then, and their total: a fixed pivot, filled forward over the days that occur."""
    per = df.groupBy(on).agg(*(F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.struct(on))).alias(n) for n in names))
    w = Window.partitionBy(F.lit(0)).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    out = per.select(on, *(F.last(n, ignorenulls=True).over(w).alias(n) for n in names))
    return out.withColumn("total", sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0)))


def with_totals(df: DataFrame, by: str, values: dict[str, Column], total: str = "TOTAL") -> DataFrame:
    """The sums for each value of by, and a row of their totals."""
    out = df.rollup(by).agg(*(F.sum(v).alias(n) for n, v in values.items()), F.count("*").alias("n"), F.grouping(by).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, total).otherwise(F.col(by)).alias(by), "n", *values)


def plausibility(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """For each column: values, infinite ones, zeros, those outside of its plausible bounds, and mean and extremes of the finite."""
    parts = []
    for c, (low, high) in bounds.items():
        x = F.col(c).cast("double")
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        ok = F.when(finite, x)
        parts.append(F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.count_if(F.abs(x) == float("inf")).alias("n_inf"), F.count_if(x == 0).alias("n_zero"), F.count_if((ok < low) | (ok > high)).alias("n_outside"), F.avg(ok).alias("mean"), F.min(ok).alias("low"), F.max(ok).alias("high")).alias(f"_{c}"))
    return df.agg(*parts).select(F.explode(F.array(*(f"_{c}" for c in bounds))).alias("r")).select("r.*")


def identities(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each rule a = b: rows where both are known, and the largest relative error."""
    parts = [F.struct(F.lit(n).alias("name"), F.count_if(a.isNotNull() & b.isNotNull()).alias("n"), F.max(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-300))).alias("worst")).alias(f"_{i}") for i, (n, (a, b)) in enumerate(rules.items())]
    return df.agg(*parts).select(F.explode(F.array(*(f"_{i}" for i in range(len(rules))))).alias("r")).select("r.*")


def lag_coverage(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """For each name: rows with the newest value, and of these the percent with each older one."""
    parts = [F.struct(F.lit(n).alias("name"), F.count(c[0]).alias("n"), *(F.try_divide(F.lit(100.0) * F.count_if(F.col(c[0]).isNotNull() & F.col(x).isNotNull()), F.count(c[0])).alias(f"with_{k}") for k, x in enumerate(c[1:], 1))).alias(f"_{i}") for i, (n, c) in enumerate(names.items())]
    return df.agg(*parts).select(F.explode(F.array(*(f"_{i}" for i in range(len(names))))).alias("r")).select("r.*")
