"""Windows over rows of a key and over days: changes, ranks of a day, positions in trailing windows, balances, pools, and growing histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.frames import Frames
from tidewell.functions.scalar import gap_percent, pct_change, safe_ratio
from tidewell.operators.quantiles import percentiles
from tidewell.operators.rank import average_rank, rank_share
from tidewell.session import shared_folder


def forward_any(df: DataFrame, f: Frames, flag: Column, first: int, last: int, needed: int, name: str) -> DataFrame:
    """df with whether the flag is set in one of the next ``first`` to ``last`` rows; null while fewer than ``needed`` rows follow: not false."""
    seen = F.max(F.coalesce(flag, F.lit(False))).over(f.by.rowsBetween(first, last))
    follow = F.count("*").over(f.by.rowsBetween(1, needed))
    return df.withColumn(name, F.when(follow >= needed, F.coalesce(seen, F.lit(False))))


def recent_changes(bars: DataFrame, f: Frames) -> DataFrame:
    """bars with ret_1, ret_2, ret_5 (percent on the close so many rows before), gap_open (open on the close before) and vol_change (volume in percent of the one before)."""
    c, v1 = F.col("c"), f.lag(F.col("v"))
    new = {f"ret_{k}": pct_change(c, f.lag(c, k)) for k in (1, 2, 5)}
    return bars.withColumns(new | {"gap_open": pct_change(F.col("o"), f.lag(c)), "vol_change": F.when(v1 > 0, F.col("v") / v1 * 100)})


def volatility_factors(bars: DataFrame, f: Frames) -> DataFrame:
    """bars with vol_long, vol_short (20-row volatility on the 120-row one, 5-row on 20-row), vol_updown (rises on falls) and vol_gap (gaps on ranges)."""
    c = F.col("c")
    out = bars.withColumns({"_r": c / f.lag(c) - 1, "_gap": F.col("o") / f.lag(c) - 1, "_range": F.when((F.col("h") > 0) & (F.col("l") > 0), F.log(F.col("h") / F.col("l")))})
    up, down = (F.pow(g("_r", F.lit(0.0)), 2) for g in (F.greatest, F.least))
    out = out.withColumns({"_up": F.when(F.col("_r").isNotNull(), up), "_down": F.when(F.col("_r").isNotNull(), down)})
    r = f.rolls()
    sd = lambda x, n, least: r(F.col(x), n, F.stddev_samp, least)
    root = lambda x: F.sqrt(r(F.col(x), 20, F.avg, 15))
    v20 = sd("_r", 20, 20)
    new = {"vol_long": safe_ratio(v20, sd("_r", 120, 90)), "vol_short": safe_ratio(sd("_r", 5, 4), v20), "vol_updown": safe_ratio(root("_up"), root("_down")), "vol_gap": safe_ratio(sd("_gap", 20, 15), sd("_range", 20, 15))}
    return r.off(r.onto(out).withColumns(new)).drop("_r", "_gap", "_range", "_up", "_down")


def day_ranks(df: DataFrame, on: str, score: str, tie: str, deciles: int = 10) -> DataFrame:
    """df with day_rank (best 1, equal scores share the better), n_day, day_share (average rank / n), first_rank (ties by tie) and decile (1 lowest)."""
    w = Window.partitionBy(on)
    best, first, up = (w.orderBy(F.col(score).desc()), w.orderBy(F.col(score).desc(), F.col(tie)), w.orderBy(F.col(score), F.col(tie)))
    some = df.where(F.col(score).isNotNull())
    n = F.count("*").over(w)
    return some.withColumns({"day_rank": F.rank().over(best).cast("long"), "n_day": n, "day_share": rank_share([on], score), "first_rank": F.row_number().over(first).cast("long"), "decile": F.ceil(F.row_number().over(up) / n * deciles).cast("long")})


def day_strata(df: DataFrame, on: str, x: str, bands: int, name: str) -> DataFrame:
    """df with the band of x among its day's equal-frequency bands (edges by linear interpolation, equal ones once)."""
    edges = percentiles(df, [on], [x], [i / bands for i in range(1, bands)]).select(on, F.array_distinct(x).alias("_e"))
    out = df.join(edges, on, "left")
    return out.withColumn(name, F.when(F.col(x).isNotNull(), F.size(F.filter("_e", lambda e: F.col(x) > e))).cast("long")).drop("_e")


def rising_share(columns: list[str]) -> Column:
    """Of the steps from each column (newest first) to the next, the share that rises; null without a known step."""
    steps = F.array_compact(F.array(*(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), (F.col(a) > F.col(b)).cast("int")) for a, b in zip(columns[:-1], columns[1:], strict=True))))
    return F.when(F.size(steps) > 0, F.aggregate(steps, F.lit(0), lambda s, x: s + x) / F.size(steps))


def series_returns(df: DataFrame, key: str, on: str, x: str, spans: tuple[int, ...]) -> DataFrame:
    """df with the percent change of x over so many rows of its key."""
    f = Frames(key, order=on)
    return df.withColumns({f"ret_{k}": gap_percent(F.col(x), f.lag(F.col(x), k)) for k in spans})


def rolling_position(df: DataFrame, f: Frames, x: str, rows: int, least: int, name: str) -> DataFrame:
    """df with the place of x among the last ``rows`` values, itself included: (average rank - 1) / (n - 1). Null under ``least`` values."""
    out = df.withColumn("_w", F.collect_list(x).over(f.trailing(rows)))
    below, equal = F.size(F.filter("_w", lambda v: v < F.col(x))), F.size(F.filter("_w", lambda v: v == F.col(x)))
    n = F.size("_w")
    return out.withColumn(name, F.when(F.col(x).isNotNull() & (n >= least) & (n > 1), (below + (equal + 1) / 2 - 1) / (n - 1))).drop("_w")


def average_volume(bars: DataFrame, f: Frames, name: str, rows: int = 20, least: int = 10) -> DataFrame:
    """bars with the mean volume of the last rows."""
    return f.roll(bars, **{name: (F.col("v"), rows, F.avg, least)})


def balances(df: DataFrame, key: str, on: str, long: str, short: str, fee: str, volume: str, least: dict[str, int], observed: Column | None = None) -> DataFrame:
    """df with the features of two balances: their log ratio and its changes, both and their changes on the average volume (asinh), new balances of five rows, fees, and places in 60 rows.

    least: how many rows of five (new) and of twenty (fee) must be known. Rows that are not observed, days that a grid added, have none.
    """
    f = Frames(key, order=on)
    a, b, v = F.col(long), F.col(short), F.when(F.col(volume) > 0, F.col(volume))
    out = df.withColumn("ratio", F.when(a.isNotNull() & b.isNotNull(), F.log((F.greatest(a, F.lit(0.0)) + 1) / (F.greatest(b, F.lit(0.0)) + 1))))
    per = lambda x: F.asinh(x / v)
    up = lambda x: F.when((x - f.lag(x)).isNotNull(), F.greatest(x - f.lag(x), F.lit(0.0)))
    paid = F.greatest(F.col(fee), F.lit(0.0))
    out = out.withColumns({"_na": up(a), "_nb": up(b), "_paid": F.when(F.col(fee).isNotNull(), paid), "_on": F.when(F.col(fee).isNotNull(), (paid > 0).cast("int"))})
    r = f.rolls()
    new = {f"ratio_chg{n}": F.col("ratio") - f.lag(F.col("ratio"), n) for n in (5, 20)} | {"long_v": per(a), "short_v": per(b), "net_v": per(a - b)}
    new |= {f"{name}_chg{n}_v": per(x - f.lag(x, n)) for name, x in (("long", a), ("short", b)) for n in (5, 20)}
    new |= {"long_new5_v": per(r(F.col("_na"), 5, F.sum, least["new"])), "short_new5_v": per(r(F.col("_nb"), 5, F.sum, least["new"])), "fee": F.log1p("_paid"), "fee_days20": r(F.col("_on"), 20, F.sum, least["fee"]).cast("double"), "fee_max20": F.log1p(r(F.col("_paid"), 20, F.max, least["fee"]))}
    out = r.off(r.onto(out).withColumns(new))
    for x, name in ((long, "long_pos60"), (short, "short_pos60"), ("ratio", "ratio_pos60")):
        out = rolling_position(out, f, x, 60, 20, name)
    names = ["ratio", *new, "long_pos60", "short_pos60", "ratio_pos60"]
    if observed is not None:
        out = out.withColumns({n: F.when(observed, F.col(n)) for n in names})
    return out.drop("_na", "_nb", "_paid", "_on")


def realised_returns(bars: DataFrame, f: Frames, horizons: tuple[int, ...] = (10, 20, 40, 60)) -> DataFrame:
    """bars with the return from the next open, and from this close, to the 5-row mean close of each horizon; entry_gap; and flex: the 20-row one if it is a gain, else the 40-row one."""
    c = F.col("c")
    out = f.roll(bars, _m=(c, 5, F.avg, 1)).withColumns({"entry": f.lead(F.col("o"))})
    new = {f"from_open_{h}": f.lead(F.col("_m"), h) / F.col("entry") - 1 for h in horizons} | {f"from_close_{h}": f.lead(F.col("_m"), h) / c - 1 for h in horizons} | {"entry_gap": F.col("entry") / c - 1}
    out = out.withColumns(new)
    return out.withColumn("flex", F.when(F.col("from_open_20") > 0, F.col("from_open_20")).otherwise(F.col("from_open_40"))).drop("_m")


def pool_rows(candidates: DataFrame, bars: DataFrame, days: DataFrame, key: str, on: str, keep: list[str], k: int = 5) -> DataFrame:
    """The pool of each decision day: candidates of the last k sessions, of each key the latest, with what its price did since.

    Adds decision, age (sessions since), ret, high and low between the candidate's day and the decision. bars: key, on, c, h, l.
    """
    index = days.select(on).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(on)))  # one row a day
    index = F.broadcast(index)
    rows = candidates.select(key, on, *keep).join(index, on).withColumn("_t", F.explode(F.sequence(F.col("_i"), F.col("_i") + k - 1)))
    latest = rows.withColumn("_p", F.row_number().over(Window.partitionBy(key, "_t").orderBy(F.col("_i").desc(), *keep))).where("_p = 1").drop("_p")
    latest = latest.join(index.select(F.col(on).alias("decision"), F.col("_i").alias("_t")), "_t")
    price = bars.select(key, F.col(on).alias("_d"), "c", "h", "l").join(index.select(F.col(on).alias("_d"), F.col("_i").alias("_j")), "_d").drop("_d")
    # each bar meets the pool rows of its key that span it: at most k each
    spans = latest.select(key, "_i", "_t", on, "decision", *keep, F.explode(F.sequence("_i", "_t")).alias("_j")).join(price, [key, "_j"], "left")
    first = F.max(F.when(F.col("_j") == F.col("_i"), F.col("c")))
    change = lambda x: F.when(first > 0, x / first - 1)
    after = F.col("_j") > F.col("_i")
    return spans.groupBy(key, on, "decision", *keep, (F.col("_t") - F.col("_i")).cast("long").alias("age")).agg(change(F.max(F.when(F.col("_j") == F.col("_t"), F.col("c")))).alias("ret"), change(F.max(F.when(after, F.col("h")))).alias("high"), change(F.min(F.when(after, F.col("l")))).alias("low"))


def counts_before(asks: DataFrame, held: DataFrame, groups: list[str], on: str, value: str, weight: str, buckets: int = 256) -> DataFrame:
    """_row, _less, _upto and _all for each row of asks (_row, groups, on, value): what the held rows (groups, on, value, weight) of its group with a smaller ``on`` weigh: those of smaller values, of values not over it, and all.

    Weights may be negative: what is withdrawn later is taken off from then on. The days before a day are a few blocks of 1, 2, 4, 8, ...
    days. Each held row is counted in one block of each length, and each row asks those that make up its past; counts within a block go
    by value, in ranges of the values' quantiles, so that no task holds a whole block. Rows without a value ask for nothing.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(on)  # one row a day
    days = asks.select(on).union(held.select(on)).where(F.col(on).isNotNull()).distinct().withColumn("_d", F.row_number().over(order) - 1)
    levels = max(1, int(days.count()).bit_length())
    edges = sorted(set(held.agg(F.percentile_approx(F.col(value).cast("double"), [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []))
    slot = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e < F.col("_s"))) if edges else F.lit(0)
    placed = lambda df, *more: df.join(F.broadcast(days), on).select(*groups, "_d", F.col(value).cast("double").alias("_s"), *more).where("_s IS NOT NULL").withColumn("_slot", slot)
    known, asked = placed(held, F.col(weight).cast("long").alias("_w")), placed(asks, "_row")
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_level")
    block = F.floor(F.col("_d") / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    place = [*groups, "_level", "_block"]
    per = known.select(*groups, level, "_d", "_slot", "_s", "_w").withColumn("_block", block).groupBy(*place, "_slot", "_s").agg(F.sum("_w").alias("_n"))
    sums = per.groupBy(*place, "_slot").agg(F.sum("_n").alias("_m"))
    # the past of day d: for each bit of d that is set, the block of that length before the bit's place
    asked = asked.select(*groups, "_row", "_d", "_slot", "_s", level).where(block % 2 == 1).withColumn("_block", block - 1)
    both = per.select(*place, "_slot", "_s", F.lit(1).alias("_side"), "_n", F.lit(None).cast("long").alias("_row")).unionByName(asked.select(*place, "_slot", "_s", F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_n"), "_row"))
    inside = Window.partitionBy(*place, "_slot")
    rows_so_far, values_so_far = inside.orderBy("_s", "_side").rowsBetween(Window.unboundedPreceding, 0), inside.orderBy("_s").rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_less": F.sum("_n").over(rows_so_far), "_upto": F.sum("_n").over(values_so_far)}).where("_row IS NOT NULL")
    ahead = Window.partitionBy(*place).orderBy("_slot")
    grid = sums.unionByName(asked.select(*place, "_slot").distinct().withColumn("_m", F.lit(0).cast("long"))).groupBy(*place, "_slot").agg(F.sum("_m").alias("_m"))
    grid = grid.withColumns({"_ahead": F.coalesce(F.sum("_m").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_m").over(Window.partitionBy(*place))})
    grid = grid.select(*(F.col(k).alias(f"_b{k}") for k in (*place, "_slot")), "_ahead", "_all")
    both = found.join(grid, [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in (*place, "_slot")])
    return both.groupBy("_row").agg(F.sum(F.col("_less") + F.col("_ahead")).alias("_less"), F.sum(F.col("_upto") + F.col("_ahead")).alias("_upto"), F.sum("_all").alias("_all"))


def _numbered(df: DataFrame) -> DataFrame:
    """df with _row, a number that does not change."""
    shared_folder(df.sparkSession)
    return df.withColumn("_row", F.monotonically_increasing_id()).checkpoint()


def growing_percentile(df: DataFrame, on: str, score: str, least: int, name: str, buckets: int = 256) -> DataFrame:
    """df with the share, in percent to one decimal, of all scores of earlier days that are smaller; null where fewer than ``least`` are known (counts_before())."""
    rows = _numbered(df)
    counts = counts_before(rows, rows.withColumn("_w", F.lit(1)), [], on, score, "_w", buckets)
    out = rows.join(counts, "_row", "left")
    return out.select(*df.columns, F.when(F.col("_all") >= least, F.round(100.0 * F.col("_less") / F.col("_all"), 1)).alias(name))


def versioned_percentile(facts: DataFrame, bucket: str, key: list[str], on: str, value: str, order: str, least: int = 20) -> DataFrame:
    """facts with pct: the mid-rank of the value among the current versions of all keys of its bucket on earlier days.

    A reissue takes its older version off, in whichever bucket that was, and one without a value withdraws it: a version counts 1 from its
    day on and -1 from the next version's (counts_before()). Rows of one day don't see each other. Null where fewer than
    ``least`` are known. NaN is no value; of versions of one key and day the last by ``order`` stays.
    """
    x = F.col(value).cast("double")
    rows = _numbered(facts.withColumn("_x", F.when(~F.isnan(x), x)))
    until = F.lead(on).over(Window.partitionBy(*key).orderBy(on, order))
    versions = rows.select(bucket, on, "_x", until.alias("_until")).where("_x IS NOT NULL")
    signed = versions.select(bucket, on, "_x", F.lit(1).alias("_w")).union(versions.where("_until IS NOT NULL").select(bucket, F.col("_until").alias(on), "_x", F.lit(-1).alias("_w")))
    out = rows.join(counts_before(rows, signed, [bucket], on, "_x", "_w"), "_row", "left")
    return out.select(*facts.columns, F.when(F.col("_all") >= least, (F.col("_less") + F.col("_upto")) / (2 * F.col("_all"))).alias("pct"))


def lookback(days: DataFrame, on: str, n: int) -> DataFrame:
    """Each session with the first of the n sessions that end with it; none before there are so many."""
    w = Window.partitionBy(F.lit(0)).orderBy(on)
    return days.select(on).distinct().withColumn("first", F.lag(on, n - 1).over(w)).where("first IS NOT NULL")


def cumulative_factors(df: DataFrame, key: str, on: str, factor: str) -> DataFrame:
    """df with upto (product of the key's factors so far) and later (product of those still to come); null factors are 1."""
    w = Window.partitionBy(key).orderBy(on)
    x = F.coalesce(F.col(factor), F.lit(1.0))
    return df.withColumns({"upto": F.product(x).over(w.rowsBetween(Window.unboundedPreceding, 0)), "later": F.coalesce(F.product(x).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))})


def last_value(df: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """The last known value of each key."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, on).alias(value))


def mid_rank(by: list[str], x: str) -> Column:
    """(values under x + half of those equal to it) / n, itself included."""
    return (average_rank(by, x) - 0.5) / F.count(x).over(Window.partitionBy(*by))
