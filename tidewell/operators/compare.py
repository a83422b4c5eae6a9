"""Profiles over windows of sessions, shapes of past cases, comparisons of definitions, and scores out of fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.frames import Frames
from tidewell.operators.quantiles import percentiles
from tidewell.operators.window_profiles import scan_profiles


def profile_windows(trades: DataFrame, bars: DataFrame, key: str, on: str, price: str, shares: str, spans: tuple[int, ...], width: float, area: float | None = None) -> DataFrame:
    """For each bar and span of its key's sessions up to it: shares, vwap, poc (middle of the fullest bin, the lower of two), and the share above and within 2 % of the close.

    With ``area`` also value_low and value_high (value_area()), poc_share in percent and c, the close.

    Sessions are the key's own bars; a window that is not full has no row. See scan_profiles().
    """
    rows = scan_profiles(trades, bars, key, on, price, shares, spans, width, area)
    ends = ("top", "low", "high") if area is not None else ()
    each = F.array(*(F.struct(F.lit(n).alias("span"), *(F.col(f"{x}_{n}").alias(x) for x in ("shares", "vwap", "poc", "above", "near", *ends))) for n in spans))
    out = rows.select(key, on, "c", F.explode(F.filter(each, lambda w: w["shares"].isNotNull())).alias("w")).select(key, on, "w.*", "c").withColumn("poc", (F.col("poc") + 0.5) * width)
    if area is None:
        return out.drop("c")
    return out.select(key, on, "span", "shares", "vwap", "poc", "above", "near", (F.col("low") * width).alias("value_low"), ((F.col("high") + 1) * width).alias("value_high"), F.col("top").alias("poc_share"), "c")


#: What profile_features() says of each window, and the parts of a session.
PROFILE_METRICS = ("poc_gap", "vwap_gap", "value_low_gap", "value_high_gap", "poc_share", "above_close_share", "near_close_share")
SESSION_PARTS = ("opening", "morning", "afternoon", "closing")


def profile_features(trades: DataFrame, sessions: DataFrame, bars: DataFrame, key: str, on: str, price: str, shares: str, spans: tuple[int, ...], width: float, area: float = 0.7) -> DataFrame:
    """A row for each bar: of its profile over each span of sessions (profile_windows()) eleven features, named <feature>_<span>d.

    Gaps of poc, vwap and the value area's ends to the close, the shares of the fullest bin, over and near the close, and the shares that traded at
    the opening, in the morning, in the afternoon and at the close (auction_sessions()), all as parts of 1. A span of which a
    session has no trades or an invalid one has none.
    """
    day = bars.select(key, on, "c").join(sessions.where("status = 'ok'").select(key, on, *SESSION_PARTS), [key, on], "left")
    out = scan_profiles(trades, day, key, on, price, shares, spans, width, area, SESSION_PARTS)
    gap = lambda v: v / F.col("c") - 1

    def metric(m: str, n: int) -> Column:
        at = lambda x: F.col(f"{x}_{n}")
        return {"poc_gap": gap((at("poc") + 0.5) * width), "vwap_gap": gap(at("vwap")), "value_low_gap": gap(at("low") * width), "value_high_gap": gap((at("high") + 1) * width), "poc_share": at("top") / 100, "above_close_share": at("above") / 100, "near_close_share": at("near") / 100}[m]

    whole = {n: sum((F.col(f"{part}_{n}") for part in SESSION_PARTS), F.lit(0.0)) for n in spans}  # null unless all sessions are there
    columns = [F.when(whole[n] > 0, metric(m, n)).alias(f"{m}_{n}d") for n in spans for m in PROFILE_METRICS]
    columns += [F.when(whole[n] > 0, F.col(f"{part}_{n}") / whole[n]).alias(f"{part}_share_{n}d") for n in spans for part in SESSION_PARTS]
    return out.select(key, on, *columns)


def reconciled(profile: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """bars' keys with status: ok, volume (off by over 0.01), turnover (over 1), range (a price outside of the bar), missing, or unexpected.

    profile: keys, shares, amount, low, high; bars: keys, v, va, l, h.
    """
    both = bars.select(*keys, "v", "va", "l", "h", F.lit(True).alias("_b")).join(profile.select(*keys, "shares", "amount", "low", "high", F.lit(True).alias("_p")), keys, "outer")
    status = F.when(F.col("_p").isNull(), "missing").when(F.col("_b").isNull(), "unexpected").when(F.abs(F.col("shares") - F.col("v")) > 0.01, "volume").when(F.abs(F.col("amount") - F.col("va")) > 1, "turnover").when((F.col("low") < F.col("l") - 1e-9) | (F.col("high") > F.col("h") + 1e-9), "range").otherwise("ok")
    return both.select(*keys, status.alias("status"))


def quantile_vector(values: Column, levels: int) -> Column:
    """``levels`` quantiles of an array at (i + 0.5) / levels, linear between its sorted values; null for an empty array."""
    def points(s: Column) -> Column:
        n = F.size(s)
        at = lambda i: (i + 0.5) / levels * (n - 1)
        below = lambda i: F.get(s, F.floor(at(i)).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: below(i) + (at(i) - F.floor(at(i))) * (F.get(s, F.ceil(at(i)).cast("int")) - below(i)))

    # as the one element of an array, the sorted values are made once for each row
    return F.when(F.size(values) > 0, F.get(F.transform(F.array(F.array_sort(values)), points), F.lit(0)))


def case_shapes(bars: DataFrame, f: Frames, rows: int, least: int, levels: int) -> DataFrame:
    """bars with shape (quantiles of the last returns, on their mean and deviation) and flow (of log volume on its mean); null under ``least`` values."""
    out = bars.withColumns({"_r": F.log(F.col("c")) - F.log(f.lag(F.col("c"))), "_v": F.when(F.col("v") > 0, F.log("v"))})
    w = f.trailing(rows)
    out = out.withColumns({"_rs": F.collect_list("_r").over(w), "_m": F.avg("_r").over(w), "_sd": F.stddev_pop("_r").over(w), "_vs": F.collect_list("_v").over(w), "_vm": F.avg("_v").over(w)})
    shape = F.when((F.size("_rs") >= least) & (F.col("_sd") > 0), quantile_vector(F.transform("_rs", lambda x: (x - F.col("_m")) / F.col("_sd")), levels))
    flow = F.when(F.size("_vs") >= least, quantile_vector(F.transform("_vs", lambda x: x - F.col("_vm")), levels))
    return out.withColumns({"shape": shape, "flow": flow}).drop("_r", "_v", "_rs", "_m", "_sd", "_vs", "_vm")


def pair_scale(cases: DataFrame, key: str, vector: str, pairs: int, seed: int = 0) -> DataFrame:
    """scale: the median distance (mean absolute difference) of about ``pairs`` pairs of cases, drawn by a hash: neighbours in its order.

    A stated number of pairs, of which each case is in two at most: no case meets all others.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    some = cases.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("_v"), h.alias("_h")).orderBy("_h").limit(2 * pairs)
    number = some.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h")) - 1)  # 2 * pairs rows
    two = number.groupBy(F.floor(F.col("_n") / 2).alias("_p")).agg(F.min_by("_v", "_n").alias("_a"), F.max_by("_v", "_n").alias("_b"), F.count("*").alias("_m")).where("_m = 2")
    distance = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("_a")
    return two.agg(F.count("*").alias("n_pairs"), F.percentile(distance, 0.5).alias("scale"))


def scaled_states(df: DataFrame, key: str, columns: list[str], clip: tuple[float, float] = (0.01, 0.99), most: float = 6.0) -> DataFrame:
    """df with each column clipped to its key's quantiles, as asinh on the key's quartile range, less the mean on the deviation, within ``most``."""
    points = percentiles(df, [key], columns, [clip[0], 0.25, 0.75, clip[1]])
    out = df.join(points.select(key, *(F.col(c).alias(f"_q_{c}") for c in columns)), key)
    for c in columns:
        q = F.col(f"_q_{c}")
        half = (q[2] - q[1]) / 2
        out = out.withColumn(f"_t_{c}", F.when(F.col(c).isNotNull(), F.asinh(F.least(F.greatest(F.col(c), q[0]), q[3]) / F.when(half > 1e-12, half).otherwise(1.0))))
    w = Window.partitionBy(key)
    for c in columns:
        t = F.col(f"_t_{c}")
        sd = F.stddev_pop(t).over(w)
        z = (t - F.avg(t).over(w)) / sd
        out = out.withColumn(f"z_{c}", F.when(t.isNotNull() & (sd > 0), F.least(F.greatest(z, F.lit(-most)), F.lit(most))))
    return out.drop(*(f"_q_{c}" for c in columns), *(f"_t_{c}" for c in columns))


def one_factor_at_a_time(base: dict[str, float], changes: dict[str, list[float]]) -> list[dict[str, float]]:
    """The base, and each change of one value of it."""
    return [base, *({**base, k: v} for k, values in changes.items() for v in values if v != base[k])]


def definitions(df: DataFrame, configs: list[dict[str, float]], rise: str, end: str) -> DataFrame:
    """For each definition of a label (need: the rise to reach, end_need: where to end, both in the returns' units): rows, rate, and means of the end where it holds and where not.

    All definitions are counted in one pass over the rows.
    """
    parts = []
    for i, c in enumerate(configs):
        known = F.col(rise).isNotNull() & F.col(end).isNotNull()
        label = (F.col(rise) >= c["need"]) & (F.col(end) >= c["end_need"])
        parts.append(F.struct(F.lit(i).alias("config"), F.lit(c["need"]).cast("double").alias("need"), F.lit(c["end_need"]).cast("double").alias("end_need"), F.count_if(known).alias("n"), F.avg(F.when(known, label.cast("double"))).alias("rate"), F.avg(F.when(known & label, F.col(end))).alias("end_if"), F.avg(F.when(known & ~label, F.col(end))).alias("end_else")).alias(f"_{i}"))
    return df.agg(*parts).select(F.explode(F.array(*(f"_{i}" for i in range(len(configs))))).alias("r")).select("r.*")


def out_of_fold(df: DataFrame, fold: str, x: str, y: str) -> DataFrame:
    """df with oof: y by the line through x that is fitted to all other folds. Sums by fold, of which each fold's are taken away: one pass, one small join."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = known.groupBy(fold).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    every = sums.agg(*(F.sum(c).alias(f"t_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")))
    rest = sums.join(F.broadcast(every)).select(fold, *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    lines = rest.select(fold, slope.alias("_slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("_base"))
    return df.join(F.broadcast(lines), fold, "left").withColumn("oof", F.col("_base") + F.col("_slope") * F.col(x)).drop("_slope", "_base")


def fixed_folds(days: DataFrame, on: str, first_test: str, test_months: int, train_months: int, folds: int, embargo_days: int) -> DataFrame:
    """fold, train_from, train_to (without), test_from, test_to (without) and rows of each: a training window of fixed length before each test."""
    start = F.add_months(F.lit(first_test).cast("date"), F.col("fold") * test_months)
    grid = days.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    plan = grid.select("fold", F.add_months(F.date_sub(start, embargo_days), -train_months).alias("train_from"), F.date_sub(start, embargo_days).alias("train_to"), start.alias("test_from"), F.add_months(start, test_months).alias("test_to"))
    d = days.groupBy(F.col(on).alias("_d")).agg(F.count("*").alias("_n"))
    train, test = ((F.col("_d") >= F.col(f"{k}_from")) & (F.col("_d") < F.col(f"{k}_to")) for k in ("train", "test"))
    side = d.join(F.broadcast(plan), train | test)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    return side.groupBy("fold", "train_from", "train_to", "test_from", "test_to").agg(n(train).alias("n_train"), n(test).alias("n_test"))


def fetch_order(keys: DataFrame, fetched: DataFrame, key: str, at: str, budget: int) -> DataFrame:
    """The keys to fetch next, ``budget`` of them: those never fetched first, then the longest ago."""
    last = fetched.groupBy(key).agg(F.max(at).alias("last"))
    return keys.select(key).distinct().join(last, key, "left").orderBy(F.col("last").asc_nulls_first(), key).limit(budget)


def aligned(parts: list[DataFrame], ids: list[str]) -> DataFrame:
    """The parts together by name; id columns that are of different types become text, whole numbers without a decimal point."""
    text = lambda p, c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "") if p.schema[c].dataType.simpleString() in ("double", "float") else F.col(c).cast("string")
    differ = [c for c in ids if len({p.schema[c].dataType.simpleString() for p in parts if c in p.columns}) > 1]
    out = None
    for p in parts:
        p = p.withColumns({c: text(p, c) for c in differ if c in p.columns}) if differ else p
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def by_day_json(df: DataFrame, on: str, order: list[str], columns: list[str]) -> DataFrame:
    """on, n and json: the rows of each day as one JSON array, in order. A day's rows should be few: candidates, not bars."""
    rows = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("r"))))
    return df.groupBy(on).agg(F.count("*").alias("n"), F.to_json(F.transform(rows, lambda x: x["r"])).alias("json"))


def hash_check(content: DataFrame, manifest: DataFrame, key: str, text: str, digest: str) -> DataFrame:
    """key and state of what a manifest names: ok, changed, missing; and extra for what it doesn't."""
    have = content.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("_h"), F.lit(True).alias("_c"))
    both = have.join(manifest.select(key, F.col(digest).alias("_d"), F.lit(True).alias("_m")), key, "outer")
    return both.select(key, F.when(F.col("_m").isNull(), "extra").when(F.col("_c").isNull(), "missing").when(F.col("_h").eqNullSafe(F.col("_d")), "ok").otherwise("changed").alias("state"))
