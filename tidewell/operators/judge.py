"""Evaluation beyond ranks: tests, splits and folds, reports with lift, resampled differences, calibration by bands, and fitted transforms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import evaluate
from tidewell.operators.quantiles import percentiles
from tidewell.session import ship

#: Sessions of an embargo as calendar days.
CALENDAR = 1.45


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided binomial test that a win is as likely as a loss; null without any. Ties count for neither.

    Terms are taken from the middle outwards, as multiples of the middle one, over their sum: 0.5 ** n would be 0 from n = 1,075 on. Beyond 20 roots of n
    from the middle a multiple is under exp(-800), which is 0 as a double.
    """
    n, k = (wins + losses).cast("long"), F.greatest(wins, losses).cast("long")
    half = F.ceil(n / 2)
    # each term from the one before: C(n, i + 1) = C(n, i) (n - i) / (i + 1)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("tail"))
    step = lambda a, i: F.struct((a["term"] * (n - i) / (i + 1)).alias("term"), (a["upper"] + a["term"]).alias("upper"), (a["tail"] + F.when(i >= k, a["term"]).otherwise(0.0)).alias("tail"))
    last = F.least(n, half + F.ceil(20 * F.sqrt(n)))
    # the lower half mirrors the upper one; of an even n the middle is in both
    p = F.aggregate(F.sequence(half, last), start, step, lambda a: 2 * a["tail"] / (2 * a["upper"] - (1 - n % 2)))
    return F.when(n > 0, F.least(p, F.lit(1.0)))


def holdout(df: DataFrame, on: str, months: int, embargo: int) -> DataFrame:
    """df with part: train, embargo or test, the last ``months`` being the test."""
    last = F.broadcast(df.agg(F.add_months(F.max(on), -months).alias("_test")))
    out = df.join(last)
    days = int(round(embargo * CALENDAR))
    return out.withColumn("part", F.when(F.col(on) >= F.col("_test"), "test").when(F.col(on) > F.date_sub("_test", days), "embargo").otherwise("train")).drop("_test")


def stratified_folds(df: DataFrame, strata: list[list[str]], key: str, folds: int, seed: int = 0) -> DataFrame:
    """df with fold: rows are dealt in turn within a stratum, in the order of a hash of the key.

    strata: column lists from fine to coarse. A row takes the finest stratum that has ``folds`` rows or more; the last takes all.
    """
    out, which = df, F.lit(len(strata) - 1)
    for i in reversed(range(len(strata) - 1)):
        which = F.when(F.count("*").over(Window.partitionBy(*strata[i])) >= folds, F.lit(i)).otherwise(which)
    name = F.coalesce(*(F.when(F.col("_w") == i, F.concat_ws("|", F.lit(str(i)), *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in strata[i]))) for i in range(len(strata))))
    out = out.withColumn("_w", which).withColumn("stratum", name)
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return out.withColumn("fold", (F.row_number().over(order) - 1) % folds).drop("_w")


def time_folds(df: DataFrame, on: str, folds: int, embargo: int) -> DataFrame:
    """fold, test_from (without), test_to, train_to and the rows of each side: windows of equally many rows, all before for training."""
    day = F.datediff(on, F.lit("1970-01-01").cast("date"))
    edges = df.agg(F.percentile(day, [k / (folds + 1) for k in range(1, folds + 2)])).first()[0]
    at = [math.floor(e) for e in edges]
    grid = df.sparkSession.createDataFrame([(i, at[i], at[i + 1], at[i] - int(round(embargo * CALENDAR))) for i in range(folds)], "fold int, a int, b int, t int")
    rows = df.select(day.alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    side = rows.join(F.broadcast(grid), (F.col("d") <= F.col("t")) | ((F.col("d") > F.col("a")) & (F.col("d") <= F.col("b"))))
    date = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return side.groupBy("fold", "a", "b", "t").agg(n(F.col("d") <= F.col("t")).alias("n_train"), n(F.col("d") > F.col("a")).alias("n_test")).select("fold", date("a").alias("test_from"), date("b").alias("test_to"), date("t").alias("train_to"), "n_train", "n_test")


def report(df: DataFrame, by: list[str], score: str, label: str, percents: tuple[float, ...] = (1.0, 5.0, 10.0)) -> DataFrame:
    """For each group n, base rate, average precision, AUC, and for each percent the precision of the best (ties by expectation) and its lift. A missing score ranks last."""
    low = F.min(score).over(Window.partitionBy(*by)) - 1
    d = df.where(F.col(label).isNotNull()).withColumn(score, F.coalesce(F.col(score), low, F.lit(0.0)))
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("base"))
    out = out.join(evaluate.average_precision(d, by, score, label), by, "left").join(evaluate.auc(d, by, score, label).select(*by, "auc"), by, "left")
    sized = d.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    for p in percents:
        k = F.greatest(F.floor(F.col("_n") * p / 100), F.lit(1))
        top = _top(sized.withColumn("_k", k), by, score, label).withColumnRenamed("precision", f"precision_{p:g}")
        out = out.join(top, by, "left").withColumn(f"lift_{p:g}", F.when(F.col("base") > 0, F.col(f"precision_{p:g}") / F.col("base")))
    return out


def _top(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    order, tied = Window.partitionBy(*by).orderBy(F.col(score).desc()), Window.partitionBy(*by, score)
    out = df.select(*by, "_k", F.col(label).cast("double").alias("_t"), F.rank().over(order).alias("_r"), F.count("*").over(tied).alias("_m"))
    weight = F.greatest(F.least((F.col("_k") - F.col("_r") + 1) / F.col("_m"), F.lit(1.0)), F.lit(0.0))
    return out.groupBy(*by).agg((F.sum(weight * F.col("_t")) / F.sum(weight)).alias("precision"))


def interval(draws: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """The mean of the draws and the interval that holds ``share`` of them."""
    edge = (1 - share) / 2
    return draws.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, edge).alias("low"), F.percentile(value, 1 - edge).alias("high"), F.avg((F.col(value) > 0).cast("double")).alias("share_positive"))


def _weights(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Poisson(1) counts of each key in each draw, from a hash: 0 as drawn is 1 of each."""
    x = keys[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(draws, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x ^ (x >> np.uint64(31))) / 2.0**64
    edges = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    out = np.searchsorted(edges, u, side="right")
    out[:, 0] = 1
    return out


def bootstrap_precision(df: DataFrame, score: str, label: str, key: str, draws: int, seed: int = 0, ranges: int = 64) -> DataFrame:
    """draw (0: as observed) and average_precision of score when rows are drawn with replacement (Poisson counts by a hash of the key).

    Rows are put into ranges of score, best first. One pass sums each range's weights by draw, a second goes on from these: what is
    shuffled is the table, once, whatever the number of draws. Rows without a score or label are left out.
    """
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"), F.xxhash64(key).alias("k"))
    cuts = sorted(set(d.agg(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []), reverse=True)
    part = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: F.col("s") <= c)) if cuts else F.lit(0)
    d = d.withColumn("part", part)

    def sums(table: pa.Table) -> pa.Table:
        w = _weights(table["k"].to_numpy().view(np.uint64), draws, seed)
        y = table["y"].to_numpy()
        n = [int(v) for v in w.sum(0)], [int(v) for v in (w * y[:, None]).sum(0)]
        return pa.table({"part": pa.array([table["part"][0].as_py()] * draws, pa.int32()), "draw": pa.array(range(draws), pa.int32()), "n": pa.array(n[0], pa.int64()), "p": pa.array(n[1], pa.int64())})

    def areas(key: tuple, table: pa.Table, before: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"draw": pa.array([], pa.int32()), "area": pa.array([], pa.float64())})
        table = table.sort_by([("s", "descending")])
        w = _weights(table["k"].to_numpy().view(np.uint64), draws, seed)
        wp = w * table["y"].to_numpy()[:, None]
        n0, p0 = np.zeros(draws), np.zeros(draws)
        at = before["draw"].to_numpy()
        n0[at], p0[at] = before["n0"].to_numpy(), before["p0"].to_numpy()
        s = table["s"].to_numpy()
        last = np.flatnonzero(np.append(s[1:] != s[:-1], True))  # tied scores count together
        cn, cp = np.cumsum(w, 0)[last] + n0, np.cumsum(wp, 0)[last] + p0
        gain = np.diff(np.vstack([p0, cp]), axis=0)
        area = np.where(cn > 0, gain * cp / np.maximum(cn, 1), 0.0).sum(0)
        return pa.table({"draw": pa.array(range(draws), pa.int32()), "area": pa.array(area, pa.float64())})

    ship(df.sparkSession)
    per = d.groupBy("part").applyInArrow(sums, "part int, draw int, n long, p long")
    ahead = Window.partitionBy("draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("part", "draw", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}0") for c in "np"))
    total = per.groupBy("draw").agg(F.sum("p").alias("p"))
    area = d.groupBy("part").cogroup(before.groupBy("part")).applyInArrow(areas, "draw int, area double").groupBy("draw").agg(F.sum("area").alias("area"))
    return area.join(total, "draw").select("draw", F.when(F.col("p") > 0, F.col("area") / F.col("p")).alias("average_precision"))


def paired_difference(df: DataFrame, score: str, reference: str, label: str, key: str, draws: int, seed: int = 0) -> DataFrame:
    """draw and diff: the average precision of score less that of the reference, on the same draws."""
    a = bootstrap_precision(df, score, label, key, draws, seed)
    b = bootstrap_precision(df, reference, label, key, draws, seed).withColumnRenamed("average_precision", "_b")
    return a.join(b, "draw").select("draw", (F.col("average_precision") - F.col("_b")).alias("diff"))


def band_of(score: Column, bands: list[tuple[float, str]]) -> Column:
    """The name of the first band whose upper edge the score does not exceed, the last for any over all."""
    out = F.when(score.isNull(), None)
    for high, name in bands[:-1]:
        out = out.when(score <= high, name)
    return out.otherwise(bands[-1][1])


def cluster_error(df: DataFrame, by: list[str], value: str, cluster: str) -> DataFrame:
    """n, clusters, mean and its standard error with rows of one cluster taken together (with G / (G - 1)): sums by cluster, then by group."""
    known = df.where(F.col(value).isNotNull())
    per = known.groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    per = per.withColumn("_mean", F.sum("_s").over(w) / F.sum("_n").over(w))
    g = F.count("*")
    return per.groupBy(*by).agg(F.sum("_n").alias("n"), g.alias("clusters"), F.first("_mean").alias("mean"), F.when(g >= 2, F.sqrt(F.sum(F.pow(F.col("_s") - F.col("_n") * F.col("_mean"), 2)) * g / (g - 1)) / F.sum("_n")).alias("error"))


def area_between(df: DataFrame, by: list[str], value: str, recent: Column) -> DataFrame:
    """w1, down and up: the area between the distributions of recent and earlier values of each group, where recent ones lie lower, and where higher."""
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"), recent.cast("int").alias("_q"))
    per = d.groupBy(*by, "_x").agg(F.sum("_q").alias("_a"), F.sum(1 - F.col("_q")).alias("_b"))
    w, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_x")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.sum("_a").over(so_far) / F.sum("_a").over(w) - F.sum("_b").over(so_far) / F.sum("_b").over(w)
    per = per.withColumns({"_d": gap, "_w": F.lead("_x").over(order) - F.col("_x")})
    area = lambda c: F.coalesce(F.sum(c * F.col("_w")), F.lit(0.0))
    return per.groupBy(*by).agg(area(F.abs("_d")).alias("w1"), area(F.greatest("_d", F.lit(0.0))).alias("down"), area(F.greatest(-F.col("_d"), F.lit(0.0))).alias("up"), F.sum("_a").alias("n_recent"), F.sum("_b").alias("n_before"))


def fitted(train: DataFrame, kinds: dict[str, str], clip: tuple[float, float] = (0.001, 0.999)) -> dict[str, tuple[Column, Column | None]]:
    """For each column a transform fitted on the training rows, and a flag of missing values where training had some.

    Kinds: clip (to the quantiles), asinh (of the value on half the quartile range), log (of 1 + the value, negative ones as 0), each filled with its
    median; mode and max fill with these; a number fills with itself. Two passes over the training rows.
    """
    quantiles = percentiles(train, [], list(kinds), [clip[0], 0.25, 0.5, 0.75, clip[1]]).first()
    ends = train.agg(*(F.max(c).alias(f"_max_{c}") for c in kinds), *(F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in kinds)).first()
    modes = {}
    for c, kind in kinds.items():
        if kind == "mode":
            row = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), c).first()
            modes[c] = row[0] if row else 0.0
    out = {}
    for c, kind in kinds.items():
        low, q1, middle, q3, high = quantiles[c] or [None, 0.0, 0.0, 0.0, None]
        x, fill = F.col(c).cast("double"), middle
        if kind == "clip" and low is not None:
            x = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
        elif kind == "asinh":
            scale = (q3 - q1) / 2 if (q3 - q1) / 2 > 1e-12 else 1.0
            x, fill = F.asinh(x / scale), math.asinh(middle / scale)
        elif kind == "log":
            x, fill = F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0)))), math.log1p(max(middle, 0.0))
        elif kind == "mode":
            fill = modes[c]
        elif kind == "max":
            fill = ends[f"_max_{c}"] or 0.0
        elif kind not in ("clip",):
            fill = float(kind)
        out[c] = (F.coalesce(x, F.lit(float(fill))), F.col(c).isNull().cast("int") if ends[f"_null_{c}"] else None)
    return out


def unusual(df: DataFrame, columns: list[str], by_sample: DataFrame | None = None) -> DataFrame:
    """df with distance: Mahalanobis' distance from the mean of the sample (all rows by default), null where a column is unknown.

    One pass for means and covariances, whose inverse is a d by d matrix of the driver's.
    """
    sample = df if by_sample is None else by_sample
    known = sample.dropna(subset=columns)
    d = len(columns)
    row = known.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d))).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    inverse = np.linalg.pinv(cov)
    x = [F.col(c).cast("double") - F.lit(row[f"m{i}"]) for i, c in enumerate(columns)]
    total = sum((x[i] * x[j] * float(inverse[i, j]) for i in range(d) for j in range(d)), F.lit(0.0))
    return df.withColumn("distance", F.sqrt(F.greatest(total, F.when(total.isNotNull(), 0.0))))


def exits(bars: DataFrame, horizon: int, gain: float, loss: float) -> DataFrame:
    """bars with what a rule makes of a buy at the next open: out at the first close over ``gain`` or more than ``loss`` under its best so far, else at the horizon.

    Adds held (rows), result (percent), best and fall (the largest drop from the best close until then); null while the horizon is open.
    """
    by = Window.partitionBy("code").orderBy("day")
    out = bars.withColumns({"entry": F.lead("o").over(by), "_c": F.collect_list("c").over(by.rowsBetween(1, horizon))})
    start = F.struct(F.lit(0).alias("n"), F.col("entry").alias("top"), F.lit(0.0).alias("fall"), F.col("entry").alias("last"), F.lit(False).alias("out"))

    def step(a: Column, c: Column) -> Column:
        top = F.greatest(a["top"], c)
        fall = F.greatest(a["fall"], 1 - c / top)
        leave = (c >= F.col("entry") * (1 + gain)) | (c < top * (1 - loss))
        return F.when(a["out"], a).otherwise(F.struct((a["n"] + 1).alias("n"), top.alias("top"), fall.alias("fall"), c.alias("last"), leave.alias("out")))

    out = out.withColumn("_e", F.when((F.size("_c") == horizon) & F.col("entry").isNotNull(), F.aggregate("_c", start, step)))
    return out.withColumns({"held": F.col("_e.n").cast("long"), "result": (F.col("_e.last") / F.col("entry") - 1) * 100, "best": (F.col("_e.top") / F.col("entry") - 1) * 100, "fall": F.col("_e.fall") * 100}).drop("_c", "_e")


def held_states(bars: DataFrame, entries: Column, horizon: int) -> DataFrame:
    """A row for each entry and each of the next rows that it is held: age, ret, best and drop so far, and the last row's change."""
    by = Window.partitionBy("code").orderBy("day")
    out = bars.withColumns({"entry": F.lead("o").over(by), "_c": F.collect_list("c").over(by.rowsBetween(1, horizon)), "_go": entries}).where(F.col("_go") & F.col("entry").isNotNull())
    rows = out.select("code", "day", "entry", "_c", F.posexplode("_c").alias("age", "c"))
    best = F.greatest(F.col("entry"), F.array_max(F.slice("_c", 1, F.col("age") + 1)))
    change = F.when(F.col("age") > 0, (F.col("c") / F.get("_c", F.col("age") - 1) - 1) * 100)
    return rows.select("code", "day", (F.col("age") + 1).cast("long").alias("age"), ((F.col("c") / F.col("entry") - 1) * 100).alias("ret"), ((best / F.col("entry") - 1) * 100).alias("best"), ((1 - F.col("c") / best) * 100).alias("drop"), change.alias("change"))

