"""Price panels: new highs and fresh breaks, forward outcomes, drawdowns, and the row-frame technical indicators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.frames import Frames, trend
from tidewell.functions.scalar import fill_ratio, gap_percent

#: Rows of the high, share of them that must hold a price, rows without a new high before a fresh break, rows of the outcome.
HIGH_ROWS, COVERAGE, COOLDOWN, HORIZON = 368, 0.5, 20, 20


def bar_columns() -> tuple[Column, ...]:
    """Close, open, high, low, volume and turnover."""
    return tuple(F.col(c) for c in ("c", "o", "h", "l", "v", "va"))


def bars_frames() -> Frames:
    return Frames("code", order="day")


def clean_bars(bars: DataFrame) -> DataFrame:
    """bars with traded, and o, h, l, c, v as an indicator may take them.

    A bar without a finite close over 0 was not traded: its values are null. Other prices that aren't finite and over 0 become the close, high and low take in
    open and close, and a volume that isn't finite and 0 or more becomes 0.
    """
    C, O, H, L, V, _ = bar_columns()
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    price = lambda x: F.when(finite(x) & (x > 0), x).otherwise(C)
    out = bars.withColumns({"traded": finite(C) & (C > 0), "o": price(O), "h": price(H), "l": price(L), "v": F.when(finite(V) & (V >= 0), V).otherwise(0).cast(bars.schema["v"].dataType)})
    out = out.withColumns({"h": F.greatest("h", "o", "c"), "l": F.least("l", "o", "c")})
    return out.withColumns({x: F.when(F.col("traded"), F.col(x)) for x in ("o", "h", "l", "c", "v")})


def over_clean_bars(build: Callable[[DataFrame, Frames], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """build over clean_bars(), in frames of traded rows only: the bars as they came with its columns, null in rows that were not traded."""

    @wraps(build)
    def over(bars: DataFrame) -> DataFrame:
        raw = {f"_raw_{x}": F.col(x) for x in ("o", "h", "l", "c", "v")}
        out = build(clean_bars(bars.withColumns(raw)), Frames("code", "traded", order="day"))
        new = [x for x in out.columns if x not in bars.columns and x not in raw and x != "traded"]
        return out.select(*(F.col(f"_raw_{x}").alias(x) if f"_raw_{x}" in raw else x for x in bars.columns), *(F.when(F.col("traded"), F.col(x)).alias(x) for x in new))

    return over


def price_panel(bars: DataFrame, rows: int = HIGH_ROWS, coverage: float = COVERAGE, cooldown: int = COOLDOWN) -> DataFrame:
    """bars with high_n (largest close of the last ``rows``), prior_high (before this row), new_high and fresh_break.

    A high holds from the row on that is ``rows`` - 1 rows old, if enough of its closes are known. A fresh break is a new
    high with no other in the ``cooldown`` rows before it.
    """
    C, _, _, _, V, _ = bar_columns()
    f = bars_frames()
    r = f.rolls()
    high, volume = r(C, rows, F.max, rows * coverage), r(V, 20)
    out = r.off(r.onto(bars).withColumns({"high_n": F.when(f.row() >= rows, high), "vol_ratio": F.when(volume > 0, V / volume)}))
    out = out.withColumn("prior_high", f.lag(F.col("high_n")))
    out = out.withColumn("new_high", F.coalesce(C > F.col("prior_high"), F.lit(False)))
    recent = F.coalesce(F.max(F.col("new_high").cast("int")).over(f.by.rowsBetween(-cooldown, -1)), F.lit(0))
    return out.withColumn("fresh_break", F.col("new_high") & (recent == 0))


def forward_label(bars: DataFrame, horizon: int = HORIZON, rise: float = 0.1) -> DataFrame:
    """bars with entry (next open), max_ahead, min_ahead, end_close, above_ahead (share of closes over this one) and label.

    All are null unless the whole horizon is known. label: the largest close reaches (1 + rise) * entry and the last is over entry.
    """
    C, O, _, _, _, _ = bar_columns()
    f = bars_frames()
    out = bars.withColumns({"entry": f.lead(O), "max_ahead": f.ahead(C, horizon, F.max), "min_ahead": f.ahead(C, horizon, F.min), "end_close": f.lead(C, horizon)})
    out = out.withColumn("closes", F.when(F.col("max_ahead").isNotNull(), F.collect_list(C).over(f.by.rowsBetween(1, horizon))))
    out = out.withColumn("above_ahead", F.size(F.filter("closes", lambda x: x > C)).cast("long")).drop("closes")
    return out.withColumn("above_ahead", F.when(F.col("max_ahead").isNotNull(), F.col("above_ahead"))).withColumn("label", (F.col("max_ahead") >= F.col("entry") * (1 + rise)) & (F.col("end_close") > F.col("entry")))


def drawdown(bars: DataFrame, rows: int = 120) -> DataFrame:
    """bars with depth (percent below the largest close of the last rows) and high_age (rows since its last occurrence)."""
    C, _, _, _, _, _ = bar_columns()
    f = bars_frames()
    w = f.trailing(rows)
    out = bars.withColumn("i", f.row())
    out = out.withColumn("top", F.max(F.struct(C.alias("c"), F.col("i").alias("i"))).over(w))
    return out.withColumns({"depth": (C / F.col("top.c") - 1) * 100, "high_age": (F.col("i") - F.col("top.i")).cast("long")}).drop("i", "top")


def run_length(df: DataFrame, sign: Column, name: str, f: Frames) -> DataFrame:
    """df with name: how many rows in a row have had this sign, times the sign; null where the sign is."""
    out = df.withColumn("_s", sign).withColumn("_new", F.when(F.lag("_s").over(f.by).eqNullSafe(F.col("_s")), 0).otherwise(1))
    out = out.withColumn("_run", F.sum("_new").over(f.by))
    return out.withColumn(name, (F.count("*").over(Frames(*f.key, "_run", order="day").by) * F.col("_s")).cast("long")).drop("_s", "_new", "_run")


@over_clean_bars
def moving_averages(bars: DataFrame, f: Frames) -> DataFrame:
    """Gaps to, slopes of and ratios between moving averages, their order, and how long the last crossing is ago."""
    C, _, _, _, _, _ = bar_columns()
    sizes = (5, 10, 25, 50, 75, 100, 200)
    out = f.roll(bars, **{f"sma{n}": (C, n, F.avg, None, 0) for n in sizes})
    sma = {n: F.col(f"sma{n}") for n in sizes}
    new = {f"tx_ma_gap_{n}": gap_percent(C, sma[n]) for n in sizes} | {f"tx_ma_slope_{n}": gap_percent(sma[n], f.lag(sma[n], 5)) for n in (25, 75, 200)}
    new |= {f"tx_ma_ratio_{a}_{b}": gap_percent(sma[a], sma[b]) for a, b in ((5, 25), (25, 75), (50, 200))}
    new["tx_perfect_order"] = F.when(sma[200].isNotNull(), (sma[5] > sma[25]).cast("int") + (sma[25] > sma[75]).cast("int") + (sma[75] > sma[200]).cast("int")).cast("double")
    out = run_length(out.withColumns(new), F.signum(sma[25] - sma[75]), "tx_ma_cross_days", f)
    return out.drop(*(f"sma{n}" for n in sizes))


@over_clean_bars
def channels(bars: DataFrame, f: Frames) -> DataFrame:
    """Bollinger, Donchian, stochastic, Williams, Aroon, CCI and Ichimoku positions; the cloud of a day is drawn 25 rows before it."""
    C, _, H, L, _, _ = bar_columns()
    tp = (H + L + C) / 3
    r, smooth = f.rolls(), f.rolls()
    hh, ll = {n: r(H, n, F.max, head=0) for n in (9, 14, 20, 26, 52, 55)}, {n: r(L, n, F.min, head=0) for n in (9, 14, 20, 26, 52, 55)}
    first = {"m20": r(C, 20, head=0), "sd20": r(C, 20, F.stddev_pop, head=0), "fast": 100 * fill_ratio(C - ll[14], hh[14] - ll[14], 0.5), "tp20": r(tp, 20, head=0), "i": f.row(), "ten": (hh[9] + ll[9]) / 2, "kij": (hh[26] + ll[26]) / 2, "sb0": (hh[52] + ll[52]) / 2}
    slow = smooth(F.col("fast"), 3)
    out = smooth.onto(r.onto(bars).withColumns(first))
    out = smooth.off(out.withColumns({"slow": slow})).withColumns({"tps": F.collect_list(tp).over(f.trailing(20)), "top": F.max(F.struct(H.alias("x"), F.col("i"))).over(f.trailing(26)), "low": F.max(F.struct((-L).alias("x"), F.col("i"))).over(f.trailing(26)), "sa": f.lag((F.col("ten") + F.col("kij")) / 2, 25), "sb": f.lag(F.col("sb0"), 25), "c25": f.lag(C, 25)})
    mean_dev = F.aggregate("tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("tp20"))) / 20
    over, under, smoother = F.greatest("sa", "sb"), F.least("sa", "sb"), f.rolls()
    ready = F.col("sa").isNotNull() & F.col("sb").isNotNull()
    new = {
        "tx_bb_pctb": 100 * fill_ratio(C - (F.col("m20") - 2 * F.col("sd20")), 4 * F.col("sd20"), 0.5),
        "tx_bb_width": 100 * fill_ratio(4 * F.col("sd20"), F.col("m20")),
        "tx_donchian_pos_20": 100 * fill_ratio(C - ll[20], hh[20] - ll[20], 0.5),
        "tx_donchian_pos_55": 100 * fill_ratio(C - ll[55], hh[55] - ll[55], 0.5),
        "tx_stoch_k": F.col("slow"),
        "tx_stoch_d": smoother(F.col("slow"), 3),
        "tx_williams_r_14": -100 * fill_ratio(hh[14] - C, hh[14] - ll[14], 0.5),
        "tx_aroon_up_25": F.when(F.col("i") >= 26, 100 * (25 - (F.col("i") - F.col("top.i"))) / 25),
        "tx_aroon_down_25": F.when(F.col("i") >= 26, 100 * (25 - (F.col("i") - F.col("low.i"))) / 25),
        "tx_cci_20": F.when(F.col("i") >= 20, fill_ratio(tp - F.col("tp20"), 0.015 * mean_dev, 0.0)),
        "tx_ichi_tk": (F.col("ten") - F.col("kij")) / C * 100,
        "tx_ichi_kijun_gap": gap_percent(C, F.col("kij")),
        "tx_ichi_cloud_pos": F.when(ready, F.when(C > over, (C - over) / C).when(C < under, (C - under) / C).otherwise(0.0) * 100),
        "tx_ichi_cloud_thick": (F.col("sa") - F.col("sb")) / C * 100,
        "tx_ichi_chikou": gap_percent(C, F.col("c25")),
        "tx_ichi_sanyaku": F.when(ready & F.col("ten").isNotNull() & F.col("kij").isNotNull() & F.col("c25").isNotNull(), (F.col("ten") > F.col("kij")).cast("int") + (C > over).cast("int") + (C > F.col("c25")).cast("int")).cast("double"),
    }
    return smoother.off(r.off(smoother.onto(out).withColumns(new))).drop("m20", "sd20", "fast", "slow", "tp20", "tps", "i", "top", "low", "ten", "kij", "sb0", "sa", "sb", "c25")


@over_clean_bars
def momentum(bars: DataFrame, f: Frames) -> DataFrame:
    """Rates of change, Kaufman efficiency, CMO, DPO, KST, awesome and psychological lines, vortex, choppiness and regression slopes."""
    C, _, H, L, _, _ = bar_columns()
    out = bars.withColumns({"i": f.row(), "pc": f.lag(C), "ph": f.lag(H), "pl": f.lag(L), "mp": (H + L) / 2, "y": F.log(C)})
    d = C - F.col("pc")
    out = out.withColumns({"d": d, "tr": F.greatest(H - L, F.abs(H - F.col("pc")), F.abs(L - F.col("pc"))), "up": F.greatest(d, F.lit(0.0)), "dn": F.greatest(-d, F.lit(0.0)), **{f"roc{n}": gap_percent(C, f.lag(C, n)) for n in (10, 15, 20, 30)}})
    r = f.rolls()
    total = lambda x, n: r(x, n, F.sum, head=1)
    up, dn, tr = (r(F.col(x), 14, F.sum, head=0) for x in ("up", "dn", "tr"))  # greatest() passes the first row's null over
    i = F.col("i")

    def regression(k: int) -> tuple[Column, Column, Column]:
        """Covariance of time and log close, variance of time, variance of log close."""
        return r(F.col("y"), k, trend, head=0), F.lit((k * k - 1) / 12.0), r(F.col("y"), k, F.var_pop, head=0)

    c20, v20, _ = regression(20)
    c60, v60, y60 = regression(60)
    new = {f"tx_roc_{k}": gap_percent(C, f.lag(C, k)) for k in (10, 60, 120, 250)} | {
        "tx_kaufman_er_20": fill_ratio(F.abs(C - f.lag(C, 20)), r(F.abs(F.col("d")), 20, F.sum, head=1), 0.0),
        "tx_cmo_14": 100 * fill_ratio(up - dn, up + dn, 0.0),
        "tx_dpo_20": (f.lag(C, 11) - r(C, 20, head=0)) / C * 100,
        "tx_kst": r(F.col("roc10"), 10, head=10) + 2 * r(F.col("roc15"), 10, head=15) + 3 * r(F.col("roc20"), 10, head=20) + 4 * r(F.col("roc30"), 15, head=30),
        "tx_awesome_osc": (r(F.col("mp"), 5, head=0) - r(F.col("mp"), 34, head=0)) / C * 100,
        "tx_psy_12": F.when(i > 12, 100 * r((F.col("d") > 0).cast("int"), 12, F.sum, head=1) / 12),
        "tx_vortex_pos_14": fill_ratio(total(F.abs(H - F.col("pl")), 14), tr),
        "tx_vortex_neg_14": fill_ratio(total(F.abs(L - F.col("ph")), 14), tr),
        "tx_linreg_slope_20": c20 / v20 * 100,
        "tx_linreg_slope_60": c60 / v60 * 100,
        "tx_linreg_r2_60": fill_ratio(c60 * c60, v60 * y60, 0.0),
        "tx_chop_14": F.when(i > 14, 100 * F.log10(fill_ratio(tr, r(H, 14, F.max, head=0) - r(L, 14, F.min, head=0))) / F.log10(F.lit(14.0))),
    }
    return r.off(r.onto(out).withColumns(new)).drop("i", "pc", "ph", "pl", "mp", "y", "d", "tr", "up", "dn", "roc10", "roc15", "roc20", "roc30")


@over_clean_bars
def volatility(bars: DataFrame, f: Frames) -> DataFrame:
    """Standard deviations of returns, downside deviation, Parkinson range volatility, the ulcer index and ratios between horizons."""
    C, _, H, L, _, _ = bar_columns()
    out = f.roll(bars, top14=(C, 14, F.max, None, 0)).withColumns({"r": gap_percent(C, f.lag(C)), "hl": F.pow(F.log(H / L), 2), "dd": F.pow(gap_percent(C, F.col("top14")), 2)})
    out = out.withColumn("down", F.pow(F.least("r", F.lit(0.0)), 2))
    r = f.rolls()
    s5, s20, s60, s120 = (r(F.col("r"), n, F.stddev_samp, head=1) for n in (5, 20, 60, 120))
    new = {"vol_5": s5, "vol_20": s20, "tx_vol_60": s60, "vol_ratio_5_20": fill_ratio(s5, s20), "vol_ratio_20_120": fill_ratio(s20, s120), "semi_20": F.sqrt(r(F.col("down"), 20, head=0)), "tx_vol_parkinson_20": F.sqrt(r(F.col("hl"), 20, head=0) / F.lit(4 * 0.6931471805599453)) * 100, "tx_ulcer_14": F.sqrt(r(F.col("dd"), 14, head=13))}
    return r.off(r.onto(out).withColumns(new)).drop("top14", "r", "hl", "dd", "down")


@over_clean_bars
def volume(bars: DataFrame, f: Frames) -> DataFrame:
    """On-balance and money flows, volume-weighted gaps, volume ratios and turnover ratios."""
    C, _, H, L, V, VA = bar_columns()
    tp, rng = (H + L + C) / 3, H - L
    out = bars.withColumns({"i": f.row(), "d": C - f.lag(C), "ptp": f.lag(tp)})
    sign = F.coalesce(F.signum("d"), F.lit(0.0))
    out = out.withColumns({"sv": sign * V, "mfv": fill_ratio((C - L) - (H - C), rng, 0.0) * V, "pos": F.when(tp > F.col("ptp"), tp * V).otherwise(0.0), "neg": F.when(tp < F.col("ptp"), tp * V).otherwise(0.0)})
    out = out.withColumns({"obv": f.total(F.col("sv")), "ad": f.total(F.col("mfv"))})
    r = f.rolls()
    total, i = (lambda x, n: r(x, n, F.sum, head=0)), F.col("i")
    v20, ret = total(V, 20), F.coalesce(F.col("d") / (C - F.col("d")), F.lit(0.0))
    out = out.withColumn("ret", ret)
    upv, dnv, eqv = (F.when(c, V).otherwise(0.0) for c in (F.col("d") > 0, F.col("d") < 0, F.col("d") == 0))
    new = {
        "tx_obv_chg_20": F.when(i > 20, 100 * fill_ratio(total(F.col("sv"), 20), v20)),
        "tx_obv_ma_gap": 100 * fill_ratio(F.col("obv") - r(F.col("obv"), 20, head=0), v20),
        "tx_ad_ma_gap": 100 * fill_ratio(F.col("ad") - r(F.col("ad"), 20, head=0), v20),
        "tx_cmf_20": fill_ratio(total(F.col("mfv"), 20), v20),
        "tx_mfi_14": F.when(i > 14, 100 * fill_ratio(total(F.col("pos"), 14), total(F.col("pos"), 14) + total(F.col("neg"), 14), 0.5)),
        "tx_vwap_gap_20": gap_percent(C, fill_ratio(total(tp * V, 20), v20)),
        "tx_vwap_gap_60": gap_percent(C, fill_ratio(total(tp * V, 60), total(V, 60))),
        "tx_pvt_chg_20": F.when(i > 20, fill_ratio(total(F.col("ret") * 100 * V, 20), v20)),
        "tx_vr_25": F.when(i > 25, F.least(100 * fill_ratio(total(upv + eqv / 2, 25), total(dnv + eqv / 2, 25), 10.0), F.lit(1000.0))),
        "tx_vol_osc_5_20": gap_percent(r(V, 5, head=0), r(V, 20, head=0)),
        "tx_vol_ratio_60_250": fill_ratio(r(V, 60, head=0), r(V, 250, head=0)),
        "tx_up_vol_share_20": F.when(i > 20, 100 * fill_ratio(total(upv, 20), v20)),
        "tx_tv_ratio_20_120": fill_ratio(r(VA, 20), r(VA, 120)),
    }
    return r.off(r.onto(out).withColumns(new)).drop("i", "d", "ptp", "sv", "mfv", "pos", "neg", "obv", "ad", "ret")


@over_clean_bars
def candles(bars: DataFrame, f: Frames) -> DataFrame:
    """Shapes of single bars and of the last few, and streaks."""
    C, O, H, L, _, _ = bar_columns()
    rng = H - L
    out = bars.withColumns({"i": f.row(), "po": f.lag(O), "pc": f.lag(C), "ph": f.lag(H), "pl": f.lag(L), "rng": rng})
    up = (C > O) & (C > F.col("pc")) & (H > F.col("ph")) & (L > F.col("pl"))
    out = out.withColumns({"step": up.cast("int"), "bull": (C > O) & (F.col("pc") < F.col("po")) & (C > F.col("po")) & (O < F.col("pc")), "bear": (C < O) & (F.col("pc") > F.col("po")) & (C < F.col("po")) & (O > F.col("pc"))})
    r = f.rolls()
    new = {
        "tx_body_ratio": fill_ratio(C - O, rng, 0.0),
        "tx_upper_shadow": fill_ratio(H - F.greatest(O, C), rng, 0.0),
        "tx_lower_shadow": fill_ratio(F.least(O, C) - L, rng, 0.0),
        "tx_bull_share_20": 100 * r((C > O).cast("int"), 20),
        "tx_body_mean_20": r(fill_ratio(F.abs(C - O), rng, 0.0), 20),
        "tx_bop_14": r(fill_ratio(C - O, rng, 0.0), 14),
        "tx_gap_up_count_20": F.when(F.col("i") > 20, r((L > F.col("ph")).cast("int"), 20, F.sum)).cast("double"),
        "tx_engulfing": F.when(F.col("i") > 1, F.col("bull").cast("int") - F.col("bear").cast("int")).cast("double"),
        "tx_nr7": F.when(F.col("i") > 6, (rng <= r(F.col("rng"), 7, F.min)).cast("int")).cast("double"),
        "tx_three_soldiers": F.when(F.col("i") > 3, ((F.col("step") == 1) & (f.lag(F.col("step"), 1) == 1) & (f.lag(F.col("step"), 2) == 1)).cast("int")).cast("double"),
    }
    out = run_length(r.off(r.onto(out).withColumns(new)), F.signum(C - O), "tx_candle_streak", f)
    return run_length(out, F.signum(C - F.col("pc")), "tx_close_streak", f).drop("i", "po", "pc", "ph", "pl", "rng", "step", "bull", "bear")
