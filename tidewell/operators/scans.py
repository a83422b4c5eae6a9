"""Recursive indicators: exponential averages and state machines, one ordered pass for each key.

A recursion has no frame, so these run as a grouped map over a key's rows; a key's history is bounded by its number of days.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewell.operators.panel import clean_bars
from tidewell.session import ship

def ema(x: np.ndarray, alpha: float) -> np.ndarray:
    """e = alpha * x + (1 - alpha) * e before, from the first value that is there; missing before it."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy() if len(x) else x


def span(x: np.ndarray, n: int) -> np.ndarray:
    return ema(x, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return ema(x, 1 / n)


def _div(a: np.ndarray, b: np.ndarray, fill: float = np.nan) -> np.ndarray:
    out = np.full(np.broadcast(a, b).shape, np.nan)
    np.divide(a, b, out=out, where=b != 0)
    return np.where(b == 0, fill, out)


def _roll(x: np.ndarray, n: int, how: str = "mean") -> np.ndarray:
    return getattr(pd.Series(x).rolling(n), how)(**({"ddof": 0} if how == "std" else {})).to_numpy()


def _shift(x: np.ndarray, k: int = 1) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), np.nan), x[: max(0, len(x) - k)]])


def _head(x: np.ndarray, k: int) -> np.ndarray:
    """x, missing in the first k rows."""
    return np.where(np.arange(len(x)) < k, np.nan, x)


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's RSI: averages of rises and falls from the first change on; 50 where nothing moved. Missing in the first n rows."""
    d = x - _shift(x)
    up, down = wilder(np.maximum(d, 0), n), wilder(np.maximum(-d, 0), n)
    out = 100 * _div(up, up + down, 0.5)
    return _head(np.where(np.isnan(out), 50.0, out), n)


def run_length(sign: np.ndarray) -> np.ndarray:
    out, n, last = np.full(len(sign), np.nan), 0, None
    for i, s in enumerate(sign.tolist()):
        n = n + 1 if s == last else 1
        last = s
        out[i] = n * s  # missing where the sign is
    return out


def parabolic(h: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Stop-and-reverse level and trend (1 or -1)."""
    n = len(h)
    level, trend = np.full(n, np.nan), np.ones(n)
    if n == 0:
        return level, trend
    up, at, extreme, speed = True, low[0], h[0], step
    level[0] = at
    for i in range(1, n):
        at = at + speed * (extreme - at)
        before = slice(max(0, i - 2), i)
        at = min(at, low[before].min()) if up else max(at, h[before].max())
        if (low[i] < at) if up else (h[i] > at):
            up, at, extreme, speed = not up, extreme, (low[i] if up else h[i]), step
            at = max(at, h[max(0, i - 1) : i + 1].max()) if not up else min(at, low[max(0, i - 1) : i + 1].min())
        elif (h[i] > extreme) if up else (low[i] < extreme):
            extreme, speed = (h[i] if up else low[i]), min(speed + step, most)
        level[i], trend[i] = at, 1 if up else -1
    return level, trend


def supertrend(h: np.ndarray, low: np.ndarray, c: np.ndarray, atr: np.ndarray, width: float = 3.0) -> np.ndarray:
    """The band on the other side of the trend, from the first row with a range on, where the trend is up if the close is not below the middle.

    A band moves only towards the close while the close before was inside of it; the trend turns when the close leaves the
    band of the row before.
    """
    middle, out = (h + low) / 2, np.full(len(c), np.nan)
    first = np.flatnonzero(~np.isnan(atr))
    if not len(first):
        return out
    top, bottom, i = middle + width * atr, middle - width * atr, int(first[0])
    ceiling, floor, rising = top[i], bottom[i], c[i] >= middle[i]
    out[i] = floor if rising else ceiling
    for i in range(i + 1, len(c)):
        rising = c[i] >= floor if rising else c[i] > ceiling
        ceiling = min(top[i], ceiling) if c[i - 1] < ceiling else top[i]
        floor = max(bottom[i], floor) if c[i - 1] > floor else bottom[i]
        out[i] = floor if rising else ceiling
    return out


def fisher(middle: np.ndarray, n: int = 10) -> np.ndarray:
    """Fisher transform of the smoothed place in the last n rows' range; a smoothed place beyond 0.99 counts as 0.999."""
    high, low = _roll(middle, n, "max"), _roll(middle, n, "min")
    raw, out, x, y = 2 * _div(middle - low, high - low, 0.5) - 1, np.full(len(middle), np.nan), 0.0, 0.0
    for i in np.flatnonzero(~np.isnan(raw)).tolist():
        x = 0.33 * raw[i] + 0.67 * x
        x = x if abs(x) <= 0.99 else np.copysign(0.999, x)
        y = np.arctanh(x) + 0.5 * y
        out[i] = y
    return out


def rank_correlation(c: np.ndarray, n: int) -> np.ndarray:
    """Spearman's correlation of the last n values with time, in percent."""
    out = np.full(len(c), np.nan)
    if len(c) >= n:
        w = np.lib.stride_tricks.sliding_window_view(c, n)
        less = (w[:, :, None] > w[:, None, :]).sum(2) + ((w[:, :, None] == w[:, None, :]).sum(2) - 1) / 2
        r = less - less.mean(1, keepdims=True)
        t = np.arange(n) - (n - 1) / 2
        out[n - 1 :] = 100 * _div(r @ t, np.sqrt((r * r).sum(1) * (t @ t)), 0.0)
    return out


class Key:
    """The bars of one key in the order of days, and what several indicators need of them."""

    def __init__(self, o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray):
        self.o, self.h, self.low, self.c, self.v = o, h, low, c, v
        self.before, self.range, self.middle = _shift(c), h - low, (h + low) / 2
        self.change = c - self.before
        self.true_range = np.fmax(self.range, np.fmax(np.abs(h - self.before), np.abs(low - self.before)))

    def atr(self, n: int) -> np.ndarray:
        return wilder(self.true_range, n)


def averages(k: Key) -> dict[str, np.ndarray]:
    c, v20 = k.c, _roll(k.v, 20)
    macd = span(c, 12) - span(c, 26)
    signal, e3, e13 = span(macd, 9), span(span(span(c, 15), 15), 15), span(c, 13)
    typical = k.h + k.low + c
    flow = np.where(typical > _shift(typical), k.v, -k.v)
    flow[:1] = np.nan
    return {
        "tx_macd": _head(macd / c * 100, 25), "tx_macd_signal": _head(signal / c * 100, 34), "tx_macd_hist": _head((macd - signal) / c * 100, 34), "tx_trix_15": _head((_div(e3, _shift(e3)) - 1) * 100, 44),
        "tx_tsi": _head(100 * _div(span(span(k.change, 25), 13), span(span(np.abs(k.change), 25), 13), 0.0), 38), "tx_elder_bull": _head((k.h - e13) / c * 100, 12), "tx_elder_bear": _head((k.low - e13) / c * 100, 12),
        "tx_force_13": _head(100 * _div(span(k.change * k.v, 13), c * v20), 19), "tx_klinger": _head(_div(span(flow, 34) - span(flow, 55), v20), 55),
    }


def trends(k: Key) -> dict[str, np.ndarray]:
    up, down, atr = k.h - _shift(k.h), _shift(k.low) - k.low, k.atr(14)
    plus, minus = (np.where(np.isnan(up), np.nan, np.where((x > y) & (x > 0), x, 0.0)) for x, y in ((up, down), (down, up)))
    pdi, mdi = 100 * _div(wilder(plus, 14), atr), 100 * _div(wilder(minus, 14), atr)
    level, trend = parabolic(k.h, k.low)
    return {
        "tx_pdi_14": _head(pdi, 14), "tx_mdi_14": _head(mdi, 14), "tx_adx_14": _head(wilder(100 * _div(np.abs(pdi - mdi), pdi + mdi, 0.0), 14), 27), "tx_psar_gap": _head((k.c - level) / k.c * 100, 4), "tx_psar_days": _head(run_length(trend), 4),
        "tx_supertrend_gap": (k.c - supertrend(k.h, k.low, k.c, _head(k.atr(10), 9))) / k.c * 100, "tx_natr_14": _head(atr / k.c * 100, 13), "tx_atr_ratio_14_50": _head(_div(atr, k.atr(50)), 49), "tx_range_atr": _head(_div(k.range, atr), 13),
    }


def strengths(k: Key) -> dict[str, np.ndarray]:
    c, r14 = k.c, rsi(k.c, 14)
    rate, share = (_div(c, k.before) - 1) * 100, np.full(len(c), np.nan)
    if len(c) > 100:
        w = np.lib.stride_tricks.sliding_window_view(rate, 101)
        share[100:] = np.where(np.isnan(w).any(1), np.nan, (w[:, :-1] < w[:, -1:]).sum(1))
    bought, part = c - np.fmin(k.low, k.before), {}
    for n in (7, 14, 28):
        part[n] = _div(_roll(bought, n, "sum"), _roll(k.true_range, n, "sum"), 0.5)
    low, high = _roll(r14, 14, "min"), _roll(r14, 14, "max")
    return {
        "tx_rsi_9": rsi(c, 9), "tx_rsi_14": r14, "tx_rsi_25": rsi(c, 25), "tx_stoch_rsi_14": 100 * _div(r14 - low, high - low, 0.5), "tx_connors_rsi": _head((rsi(c, 3) + rsi(run_length(np.sign(k.change)), 2) + share) / 3, 101),
        "tx_fisher_10": fisher(k.middle), "tx_rci_9": rank_correlation(c, 9), "tx_rci_26": rank_correlation(c, 26), "tx_ultimate_osc": 100 * (4 * part[7] + 2 * part[14] + part[28]) / 7,
    }


def ranges(k: Key) -> dict[str, np.ndarray]:
    c, v, a10, a20 = k.c, k.v, _head(k.atr(10), 9), _head(k.atr(20), 19)
    sd20, m20, middle, e9, spread = _roll(c, 20, "std"), _roll(c, 20), span(c, 20), span(k.range, 9), span(k.range, 10)
    flow = np.cumsum(_div((c - k.low) - (k.h - c), k.range, 0.0) * v)
    with np.errstate(divide="ignore", invalid="ignore"):
        gk = 0.5 * np.log(k.h / k.low) ** 2 - (2 * np.log(2) - 1) * np.log(c / k.o) ** 2
        quiet = np.where(v < _shift(v), np.log1p(np.nan_to_num(c / k.before - 1)), 0.0)
    moved = (k.middle - _shift(k.middle)) / c * 100 * (k.range / c * 100)
    return {
        "tx_keltner_pos": _head(100 * _div(c - (middle - 2 * a10), 4 * a10, 0.5), 19), "tx_squeeze": np.where(np.isnan(sd20) | np.isnan(a20), np.nan, 2 * sd20 < 1.5 * a20), "tx_chaikin_vol_10": _head((_div(spread, _shift(spread, 10)) - 1) * 100, 19),
        "tx_mass_index_25": _head(_roll(_div(e9, span(e9, 9), 1.0), 25, "sum"), 41), "tx_chaikin_osc": _head(_div(span(flow, 3) - span(flow, 10), _roll(v, 10)), 9), "tx_bb_width_rank_120": 100 * pd.Series(_div(4 * sd20, m20) * 100).rolling(120).rank(pct=True).to_numpy(),
        "tx_vol_gk_20": np.sqrt(np.clip(_roll(gk, 20), 0, None)) * 100, "tx_eom_14": _head(_roll(_div(moved, _div(v, _roll(v, 20)), 0.0), 14), 33), "tx_nvi_chg_60": _head((np.exp(_roll(quiet, 60, "sum")) - 1) * 100, 60),
    }


GROUPS = {"averages": averages, "trends": trends, "strengths": strengths, "ranges": ranges}
#: The indicators by group.
COLUMNS = {
    "averages": ("tx_macd", "tx_macd_signal", "tx_macd_hist", "tx_trix_15", "tx_tsi", "tx_elder_bull", "tx_elder_bear", "tx_force_13", "tx_klinger"),
    "trends": ("tx_pdi_14", "tx_mdi_14", "tx_adx_14", "tx_psar_gap", "tx_psar_days", "tx_supertrend_gap", "tx_natr_14", "tx_atr_ratio_14_50", "tx_range_atr"),
    "strengths": ("tx_rsi_9", "tx_rsi_14", "tx_rsi_25", "tx_stoch_rsi_14", "tx_connors_rsi", "tx_fisher_10", "tx_rci_9", "tx_rci_26", "tx_ultimate_osc"),
    "ranges": ("tx_keltner_pos", "tx_squeeze", "tx_chaikin_vol_10", "tx_mass_index_25", "tx_chaikin_osc", "tx_bb_width_rank_120", "tx_vol_gk_20", "tx_eom_14", "tx_nvi_chg_60"),
}


def recursive_indicators(bars: DataFrame, groups: tuple[str, ...] = tuple(GROUPS)) -> DataFrame:
    """code and day of the bars with the COLUMNS of the groups, null where they are not defined yet and in rows that were not traded (clean_bars())."""
    names = [c for g in groups for c in COLUMNS[g]]

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("day")
        traded = np.flatnonzero(rows["traded"].to_numpy())
        columns = [pa.nulls(len(rows), pa.float64()) for _ in names]
        if len(traded):
            key, out = Key(*(rows[x].to_numpy().astype(np.float64)[traded] for x in ("o", "h", "l", "c", "v"))), {}
            for g in groups:
                out |= GROUPS[g](key)
            whole = np.full((len(names), len(rows)), np.nan)
            for i, c in enumerate(names):
                whole[i, traded] = np.where(np.isfinite(out[c]), out[c], np.nan)
            columns = [pa.array(x, pa.float64(), from_pandas=True) for x in whole]
        return pa.Table.from_arrays([rows["code"], rows["day"], *columns], names=["code", "day", *names])

    ship(bars.sparkSession)
    schema = StructType([bars.schema["code"], bars.schema["day"], *(StructField(c, DoubleType()) for c in names)])
    return clean_bars(bars).select("code", "day", "o", "h", "l", "c", "v", "traded").groupBy("code").applyInArrow(work, schema)
