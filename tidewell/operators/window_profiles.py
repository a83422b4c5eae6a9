"""Volume by price over windows of sessions, in one pass over each key's trades in the order of its sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import ship

#: Bins of sessions, each in every window that holds it, that are sorted at once.
AT_ONCE = 1 << 20


def scan_profiles(trades: DataFrame, bars: DataFrame, key: str, on: str, price: str, shares: str, spans: tuple[int, ...], width: float, area: float | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, on and c of each bar, and for each span n of its key's sessions up to it shares_n, vwap_n, poc_n, above_n and near_n, and with ``area`` top_n, low_n and high_n.

    poc is the fullest bin (the lower of two), above and near are the shares in per cent above and within 2 % of the close, top those of the fullest bin,
    low and high the ends of the value area. A window that is not full, or without trades, has nulls. Bars' columns of ``carry`` are summed over
    the windows too (<name>_n, null unless all are known).

    Trades and bars are shuffled once, by key; a task reads them in order and keeps the sessions of the longest window only, however long a key is.
    """
    none = lambda kind: F.lit(None).cast(kind)
    marks = bars.select(key, on, F.lit(True).alias("_bar"), F.col("c").cast("double").alias("c"), none("long").alias("_b"), none("double").alias("_s"), none("double").alias("_a"), *(F.col(x).cast("double").alias(x) for x in carry))
    sold = trades.select(key, on, F.lit(False).alias("_bar"), none("double").alias("c"), F.floor(F.col(price) / width).cast("long").alias("_b"), F.col(shares).cast("double").alias("_s"), (F.col(price) * F.col(shares)).cast("double").alias("_a"), *(none("double").alias(x) for x in carry))
    before = Window.partitionBy(key).orderBy(on, F.col("_bar").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.union(sold.where("_s IS NOT NULL")).where(F.col(key).isNotNull() & F.col(on).isNotNull())
    rows = rows.withColumns({"_i": F.count_if("_bar").over(before), "_at": F.max(F.when(F.col("_bar"), F.col(on))).over(before)}).where(F.col("_bar") | (F.col("_at") == F.col(on))).drop("_at")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["shares", "vwap", "poc", "above", "near", *(("top", "low", "high") if area is not None else ()), *carry]
    kind = ", ".join([f"`{key}` {kinds[key]}", f"`{on}` {kinds[on]}", "c double", *(f"`{x}_{n}` {'long' if x in ('poc', 'low', 'high') else 'double'}" for n in spans for x in names)])
    ship(bars.sparkSession)
    return rows.mapInArrow(_scan(key, on, spans, width, area, list(carry)), kind)


def _value_area(b: np.ndarray, s: np.ndarray, first: np.ndarray, last: np.ndarray, top: np.ndarray, total: np.ndarray, area: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest bin of each window's value area (see profile.value_area()). b and s: bins and what they hold; first, last and top: places in b."""
    i, j, lo, hi, held = top.copy(), top.copy(), b[top], b[top], s[top].copy()
    left = np.arange(len(top))
    while len(left):
        under, over = np.maximum(i[left] - 1, 0), np.minimum(j[left] + 1, len(b) - 1)
        can_fall, can_rise = i[left] > first[left], j[left] < last[left]
        beside, above = b[under] == lo[left] - 1, b[over] == hi[left] + 1
        below = np.where(can_fall, np.where(beside, s[under], 0.0), -1.0)
        more = np.where(can_rise, np.where(above, s[over], 0.0), -1.0)
        go = (held[left] < area * total[left]) & (can_fall | can_rise)
        down = go & (below >= more)
        up = go & ~down
        for move, near, at, place, edge, sign in ((down, beside, under, i, lo, 1), (up, above, over, j, hi, -1)):
            take, skip = move & near, move & ~near
            place[left[take]], edge[left[take]] = at[take], b[at[take]]
            held[left[take]] += s[at[take]]
            edge[left[skip]] = b[at[skip]] + sign  # over bins that hold nothing, up to the next that is there
        left = left[go]
    return lo, hi


def _scan(key: str, on: str, spans: tuple[int, ...], width: float, area: float | None, carry: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    longest = max(spans)

    def windows(lo: int, hi: int, i: np.ndarray, c: np.ndarray, bins: dict[str, np.ndarray]) -> list[pa.Array]:
        """The columns of the bars lo to hi; i and c are theirs. Sorted by bar, bins hold those of all bars that they need."""
        rows = np.arange(np.searchsorted(bins["bar"], lo - longest + 1), np.searchsorted(bins["bar"], hi))
        age = np.tile(np.arange(longest), len(rows))
        rows = np.repeat(rows, longest)
        w = bins["bar"][rows] + age
        ok = (w >= lo) & (w < hi)
        rows, age, w = rows[ok], age[ok], w[ok] - lo
        ok = age < i[w]
        rows, age, w = rows[ok], age[ok], w[ok]
        values, rank = np.unique(bins["b"][rows], return_inverse=True)
        rank = np.where(bins["known"][rows], rank, len(values))  # trades without a price are a bin of their own
        order = np.argsort(w * (len(values) + 1) + rank, kind="stable")
        rows, age, w, rank = rows[order], age[order], w[order], rank[order]
        out = []
        for n in spans:
            full = (age < n) & (i[w] >= n)
            r, ww, kk = rows[full], w[full], rank[full]
            starts = np.flatnonzero(np.r_[True, (ww[1:] != ww[:-1]) | (kk[1:] != kk[:-1])]) if len(r) else np.zeros(0, np.int64)
            have, made = np.zeros(hi - lo, bool), {}
            if len(r):
                s, a, n_a = (np.add.reduceat(bins[x][r], starts) for x in ("s", "a", "n_a"))
                ww, kk = ww[starts], kk[starts]
                known = kk < len(values)
                b = values[np.minimum(kk, len(values) - 1)]
                first = np.flatnonzero(np.r_[True, ww[1:] != ww[:-1]])
                at = ww[first]
                last = np.r_[first[1:], len(ww)] - 1
                total, close = np.add.reduceat(s, first), c[ww]
                best = np.lexsort((np.where(known, -kk, -len(values) - 1), s, ww))[last]
                middle = (b + 0.5) * width
                part = lambda x: np.add.reduceat(np.where(known & x, s, 0.0), first)
                have[at] = True
                with np.errstate(divide="ignore", invalid="ignore"):
                    made = {"shares": (total, True), "vwap": (np.add.reduceat(a, first) / total, (np.add.reduceat(n_a, first) > 0) & (total != 0)), "poc": (b[best], known[best])}
                    made |= {"above": (part(middle > close) / total * 100, total != 0), "near": (part((middle >= close * 0.98) & (middle <= close * 1.02)) / total * 100, total != 0)}
                    if area is not None:
                        low, high = _value_area(b, s, first, np.where(known[last], last, last - 1), best, total, area)
                        made |= {"top": (s[best] / total * 100, total != 0), "low": (low, known[best]), "high": (high, known[best])}
            for x in ["shares", "vwap", "poc", "above", "near", *(("top", "low", "high") if area is not None else ())]:
                column, there = np.zeros(hi - lo, np.int64 if x in ("poc", "low", "high") else np.float64), have.copy()
                if x in made:
                    column[at], there[at] = made[x][0], made[x][1]
                out.append(pa.array(column, mask=~there))
            out += [None] * len(carry)
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, on, "c", *(f"{x}_{n}" for n in spans for x in ["shares", "vwap", "poc", "above", "near", *(("top", "low", "high") if area is not None else ()), *carry])]
        empty = {"bar": np.int64, "b": np.int64, "known": bool, "s": np.float64, "a": np.float64, "n_a": np.int64}
        bins, seen, done, kept = {x: np.zeros(0, t) for x, t in empty.items()}, 0, 0, 0  # bars so far, given out, and the first that is kept
        held: pa.Table | None = None

        def give(upto: int) -> Iterator[pa.RecordBatch]:
            i, c = held["_i"].to_numpy(), held["c"].to_numpy(zero_copy_only=False)
            x = np.stack([held[name].to_numpy(zero_copy_only=False).astype(np.float64) for name in carry], 1) if carry else None
            step = max(1, AT_ONCE * (upto - done) // max(1, len(bins["bar"]) * longest))
            for lo in range(done, upto, step):
                hi = min(lo + step, upto)
                columns = windows(lo, hi, i[lo - kept : hi - kept], c[lo - kept : hi - kept], bins)
                if carry:
                    for m, n in enumerate(spans):
                        rolled = np.full((hi - lo, len(carry)), np.nan)
                        full = np.flatnonzero(i[lo - kept : hi - kept] >= n)
                        rolled[full] = x[(full + lo - kept)[:, None] - np.arange(n)[::-1]].sum(1)
                        end = (m + 1) * (len(columns) // len(spans))
                        columns[end - len(carry) : end] = [pa.array(r, mask=np.isnan(r)) for r in rolled.T]
                rows = held.slice(lo - kept, hi - lo)
                yield pa.RecordBatch.from_arrays([*(rows[n].combine_chunks() for n in (key, on, "c")), *columns], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            bar = table["_bar"].to_numpy()
            at, sold = seen + np.cumsum(bar) - 1, ~bar
            known, n_a = table["_b"].is_valid().to_numpy()[sold], table["_a"].is_valid().to_numpy()[sold]
            new = {"bar": at[sold], "b": table["_b"].fill_null(0).to_numpy()[sold], "known": known, "s": table["_s"].fill_null(0.0).to_numpy()[sold], "a": table["_a"].fill_null(0.0).to_numpy()[sold], "n_a": n_a.astype(np.int64)}
            bins = {x: np.concatenate([bins[x][bins["bar"] >= kept], new[x]]) for x in empty}
            order = np.lexsort((bins["known"], bins["b"], bins["bar"]))
            bins = {x: v[order] for x, v in bins.items()}
            if len(order):  # one row for each bin of a session
                same = np.r_[True, (bins["bar"][1:] != bins["bar"][:-1]) | (bins["b"][1:] != bins["b"][:-1]) | (bins["known"][1:] != bins["known"][:-1])]
                starts = np.flatnonzero(same)
                bins = {x: np.add.reduceat(v, starts) if x in ("s", "a", "n_a") else v[starts] for x, v in bins.items()}
            own = table.select([key, on, "c", "_i", *carry]).filter(table["_bar"])
            held = own if held is None else pa.concat_tables([held, own])
            seen += int(bar.sum())
            if done < seen - 1:  # the last bar's trades may go on
                yield from give(seen - 1)
                done = seen - 1
                held, kept = held.slice(max(kept, done - longest + 1) - kept).combine_chunks(), max(kept, done - longest + 1)
        if held is not None and done < seen:
            yield from give(seen)

    return scan
