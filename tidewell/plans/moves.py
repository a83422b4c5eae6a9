"""Queries of windows over rows and days, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import panel, windows
from tidewell.plans import bars_sql as sql
from tidewell.plans.choices import _CANDIDATES, candidates
from tidewell.sources.tables import daily_bars, table


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _r(c: str, digits: int = 6):
    return F.round(F.col(c) + 3e-9, digits).alias(c)


def _rounded(x: str, name: str, digits: int = 6) -> str:
    return f"round({x} + 3e-9, {digits}) AS {name}"


def forward_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.price_panel(_bars(spark, sf_dir), rows=60, cooldown=5)
    return windows.forward_any(p, panel.bars_frames(), F.col("fresh_break"), 3, 15, 20, "ahead").select("code", "day", "fresh_break", "ahead")


def base_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.price_panel(_bars(spark, sf_dir), rows=60, cooldown=5)
    since = panel.bars_frames().rows_since(F.col("new_high"))
    return p.withColumn("base", since).where("new_high").select("code", "day", F.col("base").cast("long").alias("base"), F.round((F.col("c") / F.col("prior_high") - 1) * 100 + 3e-9, 6).alias("margin"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.recent_changes(_bars(spark, sf_dir), panel.bars_frames()).select("code", "day", *(_r(c) for c in ("ret_1", "ret_2", "ret_5", "gap_open", "vol_change")))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.volatility_factors(_bars(spark, sf_dir), panel.bars_frames()).select("code", "day", *(_r(c, 5) for c in ("vol_long", "vol_short", "vol_updown", "vol_gap")))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("coarse", F.floor(F.col("p3") / 10))
    return windows.day_ranks(c, "day", "coarse", "id").select("day", "id", "day_rank", "n_day", _r("day_share"), "first_rank", "decile")


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("month", F.trunc("day", "month"))
    return windows.day_strata(c, "month", "p3", 4, "stratum").select("id", "stratum")


def rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).withColumn("p4", F.col("score") / 4000).select("id", F.round(windows.rising_share(["p1", "p2", "p3", "p4"]), 6).alias("share"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.series_returns(_bars(spark, sf_dir), "code", "day", "c", (20, 120)).select("code", "day", _r("ret_20"), _r("ret_120"))


def group_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), (F.col("s_nationkey") % 5).alias("grp"))
    level = _bars(spark, sf_dir).join(F.broadcast(s) if s.count() <= 1_000_000 else s, "code").groupBy("grp", "day").agg(F.avg("c").alias("level"))
    return windows.series_returns(level, "grp", "day", "level", (20, 120)).select("grp", "day", _r("ret_20"), _r("ret_120"))


def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).withColumn("x", F.when(F.col("v") > 5, F.col("v")))
    return windows.rolling_position(b, panel.bars_frames(), "x", 60, 20, "place").select("code", "day", _r("place"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = windows.average_volume(_bars(spark, sf_dir), panel.bars_frames(), "volume")
    return b.select("code", "day", F.round(F.col("volume") + 3e-9, 6).alias("volume"))


_BALANCE_NAMES = ("ratio", "ratio_chg5", "ratio_chg20", "long_v", "short_v", "net_v", "long_chg5_v", "long_chg20_v", "short_chg5_v", "short_chg20_v", "long_new5_v", "short_new5_v", "fee", "fee_days20", "fee_max20", "long_pos60", "short_pos60", "ratio_pos60")


def _balances(spark: SparkSession, sf_dir: str, least: dict[str, int], grid: bool) -> DataFrame:
    b = windows.average_volume(_bars(spark, sf_dir), panel.bars_frames(), "volume")
    b = b.select("code", "day", (F.col("v") * 3).alias("a"), F.when(F.col("v") > 3, F.col("c") / 100).alias("b"), F.when(F.col("v") > 10, F.col("v") - 25).alias("paid"), "volume", F.lit(True).alias("seen"))
    if grid:
        span = b.groupBy("code").agg(F.min("day").alias("x"), F.max("day").alias("y"))
        days = b.select("day").distinct()
        full = F.broadcast(days).join(span, (F.col("day") >= F.col("x")) & (F.col("day") <= F.col("y"))).select("code", "day")  # days are one row each
        b = full.join(b, ["code", "day"], "left")
    out = windows.balances(b, "code", "day", "a", "b", "paid", "volume", least, F.coalesce("seen", F.lit(False)) if grid else None)
    return out.where("seen").select("code", "day", *(_r(c, 5) for c in _BALANCE_NAMES))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balances(spark, sf_dir, {"new": 3, "fee": 10}, False)


def grid_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balances(spark, sf_dir, {"new": 5, "fee": 10}, True)


def _balances_sql(new: int, grid: bool) -> str:
    v, o = "CASE WHEN volume > 0 THEN volume END", sql.over
    s = lambda x, n, least, agg: f"CASE WHEN {o(f'count({x})', 1 - n, 0)} >= {least} THEN {o(f'{agg}({x})', 1 - n, 0)} END"
    per = lambda x: f"asinh(({x}) / ({v}))"
    pos = lambda x: f"CASE WHEN {x} IS NOT NULL AND len(w_{x}) >= 20 THEN (len(list_filter(w_{x}, lambda y: y < {x})) + (len(list_filter(w_{x}, lambda y: y = {x})) + 1) / 2 - 1) / (len(w_{x}) - 1) END"
    columns = {
        "ratio": "ratio", "ratio_chg5": f"ratio - {sql.lag('ratio', 5)}", "ratio_chg20": f"ratio - {sql.lag('ratio', 20)}", "long_v": per("a"), "short_v": per("b"), "net_v": per("a - b"), "long_chg5_v": per(f"a - {sql.lag('a', 5)}"), "long_chg20_v": per(f"a - {sql.lag('a', 20)}"),
        "short_chg5_v": per(f"b - {sql.lag('b', 5)}"), "short_chg20_v": per(f"b - {sql.lag('b', 20)}"), "long_new5_v": per(s("na", 5, new, "sum")), "short_new5_v": per(s("nb", 5, new, "sum")), "fee": "ln(1 + fee)", "fee_days20": s("(fee > 0)::INT", 20, 10, "sum"), "fee_max20": f"ln(1 + ({s('fee', 20, 10, 'max')}))",
        "long_pos60": pos("a"), "short_pos60": pos("b"), "ratio_pos60": pos("ratio"),
    }
    rows = "b0" if not grid else "(SELECT g.code, g.day, b0.* EXCLUDE (code, day) FROM (SELECT code, day FROM (SELECT DISTINCT day FROM b0) d JOIN (SELECT code, min(day) AS x, max(day) AS y FROM b0 GROUP BY code) s ON day BETWEEN x AND y) g LEFT JOIN b0 USING (code, day))"
    return f"""WITH {sql.BARS}, v0 AS (SELECT *, CASE WHEN {o('count(v)', -19, 0)} >= 10 THEN {o('avg(v)', -19, 0)} END AS volume FROM bars),
b0 AS (SELECT code, day, v * 3 AS a, CASE WHEN v > 3 THEN c / 100 END AS b, CASE WHEN v > 10 THEN greatest(v - 25, 0) END AS fee, volume, true AS seen FROM v0),
b1 AS (SELECT *, a - {sql.lag('a')} AS da, b - {sql.lag('b')} AS db FROM {rows}),
b2 AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN ln((greatest(a, 0) + 1) / (greatest(b, 0) + 1)) END AS ratio, CASE WHEN da IS NOT NULL THEN greatest(da, 0) END AS na, CASE WHEN db IS NOT NULL THEN greatest(db, 0) END AS nb FROM b1),
b3 AS (SELECT *, {', '.join(f"{o(f'list({x}) FILTER (WHERE {x} IS NOT NULL)', -59, 0)} AS w_{x}" for x in ('a', 'b', 'ratio'))} FROM b2),
b4 AS (SELECT code, day, seen, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in columns.items())} FROM b3)
SELECT code, day, {', '.join(_rounded(n, n, 5) for n in columns)} FROM b4 WHERE seen"""


def realised(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.realised_returns(_bars(spark, sf_dir), panel.bars_frames())
    return out.select("code", "day", *(_r(f"from_open_{h}") for h in (10, 20, 40, 60)), *(_r(f"from_close_{h}") for h in (10, 20, 40, 60)), _r("entry_gap"), _r("flex"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.price_panel(_bars(spark, sf_dir), rows=40, cooldown=3).where("fresh_break").select("code", "day", "vol_ratio")
    out = windows.pool_rows(p, _bars(spark, sf_dir), _bars(spark, sf_dir), "code", "day", ["vol_ratio"], 5)
    return out.select("code", "day", "decision", _r("vol_ratio"), "age", _r("ret"), _r("high"), _r("low"))


def growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("id", "day", F.round("p3").alias("x"))
    return windows.growing_percentile(c, "day", "x", 50, "pct").select("id", "pct")


def sessions_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.lookback(candidates(spark, sf_dir), "day", 20)


def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).select("code", "day", F.when(F.dayofmonth("day") == 15, 0.5).when(F.dayofmonth("day") == 20, 2.0).alias("factor"))
    return windows.cumulative_factors(b, "code", "day", "factor")


def last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).select("code", "day", F.when(F.col("v") > 40, F.col("c")).alias("x"))
    return windows.last_value(b, "code", "day", "x")


def _panel_sql(rows: int, cooldown: int) -> str:
    return f"""{sql.BARS}, pp AS (SELECT *, CASE WHEN {sql.ROW} >= {rows} AND {sql.over("count(c)", 1 - rows, 0)} >= {rows / 2} THEN {sql.over("max(c)", 1 - rows, 0)} END AS high_n, CASE WHEN {sql.roll("v", 20)} > 0 THEN v / ({sql.roll("v", 20)}) END AS vol_ratio FROM bars),
pq AS (SELECT *, {sql.lag("high_n")} AS prior_high FROM pp), pn AS (SELECT *, coalesce(c > prior_high, false) AS new_high FROM pq),
pf AS (SELECT *, new_high AND NOT coalesce({sql.over("max(new_high)", -cooldown, -1)}, false) AS fresh_break, {sql.ROW} AS i FROM pn)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "forward_any": forward_any, "base_length": base_length, "recent_changes": changes, "volatility_factors": factors, "day_ranks": ranks, "day_strata": strata, "rising_share": rising, "series_returns": returns, "group_returns": group_returns, "rolling_position": position, "average_volume": volumes,
        "margin_balances": balances, "margin_balances_on_grid": grid_balances, "realised_returns": realised, "decision_pool": pool, "growing_percentile": growing, "session_lookback": sessions_back, "cumulative_factors": cumulative, "last_known_value": last_known,
    }


def oracle_sql() -> dict[str, str]:
    c = f"WITH {_CANDIDATES}"
    lead = lambda x, k: f"lead({x}, {k}) OVER (PARTITION BY code ORDER BY day)"
    sd = lambda x, n, least: f"(CASE WHEN {sql.over(f'count({x})', 1 - n, 0)} >= {least} THEN {sql.over(f'stddev_samp({x})', 1 - n, 0)} END)"
    root = lambda x: f"sqrt(CASE WHEN {sql.over(f'count({x})', -19, 0)} >= 15 THEN {sql.over(f'avg({x})', -19, 0)} END)"
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} END"
    return {
        "forward_any": f"WITH {_panel_sql(60, 5)} SELECT code, day, fresh_break, CASE WHEN {sql.over('count(*)', 1, 20)} >= 20 THEN {sql.over('max(fresh_break)', 3, 15)} END AS ahead FROM pf",
        "base_length": f"WITH {_panel_sql(60, 5)} SELECT code, day, base, {_rounded('(c / prior_high - 1) * 100', 'margin')} FROM (SELECT *, i - {sql.over('max(CASE WHEN new_high THEN i END)', 'all', -1)} AS base FROM pf) WHERE new_high",
        "recent_changes": f"WITH {sql.BARS} SELECT code, day, " + ", ".join(_rounded(sql.gap("c", sql.lag("c", k)), f"ret_{k}") for k in (1, 2, 5)) + f", {_rounded(sql.gap('o', sql.lag('c')), 'gap_open')}, {_rounded('v / ' + sql.lag('v') + ' * 100', 'vol_change')} FROM bars",
        "volatility_factors": f"WITH {sql.BARS}, r AS (SELECT *, c / {sql.lag('c')} - 1 AS r, o / {sql.lag('c')} - 1 AS g, ln(h / l) AS x FROM bars), u AS (SELECT *, CASE WHEN r IS NOT NULL THEN pow(greatest(r, 0), 2) END AS up, CASE WHEN r IS NOT NULL THEN pow(least(r, 0), 2) END AS dn FROM r) SELECT code, day, {_rounded(ratio(sd('r', 20, 20), sd('r', 120, 90)), 'vol_long', 5)}, {_rounded(ratio(sd('r', 5, 4), sd('r', 20, 20)), 'vol_short', 5)}, {_rounded(ratio(root('up'), root('dn')), 'vol_updown', 5)}, {_rounded(ratio(sd('g', 20, 15), sd('x', 20, 15)), 'vol_gap', 5)} FROM u",
        "day_ranks": f"{c}, k AS (SELECT day, id, floor(p3 / 10) AS x FROM c WHERE p3 IS NOT NULL) SELECT day, id, rank() OVER (PARTITION BY day ORDER BY x DESC) AS day_rank, count(*) OVER (PARTITION BY day) AS n_day, {_rounded('CASE WHEN count(*) OVER (PARTITION BY day) >= 2 THEN (rank() OVER (PARTITION BY day ORDER BY x) + (count(*) OVER (PARTITION BY day, x) - 1) / 2) / count(*) OVER (PARTITION BY day) END', 'day_share')}, row_number() OVER (PARTITION BY day ORDER BY x DESC, id) AS first_rank, ceil(row_number() OVER (PARTITION BY day ORDER BY x, id) / count(*) OVER (PARTITION BY day) * 10)::BIGINT AS decile FROM k",
        "day_strata": f"{c}, m AS (SELECT *, date_trunc('month', day) AS m FROM c), e AS (SELECT m, list_distinct([quantile_cont(p3, 0.25), quantile_cont(p3, 0.5), quantile_cont(p3, 0.75)]) AS e FROM m GROUP BY m) SELECT id, CASE WHEN p3 IS NOT NULL THEN len(list_filter(e, lambda x: p3 > x)) END AS stratum FROM m JOIN e USING (m)",
        "rising_share": f"{c} SELECT id, round(list_avg(list_filter([(p1 > p2)::INT, (p2 > p3)::INT, (p3 > score / 4000)::INT], lambda x: x IS NOT NULL)), 6) AS share FROM c",
        "series_returns": f"WITH {sql.BARS} SELECT code, day, {_rounded(sql.gap('c', sql.lag('c', 20)), 'ret_20')}, {_rounded(sql.gap('c', sql.lag('c', 120)), 'ret_120')} FROM bars",
        "group_returns": f"WITH {sql.BARS}, l AS (SELECT s_nationkey % 5 AS code, day, avg(c) AS c FROM bars JOIN supplier ON s_suppkey = code GROUP BY 1, 2) SELECT code AS grp, day, {_rounded(sql.gap('c', sql.lag('c', 20)), 'ret_20')}, {_rounded(sql.gap('c', sql.lag('c', 120)), 'ret_120')} FROM l",
        "rolling_position": f"WITH {sql.BARS}, x AS (SELECT code, day, CASE WHEN v > 5 THEN v END AS x FROM bars), w AS (SELECT *, {sql.over('list(x) FILTER (WHERE x IS NOT NULL)', -59, 0)} AS w FROM x) SELECT code, day, {_rounded('CASE WHEN x IS NOT NULL AND len(w) >= 20 THEN (len(list_filter(w, lambda y: y < x)) + (len(list_filter(w, lambda y: y = x)) + 1) / 2 - 1) / (len(w) - 1) END', 'place')} FROM w",
        "average_volume": f"WITH {sql.BARS} SELECT code, day, round(CASE WHEN {sql.over('count(v)', -19, 0)} >= 10 THEN {sql.over('avg(v)', -19, 0)} END + 3e-9, 6) AS volume FROM bars",
        "margin_balances": _balances_sql(3, False),
        "margin_balances_on_grid": _balances_sql(5, True),
        "realised_returns": f"WITH {sql.BARS}, e AS (SELECT *, {lead('o', 1)} AS entry, {sql.over('avg(c)', -4, 0)} AS m FROM bars), f AS (SELECT code, day, " + ", ".join(f"{lead('m', h)} / entry - 1 AS from_open_{h}, {lead('m', h)} / c - 1 AS from_close_{h}" for h in (10, 20, 40, 60)) + ", entry / c - 1 AS entry_gap FROM e) SELECT code, day, " + ", ".join(f"{_rounded(f'from_open_{h}', f'from_open_{h}')}, {_rounded(f'from_close_{h}', f'from_close_{h}')}" for h in (10, 20, 40, 60)) + f", {_rounded('entry_gap', 'entry_gap')}, {_rounded('CASE WHEN from_open_20 > 0 THEN from_open_20 ELSE from_open_40 END', 'flex')} FROM f",
        "decision_pool": f"""WITH {_panel_sql(40, 3)}, dd AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM bars)),
k AS (SELECT code, pf.day, dd.i, vol_ratio FROM pf JOIN dd USING (day) WHERE fresh_break), x AS (SELECT *, i + unnest(range(5)) AS t FROM k), y AS (SELECT *, row_number() OVER (PARTITION BY code, t ORDER BY i DESC) AS p FROM x), z AS (SELECT y.code, y.day, y.i, y.t, vol_ratio, dd.day AS decision FROM y JOIN dd ON dd.i = y.t WHERE p = 1),
b AS (SELECT code, dd.i AS j, c, h, l FROM bars JOIN dd USING (day)),
m AS (SELECT z.code, z.day, decision, vol_ratio, t - z.i AS age, max(c) FILTER (WHERE j = z.i) AS c0, max(c) FILTER (WHERE j = t) AS c1, max(h) FILTER (WHERE j > z.i) AS hi, min(l) FILTER (WHERE j > z.i) AS lo FROM z LEFT JOIN b ON b.code = z.code AND j BETWEEN z.i AND t GROUP BY ALL)
SELECT code, day, decision, {_rounded('vol_ratio', 'vol_ratio')}, age, {_rounded('c1 / c0 - 1', 'ret')}, {_rounded('hi / c0 - 1', 'high')}, {_rounded('lo / c0 - 1', 'low')} FROM m""",
        "growing_percentile": f"{c}, x AS (SELECT id, day, round(p3) AS x FROM c), p AS (SELECT a.id, count(*) AS n, count(*) FILTER (WHERE b.x < a.x) AS k FROM x a JOIN x b ON b.day < a.day AND b.x IS NOT NULL AND a.x IS NOT NULL GROUP BY 1) SELECT x.id, CASE WHEN n >= 50 THEN round(100.0::DOUBLE * k / n, 1) END AS pct FROM x LEFT JOIN p USING (id)",
        "session_lookback": f"{c} SELECT day, first FROM (SELECT day, lag(day, 19) OVER (ORDER BY day) AS first FROM (SELECT DISTINCT day FROM c)) WHERE first IS NOT NULL",
        "cumulative_factors": f"WITH {sql.BARS}, f AS (SELECT code, day, CASE day(day) WHEN 15 THEN 0.5 WHEN 20 THEN 2.0 END::DOUBLE AS factor FROM bars) SELECT code, day, factor, {sql.over('product(coalesce(factor, 1))', 'all', 0)} AS upto, coalesce(product(coalesce(factor, 1)) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS later FROM f",
        "last_known_value": f"WITH {sql.BARS} SELECT code, arg_max(c, day) AS x FROM bars WHERE v > 40 GROUP BY code",
    }
