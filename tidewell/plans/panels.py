"""Queries of event feeds, yearly panels and positions among others, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import facts, feeds, panel, windows
from tidewell.operators.asof import asof_calendar, asof_join
from tidewell.operators.facts import known_at
from tidewell.plans import bars_sql as sql
from tidewell.plans.choices import _CANDIDATES, candidates
from tidewell.plans.summaries import holder_stats
from tidewell.sources.tables import daily_bars, table


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _r(c: str, digits: int = 6):
    return F.round(F.col(c) + 3e-9, digits).alias(c)


def _rounded(x: str, name: str, digits: int = 6) -> str:
    return f"round({x} + 3e-9, {digits}) AS {name}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports about a customer: its orders but those of low priority, which are the rows that ask."""
    return candidates(spark, sf_dir).where("grp <> '5-LOW'").groupBy("code", F.col("day").alias("at")).agg(F.max("p1").alias("ratio"), F.max("p2").alias("before"))


_FEED = f"{_CANDIDATES}, ev AS (SELECT code, day AS ad, max(p1) AS ratio, max(p2) AS before FROM c WHERE grp <> '5-LOW' GROUP BY 1, 2), rw AS (SELECT id, code, day FROM c WHERE grp = '5-LOW')"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).where("grp = '5-LOW'").select("id", "code", "day")


def large_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.event_features(_rows(spark, sf_dir), _events(spark, sf_dir), "code", "day", "at", ["ratio", "before"], {"n_60": 60, "n_250": 250})
    return out.select("id", "days", "ratio", F.round(F.col("ratio") - F.col("before") + 3e-9, 6).alias("change"), "n_60", "n_250")


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feeds.recent_flags(_rows(spark, sf_dir), _events(spark, sf_dir), "code", "day", "at", {"buy_20": 20, "buy_60": 60}, F.lit("1996-01-01").cast("date"))
    return out.select("id", "buy_20", "buy_60")


def major_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holder statistics of the customer's latest order before or on the day."""
    stats = holder_stats(spark, sf_dir).join(candidates(spark, sf_dir).where("grp <> '5-LOW'").select(F.col("id").alias("l_orderkey"), "code", F.col("day").alias("at")), "l_orderkey")
    stats = stats.groupBy("code", "at").agg(F.max("n_holders").alias("n_holders"), F.max("total").alias("total"))
    return feeds.event_features(_rows(spark, sf_dir), stats, "code", "day", "at", ["n_holders", "total"], {}).select("id", "days", "n_holders", "total")


def cross_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a nested report, as of the day, on the size of the key."""
    report = _events(spark, sf_dir).withColumn("report", F.struct(F.struct(F.col("ratio").alias("book"), (F.col("ratio") - F.col("before")).alias("net")).alias("listed"))).select("code", "at", F.col("report.listed.book").alias("book"), F.col("report.listed.net").alias("net"))
    size = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("cap"))
    out = feeds.event_features(_rows(spark, sf_dir), report, "code", "day", "at", ["book", "net"], {}, clip=500).join(size, "code", "left")
    share = lambda c: F.when(F.col("cap") > 0, F.col(c) / F.col("cap") * 100)
    return out.select("id", "days", F.round(share("book") + 3e-9, 6).alias("book_share"), F.round(share("net") + 3e-9, 6).alias("net_share"))


def short_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market series with its gap to the mean of 20 rows, as of each row's day."""
    c = candidates(spark, sf_dir)
    per = c.groupBy("day").agg((F.sum((F.col("label") == 1).cast("int")) / F.count("*") * 100).alias("ratio"))
    w = Window.partitionBy(F.lit(0)).orderBy("day")  # one row a day
    per = per.withColumn("gap", F.when(F.count("ratio").over(w.rowsBetween(-19, 0)) == 20, F.col("ratio") - F.avg("ratio").over(w.rowsBetween(-19, 0))))
    rows = _rows(spark, sf_dir).withColumn("day", F.date_add("day", 1))
    return asof_calendar(rows, per, "day", "day", ["ratio", "gap"]).select("id", _r("ratio"), _r("gap"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = candidates(spark, sf_dir).where("grp <> '5-LOW'").withColumns({"period": F.year("day"), "at": F.col("day")})
    d = feeds.revised(d, "code", "period", ["at", "id"], "score").where("revision IS NOT NULL")
    one = d.groupBy("code", "at").agg(F.max_by("revision", "id").alias("revision"))
    up, down = d.where("revision > 0"), d.where("revision < 0")
    out = feeds.event_features(_rows(spark, sf_dir), one, "code", "day", "at", ["revision"], {"n_250": 250}, clip=365)
    out = feeds.count_in_windows(out, up, "code", "day", "at", {"up_250": 250})
    out = feeds.count_in_windows(out, down, "code", "day", "at", {"down_250": 250})
    return out.select("id", "days", _r("revision", 4), (F.col("revision") > 0).cast("int").alias("up"), "n_250", "up_250", "down_250")


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since any disclosure, and since one of a whole year, at most 400."""
    e = _events(spark, sf_dir)
    rows = feeds.event_features(_rows(spark, sf_dir), e, "code", "day", "at", [], {}, clip=400).withColumnRenamed("days", "since_any")
    rows = feeds.event_features(rows, e.where(F.quarter("at") == 1), "code", "day", "at", [], {}, clip=400).withColumnRenamed("days", "since_year")
    return rows.select("id", "since_any", "since_year")


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = candidates(spark, sf_dir).groupBy("code", F.year("day").alias("fy")).agg(F.sum(F.col("score").cast("decimal(18,2)")).cast("double").alias("revenue"), F.sum(F.round(F.col("p1") * 1000 - 30000, 2).cast("decimal(18,2)")).cast("double").alias("operating"), F.max("grp").alias("basis"), F.count("*").alias("n"))
    return o.withColumns({"basis": F.substring("basis", 1, 1), "margin": F.when(F.col("revenue") > 0, F.col("operating") / F.col("revenue"))})


_YEARLY = f"{_CANDIDATES}, y AS (SELECT code, year(day)::INTEGER AS fy, sum(score::DECIMAL(18,2))::DOUBLE AS revenue, sum(round(p1 * 1000 - 30000, 2)::DECIMAL(18,2))::DOUBLE AS operating, substr(max(grp), 1, 1) AS basis, count(*) AS n FROM c GROUP BY 1, 2), yy AS (SELECT *, operating / revenue AS margin FROM y)"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = feeds.yearly_lags(_yearly(spark, sf_dir), "code", "fy", ["revenue", "operating", "margin"], ["basis"])
    new = feeds.level_changes("revenue") | feeds.level_changes("operating") | feeds.ratio_changes("margin")
    return p.select("code", "fy", *(F.round(v.cast("double") + 3e-9, 6).alias(n) for n, v in new.items()))


def _filings_sql() -> str:
    lag = lambda v, k: f"CASE WHEN y{k}.code IS NOT NULL AND y{k}.basis = yy.basis THEN y{k}.{v} END"
    lags = ", ".join(f"{lag(v, k)} AS {v}_y{k}" for v in ("revenue", "operating", "margin") for k in (1, 2, 3))
    sym = lambda a, b: f"CASE WHEN abs({a}) + abs({b}) > 0 THEN 2 * (({a}) - ({b})) / (abs({a}) + abs({b})) END"
    out = []
    for v in ("revenue", "operating"):
        y = [v, f"{v}_y1", f"{v}_y2", f"{v}_y3"]
        whole = f"{y[0]} + {y[1]} + {y[2]} + {y[3]} IS NOT NULL"
        peak, prior = f"greatest({y[1]}, {y[2]}, {y[3]})", f"greatest({y[2]}, {y[3]})"
        cols = {f"yoy{k + 1}": sym(y[k], y[k + 1]) for k in range(3)} | {"chg2y": sym(y[0], y[2]), "chg3y": sym(y[0], y[3]), "accel": f"({sym(y[0], y[1])}) - ({sym(y[1], y[2])})"}
        cols |= {"recovery3": f"CASE WHEN {whole} THEN {sym(y[0], peak)} END", "dip3": f"CASE WHEN {whole} THEN least({sym(y[1], prior)}, 0) END", "vshape3": f"CASE WHEN {whole} THEN ({y[1]} < {prior} AND {y[0]} > {y[1]})::INT END", "high4": f"CASE WHEN {whole} THEN ({y[0]} > {peak})::INT END"}
        out += [_rounded(f"({e})::DOUBLE", f"{v}_{n}") for n, e in cols.items()]
    out += [_rounded("margin", "margin"), *(_rounded(f"margin - margin_y{k}", f"margin_chg{k}y") for k in (1, 2, 3))]
    joins = " ".join(f"LEFT JOIN yy y{k} ON y{k}.code = yy.code AND y{k}.fy = yy.fy - {k}" for k in (1, 2, 3))
    return f"WITH {_YEARLY}, l AS (SELECT yy.*, {lags} FROM yy {joins}) SELECT code, fy, {', '.join(out)} FROM l"


def capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = _yearly(spark, sf_dir).select("code", "fy", "basis", "revenue", (F.col("revenue") * 0.6).alias("cost"), "operating", (F.col("operating") * 0.9).alias("pretax"), (F.col("n") * 2000.0).alias("tax"), (F.col("revenue") * 0.1 + F.col("n")).alias("receivables"), (F.col("revenue") * 0.05).alias("inventories"), (F.col("n") * 500.0).alias("payables"), (F.col("operating") + 40000).alias("equity"), (F.col("n") * 7000.0).alias("debt"), (F.col("n") * 900.0).alias("cash"))
    y = feeds.yearly_lags(y, "code", "fy", ["receivables", "inventories", "payables", "equity", "debt", "cash"], ["basis"], (1,))
    out = feeds.capital_efficiency(y, F.lit(365.0), F.col("cash_y1").isNotNull())
    return out.select("code", "fy", *(_r(c) for c in ("dso", "dio", "dpo", "ccc", "nwc_share", "op_margin", "tax_rate", "turnover", "roic")))


_CAPITAL = f"""WITH {_YEARLY}, a AS (SELECT code, fy, basis, revenue, revenue * 0.6 AS cost, operating, operating * 0.9 AS pretax, n * 2000.0::DOUBLE AS tax, revenue * 0.1 + n AS rec, revenue * 0.05 AS inv, n * 500.0::DOUBLE AS pay, operating + 40000 AS eq, n * 7000.0::DOUBLE AS debt, n * 900.0::DOUBLE AS cash FROM yy),
b AS (SELECT a.*, (a.rec + p.rec) / 2 AS mrec, (a.inv + p.inv) / 2 AS minv, (a.pay + p.pay) / 2 AS mpay, CASE WHEN a.tax / CASE WHEN a.pretax > 0 THEN a.pretax END BETWEEN 0 AND 1 THEN a.tax / a.pretax END AS rate,
  CASE WHEN a.eq > 0 THEN a.eq + a.debt - a.cash END AS ic, CASE WHEN p.eq > 0 THEN p.eq + p.debt - p.cash END AS ic0 FROM a LEFT JOIN a p ON p.code = a.code AND p.fy = a.fy - 1 AND p.basis = a.basis),
d AS (SELECT *, CASE WHEN ic > 0 AND ic0 > 0 THEN (ic + ic0) / 2 END AS mic FROM b)
SELECT code, fy, {_rounded('mrec / revenue * 365', 'dso')}, {_rounded('minv / cost * 365', 'dio')}, {_rounded('mpay / cost * 365', 'dpo')}, {_rounded('mrec / revenue * 365 + minv / cost * 365 - mpay / cost * 365', 'ccc')}, {_rounded('(mrec + minv - mpay) / revenue', 'nwc_share')}, {_rounded('operating / revenue', 'op_margin')}, {_rounded('rate', 'tax_rate')}, {_rounded('revenue / mic', 'turnover')}, {_rounded('operating * (1 - rate) / mic', 'roic')} FROM d"""


def relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    ref = c.groupBy(F.last_day("day").alias("end"), "grp", "code").agg(F.max("p3").alias("p3"), F.round(F.max("p1")).alias("p1"))
    rows = c.select("id", "day", F.when(F.col("id") % 13 > 0, F.col("grp")).alias("grp"), "p3", F.round("p1").alias("p1"))
    out = feeds.relative_position(rows, ref, "day", "end", "grp", ["p1", "p3"], 100, 30)
    return out.select("id", *(_r(f"{k}_{m}") for m in ("p1", "p3") for k in ("market", "group")))


def _relative_sql() -> str:
    place = lambda m, extra, least: f"(SELECT CASE WHEN count(*) >= {least} AND rw.{m} IS NOT NULL THEN (count(*) FILTER (WHERE f.{m} < rw.{m}) + count(*) FILTER (WHERE f.{m} <= rw.{m})) / (2 * count(f.{m})) END FROM rf f WHERE f.fin = rw.fin{extra})"
    parts = ", ".join(f"{_rounded(place(m, extra, least), f'{k}_{m}')}" for m in ("p1", "p3") for k, extra, least in (("market", "", 100), ("group", " AND f.grp = rw.grp", 30)))
    return f"WITH {_CANDIDATES}, rf AS (SELECT last_day(day) AS fin, grp, code, max(p3) AS p3, round(max(p1)) AS p1 FROM c GROUP BY 1, 2, 3), rw AS (SELECT id, CASE WHEN id % 13 > 0 THEN grp END AS grp, p3, round(p1) AS p1, (date_trunc('month', day)::DATE - 1) AS fin FROM c) SELECT id, {parts} FROM rw"


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.plans.relational import _cumulative

    return _cumulative(spark, sf_dir)


_QUARTERS = "qc AS (SELECT entity, fy, q, (sum(x) OVER (PARTITION BY entity, fy ORDER BY q))::DOUBLE AS cum FROM (SELECT o_custkey AS entity, year(o_orderdate)::INTEGER AS fy, quarter(o_orderdate)::INTEGER AS q, sum(o_totalprice::DECIMAL(18,2)) AS x FROM orders GROUP BY ALL))"


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.progress_benchmark(_quarters(spark, sf_dir), "entity", "fy", "q", "cum").select("entity", "fy", "q", _r("benchmark"), "basis")


def ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trailing year of each customer as it was known strictly before each of its orders, the quarter being published 40 days after its end."""
    f = feeds.trailing_year(_quarters(spark, sf_dir), "entity", "fy", "q", "cum")
    f = f.withColumn("known", F.date_add(F.add_months(F.make_date("fy", F.col("q") * 3, F.lit(1)), 1), 39))
    rows = candidates(spark, sf_dir).select("id", F.col("code").alias("entity"), "day")
    out = asof_join(rows, f, ["entity"], "day", "known", ["ttm", "fy", "q"], strict=True, tolerance_days=365)
    return out.select("id", "known", F.round(F.col("ttm") + 3e-7, 2).alias("ttm"), "fy", "q")


def credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).select("code", "day", (F.col("v") * 3).alias("long"), F.when(F.col("v") > 3, F.col("c") / 100).alias("short"))
    out = feeds.latest_published(b, "code", "day", F.date_add(F.trunc("day", "week"), 8), F.lit("1999-03-10").cast("date"))
    return out.select("code", "day", F.round(F.col("long") / F.when(F.col("short") > 0, F.col("short")) + 3e-9, 6).alias("ratio"))


_BOOK = ("cash_last", "cash_chg1", "cash_chg2", "sustainable_growth", "sustainable_growth_chg1", "sustainable_growth_chg2", "equity_turnover", "equity_turnover_chg1", "equity_turnover_chg2", *(f"{c}_yoy{p}" for c in ("cfo", "fcf", "cfi", "cff", "dividend", "bps", "shares") for p in ("", "_p1")), "dividend_up", "foreign_standard")


def book_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash, flows, dividends and shares of quarterly disclosures made of each customer's orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("q")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("x"), F.count("*").cast("double").alias("n"), F.max("o_orderkey").alias("k"))
    p = o.select(
        "entity", "fy", "q", F.date_add(F.make_date("fy", F.col("q") * 3, F.lit(28)), 40).alias("disclosed"), F.when(F.col("q") % 2 == 0, F.col("x")).alias("cash"), (F.col("x") / 10 - 20000).alias("cfo"), F.when(F.col("k") % 5 > 0, 9000 - F.col("x") / 20).alias("cfi"), (F.col("n") * 1000 - 2500).alias("cff"),
        (F.col("x") / 10000).alias("roe"), F.when(F.col("k") % 4 > 0, F.col("k") % 90).alias("payout"), (F.col("x") * 4).alias("sales_ttm"), (F.col("x") - 50000).alias("equity"), (F.col("k") % 7).cast("double").alias("dps"), (F.col("x") / 100).alias("bps"), (F.col("n") * 100).alias("shares"),
        F.element_at(F.array(F.lit("JP"), F.lit("IFRS"), F.lit("US"), F.lit("other")), (F.col("k") % 4 + 1).cast("int")).alias("standard"), F.when(F.col("fy") < 1995, 2.0).alias("splits"),
    )
    out = facts.book_ratios(p, "entity", "fy", "q", "disclosed", F.col("splits"))
    return out.select("entity", "fy", "q", *(_r(c, 5) for c in _BOOK))


def _book_sql() -> str:
    sym = lambda a, b: f"CASE WHEN abs({a}) + abs({b}) > 0 THEN ({a} - {b}) / (abs({a}) + abs({b})) * 100 END"
    back = lambda c, k: f"lag({c}, {k}) OVER y" if k else c
    clip = lambda x, low, high: f"CASE WHEN {x} BETWEEN {low} AND {high} THEN {x} END"
    new = {"cash_last": "cash_last", "cash_chg1": sym("cash_last", "c1"), "cash_chg2": sym("c1", "c2")}
    for c in ("sustainable_growth", "equity_turnover"):
        new |= {c: c, f"{c}_chg1": f"{c} - lag({c}) OVER d", f"{c}_chg2": f"lag({c}) OVER d - lag({c}, 2) OVER d"}
    for c, name in (("cfo", "cfo"), ("fcf", "fcf"), ("cfi", "cfi"), ("cff", "cff"), ("dps", "dividend")):
        new |= {f"{name}_yoy{p}": sym(back(c, k), back(c, k + 1)) for k, p in ((0, ""), (1, "_p1"))}
    for c, low, high in (("bps", -100, 300), ("shares", -50, 200)):
        new |= {f"{c}_yoy{p}": clip(f"(CASE WHEN {back(c, k + 1)} > 0 THEN ({back(c, k)} - {back(c, k + 1)}) / ({back(c, k + 1)}) * 100 END)", low, high) for k, p in ((0, ""), (1, "_p1"))}
    new |= {"dividend_up": "(dps > lag(dps) OVER y)::INT::DOUBLE", "foreign_standard": "CASE WHEN k % 4 < 3 THEN (k % 4 > 0)::INT::DOUBLE END"}
    return f"""
WITH o AS (SELECT o_custkey AS entity, year(o_orderdate)::INTEGER AS fy, quarter(o_orderdate)::INTEGER AS q, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS x, count(*)::DOUBLE AS n, max(o_orderkey) AS k FROM orders GROUP BY ALL),
p AS (SELECT entity, fy, q, k, (make_date(fy, q * 3, 28) + 40)::DATE AS t, CASE WHEN q % 2 = 0 THEN x END AS cash, x / 10 - 20000 AS cfo, CASE WHEN k % 5 > 0 THEN 9000 - x / 20 END AS cfi, n * 1000 - 2500 AS cff, {clip('(x / 10000 * (1 - CASE WHEN k % 4 > 0 THEN k % 90 END / 100::DOUBLE))', -500, 500)} AS sustainable_growth, {clip('(CASE WHEN x > 50000 THEN x * 4 / (x - 50000) END)', 0, 100)} AS equity_turnover, (k % 7)::DOUBLE AS dps, x / 100 / CASE WHEN fy < 1995 THEN 2 ELSE 1 END AS bps, n * 100 * CASE WHEN fy < 1995 THEN 2 ELSE 1 END AS shares FROM o),
l AS (SELECT *, cfo + cfi AS fcf, CASE WHEN cash IS NOT NULL THEN lag(cash) OVER w END AS l1, CASE WHEN cash IS NOT NULL THEN lag(cash, 2) OVER w END AS l2 FROM p WINDOW w AS (PARTITION BY entity, cash IS NULL ORDER BY t, fy, q)),
m AS (SELECT *, last_value(cash IGNORE NULLS) OVER f AS cash_last, last_value(l1 IGNORE NULLS) OVER f AS c1, last_value(l2 IGNORE NULLS) OVER f AS c2 FROM l WINDOW f AS (PARTITION BY entity ORDER BY t, fy, q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT entity, fy, q, {', '.join(f'round({new[c]} + 3e-9, 5) AS {c}' for c in _BOOK)} FROM m WINDOW d AS (PARTITION BY entity ORDER BY t, fy, q), y AS (PARTITION BY entity, q ORDER BY fy)"""


def price_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price, its share of the highest close of 100 rows, turnover and volume trend of each key as of a day."""
    f = panel.bars_frames()
    b = _bars(spark, sf_dir).where("day <= DATE '1999-03-10'")
    b = f.roll(b, high=(F.col("c"), 100, F.max, 1), volume=(F.col("v"), 20, F.avg, 15), turnover=(F.col("va"), 20, F.avg, 15))
    b = b.withColumns({"p": F.row_number().over(Window.partitionBy("code").orderBy(F.col("day").desc()))})
    return b.where("p = 1").select("code", "day", "c", F.round(F.col("c") / F.col("high") * 100 + 3e-9, 6).alias("high_ratio"), F.round(F.col("turnover") + 3e-7, 4).alias("turnover"), F.round(F.col("v") / F.col("volume") * 100 + 3e-9, 6).alias("volume_trend"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks at least 30 days apart, and the last eight jumps in volume of each key."""
    from tidewell.operators.select import last_of_kind

    f = panel.bars_frames()
    p = f.roll(panel.price_panel(_bars(spark, sf_dir), rows=60, cooldown=5), m=(F.col("v"), 20))
    breaks = feeds.apart(p.where("new_high"), "code", "day", 30).withColumn("kind", F.lit("break"))
    jumps = last_of_kind(p.where("v >= 2 * m AND c > o"), ["code"], "day", "v", 8).select("code", "day", F.lit("volume").alias("kind"))
    return breaks.unionByName(jumps).select("code", "day", "kind")


def known_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each customer's years on a day, whatever was reissued later."""
    c = candidates(spark, sf_dir).withColumns({"fy": F.year("day"), "published": F.date_add("day", (F.col("id") % 200).cast("int"))})
    return known_at(c, F.lit("1999-01-01").cast("date"), ["code", "fy"], "published", ["published", "id"]).select("code", "fy", "published", "id", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "book_ratios": book_ratios,
        "large_holdings": large_holdings, "buy_flags": flags, "major_holders": major_holders, "cross_holdings": cross_holdings, "short_ratio": short_ratio, "forecast_revisions": revisions, "disclosure_timing": timing, "annual_filings": filings, "capital_efficiency": capital, "relative_position": relative,
        "progress_benchmark": benchmark, "trailing_year_known": ttm, "credit_as_of": credit, "price_metrics_as_of": price_metrics, "event_timeline": timeline, "facts_known_by_year": known_facts,
    }


def oracle_sql() -> dict[str, str]:
    c = f"WITH {_CANDIDATES}"
    count = lambda e, n: f"(SELECT count(*) FROM {e} e WHERE e.code = rw.code AND e.ad <= rw.day AND e.ad > rw.day - {n})"
    last = lambda e, columns: f"x AS (SELECT rw.id, rw.code, rw.day, e.ad, {columns} FROM rw ASOF LEFT JOIN {e} e ON e.code = rw.code AND e.ad <= rw.day)"
    holders = "SELECT o.code, o.day AS ad, max(h.n) AS n_holders, max(h.t) AS total FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 3) AS n, sum(l_quantity) FILTER (WHERE l_quantity > 3) AS t FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) h JOIN c o ON o.id = l_orderkey WHERE o.grp <> '5-LOW' GROUP BY 1, 2"
    return {
        "book_ratios": _book_sql(),
        "large_holdings": f"WITH {_FEED}, {last('ev', 'e.ratio, e.before')} SELECT id, day - ad AS days, ratio, {_rounded('ratio - before', 'change')}, {count('ev', 60).replace('rw.', 'x.')} AS n_60, {count('ev', 250).replace('rw.', 'x.')} AS n_250 FROM x",
        "buy_flags": f"WITH {_FEED} SELECT id, CASE WHEN day >= DATE '1996-01-01' THEN ({count('ev', 20)} > 0)::INT END AS buy_20, CASE WHEN day >= DATE '1996-01-01' THEN ({count('ev', 60)} > 0)::INT END AS buy_60 FROM rw",
        "major_holders": f"WITH {_FEED}, mh AS ({holders}), {last('mh', 'e.n_holders, e.total')} SELECT id, day - ad AS days, n_holders, total FROM x",
        "cross_holdings": f"WITH {_FEED}, {last('ev', 'e.ratio, e.before')} SELECT id, least(day - ad, 500) AS days, {_rounded('CASE WHEN c_acctbal > 0 THEN ratio / c_acctbal * 100 END', 'book_share')}, {_rounded('CASE WHEN c_acctbal > 0 THEN (ratio - before) / c_acctbal * 100 END', 'net_share')} FROM x LEFT JOIN customer ON c_custkey = x.code",
        "short_ratio": f"WITH {_FEED}, d AS (SELECT day, avg(label) * 100 AS ratio FROM c GROUP BY day), g AS (SELECT day, ratio, CASE WHEN count(*) OVER w = 20 THEN ratio - avg(ratio) OVER w END AS gap FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), k AS (SELECT day, last_value(ratio IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ratio, last_value(gap IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap FROM g) SELECT id, {_rounded('ratio', 'ratio')}, {_rounded('gap', 'gap')} FROM rw ASOF LEFT JOIN k ON k.day <= rw.day + 1",
        "forecast_revisions": f"""WITH {_FEED}, r0 AS (SELECT code, day AS ad, id, score, lag(score) OVER (PARTITION BY code, year(day) ORDER BY day, id) AS b FROM c WHERE grp <> '5-LOW'), r AS (SELECT code, ad, id, score / b * 100 - 100 AS revision FROM r0 WHERE b > 0), r1 AS (SELECT code, ad, arg_max(revision, id) AS revision FROM r GROUP BY 1, 2),
{last('r1', 'e.revision')} SELECT id, least(day - ad, 365) AS days, {_rounded('revision', 'revision', 4)}, (revision > 0)::INT AS up, {count('r1', 250).replace('rw.', 'x.')} AS n_250, {count('(SELECT * FROM r WHERE revision > 0)', 250).replace('rw.', 'x.')} AS up_250, {count('(SELECT * FROM r WHERE revision < 0)', 250).replace('rw.', 'x.')} AS down_250 FROM x""",
        "disclosure_timing": f"WITH {_FEED} SELECT id, least(day - (SELECT max(ad) FROM ev e WHERE e.code = rw.code AND ad <= day), 400) AS since_any, least(day - (SELECT max(ad) FROM ev e WHERE e.code = rw.code AND ad <= day AND quarter(ad) = 1), 400) AS since_year FROM rw",
        "annual_filings": _filings_sql(),
        "capital_efficiency": _CAPITAL,
        "relative_position": _relative_sql(),
        "progress_benchmark": f"WITH {_QUARTERS}, j AS (SELECT a.entity, a.fy, a.q, CASE WHEN b.cum > 0 AND w.cum > 0 THEN b.cum / w.cum * 100 END AS s FROM qc a LEFT JOIN qc b ON b.entity = a.entity AND b.fy = a.fy - 1 AND b.q = a.q LEFT JOIN qc w ON w.entity = a.entity AND w.fy = a.fy - 1 AND w.q = 4) SELECT entity, fy, q, {_rounded('CASE WHEN s IS NULL THEN q * 25 ELSE greatest(s, q * 12.5) END', 'benchmark')}, CASE WHEN s IS NULL THEN 'linear' WHEN s < q * 12.5 THEN 'floor' ELSE 'seasonal' END AS basis FROM j",
        "trailing_year_known": f"WITH {_CANDIDATES}, {_QUARTERS}, t AS (SELECT a.entity, a.fy, a.q, (make_date(a.fy, a.q * 3, 1) + INTERVAL 1 MONTH)::DATE + 39 AS known, CASE WHEN a.q = 4 THEN a.cum ELSE a.cum + w.cum - b.cum END AS ttm FROM qc a LEFT JOIN qc b ON b.entity = a.entity AND b.fy = a.fy - 1 AND b.q = a.q LEFT JOIN qc w ON w.entity = a.entity AND w.fy = a.fy - 1 AND w.q = 4) SELECT id, CASE WHEN day - known <= 365 THEN known END AS known, round(CASE WHEN day - known <= 365 THEN ttm END + 3e-7, 2) AS ttm, CASE WHEN day - known <= 365 THEN fy END AS fy, CASE WHEN day - known <= 365 THEN q END AS q FROM c ASOF LEFT JOIN t ON t.entity = c.code AND t.known < c.day",
        "credit_as_of": f"WITH {sql.BARS} SELECT code, max(day) AS day, {_rounded('arg_max(struct_pack(r := v * 3 / CASE WHEN v > 3 AND c > 0 THEN c / 100 END), day).r', 'ratio')} FROM bars WHERE date_trunc('week', day)::DATE + 8 <= DATE '1999-03-10' GROUP BY code",
        "price_metrics_as_of": f"WITH {sql.BARS}, b AS (SELECT *, {sql.over('max(c)', -99, 0)} AS high, CASE WHEN {sql.over('count(v)', -19, 0)} >= 15 THEN {sql.over('avg(v)', -19, 0)} END AS mv, CASE WHEN {sql.over('count(va)', -19, 0)} >= 15 THEN {sql.over('avg(va)', -19, 0)} END AS mt, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS p FROM bars WHERE day <= DATE '1999-03-10') SELECT code, day, c, {_rounded('c / high * 100', 'high_ratio')}, round(mt + 3e-7, 4) AS turnover, {_rounded('v / mv * 100', 'volume_trend')} FROM b WHERE p = 1",
        "event_timeline": f"""WITH RECURSIVE {sql.BARS}, pp AS (SELECT *, CASE WHEN {sql.ROW} >= 60 AND {sql.over("count(c)", -59, 0)} >= 30 THEN {sql.over("max(c)", -59, 0)} END AS high_n, {sql.roll("v", 20)} AS m FROM bars), pq AS (SELECT *, coalesce(c > {sql.lag("high_n")}, false) AS nh FROM pp),
n AS (SELECT code, day, row_number() OVER (PARTITION BY code ORDER BY day) AS i FROM pq WHERE nh), s AS (SELECT code, day, i, day AS kept, true AS k FROM n WHERE i = 1 UNION ALL SELECT n.code, n.day, n.i, CASE WHEN n.day - s.kept > 30 THEN n.day ELSE s.kept END, n.day - s.kept > 30 FROM s JOIN n ON n.code = s.code AND n.i = s.i + 1),
j AS (SELECT code, day, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS p FROM pq WHERE v >= 2 * m AND c > o)
SELECT code, day, 'break' AS kind FROM s WHERE k UNION ALL SELECT code, day, 'volume' FROM j WHERE p <= 8""",
        "facts_known_by_year": f"{c}, k AS (SELECT code, year(day)::INTEGER AS fy, day + (id % 200)::INT AS published, id, score FROM c) SELECT code, fy, published, id, score FROM (SELECT *, row_number() OVER (PARTITION BY code, fy ORDER BY published DESC, id DESC) AS n FROM k WHERE published < DATE '1999-01-01') WHERE n = 1",
    }
