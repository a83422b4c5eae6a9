"""Queries of summaries, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import panel, simulate, summarise
from tidewell.plans import bars_sql as sql
from tidewell.plans.choices import _CANDIDATES, candidates
from tidewell.sources.tables import daily_bars, table


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _r(c: str, digits: int = 6):
    return F.round(F.col(c) + 3e-9, digits).alias(c)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = panel.forward_label(_bars(spark, sf_dir)).withColumns({"end": F.col("end_close") / F.col("entry") - 1, "best": F.col("max_ahead") / F.col("entry") - 1, "year": F.year("day")})
    return b.where("end IS NOT NULL AND best IS NOT NULL")


_OUTCOMES = f"""{sql.BARS}, fw AS (SELECT code, day, lead(o) OVER w AS entry, CASE WHEN {sql.over("count(c)", 1, 20)} >= 20 THEN {sql.over("max(c)", 1, 20)} END AS top, lead(c, 20) OVER w AS fin FROM bars WINDOW w AS (PARTITION BY code ORDER BY day)),
oc AS (SELECT code, day, year(day)::INTEGER AS year, fin / entry - 1 AS fin, top / entry - 1 AS best FROM fw WHERE fin / entry IS NOT NULL AND top / entry IS NOT NULL)"""


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return summarise.key_choices(li, {"order and line": ["l_orderkey", "l_linenumber"], "order and part": ["l_orderkey", "l_partkey"], "part and supplier": ["l_partkey", "l_suppkey"]})


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("late", F.when(F.col("p1") > 30, F.col("p1")))
    return summarise.missing_by(c, F.year("day"), ["p2", "p3", "late"]).select("period", "name", _r("share"))


def label_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"year": F.year("day"), "known": F.when(F.col("id") % 6 != 0, F.col("label"))})
    return summarise.label_rates(c, ["year", "grp"], "known", "p3").select("year", "grp", "level", "n", "n_known", _r("rate"), _r("q25"), _r("q50"), _r("q75"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("month", F.last_day("day"))
    return summarise.coverage(c, ["month", "grp"], ["p1", "p3"]).select("month", "grp", "n", "n_p1", "n_p3", _r("median_p1"), _r("median_p3"))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.funnel(candidates(spark, sf_dir), {"all": F.lit(True), "p1": F.col("p1") > 20, "p3": F.col("p3") > 20, "score": F.col("score") > 100000}, "label").select(F.col("step").cast("long").alias("step"), "name", "n", _r("rate"))


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.ladder(candidates(spark, sf_dir), "p3", "label", [None, 10.0, 50.0, 90.0, 200.0]).select("line", "n", _r("share"), _r("rate"))


def return_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.returns_of(_outcomes(spark, sf_dir), ["year"], "end", "best").select("year", "n", *(_r(c) for c in ("end_mean", "end_median", "best_mean", "best_median", "hit_share", "loss_share")))


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.overlap(candidates(spark, sf_dir), F.col("p1") >= 90, F.col("p3") >= 80).select("n", "n_a", "n_b", "n_both", "n_neither", _r("expected"), _r("b_in_a"), _r("a_in_b"))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = _bars(spark, sf_dir).groupBy("code", F.last_day("day").alias("day")).agg(F.sum("va").alias("x"))
    kinds = month.withColumn("ref", F.col("code") % 4).groupBy("ref", "day").agg(F.sum(F.col("x").cast("decimal(18,2)")).cast("double").alias("x"))
    out = summarise.matched_series(month, "code", kinds, "ref", "day", "x", 20)
    return out.select("code", F.col("best").cast("long").alias("best"), _r("r"), _r("second"), _r("gap"))


def market_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"part": F.when(F.col("label") == 1, F.col("score")).otherwise(0.0).cast("decimal(18,2)"), "whole": F.col("score").cast("decimal(18,2)")})
    return summarise.complete_ratio(c, "day", "grp", "part", "whole", 4).select("day", "n", _r("ratio"))


def weekly_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.date_add(F.trunc("o_orderdate", "week"), 6).alias("week"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    out = summarise.flows(o, F.col("week"), "o_orderstatus", "x", ["F", "O", "P"])
    return out.select(F.col("on").alias("week"), *(F.col(c).cast("double").alias(c) for c in ("total", "F", "O", "P")), *(F.round(F.col(f"share_{c}").cast("double") + 3e-9, 6).alias(f"share_{c}") for c in "FOP"))


def holder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    nested = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("p_name").alias("name"), F.when(F.col("l_quantity") > 3, F.col("l_quantity")).alias("share"))).alias("h"))
    out = summarise.holders(nested, "l_orderkey", "h", "name", "share", {"small": "^small", "metal": "(steel|brass|copper|ring)"})
    return out.select("l_orderkey", "n_holders", "largest", "total", _r("concentration"), "share_small", "share_metal")


def trade_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = simulate.entry_outcome(_bars(spark, sf_dir)).withColumns({"year": F.year("day"), "ret": F.when(F.col("status").isin("hit", "expired"), (F.col("mfe") + F.col("mae")) / 2)})
    out = summarise.trade_statistics(o, ["year"], "ret", F.col("status") == "hit", 250, 3)
    return out.select("year", "n", *(_r(c, 5) for c in ("mean", "median", "win", "se", "hit", "worst", "per_month", "monthly")))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.session_blocks(candidates(spark, sf_dir), "day", 60, 25)


def block_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.broadcast(summarise.session_blocks(_bars(spark, sf_dir), "day", 120, 60))  # one row for 60 sessions
    rows = _outcomes(spark, sf_dir).join(b, (F.col("day") >= F.col("first")) & (F.col("day") <= F.col("last")))
    return summarise.returns_of(rows, ["block", "first", "last"], "end", "best").select("block", "first", "last", "n", *(_r(c) for c in ("end_mean", "end_median", "best_mean", "best_median", "hit_share", "loss_share")))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.place_in(candidates(spark, sf_dir), ["grp"], "p3", F.lit(70.0)).select("grp", "n", _r("p10"), _r("p50"), _r("p90"), _r("rank"))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("quarter", F.quarter("day"))
    out = summarise.percentile_table(c, ["quarter", "grp"], "p3", [i / 12 for i in range(13)], 30)
    return out.select("quarter", "grp", "n", *(F.round(F.get("points", F.lit(i)) + 3e-9, 6).alias(f"x{i}") for i in range(13)))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").alias("amount"), "l_linenumber")
    out = summarise.size_buckets(li, ["code", "day"], "amount", (20000.0, 60000.0), F.col("l_linenumber") == 1)
    return out.select("code", "day", *(F.round(F.col(c) + 3e-7, 2).alias(c) for c in ("small", "medium", "large", "auction")), "n_small", "n_medium", "n_large", "n_auction", F.round(F.col("large_share") + 3e-9, 5).alias("large_share"))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.density(_outcomes(spark, sf_dir), "end", "best", (-0.5, 0.5, 20), (0.0, 1.0, 20), 30)


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("fold", F.col("id") % 5)
    return summarise.composition_spread(c, "fold", "grp").select("grp", _r("low"), _r("high"), _r("spread"))


def agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("grp", summarise.agreement(["p1", "p2", "p3"], 80.0).alias("n_agree")).groupBy("grp", "n_agree").agg(F.count("*").alias("n"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = candidates(spark, sf_dir).groupBy("day", "grp").agg(F.max("score").alias("x"))
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return summarise.ledger(d, "day", "grp", "x", names).select("day", *(F.col(f"`{n}`").alias(f"v{n[0]}") for n in names), F.round(F.col("total") + 3e-7, 2).alias("total"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    out = summarise.with_totals(c, "grp", {"amount": F.col("score").cast("decimal(18,2)"), "realised": F.when(F.col("label") == 1, F.col("score").cast("decimal(18,2)"))})
    return out.select("grp", "n", F.col("amount").cast("double").alias("amount"), F.col("realised").cast("double").alias("realised"))


def plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"inverse": F.when(F.col("p1") == 0, float("inf")).otherwise(1 / F.col("p1")), "shifted": F.col("p2") - 50})
    return summarise.plausibility(c, {"score": (1000.0, 400000.0), "p3": (5.0, 95.0), "inverse": (0.0, 1.0), "shifted": (-40.0, 40.0)}).select("name", "n", "n_inf", "n_zero", "n_outside", F.round(F.col("mean") + 3e-7, 5).alias("mean"), "low", "high")


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    rules = {"product": (F.col("p1") * F.col("p2"), F.col("p2") * F.col("p1")), "shifted": (F.col("p1") + 1, F.col("p1")), "third": (F.col("p3"), F.floor("p3"))}
    return summarise.identities(c, rules).select("name", "n", _r("worst"))


def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"q0": F.col("p3"), "q1": F.when(F.col("id") % 3 > 0, F.col("p3")), "q2": F.when(F.col("id") % 9 > 0, F.col("p1"))})
    return summarise.lag_coverage(c, {"first": ["q0", "q1", "q2"], "second": ["q1", "q0", "q2"]}).select("name", "n", _r("with_1"), _r("with_2"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "key_choices": keys, "missing_by_year": missing, "label_rates": label_cube, "coverage_by_group": coverage, "filter_funnel": funnel, "liquidity_ladder": ladder, "return_summary": return_summary, "overlap_table": overlaps, "matched_series": matched, "complete_ratio": market_ratio,
        "weekly_flows": weekly_flows, "holder_statistics": holder_stats, "trade_statistics": trade_stats, "session_blocks": blocks, "block_returns": block_returns, "place_in_distribution": placed, "percentile_tables": percentiles, "size_buckets": buckets, "outcome_density": density, "composition_spread": spread,
        "model_agreement": agreed, "daily_ledger": ledger, "totals_rows": totals, "plausibility": plausible, "identity_checks": identity, "lag_coverage": lags,
    }


def oracle_sql() -> dict[str, str]:
    c = f"WITH {_CANDIDATES}"
    q = lambda x, p: f"round(quantile_cont({x}, {p}) + 3e-9, 6)"
    a = lambda x: f"round(avg({x}) + 3e-9, 6)"
    returns = f"count(*) AS n, {a('fin')} AS end_mean, {q('fin', 0.5)} AS end_median, {a('best')} AS best_mean, {q('best', 0.5)} AS best_median, {a('(best >= 0.1)::INT')} AS hit_share, {a('(fin < -0.1)::INT')} AS loss_share"
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    ladder = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS line, count(*) FILTER (WHERE {w}) AS n, round(count(*) FILTER (WHERE {w}) / count(*) + 3e-9, 6) AS share, round(avg(label) FILTER (WHERE {w}) + 3e-9, 6) AS rate FROM c" for t, w in (("NULL", "true"), *((t, f"coalesce(p3 >= {t}, false)") for t in (10, 50, 90, 200))))
    steps = ["true", "true AND p1 > 20", "true AND p1 > 20 AND coalesce(p3 > 20, false)", "true AND p1 > 20 AND coalesce(p3 > 20, false) AND score > 100000"]
    funnel = " UNION ALL ".join(f"SELECT {i}::BIGINT AS step, '{n}' AS name, count(*) FILTER (WHERE {w}) AS n, round(avg(label) FILTER (WHERE {w}) + 3e-9, 6) AS rate FROM c" for i, (n, w) in enumerate(zip(("all", "p1", "p3", "score"), steps, strict=True)))
    return {
        "key_choices": "WITH k AS (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS d, count(DISTINCT (l_orderkey, l_linenumber)) AS a, count(DISTINCT (l_orderkey, l_partkey)) AS b, count(DISTINCT (l_partkey, l_suppkey)) AS e FROM lineitem) SELECT 'order and line' AS name, n AS n_rows, d AS n_distinct, a AS n_keys FROM k UNION ALL SELECT 'order and part', n, d, b FROM k UNION ALL SELECT 'part and supplier', n, d, e FROM k",
        "missing_by_year": f"{c} SELECT year(day)::INTEGER AS period, name, {a('(x IS NULL)::INT')} AS share FROM (SELECT day, 'p2' AS name, p2 AS x FROM c UNION ALL SELECT day, 'p3', p3 FROM c UNION ALL SELECT day, 'late', CASE WHEN p1 > 30 THEN p1 END FROM c) GROUP BY 1, 2",
        "label_rates": f"{c}, y AS (SELECT year(day)::INTEGER AS year, grp, CASE WHEN id % 6 <> 0 THEN label END AS known, p3 FROM c) SELECT year, grp, grouping(year, grp)::BIGINT AS level, count(*) AS n, count(known) AS n_known, {a('known')} AS rate, {q('p3', 0.25)} AS q25, {q('p3', 0.5)} AS q50, {q('p3', 0.75)} AS q75 FROM y GROUP BY CUBE (year, grp)",
        "coverage_by_group": f"{c} SELECT last_day(day) AS month, grp, count(*) AS n, count(p1) AS n_p1, count(p3) AS n_p3, {q('p1', 0.5)} AS median_p1, {q('p3', 0.5)} AS median_p3 FROM c GROUP BY 1, 2",
        "filter_funnel": f"{c} {funnel}",
        "liquidity_ladder": f"{c} {ladder}",
        "return_summary": f"WITH {_OUTCOMES} SELECT year, {returns} FROM oc GROUP BY year",
        "overlap_table": f"{c}, s AS (SELECT p1 >= 90 AS a, coalesce(p3 >= 80, false) AS b FROM c) SELECT count(*) AS n, count_if(a) AS n_a, count_if(b) AS n_b, count_if(a AND b) AS n_both, count_if(NOT a AND NOT b) AS n_neither, round(count_if(a) * count_if(b) / count(*) + 3e-9, 6) AS expected, round(count_if(a AND b) / count_if(a) + 3e-9, 6) AS b_in_a, round(count_if(a AND b) / count_if(b) + 3e-9, 6) AS a_in_b FROM s",
        "matched_series": f"WITH {sql.BARS}, m AS (SELECT code, last_day(day) AS day, sum(va) AS x FROM bars GROUP BY 1, 2), k AS (SELECT code % 4 AS ref, day, sum(x::DECIMAL(18,2))::DOUBLE AS y FROM m GROUP BY 1, 2), r AS (SELECT code, ref, corr(x, y) AS r FROM m JOIN k USING (day) GROUP BY 1, 2 HAVING count(*) >= 20), o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY r DESC, ref) AS p FROM r) SELECT code, max(ref) FILTER (WHERE p = 1) AS best, round(max(r) FILTER (WHERE p = 1) + 3e-9, 6) AS r, round(max(r) FILTER (WHERE p = 2) + 3e-9, 6) AS second, round(max(r) FILTER (WHERE p = 1) - max(r) FILTER (WHERE p = 2) + 3e-9, 6) AS gap FROM o GROUP BY code",
        "complete_ratio": f"{c} SELECT day, count(DISTINCT grp) AS n, round(CASE WHEN sum(score) > 0 THEN sum(CASE WHEN label = 1 THEN score ELSE 0 END::DECIMAL(18,2))::DOUBLE / sum(score::DECIMAL(18,2))::DOUBLE * 100 END + 3e-9, 6) AS ratio FROM c GROUP BY day HAVING count(DISTINCT grp) >= 4",
        "weekly_flows": "WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE + 6 AS week, sum(x) AS total, " + ", ".join(f"coalesce(sum(x) FILTER (WHERE o_orderstatus = '{s}'), 0) AS {s}" for s in "FOP") + " FROM (SELECT *, o_totalprice::DECIMAL(18,2) AS x FROM orders) GROUP BY 1) SELECT week, total::DOUBLE AS total, F::DOUBLE AS F, O::DOUBLE AS O, P::DOUBLE AS P, " + ", ".join(f"round({s}::DOUBLE / total::DOUBLE * 100 + 3e-9, 6) AS share_{s}" for s in "FOP") + " FROM w",
        "holder_statistics": "WITH h AS (SELECT l_orderkey, p_name, CASE WHEN l_quantity > 3 THEN l_quantity END AS s FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_orderkey, count(s) AS n_holders, max(s) AS largest, sum(s) AS total, round(sum(s * s) / pow(sum(s), 2) + 3e-9, 6) AS concentration, CASE WHEN count(s) > 0 THEN coalesce(sum(s) FILTER (WHERE regexp_matches(p_name, '^small')), 0) END AS share_small, CASE WHEN count(s) > 0 THEN coalesce(sum(s) FILTER (WHERE regexp_matches(p_name, 'steel|brass|copper|ring')), 0) END AS share_metal FROM h GROUP BY 1",
        "trade_statistics": f"""WITH {sql.BARS}, w AS (SELECT code, day, lead(o) OVER x AS entry, {sql.over("max(h)", 1, 20)} AS top, {sql.over("min(l)", 1, 20)} AS low, {sql.over("count(*)", 1, 20)} AS n FROM bars WINDOW x AS (PARTITION BY code ORDER BY day)),
t AS (SELECT year(day)::INTEGER AS year, top >= entry * (1 + 0.1) AS hit, ((top / entry - 1) * 100 + (low / entry - 1) * 100) / 2 AS ret FROM w WHERE entry IS NOT NULL AND (top >= entry * (1 + 0.1) OR n = 20))
SELECT year, count(*) AS n, round(avg(ret) + 3e-9, 5) AS mean, round(quantile_cont(ret, 0.5) + 3e-9, 5) AS median, round(avg((ret > 0)::INT) * 100 + 3e-9, 5) AS win, round(stddev_samp(ret) / sqrt(count(*)) + 3e-9, 5) AS se, round(avg(hit::INT) * 100 + 3e-9, 5) AS hit, round(min(ret) + 3e-9, 5) AS worst, round(count(*) / (250 / 21.0) + 3e-9, 5) AS per_month, round(sum(ret) / 3 / (250 / 21.0) + 3e-9, 5) AS monthly FROM t GROUP BY year""",
        "session_blocks": f"{c}, d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, lead(day, 59) OVER (ORDER BY day) AS last FROM (SELECT DISTINCT day FROM c)) SELECT i // 25 AS block, day AS first, last FROM d WHERE i % 25 = 0 AND last IS NOT NULL",
        "block_returns": f"WITH {_OUTCOMES}, d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, lead(day, 119) OVER (ORDER BY day) AS last FROM (SELECT DISTINCT day FROM bars)) SELECT i // 60 AS block, d.day AS first, last, {returns} FROM d JOIN oc ON oc.day BETWEEN d.day AND last WHERE i % 60 = 0 AND last IS NOT NULL GROUP BY ALL",
        "place_in_distribution": f"{c} SELECT grp, count(p3) AS n, {q('p3', 0.1)} AS p10, {q('p3', 0.5)} AS p50, {q('p3', 0.9)} AS p90, {a('CASE WHEN p3 < 70 THEN 100.0 WHEN p3 = 70 THEN 50.0 ELSE 0.0 END::DOUBLE')} AS rank FROM c WHERE p3 IS NOT NULL GROUP BY grp",
        "percentile_tables": f"{c} SELECT quarter(day)::INTEGER AS quarter, grp, count(p3) AS n, " + ", ".join(f"{q('p3', f'{i} / 12.0')} AS x{i}" for i in range(13)) + " FROM c WHERE p3 IS NOT NULL GROUP BY 1, 2 HAVING count(p3) >= 30",
        "size_buckets": "WITH t AS (SELECT l_suppkey AS code, l_shipdate::DATE AS day, l_extendedprice AS x, CASE WHEN l_linenumber = 1 THEN 'auction' WHEN l_extendedprice < 20000 THEN 'small' WHEN l_extendedprice < 60000 THEN 'medium' ELSE 'large' END AS k FROM lineitem), s AS (SELECT code, day, " + ", ".join(f"coalesce(sum(x) FILTER (WHERE k = '{k}'), 0) AS {k}, count(*) FILTER (WHERE k = '{k}') AS n_{k}" for k in ("small", "medium", "large", "auction")) + " FROM t GROUP BY 1, 2) SELECT code, day, " + ", ".join(f"round({k} + 3e-7, 2) AS {k}, n_{k}" for k in ("small", "medium", "large", "auction")) + ", round(CASE WHEN small + medium + large > 0 THEN large / (small + medium + large) * 100 END + 3e-9, 5) AS large_share FROM s",
        "outcome_density": f"WITH {_OUTCOMES} SELECT least(greatest(floor((fin + 0.5) / 0.05), 0), 19)::INTEGER AS bin_x, least(greatest(floor(best / 0.05), 0), 19)::INTEGER AS bin_y, count(*) AS n, CASE WHEN count(*) >= 30 THEN count(*) ELSE 0 END AS shown FROM oc GROUP BY 1, 2",
        "composition_spread": f"{c}, s AS (SELECT f, g, count(*) FILTER (WHERE grp = g) / count(*) AS s FROM (SELECT id % 5 AS f, grp FROM c), (SELECT DISTINCT grp AS g FROM c) GROUP BY f, g) SELECT g AS grp, round(min(s) + 3e-9, 6) AS low, round(max(s) + 3e-9, 6) AS high, round(max(s) - min(s) + 3e-9, 6) AS spread FROM s GROUP BY g",
        "model_agreement": f"{c} SELECT grp, (p1 >= 80)::INT + (p2 >= 80)::INT + coalesce((p3 >= 80)::INT, 0)::BIGINT AS n_agree, count(*) AS n FROM c GROUP BY 1, 2",
        "daily_ledger": f"{c}, d AS (SELECT day, " + ", ".join(f"max(score) FILTER (WHERE grp = '{n}') AS v{n[0]}" for n in names) + " FROM c GROUP BY day), f AS (SELECT day, " + ", ".join(f"last_value(v{n[0]} IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v{n[0]}" for n in names) + " FROM d) SELECT *, round(" + " + ".join(f"coalesce(v{n[0]}, 0)" for n in names) + " + 3e-7, 2) AS total FROM f",
        "totals_rows": f"{c} SELECT CASE WHEN grouping(grp) = 1 THEN 'TOTAL' ELSE grp END AS grp, count(*) AS n, sum(score::DECIMAL(18,2))::DOUBLE AS amount, sum(CASE WHEN label = 1 THEN score::DECIMAL(18,2) END)::DOUBLE AS realised FROM c GROUP BY ROLLUP (grp)",
        "plausibility": f"{c}, l AS (SELECT 'score' AS name, score AS x, 1000 AS lo, 400000 AS hi FROM c UNION ALL SELECT 'p3', p3, 5, 95 FROM c UNION ALL SELECT 'inverse', CASE WHEN p1 = 0 THEN 'infinity'::DOUBLE ELSE 1 / p1 END, 0, 1 FROM c UNION ALL SELECT 'shifted', p2 - 50, -40, 40 FROM c) SELECT name, count(x) AS n, count_if(isinf(x)) AS n_inf, count_if(x = 0) AS n_zero, count_if(isfinite(x) AND (x < lo OR x > hi)) AS n_outside, round(avg(x) FILTER (WHERE isfinite(x)) + 3e-7, 5) AS mean, min(x) FILTER (WHERE isfinite(x)) AS low, max(x) FILTER (WHERE isfinite(x)) AS high FROM l GROUP BY name",
        "identity_checks": f"{c}, l AS (SELECT 'product' AS name, p1 * p2 AS a, p2 * p1 AS b FROM c UNION ALL SELECT 'shifted', p1 + 1, p1 FROM c UNION ALL SELECT 'third', p3, floor(p3) FROM c) SELECT name, count(a + b) AS n, round(max(abs(a - b) / greatest(abs(a), abs(b), 1e-300)) + 3e-9, 6) AS worst FROM l GROUP BY name",
        "lag_coverage": f"{c}, l AS (SELECT p3 AS q0, CASE WHEN id % 3 > 0 THEN p3 END AS q1, CASE WHEN id % 9 > 0 THEN p1 END AS q2 FROM c) SELECT 'first' AS name, count(q0) AS n, round(100 * count(q0 + q1) / count(q0) + 3e-9, 6) AS with_1, round(100 * count(q0 + q2) / count(q0) + 3e-9, 6) AS with_2 FROM l UNION ALL SELECT 'second', count(q1), round(100 * count(q0 + q1) / count(q1) + 3e-9, 6), round(100 * count(q1 + q2) / count(q1) + 3e-9, 6) FROM l",
    }
