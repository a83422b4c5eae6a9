"""Queries on joins by time, versioned facts, ranks and upserts: their Spark form and SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import asof, facts, rank
from tidewell.plans import bars_sql as sql
from tidewell.sources.tables import daily_bars, table


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40")
    return lines.groupBy(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("flag_day")).agg(F.sum("l_quantity").alias("flag_qty"))


_FLAGGED = "flagged AS (SELECT l_suppkey AS code, l_shipdate::DATE AS flag_day, sum(l_quantity) AS flag_qty FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY ALL)"


def _asof(strict: bool, tolerance: int | None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return asof.asof_join(_bars(spark, sf_dir).select("code", "day"), _flagged(spark, sf_dir), ["code"], "day", "flag_day", ["flag_qty"], strict, tolerance)

    return query


def _asof_sql(sign: str, tolerance: int | None) -> str:
    keep = lambda c: c if tolerance is None else f"CASE WHEN day - flag_day <= {tolerance} THEN {c} END"
    return f"WITH {sql.BARS}, {_FLAGGED} SELECT bars.code, day, {keep('flag_day')} AS flag_day, {keep('flag_qty')} AS flag_qty FROM bars ASOF LEFT JOIN flagged ON bars.code = flagged.code AND day {sign} flag_day"


def asof_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").groupBy(F.col("o_orderdate").cast("date").alias("mday")).agg(F.count("*").alias("urgent"))
    return asof.asof_calendar(bars.select("code", "day"), orders, "day", "mday", ["urgent"])


def count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    out = asof.count_within(orders, ["o_custkey"], "day", 250, F.col("o_orderpriority") == "1-URGENT", "urgent_250d")
    return asof.count_within(out, ["o_custkey"], "day", 60, F.lit(True), "orders_60d").select("o_orderkey", "orders_60d", "urgent_250d")


def scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    plan = orders.select("o_custkey", F.col("day").alias("published"), F.date_add("day", 45).alias("due"))
    return asof.next_scheduled(orders, plan, "o_custkey", "day", "published", "due", ["o_orderkey", "o_custkey", "day"])


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("a"))
    spans = first.select("o_custkey", "a", F.add_months("a", 12).alias("b"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return asof.within_intervals(rows, spans, "o_custkey", "day", "a", "b")


def live_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("a"), F.date_add(F.col("o_orderdate").cast("date"), 365).alias("b"), F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    return asof.live_total(o, ["o_custkey"], "a", "b", "x").withColumn("total", F.col("total").cast("double"))


def next_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"))
    return asof.session_index(days, "day").withColumn("session", F.col("session").cast("long"))


def _cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("q"), F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    per = o.groupBy("entity", "fy", "q").agg(F.sum("x").alias("x"))
    w = Window.partitionBy("entity", "fy").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("entity", "fy", "q", F.sum("x").over(w).cast("double").alias("cum"))


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts.quarterly(_cumulative(spark, sf_dir), "entity", "fy", "q", "cum")
    return out.select("entity", "fy", "q", "cum", *(F.round(F.col(c) + 3e-7, 2).alias(c) for c in ("single", "ttm", "yoy")), "rising")


_QUARTERLY = """
WITH p AS (SELECT o_custkey AS entity, year(o_orderdate)::INTEGER AS fy, quarter(o_orderdate)::INTEGER AS q, sum(o_totalprice::DECIMAL(18,2)) AS x FROM orders GROUP BY ALL),
c AS (SELECT entity, fy, q, (sum(x) OVER (PARTITION BY entity, fy ORDER BY q))::DOUBLE AS cum, fy * 4 + q AS i FROM p),
s AS (SELECT *, CASE WHEN q = 1 THEN cum WHEN lag(i) OVER w = i - 1 THEN cum - lag(cum) OVER w END AS single FROM c WINDOW w AS (PARTITION BY entity ORDER BY i)),
t AS (SELECT *, CASE WHEN count(single) OVER w = 4 AND min(i) OVER w = i - 3 THEN sum(single) OVER w END AS ttm FROM s WINDOW w AS (PARTITION BY entity ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
, u AS (SELECT entity, i, CASE WHEN lag(i) OVER w = i - 1 THEN sign(single - lag(single) OVER w) END AS s FROM s WINDOW w AS (PARTITION BY entity ORDER BY i)),
v AS (SELECT entity, i, s * (1 + CASE WHEN lag(s) OVER w IS DISTINCT FROM s THEN 0 WHEN lag(s, 2) OVER w IS DISTINCT FROM s THEN 1 WHEN lag(s, 3) OVER w IS DISTINCT FROM s THEN 2 ELSE 3 END) AS rising FROM u WINDOW w AS (PARTITION BY entity ORDER BY i))
SELECT t.entity, t.fy, t.q, t.cum, v.rising::BIGINT AS rising, round(t.single + 3e-7, 2) AS single, round(ttm + 3e-7, 2) AS ttm, round(CASE WHEN b.single > 0 THEN (t.single / b.single - 1) * 100 END + 3e-7, 2) AS yoy
FROM t JOIN v ON v.entity = t.entity AND v.i = t.i LEFT JOIN s b ON b.entity = t.entity AND b.i = t.i - 4"""


def lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _bars(spark, sf_dir).select("code", "day", F.when(F.col("v") > 30, F.col("v")).alias("big"))
    return facts.lag_available(df, "code", "day", "big", 2, 20, "big_2_ago")


def reissued(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("fy"), F.col("o_orderdate").cast("date").alias("day"))
    return facts.reissue_windows(o, ["o_custkey", "fy"], "day")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("fy"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_totalprice")
    return facts.known_at(o, F.lit("1998-06-30").cast("date"), ["o_custkey", "fy"], "day", ["day", "o_orderkey"])


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 10 = 3").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 20 == 3, 0).otherwise(100000000)).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return facts.keyed_upsert(o, new, ["o_orderkey"])


def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return facts.insert_missing(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lower("c_mktsegment")), ["c_custkey"])


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    return facts.replace_window(o, o.where("day >= DATE '2000-01-01' AND o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N")), "day")


def conflict_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return facts.conflicts(lines, ["l_orderkey", "l_linenumber"])[0]


def diffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    b = o.where("o_orderkey % 7 <> 0").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 11 == 0, 100000000).otherwise(0)).alias("o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, F.col("price") * 1.01).when(F.col("o_orderkey") % 5 == 1, F.col("price") * (1 + 1e-9)).when(F.col("o_orderkey") % 13 != 2, F.col("price")).alias("price"), "cust")
    return facts.table_diff(o, b, ["o_orderkey"], ["price", "cust"])


def split_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _bars(spark, sf_dir).select("code", "day", "c", F.when(F.dayofmonth("day") == 15, 0.5).when(F.dayofmonth("day") == 20, 2.0).alias("factor"))
    return facts.split_adjusted(df, "code", "day", "c", "factor")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _bars(spark, sf_dir).select("code", "day", "v")
    by = ["day"]
    return df.select("code", "day", rank.average_rank(by, "v").alias("avg_rank"), rank.rank_share(by, "v").alias("rank_share"), rank.rank_position(by, "v").alias("rank_position"), rank.grade(by, "v", 5).alias("grade"), F.rank().over(Window.partitionBy("day").orderBy(F.col("v").desc())).cast("long").alias("day_rank"))


def share_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    return rank.share_below(o.where("y >= 2000").select("o_orderkey", "o_totalprice"), o.where("y < 2000"), "o_totalprice", "o_totalprice", "share_below")


def top_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.floor(F.col("n_chars") / 500).alias("score"), "quality")
    return rank.top_with_ties(d, ["source"], "score", 5, "quality").select("source", F.round(F.col("precision") + 3e-9, 6).alias("precision"), F.round("n_taken", 6).alias("n_taken"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus")
    out = rank.banded(o, "o_totalprice", rank.quantile_bands(o, "o_totalprice", 10), "band")
    return out.groupBy("band").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "asof_backward": _asof(False, None),
        "asof_strict": _asof(True, None),
        "asof_tolerance": _asof(False, 30),
        "asof_market": asof_market,
        "count_window": count_window,
        "next_scheduled": scheduled,
        "interval_contained": contained,
        "live_positions": live_positions,
        "next_session": next_session,
        "facts_quarterly": quarterly,
        "facts_lag_available": lagged,
        "facts_reissued": reissued,
        "facts_known_at": known,
        "upsert_latest": upserted,
        "upsert_insert_missing": inserted,
        "upsert_replace_window": replaced,
        "conflict_free_keys": conflict_free,
        "table_diff": diffed,
        "split_adjusted": split_adjust,
        "rank_variants": ranked,
        "share_below": share_below,
        "top_with_ties": top_ties,
        "quantile_bands": bands,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "asof_backward": _asof_sql(">=", None),
        "asof_strict": _asof_sql(">", None),
        "asof_tolerance": _asof_sql(">=", 30),
        "asof_market": f"WITH {sql.BARS}, m AS (SELECT o_orderdate::DATE AS mday, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000 GROUP BY 1) SELECT code, day, urgent FROM bars ASOF LEFT JOIN m ON day >= mday",
        "count_window": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW) AS orders_60d, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE RANGE BETWEEN INTERVAL 249 DAY PRECEDING AND CURRENT ROW) AS urgent_250d FROM orders",
        "next_scheduled": "WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders) SELECT a.o_orderkey, a.o_custkey, a.day, min(b.day + 45) AS next_due FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.day <= a.day AND b.day + 45 >= a.day GROUP BY ALL",
        "interval_contained": "WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders), f AS (SELECT o_custkey, min(day) AS a FROM o GROUP BY 1) SELECT o.* FROM o JOIN f USING (o_custkey) WHERE day >= a AND day < (a + INTERVAL 12 MONTH)::DATE",
        "live_positions": "WITH e AS (SELECT o_custkey, o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2) AS d FROM orders UNION ALL SELECT o_custkey, o_orderdate::DATE + 365, -o_totalprice::DECIMAL(18,2) FROM orders), s AS (SELECT o_custkey, day, sum(d) AS d FROM e GROUP BY ALL) SELECT o_custkey, day, (sum(d) OVER (PARTITION BY o_custkey ORDER BY day))::DOUBLE AS total FROM s",
        "next_session": "WITH d AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem) SELECT day, row_number() OVER (ORDER BY day) AS session, lead(day) OVER (ORDER BY day) AS next_session FROM d",
        "facts_quarterly": _QUARTERLY,
        "facts_lag_available": f"WITH {sql.BARS}, b AS (SELECT code, day, CASE WHEN v > 30 THEN v END AS big FROM bars), s AS (SELECT code, day, lag(big, 2) OVER w AS x, lag(day, 2) OVER w AS t FROM b WHERE big IS NOT NULL WINDOW w AS (PARTITION BY code ORDER BY day)) SELECT b.code, b.day, b.big, CASE WHEN s.day - s.t <= 20 THEN s.x END AS big_2_ago FROM b LEFT JOIN s USING (code, day)",
        "facts_reissued": "SELECT o_custkey, year(o_orderdate)::INTEGER AS fy, min(o_orderdate::DATE) AS first_published, max(o_orderdate::DATE) AS last_published, count(*) AS versions FROM orders GROUP BY 1, 2 HAVING max(o_orderdate) > min(o_orderdate)",
        "facts_known_at": "SELECT o_custkey, fy, day, o_orderkey, o_totalprice FROM (SELECT o_custkey, year(o_orderdate)::INTEGER AS fy, o_orderdate::DATE AS day, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderdate < DATE '1998-06-30') WHERE n = 1",
        "upsert_latest": "WITH n AS (SELECT o_orderkey + CASE WHEN o_orderkey % 20 = 3 THEN 0 ELSE 100000000 END AS o_orderkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 3) SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT * FROM n",
        "upsert_insert_missing": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, lower(c_mktsegment) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0",
        "upsert_replace_window": "WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderstatus FROM orders), f AS (SELECT o_orderkey, day, 'N' AS o_orderstatus FROM o WHERE day >= DATE '2000-01-01' AND o_orderkey % 2 = 0) SELECT * FROM o WHERE day < (SELECT min(day) FROM f) UNION ALL SELECT * FROM f",
        "conflict_free_keys": "SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity) = 1",
        "table_diff": """WITH o AS (SELECT o_orderkey, o_totalprice AS price, o_custkey::DOUBLE AS cust FROM orders),
            b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 100000000 ELSE 0 END AS o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN price * 1.01 WHEN o_orderkey % 5 = 1 THEN price * (1 + 1e-9) WHEN o_orderkey % 13 <> 2 THEN price END AS price, cust FROM o WHERE o_orderkey % 7 <> 0),
            j AS (SELECT o.o_orderkey AS ka, b.o_orderkey AS kb, n.name, CASE n.name WHEN 'price' THEN o.price ELSE o.cust END AS x, CASE n.name WHEN 'price' THEN b.price ELSE b.cust END AS y FROM o FULL JOIN b ON o.o_orderkey = b.o_orderkey CROSS JOIN (VALUES ('price'), ('cust')) n(name)),
            k AS (SELECT *, ka IS NOT NULL AND kb IS NOT NULL AS c, x IS NOT DISTINCT FROM y OR coalesce(abs(x - y) <= 1e-6 * greatest(abs(x), abs(y)), false) AS near FROM j)
            SELECT name, count(*) FILTER (WHERE kb IS NULL) AS only_a, count(*) FILTER (WHERE ka IS NULL) AS only_b, count(*) FILTER (WHERE c AND near) AS same, count(*) FILTER (WHERE c AND NOT near AND x IS NOT NULL AND y IS NOT NULL) AS changed, count(*) FILTER (WHERE c AND (x IS NULL) <> (y IS NULL)) AS null_on_one_side FROM k GROUP BY name""",
        "split_adjusted": f"WITH {sql.BARS}, f AS (SELECT code, day, c, CASE day(day) WHEN 15 THEN 0.5 WHEN 20 THEN 2.0 END::DOUBLE AS factor FROM bars) SELECT code, day, c, factor, c * coalesce(product(coalesce(factor, 1)) OVER (PARTITION BY code ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS adjusted FROM f",
        "rank_variants": f"WITH {sql.BARS}, r AS (SELECT code, day, rank() OVER (PARTITION BY day ORDER BY v) + (count(*) OVER (PARTITION BY day, v) - 1) / 2 AS avg_rank, count(*) OVER (PARTITION BY day) AS n, rank() OVER (PARTITION BY day ORDER BY v DESC) AS day_rank FROM bars), p AS (SELECT *, CASE WHEN n = 1 THEN 0.5 ELSE (avg_rank - 1) / (n - 1) END AS rank_position FROM r) SELECT code, day, avg_rank, CASE WHEN n >= 2 THEN avg_rank / n END AS rank_share, rank_position, least(floor(rank_position * 5), 4)::BIGINT AS grade, day_rank FROM p",
        "share_below": "WITH h AS (SELECT o_totalprice AS x FROM orders WHERE year(o_orderdate) < 2000), n AS (SELECT count(*) AS n FROM h) SELECT o_orderkey, o_totalprice, round(100.0::DOUBLE * (SELECT count(*) FROM h WHERE x < o_totalprice) / n, 1) AS share_below FROM orders, n WHERE year(o_orderdate) >= 2000",
        "top_with_ties": "WITH d AS (SELECT source, floor(n_chars / 500) AS score, quality FROM documents JOIN labels USING (doc_id)), r AS (SELECT source, quality, rank() OVER (PARTITION BY source ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY source, score) AS m FROM d), w AS (SELECT source, quality, greatest(least((5 - r + 1) / m, 1), 0) AS w FROM r) SELECT source, round(sum(w * quality) / sum(w) + 3e-9, 6) AS precision, round(sum(w), 6) AS n_taken FROM w GROUP BY source",
        "quantile_bands": "WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM orders) SELECT len(list_filter(e[2:-2], lambda x: x < o_totalprice))::INTEGER AS band, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f FROM orders, e GROUP BY 1",
    }
