"""Queries on replays, growing histories, publication calendars and comparisons between years: their Spark form and SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import publication, simulate, windows
from tidewell.plans import bars_sql as sql
from tidewell.session import shared_folder
from tidewell.sources import sinks
from tidewell.sources.tables import daily_bars, table


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simulate.entry_outcome(_bars(spark, sf_dir))
    return out.select("code", "day", "entry", "hit_after", F.round(F.col("mfe") + 3e-7, 4).alias("mfe"), F.round(F.col("mae") + 3e-7, 4).alias("mae"), "status")


def _outcomes_sql() -> str:
    return f"""WITH {sql.BARS}, a AS (SELECT *, lead(o) OVER (PARTITION BY code ORDER BY day) AS entry, {sql.over("list(h)", 1, 20)} AS hs, {sql.over("max(h)", 1, 20)} AS top, {sql.over("min(l)", 1, 20)} AS low FROM bars),
b AS (SELECT *, list_position(list_transform(coalesce(hs, []), lambda x: x >= entry * (1 + 0.1)), true) AS at1 FROM a)
SELECT code, day, entry, CASE WHEN at1 > 0 THEN at1::BIGINT END AS hit_after, round((top / entry - 1) * 100 + 3e-7, 4) AS mfe, round((low / entry - 1) * 100 + 3e-7, 4) AS mae,
  CASE WHEN entry IS NULL THEN 'no_entry' WHEN at1 > 0 THEN 'hit' WHEN len(hs) < 20 THEN 'holding' ELSE 'expired' END AS status FROM b"""


def slot_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).where("o_totalprice > 300000").select(F.col("o_orderpriority").alias("book"), "o_orderkey", F.col("day").cast("string").alias("start"), F.date_add("day", 30).cast("string").alias("end"))
    return simulate.slots(o, "book", ["start", "o_orderkey"], "start", "end", 3)


_SLOTS = """
WITH RECURSIVE o AS (SELECT o_orderpriority AS book, o_orderkey, o_orderdate::DATE AS d, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate::DATE, o_orderkey) AS i FROM orders WHERE o_totalprice > 300000),
r AS (
  SELECT book, o_orderkey, d, i, true AS taken, [d + 30] AS busy FROM o WHERE i = 1
  UNION ALL
  SELECT o.book, o.o_orderkey, o.d, o.i, len(list_filter(busy, lambda b: b >= o.d)) < 3,
    CASE WHEN len(list_filter(busy, lambda b: b >= o.d)) < 3 THEN list_append(list_filter(busy, lambda b: b >= o.d), o.d + 30) ELSE list_filter(busy, lambda b: b >= o.d) END
  FROM r JOIN o ON o.book = r.book AND o.i = r.i + 1)
SELECT book, o_orderkey, d::VARCHAR AS start, (d + 30)::VARCHAR AS "end" FROM r WHERE taken"""


def versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select((F.col("o_custkey") % 20).alias("bucket"), "o_custkey", "o_orderkey", F.datediff("day", F.lit("1990-01-01").cast("date")).alias("t"), "o_totalprice")
    return windows.versioned_percentile(o, "bucket", ["o_custkey"], "t", "o_totalprice", "o_orderkey", 3).select("o_orderkey", F.round("pct", 6).alias("pct"))


_VERSIONED = """
WITH o AS (SELECT o_custkey % 20 AS bucket, o_custkey, o_orderkey, o_orderdate::DATE AS day, o_totalprice AS x, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders),
j AS (SELECT r.o_orderkey, count(*) AS n, count(*) FILTER (WHERE s.x < r.x) AS a, count(*) FILTER (WHERE s.x <= r.x) AS b FROM o r JOIN o s ON s.bucket = r.bucket AND s.day < r.day AND (s.until IS NULL OR s.until >= r.day) GROUP BY 1)
SELECT o.o_orderkey, round(CASE WHEN n >= 3 THEN (a + b) / (2 * n) END, 6) AS pct FROM o LEFT JOIN j USING (o_orderkey)"""


def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", F.col("quality").alias("label"), "n_chars", "doc_id")
    out = simulate.permutation_test(d, "source", "label", "n_chars", "doc_id", 100)
    return out.select("draw", F.round(F.col("diff") + 3e-7, 4).alias("diff"))


_PERMUTED = """
WITH d AS (SELECT source, quality AS y, n_chars AS x, doc_id FROM documents JOIN labels USING (doc_id) WHERE source IS NOT NULL AND quality IS NOT NULL AND n_chars IS NOT NULL),
k AS (SELECT source, sum(y) AS k FROM d GROUP BY source),
r AS (SELECT draw, x, CASE WHEN draw = 0 THEN y = 1 ELSE row_number() OVER (PARTITION BY draw, source ORDER BY md5('0:' || draw || ':' || doc_id), doc_id::VARCHAR) <= k END AS one FROM d JOIN k USING (source), range(101) v(draw))
SELECT draw::INTEGER AS draw, round(avg(x) FILTER (WHERE one) - avg(x) FILTER (WHERE NOT one) + 3e-7, 4) AS diff FROM r GROUP BY draw"""


def month_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.block_folds(_orders(spark, sf_dir).select("o_orderkey", "day"), "day", 5)


def purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each fold validates and trains on, when training leaves out what lies within five sessions of a validation day."""
    o = _orders(spark, sf_dir).select("o_orderkey", "day")
    folds = simulate.purged_folds(o, "day", o.where("dayofweek(day) > 1").select("day"), 5, 5).where("left_out IS NOT NULL")
    each = folds.select("fold", "left_out", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("of"))
    return each.groupBy("of").agg(F.count_if(F.col("fold") == F.col("of")).alias("n_validation"), F.count_if(~F.array_contains("left_out", F.col("of"))).alias("n_training"), F.count_if((F.col("fold") != F.col("of")) & F.array_contains("left_out", F.col("of"))).alias("n_purged"))


_PURGED = """
WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders), f AS (SELECT m, ((row_number() OVER (PARTITION BY year(m) ORDER BY md5('0:' || m::VARCHAR)) - 1) % 5)::INTEGER AS fold FROM m),
s AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE dayofweek(o_orderdate) > 0)),
d AS (SELECT s.day, s.i, f.fold FROM s JOIN f ON date_trunc('month', s.day)::DATE = f.m),
x AS (SELECT a.day, a.fold, k.fold AS of, EXISTS (SELECT 1 FROM d b WHERE b.fold = k.fold AND abs(a.i - b.i) <= 5) AS near FROM d a, (SELECT DISTINCT fold FROM f) k)
SELECT of, count(*) FILTER (WHERE x.fold = of) AS n_validation, count(*) FILTER (WHERE NOT near) AS n_training, count(*) FILTER (WHERE near AND x.fold <> of) AS n_purged
FROM orders JOIN x ON x.day = o_orderdate::DATE GROUP BY of"""


def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The isotonic fit of whether a line is open by the week it was shipped in."""
    lines = table(spark, sf_dir, "lineitem").select(F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 7).cast("double").alias("week"), (F.col("l_orderkey") % 7 < 3 * F.col("l_linestatus").eqNullSafe("O").cast("int") + 2).cast("int").alias("open"))
    return simulate.isotonic_pools(lines, "week", "open").select("low", "high", "n", F.round("value", 9).alias("value"))


#: The fit is max over a <= i of min over b >= i of the mean of a to b.
_ISOTONIC = """
WITH p AS (SELECT floor((l_shipdate::DATE - DATE '1992-01-01') / 7)::DOUBLE AS x, count(*) AS n, sum((l_orderkey % 7 < 3 * (l_linestatus = 'O')::INT + 2)::INT) AS s FROM lineitem GROUP BY 1),
q AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM p WINDOW w AS (ORDER BY x)),
m AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n) AS mean FROM q a JOIN q b ON b.i >= a.i),
l AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM m),
v AS (SELECT i, max(least) AS value FROM l GROUP BY i)
SELECT min(x) AS low, max(x) AS high, sum(n)::BIGINT AS n, round(value, 9) AS value FROM q JOIN v USING (i) GROUP BY value"""


def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.spearman(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_suppkey", "n", F.round(F.col("rho") + 3e-9, 6).alias("rho"))


def next_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.nth_session_of_next_week(_orders(spark, sf_dir), "day", 2)


def week_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.week_last_day(_orders(spark, sf_dir), "day")


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return publication.confirmed_days(o, o.where("o_orderstatus = 'P'"), "day", F.lit("2001-06-30").cast("date"), 14)


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return publication.missing_days(o, o.where("o_orderpriority <> '5-LOW'"), "day")


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _orders(spark, sf_dir).groupBy("o_custkey", F.year("day").alias("fy")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("x"), F.max("o_orderstatus").alias("g"))
    return publication.against_year(f, "o_custkey", "fy", "x", "g", 1).select("o_custkey", "fy", "x", "g", "prev", F.round(F.col("change") + 3e-7, 4).alias("change"))


def peer_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return publication.peers(c, ["c_nationkey"], "c_custkey", "c_acctbal", 5).select("c_nationkey", "c_custkey", "c_acctbal", "n_peers", F.round(F.col("peer_mean") + 3e-7, 3).alias("peer_mean"))


def month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication.month_end(_bars(spark, sf_dir).select("code", "day", "c"), "code", "day", "c", 5)


def limited_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).select("code", "day", F.when(F.col("v") > 40, F.col("v")).alias("x"))
    return publication.exact_or_asof_limit(b, "code", "day", "x", 3)


def ingested_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by day, each file sorted, and what the stored days hold."""
    path = f"{shared_folder(spark)}/tidewell-days-{uuid.uuid4().hex}"
    sinks.write_days(table(spark, sf_dir, "events"), path, "ts", ["user_id", "ts", "event_id"])
    return sinks.day_stats(spark.read.parquet(path), "date", "user_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "entry_outcomes": outcomes,
        "slot_portfolio": slot_portfolio,
        "versioned_percentile": versioned,
        "permutation_test": permutation,
        "month_block_folds": month_folds,
        "purged_folds": purged,
        "isotonic_fit": isotonic_fit,
        "spearman_by_key": rank_correlation,
        "next_week_session": next_week,
        "week_last_days": week_ends,
        "confirmed_days": confirmed,
        "missing_days": missing,
        "change_on_year": years,
        "peer_means": peer_means,
        "month_ends": month_ends,
        "limited_fill": limited_fill,
        "ingested_days": ingested_days,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "ingested_days": "SELECT ts::DATE AS date, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys FROM events GROUP BY 1",
        "entry_outcomes": _outcomes_sql(),
        "versioned_percentile": _VERSIONED,
        "slot_portfolio": _SLOTS,
        "permutation_test": _PERMUTED,
        "purged_folds": _PURGED,
        "isotonic_fit": _ISOTONIC,
        "month_block_folds": "WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders), f AS (SELECT m, ((row_number() OVER (PARTITION BY year(m) ORDER BY md5('0:' || m::VARCHAR)) - 1) % 5)::INTEGER AS fold FROM m) SELECT o_orderkey, o_orderdate::DATE AS day, fold FROM orders JOIN f ON date_trunc('month', o_orderdate)::DATE = m",
        "spearman_by_key": "WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT l_suppkey, count(*) AS n, round(corr(a, b) + 3e-9, 6) AS rho FROM r GROUP BY 1",
        "next_week_session": "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), k AS (SELECT d, date_trunc('week', d)::DATE AS w, row_number() OVER (PARTITION BY date_trunc('week', d) ORDER BY d) AS k FROM d) SELECT a.w AS week, coalesce(b.d, a.w + 8) AS available FROM (SELECT DISTINCT w FROM k) a LEFT JOIN k b ON b.w = a.w + 7 AND b.k = 2",
        "week_last_days": "SELECT date_trunc('week', o_orderdate)::DATE AS week, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1",
        "confirmed_days": "SELECT o_orderdate::DATE AS day, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_rows, count(*) FILTER (WHERE o_orderstatus = 'P') > 0 AS has_rows, count(*) FILTER (WHERE o_orderstatus = 'P') > 0 OR DATE '2001-06-30' - o_orderdate::DATE >= 14 AS confirmed FROM orders GROUP BY o_orderdate",
        "missing_days": "SELECT o_orderdate::DATE AS day FROM orders GROUP BY o_orderdate HAVING count(*) FILTER (WHERE o_orderpriority <> '5-LOW') = 0",
        "change_on_year": "WITH f AS (SELECT o_custkey, year(o_orderdate)::INTEGER AS fy, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS x, max(o_orderstatus) AS g FROM orders GROUP BY 1, 2), p AS (SELECT a.*, CASE WHEN a.g = b.g THEN b.x END AS prev FROM f a LEFT JOIN f b ON a.o_custkey = b.o_custkey AND b.fy = a.fy - 1) SELECT *, round(CASE WHEN abs(x) + abs(prev) > 0 THEN (x - prev) / ((abs(x) + abs(prev)) / 2) * 100 END + 3e-7, 4) AS change FROM p",
        "peer_means": "WITH s AS (SELECT *, count(*) OVER w - 1 AS n_peers, sum(c_acctbal) OVER w - c_acctbal AS t FROM customer WINDOW w AS (PARTITION BY c_nationkey)) SELECT c_nationkey, c_custkey, c_acctbal, n_peers, round(CASE WHEN n_peers >= 5 THEN t / n_peers END + 3e-7, 3) AS peer_mean FROM s",
        "month_ends": f"WITH {sql.BARS} SELECT code, last_day(day) AS month_end, arg_max(c, day) AS c, max(day) AS day FROM bars GROUP BY 1, 2 HAVING last_day(day) - max(day) <= 5".replace("HAVING last_day(day)", "HAVING last_day(max(day))"),
        "limited_fill": f"WITH {sql.BARS}, b AS (SELECT code, day, CASE WHEN v > 40 THEN v END AS x FROM bars) SELECT code, day, x, last_value(x IGNORE NULLS) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS filled FROM b",
    }
