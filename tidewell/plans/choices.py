"""Queries of rules, top-k and samples, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import conditions, select
from tidewell.plans import bars_sql as sql
from tidewell.sources.tables import daily_bars, table

#: Candidates: each order is one of its customer on its day, with a score, three percentiles (the third is unknown at times) and a label.
_CANDIDATES = """c AS (
  SELECT o_orderkey AS id, o_custkey AS code, o_orderdate::DATE AS day, o_totalprice AS score, (o_orderkey * 7919 % 1000) / 10.0::DOUBLE AS p1, (o_orderkey * 104729 % 1000) / 10.0::DOUBLE AS p2,
    CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 1299709 % 1000) / 10.0::DOUBLE END AS p3, (o_orderstatus = 'F')::INTEGER AS label, o_orderpriority AS grp
  FROM orders)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("score"), (k * 7919 % 1000 / 10).alias("p1"), (k * 104729 % 1000 / 10).alias("p2"),
        F.when(k % 11 != 0, k * 1299709 % 1000 / 10).alias("p3"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_orderpriority").alias("grp"),
    )


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).select("code", F.last_day("day").alias("day")).distinct()
    return b.withColumn("name", F.when((F.col("code") % 3 == 0) & (F.col("day") < F.add_months(F.lit("1997-01-31").cast("date"), (F.col("code") % 50).cast("int"))), "PRO").otherwise("MAIN"))


_SEGMENT_SQL = f"""{sql.BARS}, g AS (SELECT DISTINCT code, last_day(day) AS t FROM bars),
s AS (SELECT code, max(t) FILTER (WHERE pro) AS inside, max(t) FILTER (WHERE NOT pro) AS outside FROM (SELECT *, code % 3 = 0 AND t < (DATE '1997-01-31' + to_months((code % 50)::INT)) AS pro FROM g) GROUP BY code),
f AS (SELECT code, min(day) AS first_row, any_value(inside) AS inside, any_value(outside) AS outside, min(day) FILTER (WHERE v > 10 AND day > inside) AS after FROM bars JOIN s USING (code) GROUP BY code),
m AS (SELECT code, first_row, inside IS NOT NULL AS was_inside, CASE WHEN inside IS NULL THEN first_row WHEN outside > inside THEN after END AS start FROM f),
z AS (SELECT *, CASE WHEN was_inside THEN start IS NOT NULL ELSE first_row > (SELECT min(first_row) FROM m) END AS known FROM m)"""


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conditions.segment_start(_bars(spark, sf_dir), _segments(spark, sf_dir), "code", "day", F.col("v") > 10, F.col("name") == "PRO")


def listing_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bars(spark, sf_dir).select("code", "day")
    return conditions.years_since(rows, _starts(spark, sf_dir), "code", "day", 3.0).select("code", "day", F.round(F.col("years") + 3e-9, 6).alias("years"))


def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    return conditions.encoded(conditions.encoded(c, "c_mktsegment", "segment_code"), "nation", "nation_code").select("c_custkey", "segment_code", "nation_code")


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters one after the other: markets, common shares, completeness, quality, rule."""
    c = candidates(spark, sf_dir).withColumn("text", F.lpad(F.col("code").cast("string"), 5, "1"))
    c = c.withColumns({"in_market": conditions.not_among(F.when(F.col("grp") != "5-LOW", F.col("grp")), ["1-URGENT"]), "common": conditions.common_share(F.col("text")), "complete": conditions.complete(["p1", "p2", "p3"]), "good": conditions.last_positive(["p1", "p3"]), "least_pct": conditions.least_of(["p1", "p2", "p3"])})
    return c.where("in_market AND common").select("id", "complete", "good", "least_pct", (F.col("least_pct") >= 50).alias("passed"))


def sigma_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators import panel

    b = panel.forward_label(_bars(spark, sf_dir))
    f = panel.bars_frames()
    b = b.withColumn("r", (F.col("c") / F.lag("c").over(f.by) - 1) * 100)
    b = f.roll(b, vol=(F.col("r"), 20, F.stddev_samp))
    rise, end = F.col("max_ahead") / F.col("entry") - 1, F.col("end_close") / F.col("entry") - 1
    trend = (f.lead(F.col("c"), 20) >= F.col("c")).cast("int")
    fixed = conditions.material_label(rise, end, trend, *conditions.thresholds(F.col("vol"), 20, 0.1, 0.05, None))
    scaled = conditions.material_label(rise, end, trend, *conditions.thresholds(F.col("vol"), 20, 0.1, 0.05, 0.8))
    return b.select("code", "day", fixed.alias("fixed"), scaled.alias("scaled"))


def _label_sql(need: str) -> str:
    return f"CASE WHEN rise IS NOT NULL AND fin IS NOT NULL AND trend IS NOT NULL AND {need} IS NOT NULL THEN rise >= {need} AND fin >= 0.5 * {need} AND trend END"


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    level = conditions.keyword_level(F.when(F.col("p_size") % 10 == 0, "-").otherwise(F.col("p_name")), [("small", 1), ("ring", 2), ("large", 3)])
    flag = conditions.flag_of(F.col("p_type"), ["ECONOMY", "STANDARD"], ["PROMO", "SMALL"])
    fee = conditions.annual_percent(F.col("p_retailprice") / 1000, F.col("p_size") - 5, F.col("p_retailprice") - 905)
    kind = conditions.first_class(F.when(F.col("p_size") % 7 != 0, F.col("p_name")), [("shiny", "(gold|silver|ring)"), ("big", "^(large|huge)")])
    return p.select("p_partkey", level.alias("level"), flag.alias("flag"), F.round(fee + 3e-9, 6).alias("fee"), kind.alias("kind"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("code", "id", "day", F.when(F.col("id") % 3 == 0, F.date_add("day", 4)).alias("published"), "score")
    d = lambda x: F.lit(x).cast("date")
    return conditions.eligible_balance(c.withColumn("day", F.col("day")), "code", "day", "published", d("2000-06-30"), F.when(F.col("id") % 3 == 1, d("2000-05-31")), d("1998-01-01"), F.date_add("day", 9), "id").select("code", "day", "available", "basis", F.col("score"))


def actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"period": F.concat(F.lit("Q"), F.quarter("day")), "sales": F.when(F.col("id") % 5 > 2, F.col("score")), "profit": F.when(F.col("id") % 7 > 3, F.col("p1"))})
    return c.where(conditions.actual_only(F.col("period"), ["Q1", "Q2", "Q3"], ["sales", "profit"])).select("id", "period")


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda x: F.lit(x).cast("date")
    return conditions.between_runs(candidates(spark, sf_dir).withColumn("p", F.col("p3")), "day", d("1999-01-01"), d("1999-06-30"), "p").select("id", "day", "p")


def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_percent(candidates(spark, sf_dir), "p1", "id", 3.0).select("id", "p1")


def top_in_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_percent_within(candidates(spark, sf_dir), ["grp"], "p1", "id", 2.5).select("grp", "id", "p1")


def one_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("coarse", F.floor(F.col("p1") / 50))
    return select.best_per_day(c, "day", "coarse", "id").select("day", "id", "coarse")


def over_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("fold", F.year("day"))
    return select.over_earlier_folds(c, "fold", "p3", 0.9, 100).select("id", "fold", F.round("threshold", 6).alias("threshold"))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("rule", conditions.least_of(["p1", "p2", "p3"]))
    return select.rule_order(c, ["day"], "rule", "score", "p2", "id").select("day", "id", F.col("order").cast("long").alias("place"))


def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("rule", conditions.least_of(["p1", "p2", "p3"]))
    return select.near_misses(c, ["grp"], "rule", 60.0, 80.0, "id").select("grp", "id", "rule", F.col("place").cast("long").alias("place"))


def extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("month", F.trunc("day", "month")).withColumn("rank", F.floor("p2") + 1)
    out = select.passed_and_extras(c, ["month"], "code", F.col("p1") >= 90, F.col("id"), "rank", 5)
    return out.select("month", "code", "id", "by_rule", F.col("place").cast("long").alias("place"))


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.newest_keys(candidates(spark, sf_dir), "code", "day", [F.col("id")], 60).select("code", "day", "id")


def class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.sample_per_class(candidates(spark, sf_dir), "grp", "id", 20).select("grp", "id")


def whole_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.recent_whole_days(candidates(spark, sf_dir), "day", 500).select("day", "id")


def drawn_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.sample_days(candidates(spark, sf_dir), "day", 40).select("day", "id")


def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.every_nth_from_end(_bars(spark, sf_dir), ["code"], "day", 20).select("code", "day", "c")


def last_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators import panel

    f = panel.bars_frames()
    b = f.roll(_bars(spark, sf_dir), m=(F.col("v"), 20))
    return select.last_of_kind(b.where("v >= 2 * m"), ["code"], "day", "v", 8).select("code", "day", "v")


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("month", F.trunc("day", "month"))
    return select.first_by_source(c, ["code", "month"], F.col("grp"), "id").select("code", "month", "id", "grp")


def cheap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"v1": F.col("p1") * 2000, "v2": F.when(F.col("id") % 4 != 0, F.col("p2") * 2500)})
    out = select.cheapest_first(c, ["grp"], "score", ["v1", "v2", "p3"], "id")
    return out.select("grp", "id", F.round("median_value", 6).alias("median_value"), F.round(F.col("ratio") + 3e-9, 6).alias("ratio"), F.col("place").cast("long").alias("place"))


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"a": F.col("p1") - 50, "b": F.col("p2") - 50, "d": F.col("p3") - 50})
    out = select.top_contributions(c, {"first": "a", "second": "b", "third": "d"}, {"first": "x", "second": "x", "third": "y"}, 2)
    return out.select("id", F.get("top", 0)["name"].alias("name_1"), F.get("top", 0)["value"].alias("value_1"), F.get("top", 1)["name"].alias("name_2"), F.col("sum_x"), F.col("sum_y"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "segment_start": _starts, "listing_years": listing_years, "category_codes": encode, "population_filters": population, "sigma_labels": sigma_labels, "text_rules": text_rules, "eligible_balances": balances, "actual_disclosures": actual, "new_training_rows": new_rows,
        "top_percent": top_rows, "top_percent_in_bands": top_in_bands, "best_of_day": one_a_day, "over_earlier_folds": over_folds, "rule_order": ordered, "near_misses": misses, "passed_and_extras": extras, "newest_keys": newest, "sample_per_class": class_sample,
        "recent_whole_days": whole_days, "sample_days": drawn_days, "every_nth_from_end": thinned, "last_spikes": last_spikes, "first_by_source": by_source, "cheapest_first": cheap, "top_contributions": contributions,
    }


def oracle_sql() -> dict[str, str]:
    c = f"WITH {_CANDIDATES}"
    least = "CASE WHEN p3 IS NOT NULL THEN least(p1, p2, p3) END"
    return {
        "segment_start": f"WITH {_SEGMENT_SQL} SELECT code, first_row, was_inside, start, known FROM z",
        "listing_years": f"WITH {_SEGMENT_SQL}, d AS (SELECT min(first_row) AS d0 FROM z) SELECT code, day, round(CASE WHEN was_inside AND start IS NULL THEN NULL WHEN known THEN CASE WHEN day >= start THEN least((day - start) / 365.25, 3) END WHEN (day - d0) / 365.25 >= 3 THEN 3 END::DOUBLE + 3e-9, 6) AS years FROM bars JOIN z USING (code), d",
        "category_codes": "SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::DOUBLE AS segment_code, c_nationkey::DOUBLE AS nation_code FROM customer",
        "population_filters": f"{c}, t AS (SELECT *, {least} AS m, lpad(code::VARCHAR, 5, '1') AS t FROM c WHERE grp = '5-LOW' OR grp <> '1-URGENT') SELECT id, (p3 IS NOT NULL)::INT::DOUBLE AS complete, coalesce(p1 > 0 AND p3 > 0, false) AS good, m AS least_pct, m >= 50 AS passed FROM t WHERE t LIKE '%0'",
        "sigma_labels": f"""WITH {sql.BARS}, r AS (SELECT *, {sql.gap("c", sql.lag("c"))} AS r FROM bars),
f AS (SELECT code, day, {sql.roll("r", 20, "stddev_samp")} AS vol, lead(o) OVER w AS entry, CASE WHEN {sql.over("count(c)", 1, 20)} >= 20 THEN {sql.over("max(c)", 1, 20)} END AS top, lead(c, 20) OVER w AS last, c FROM r WINDOW w AS (PARTITION BY code ORDER BY day)),
g AS (SELECT code, day, top / entry - 1 AS rise, last / entry - 1 AS fin, last >= c AS trend, 0.8 * vol / 100 * sqrt(20) AS need FROM f)
SELECT code, day, {_label_sql("0.1::DOUBLE")} AS fixed, {_label_sql("need")} AS scaled FROM g""",
        "text_rules": """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0 WHEN contains(p_name, 'small') THEN 1 WHEN contains(p_name, 'ring') THEN 2 WHEN contains(p_name, 'large') THEN 3 END::DOUBLE AS level,
  CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 1 WHEN p_type IN ('PROMO', 'SMALL') THEN 0 END::DOUBLE AS flag,
  round(CASE WHEN p_retailprice > 905 THEN p_retailprice / 1000 / greatest(p_size - 5, 1) / (p_retailprice - 905) * 36500 END + 3e-9, 6) AS fee,
  CASE WHEN p_size % 7 = 0 OR trim(p_name) = '' THEN '(empty)' WHEN regexp_matches(p_name, 'gold|silver|ring') THEN 'shiny' WHEN regexp_matches(p_name, '^(large|huge)') THEN 'big' ELSE 'other' END AS kind FROM part""",
        "eligible_balances": f"""{c}, b AS (SELECT code, id, day, score, CASE id % 3 WHEN 0 THEN day + 4 WHEN 1 THEN CASE WHEN day <= DATE '2000-05-31' THEN DATE '2000-05-31' END END AS av, CASE WHEN id % 3 = 0 THEN 'published' WHEN id % 3 = 1 AND day <= DATE '2000-05-31' THEN 'snapshot' END AS basis FROM c),
e AS (SELECT code, id, day, score, CASE WHEN av IS NULL AND day < DATE '1998-01-01' THEN day + 9 ELSE av END AS available, CASE WHEN av IS NULL AND day < DATE '1998-01-01' THEN 'estimate' ELSE basis END AS basis FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC, available DESC, id DESC) AS n FROM e WHERE day <= available AND available <= DATE '2000-06-30')
SELECT code, day, available, basis, score FROM k WHERE n = 1""",
        "actual_disclosures": f"{c} SELECT id, 'Q' || quarter(day) AS period FROM c WHERE quarter(day) < 4 AND (id % 5 > 2 OR id % 7 > 3)",
        "new_training_rows": f"{c} SELECT id, day, p3 AS p FROM c WHERE day > DATE '1999-01-01' AND day <= DATE '1999-06-30' AND p3 IS NOT NULL",
        "top_percent": f"{c} SELECT id, p1 FROM (SELECT id, p1, row_number() OVER (ORDER BY p1 DESC, id) AS n, count(*) OVER () AS m FROM c) WHERE n <= greatest(1, floor(m * 3 / 100))",
        "top_percent_in_bands": f"{c} SELECT grp, id, p1 FROM (SELECT grp, id, p1, row_number() OVER (PARTITION BY grp ORDER BY p1 DESC, id) AS n, count(*) OVER (PARTITION BY grp) AS m FROM c) WHERE n <= greatest(1, floor(m * 2.5 / 100))",
        "best_of_day": f"{c} SELECT day, arg_max(id, (floor(p1 / 50), md5('0:' || id))) AS id, max(floor(p1 / 50))::BIGINT AS coarse FROM c GROUP BY day",
        "over_earlier_folds": f"{c}, y AS (SELECT id, year(day)::INTEGER AS fold, p3 FROM c), t AS (SELECT f.fold, quantile_cont(y.p3, 0.9) AS threshold, count(y.p3) AS n FROM (SELECT DISTINCT fold FROM y) f JOIN y ON y.fold < f.fold GROUP BY 1) SELECT id, fold, round(threshold, 6) AS threshold FROM y JOIN t USING (fold) WHERE n >= 100 AND p3 > threshold",
        "rule_order": f"{c} SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY {least} DESC NULLS LAST, score DESC, p2, id) AS place FROM c",
        "near_misses": f"{c} SELECT grp, id, m AS rule, row_number() OVER (PARTITION BY grp ORDER BY m DESC, id) AS place FROM (SELECT *, {least} AS m FROM c) WHERE m >= 60 AND m < 80",
        "passed_and_extras": f"{c}, k AS (SELECT date_trunc('month', day)::DATE AS month, code, id, p1 >= 90 AS ok, floor(p2)::BIGINT + 1 AS rank FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY month, code ORDER BY ok DESC, id, rank) AS n FROM k WHERE ok OR rank <= 5) SELECT month, code, id, ok AS by_rule, row_number() OVER (PARTITION BY month ORDER BY ok DESC, CASE WHEN ok THEN id END, rank, code) AS place FROM o WHERE n = 1",
        "newest_keys": f"{c}, n AS (SELECT code, day, id, row_number() OVER (PARTITION BY code ORDER BY day DESC, id) AS n FROM c) SELECT code, day, id FROM n WHERE n = 1 ORDER BY day DESC, id, code LIMIT 60",
        "sample_per_class": f"{c} SELECT grp, id FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY md5('0:' || id), id) AS n FROM c) WHERE n <= 20",
        "recent_whole_days": f"{c}, d AS (SELECT day, coalesce(sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM (SELECT day, count(*) AS n FROM c GROUP BY day)) SELECT day, id FROM c JOIN d USING (day) WHERE ahead < 500",
        "sample_days": f"{c} SELECT day, id FROM c WHERE day IN (SELECT day FROM (SELECT DISTINCT day FROM c) ORDER BY md5('0:' || day) LIMIT 40)",
        "every_nth_from_end": f"WITH {sql.BARS} SELECT code, day, c FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS b, row_number() OVER (PARTITION BY code ORDER BY day) AS f FROM bars) WHERE (b - 1) % 20 = 0 OR f = 1",
        "last_spikes": f"WITH {sql.BARS}, m AS (SELECT code, day, v, {sql.roll('v', 20)} AS m FROM bars), s AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM m WHERE v >= 2 * m) SELECT code, day, v FROM s WHERE n <= 8",
        "first_by_source": f"{c}, m AS (SELECT code, date_trunc('month', day)::DATE AS month, id, grp FROM c) SELECT code, month, id, grp FROM (SELECT *, row_number() OVER (PARTITION BY code, month ORDER BY grp, id) AS n FROM m) WHERE n = 1",
        "cheapest_first": f"{c}, v AS (SELECT grp, id, score, list_median(list_filter([p1 * 2000, CASE WHEN id % 4 <> 0 THEN p2 * 2500 END, p3], lambda x: x IS NOT NULL)) AS m FROM c), r AS (SELECT *, CASE WHEN m > 0 THEN score / m END AS r FROM v) SELECT grp, id, round(m, 6) AS median_value, round(r + 3e-9, 6) AS ratio, row_number() OVER (PARTITION BY grp ORDER BY r NULLS LAST, id) AS place FROM r",
        "top_contributions": f"{c}, l AS (SELECT id, p1 - 50 AS a, p2 - 50 AS b, p3 - 50 AS d, list_reverse_sort(list_filter([(abs(p1 - 50), 'first', p1 - 50), (abs(p2 - 50), 'second', p2 - 50), (abs(p3 - 50), 'third', p3 - 50)], lambda x: x[1] IS NOT NULL)) AS t FROM c) SELECT id, t[1][2] AS name_1, t[1][3] AS value_1, t[2][2] AS name_2, a + b AS sum_x, coalesce(d, 0) AS sum_y FROM l",
    }
