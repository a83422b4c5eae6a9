"""Queries on evaluation, similarity, profiles, valuation, scores, text and nested records: their Spark form and SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import describe, evaluate, panel, profile, scans, scoring, similar, valuation
from tidewell.plans import bars_sql as sql
from tidewell.session import shared_folder
from tidewell.sources.tables import daily_bars, table
from tidewell.streaming import ticks as streams


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", F.floor(F.col("n_chars") / 100).alias("score"), F.col("quality").alias("label"))


_SCORES = "s AS (SELECT doc_id, source, floor(n_chars / 100)::BIGINT AS score, quality AS label FROM documents JOIN labels USING (doc_id))"


def _r(c: str, digits: int = 6):
    return F.round(F.col(c) + 3e-9, digits).alias(c)


def macd_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scans.recursive_indicators(_bars(spark, sf_dir), ("averages", "strengths", "trends"))
    return d.select("code", "day", *(F.round(F.col(c) + 3e-7, 4).alias(c) for c in ("tx_macd", "tx_macd_signal", "tx_rsi_14", "tx_natr_14")))


_MACD = f"""
WITH RECURSIVE {sql.BARS},
n AS (SELECT code, day, c, {sql.ROW} AS i, c - {sql.lag("c")} AS d, CASE WHEN {sql.lag("c")} IS NULL THEN h - l ELSE greatest(h - l, abs(h - {sql.lag("c")}), abs(l - {sql.lag("c")})) END AS tr FROM bars),
e AS (
  SELECT code, day, c, i, c AS e12, c AS e26, 0::DOUBLE AS sg, NULL::DOUBLE AS up, NULL::DOUBLE AS dn, tr AS atr FROM n WHERE i = 1
  UNION ALL
  SELECT n.code, n.day, n.c, n.i, n.c * (2 / 13.0) + e.e12 * (11 / 13.0), n.c * (2 / 27.0) + e.e26 * (25 / 27.0),
    (n.c * (2 / 13.0) + e.e12 * (11 / 13.0) - n.c * (2 / 27.0) - e.e26 * (25 / 27.0)) * 0.2::DOUBLE + e.sg * 0.8::DOUBLE,
    CASE WHEN e.up IS NULL THEN greatest(n.d, 0) ELSE greatest(n.d, 0) / 14 + e.up * (13 / 14.0) END, CASE WHEN e.up IS NULL THEN greatest(-n.d, 0) ELSE greatest(-n.d, 0) / 14 + e.dn * (13 / 14.0) END, n.tr / 14 + e.atr * (13 / 14.0)
  FROM e JOIN n ON n.code = e.code AND n.i = e.i + 1)
SELECT code, day, round(CASE WHEN i > 25 THEN (e12 - e26) / c * 100 END + 3e-7, 4) AS tx_macd, round(CASE WHEN i > 34 THEN sg / c * 100 END + 3e-7, 4) AS tx_macd_signal,
  round(CASE WHEN i > 14 THEN CASE WHEN up + dn = 0 THEN 50 ELSE 100 * up / (up + dn) END END + 3e-7, 4) AS tx_rsi_14, round(CASE WHEN i > 13 THEN atr / c * 100 END + 3e-7, 4) AS tx_natr_14
FROM e"""


def auc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.auc(_scores(spark, sf_dir), ["source"], "score", "label").select("source", "n", "n_pos", _r("auc"))


def within_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pooled_auc(_scores(spark, sf_dir), ["source"], "score", "label").select("n_groups", "n_pairs", _r("within_auc"))


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(_scores(spark, sf_dir), ["source"], "score", "label").select("source", _r("average_precision"))


def ndcg_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ndcg(_scores(spark, sf_dir), ["source"], "score", "label", 10, "doc_id").select("source", _r("ndcg"))


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.group_bootstrap(_bars(spark, sf_dir), "day", "c", 200).select("draw", F.round(F.col("mean") + 3e-7, 4).alias("mean"))


_BOOTSTRAP = f"""
WITH RECURSIVE {sql.BARS}, g AS (SELECT day, sum(c) AS s, count(*) AS n FROM bars GROUP BY day),
p AS (SELECT 0 AS k, exp(-1::DOUBLE) AS t, exp(-1::DOUBLE) AS c UNION ALL SELECT k + 1, t / (k + 1), c + t / (k + 1) FROM p WHERE k < 11),
l AS (SELECT list(c ORDER BY k) AS cdf FROM p),
w AS (SELECT draw, s, n, len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('0:' || draw || ':' || day), 1, 12))::BIGINT::DOUBLE / 281474976710656)) AS w FROM g, l, range(200) v(draw))
SELECT draw::INTEGER AS draw, round(sum(w * s) / sum(w * n) + 3e-7, 4) AS mean FROM w GROUP BY draw"""


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.walk_forward(_bars(spark, sf_dir), "day", "1997-01-01", 6, 8, 30)


def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.wilson(_scores(spark, sf_dir), ["source"], "label").select("source", "n", *(_r(c) for c in ("p", "low", "high")))


def _near(distance: str, apart: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        out = similar.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, distance, apart)
        return out.select("query_id", "id", _r("distance"), F.col("place").cast("long").alias("place"))

    return query


def _near_sql(distance: str, apart: int) -> str:
    return f"WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {distance} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND abs(e.vec_id - q.vec_id) > {apart}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS place FROM p) SELECT query_id, id, round(d + 3e-9, 6) AS distance, place FROM r WHERE place <= 5"


_L2 = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_W1 = "list_sum(list_transform(list_zip(list_sort(q.embedding), list_sort(e.embedding)), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / 64"


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    edges = similar.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, apart=20)
    return similar.graph_summary(edges, e, "vec_id", "label").select("label", "n_edges", "n_targets", _r("furthest"), _r("same_label"))


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.session_buckets(_ticks(spark, sf_dir), "user_id", "ts", "value", F.col("k")).select("user_id", "day", "session", "n", "shares", _r("vwap"))


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.minute_bars(_ticks(spark, sf_dir), ["event_type"], "ts", "value", F.col("k"), "event_id", "1 hour")


def volume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), "l_quantity")
    return profile.volume_profile(t, "l_suppkey", "px", "l_quantity").select("l_suppkey", "n_bins", "width", F.round(F.col("vwap") + 3e-7, 4).alias("vwap"), "poc")


def value_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), "l_quantity")
    out = profile.volume_profile(t, "l_suppkey", "px", "l_quantity")
    return out.select("l_suppkey", "n_bins", *(F.round(F.col(c) + 3e-7, 4).alias(c) for c in ("width", "vwap", "poc", "value_low", "value_high")))


_VALUE_AREA = """
WITH RECURSIVE t AS (SELECT l_suppkey AS k, l_extendedprice / l_quantity AS p, l_quantity AS s FROM lineitem WHERE l_quantity > 0),
g AS (SELECT k, (max(p) - min(p)) / 36 AS raw, sum(p * s) / sum(s) AS vwap FROM t GROUP BY 1),
w AS (SELECT k, vwap, CASE WHEN raw <= 0 THEN 1 ELSE (SELECT min(m * b) FROM (VALUES (1), (2), (5), (10)) v(m) WHERE m * b >= raw) END AS width FROM (SELECT *, pow(10, floor(log10(raw))) AS b FROM g)),
b AS (SELECT k, vwap, width, floor(p / width) AS bin, sum(s) AS s FROM t JOIN w USING (k) GROUP BY ALL),
e AS (SELECT k, vwap, width, min(bin) AS lowest, max(bin) AS highest, count(*) AS n_bins, sum(s) AS total, arg_max(bin, (s, -bin)) AS top, map_from_entries(list((bin, s))) AS held FROM b GROUP BY ALL),
r AS (
  SELECT k, top AS lo, top AS hi, held[top] AS sum, 0 AS step FROM e
  UNION ALL
  SELECT k, CASE WHEN below >= above THEN lo - 1 ELSE lo END, CASE WHEN below >= above THEN hi ELSE hi + 1 END, sum + greatest(below, above), step + 1
  FROM (SELECT r.*, total, CASE WHEN lo > lowest THEN coalesce(held[lo - 1], 0) ELSE -1 END AS below, CASE WHEN hi < highest THEN coalesce(held[hi + 1], 0) ELSE -1 END AS above FROM r JOIN e USING (k))
  WHERE sum < 0.7 * total AND greatest(below, above) >= 0),
f AS (SELECT k, max(step) AS step FROM r GROUP BY k)
SELECT k AS l_suppkey, n_bins, round(width + 3e-7, 4) AS width, round(vwap + 3e-7, 4) AS vwap, round((top + 0.5) * width + 3e-7, 4) AS poc, round(lo * width + 3e-7, 4) AS value_low, round((hi + 1) * width + 3e-7, 4) AS value_high
FROM r JOIN f USING (k, step) JOIN e USING (k)"""


_PROFILE = """
WITH t AS (SELECT l_suppkey, l_extendedprice / l_quantity AS p, l_quantity AS s FROM lineitem WHERE l_quantity > 0),
g AS (SELECT l_suppkey, (max(p) - min(p)) / 36 AS raw, sum(p * s) / sum(s) AS vwap FROM t GROUP BY 1),
w AS (SELECT l_suppkey, vwap, raw, pow(10, floor(log10(raw))) AS b FROM g),
x AS (SELECT l_suppkey, vwap, (CASE WHEN raw <= b THEN b WHEN raw <= 2 * b THEN 2 * b WHEN raw <= 5 * b THEN 5 * b ELSE 10 * b END)::DOUBLE AS width FROM w),
n AS (SELECT l_suppkey, width, vwap, floor(p / width)::BIGINT AS bin, sum(s) AS s FROM t JOIN x USING (l_suppkey) GROUP BY ALL)
SELECT l_suppkey, count(*) AS n_bins, width, round(vwap + 3e-7, 4) AS vwap, (arg_max(bin, (s, -bin)) + 0.5) * width AS poc FROM n GROUP BY l_suppkey, width, vwap"""


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("book"), ((F.col("s_suppkey") % 13) / 100.0 + 0.02).alias("roe"))


def residual_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = valuation.grid(_valued(spark, sf_dir), cost=[0.05, 0.06, 0.08], fade=[0.0, 0.6, 0.9])
    g = g.withColumn("value", valuation.residual_income(F.col("book"), F.col("roe"), F.col("cost"), F.col("fade"), 10))
    return valuation.scenario_stats(g, ["s_suppkey"], "value").select("s_suppkey", "n_valid", *(F.round(F.col(c) + 3e-7, 3).alias(c) for c in ("low", "high", "mean", "median", "std")))


_RI = """
WITH RECURSIVE g AS (SELECT s_suppkey, s_acctbal AS book, (s_suppkey % 13) / 100.0::DOUBLE + 0.02::DOUBLE AS roe, cost, fade FROM supplier, (VALUES (0.05::DOUBLE), (0.06), (0.08)) c(cost), (VALUES (0.0::DOUBLE), (0.6), (0.9)) f(fade)),
r AS (SELECT s_suppkey, cost, fade, book AS b, roe - cost AS x, book AS v, 0 AS t, book > 0 AS ok FROM g UNION ALL SELECT s_suppkey, cost, fade, b * (1 + cost + x), x * fade, v + b * x / pow(1 + cost, t + 1), t + 1, ok FROM r WHERE t < 10),
f AS (SELECT s_suppkey, CASE WHEN ok THEN v END AS v FROM r WHERE t = 10)
SELECT s_suppkey, count(v) AS n_valid, round(min(v) + 3e-7, 3) AS low, round(max(v) + 3e-7, 3) AS high, round(avg(v) + 3e-7, 3) AS mean, round(quantile_cont(v, 0.5) + 3e-7, 3) AS median, round(stddev_pop(v) + 3e-7, 3) AS std FROM f GROUP BY 1"""


def cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = valuation.grid(_valued(spark, sf_dir), cost=[0.06, 0.09], growth=[0.0, 0.05])
    dcf = valuation.cash_flow_value(F.col("book"), F.lit(0.1), F.lit(0.3), F.col("growth"), F.lit(0.4), F.col("cost"), 5)
    ddm = valuation.dividend_discount(F.col("book") * 0.02, F.col("growth"), F.col("cost"), 5, F.lit(0.01))
    return g.select("s_suppkey", "cost", "growth", F.round(dcf + 3e-7, 3).alias("dcf"), F.round(ddm + 3e-7, 3).alias("ddm"))


_DCF = """
WITH g AS (SELECT s_suppkey, s_acctbal AS b, cost, growth FROM supplier, (VALUES (0.06::DOUBLE), (0.09)) c(cost), (VALUES (0.0::DOUBLE), (0.05)) f(growth)),
v AS (SELECT g.s_suppkey, cost, growth, sum(b * pow(1 + growth, t) * 0.1::DOUBLE * 0.7::DOUBLE * 0.6::DOUBLE / pow(1 + cost, t)) + max(b * pow(1 + growth, 5) * 0.1::DOUBLE * 0.7::DOUBLE / cost / pow(1 + cost, 5)) AS dcf,
  sum(b * 0.02::DOUBLE * pow((1 + growth) / (1 + cost), t)) + max(b * 0.02::DOUBLE * pow((1 + growth) / (1 + cost), 5) * 1.01::DOUBLE / (cost - 0.01::DOUBLE)) AS ddm FROM g, range(1, 6) r(t) GROUP BY ALL)
SELECT s_suppkey, cost, growth, round(dcf + 3e-7, 3) AS dcf, round(ddm + 3e-7, 3) AS ddm FROM v"""


def axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = panel.bars_frames()
    bars = _bars(spark, sf_dir).withColumns({"high_ratio": F.col("c") / F.max("c").over(f.trailing(120)) * 100, "trend": F.avg("v").over(f.trailing(5)) / F.avg("v").over(f.trailing(20)) * 100, "growth": (F.col("c") / F.lag("c", 60).over(f.by) - 1) * 100})
    out = scoring.axes(bars, "high_ratio", "trend", "growth", "va")
    return out.select("code", "day", "n_axes", "zone", *(F.round(F.col(c) + 3e-7, 4).alias(c) for c in ("axis_high", "axis_volume", "axis_growth", "axis_liquidity", "score")))


_AXES = f"""
WITH {sql.BARS},
m AS (SELECT *, c / {sql.over("max(c)", -119, 0)} * 100 AS hr, {sql.over("avg(v)", -4, 0)} / {sql.over("avg(v)", -19, 0)} * 100 AS tr, (c / {sql.lag("c", 60)} - 1) * 100 AS gr FROM bars),
a AS (SELECT code, day, CASE WHEN hr <= 80 THEN 0 WHEN hr <= 90 THEN (hr - 80) / 10 * 5 WHEN hr <= 98 THEN 5 + (hr - 90) / 8 * 5 ELSE 10 END AS axis_high, least(greatest(5 + (tr - 100) / 100 * 5, 0), 10) AS axis_volume,
  CASE WHEN gr IS NOT NULL THEN least(greatest(gr / 50 * 10, 0), 10) END AS axis_growth, least(greatest((log10(va) - 3) / 4 * 10, 0), 10) AS axis_liquidity, CASE WHEN hr >= 98 THEN 'top' WHEN hr >= 90 THEN 'near' WHEN hr >= 80 THEN 'middle' ELSE 'low' END AS zone FROM m)
SELECT code, day, 3 + (axis_growth IS NOT NULL)::BIGINT AS n_axes, zone, round(axis_high + 3e-7, 4) AS axis_high, round(axis_volume + 3e-7, 4) AS axis_volume, round(axis_growth + 3e-7, 4) AS axis_growth, round(axis_liquidity + 3e-7, 4) AS axis_liquidity,
  round((axis_high + axis_volume + coalesce(axis_growth, 0) + axis_liquidity) / (3 + (axis_growth IS NOT NULL)::INT) + 3e-7, 4) AS score FROM a"""


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir)
    return scoring.daily_picks(bars.select("day", "code", "va", "v"), "day", F.col("v") > 2, "va", "code", 2).select("day", "code", "va", F.col("place").cast("long").alias("place"))


def monthly_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir).where("v >= 80").select("day", "code", "v")
    return scoring.first_of_month(bars, "day", [F.col("day"), F.col("v").desc(), F.col("code")], 2).select("day", "code", "v", F.col("place").cast("long").alias("place"))


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = describe.column_profile(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumn("mean", F.round(F.col("mean") + 3e-7, 4))


def _profile_sql() -> str:
    one = "SELECT '{c}' AS name, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_unique, count(*) FILTER (WHERE {c} = 0) AS n_zero, round(avg({c}) + 3e-7, 4) AS mean, min({c}) AS low, any_value(q[1]) AS q25, any_value(q[2]) AS q50, any_value(q[3]) AS q75, max({c}) AS high, count(*) FILTER (WHERE {c} < q[1] - 3 * (q[3] - q[1]) OR {c} > q[3] + 3 * (q[3] - q[1])) AS n_outlier FROM lineitem, (SELECT quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM lineitem)"
    return " UNION ALL ".join(one.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount"))


def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("a", "b", _r("r"))


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades of their user: what traded in auctions and between them, with a closing auction that moves on 20 January."""
    t = _ticks(spark, sf_dir).withColumns({"price": F.col("value") + 1, "lot": F.when(F.col("event_id") % 97 > 0, F.col("k"))})
    out = profile.auction_sessions(t, "user_id", "ts", "price", "lot", "event_id", None, "2024-01-20", (200.0, 2000.0))
    return out.select("user_id", "day", "status", "opening", "morning", "afternoon", "closing", *(_r(f"{c}_amount") for c in ("small", "medium", "large")), "n_small", "n_medium", "n_large")


_AUCTIONS = """
WITH t AS (SELECT user_id, event_id AS o, ts, ts::DATE AS day, hour(ts) * 60 + minute(ts) AS m, value + 1 AS p, CASE WHEN event_id % 97 > 0 THEN json_extract(props, '$.k')::DOUBLE END AS s FROM events),
h AS (SELECT *, m < 720 AS am, CASE WHEN day >= DATE '2024-01-20' THEN 925 ELSE 900 END AS e FROM t),
f AS (SELECT *, ts = first_value(ts) OVER w AND p = first_value(p) OVER w AS opens, bool_or(am) OVER (PARTITION BY user_id, day) AS has_am, p IS NULL OR p <= 0 OR s IS NULL OR s <= 0 AS odd FROM h WINDOW w AS (PARTITION BY user_id, day, am ORDER BY o)),
g AS (SELECT *, opens AND am = has_am AS day_open, NOT am AND m >= e AND NOT (opens AND am = has_am) AS closes, NOT (opens OR (am AND m >= 690) OR (NOT am AND m >= e)) AS normal, p * s AS v FROM f)
SELECT user_id, day, CASE WHEN bool_or(odd) THEN 'invalid' ELSE 'ok' END AS status, CASE WHEN NOT bool_or(odd) THEN coalesce(sum(s) FILTER (WHERE day_open), 0) END AS opening, CASE WHEN NOT bool_or(odd) THEN coalesce(sum(s) FILTER (WHERE am AND NOT day_open), 0) END AS morning,
  CASE WHEN NOT bool_or(odd) THEN coalesce(sum(s) FILTER (WHERE NOT am AND NOT closes AND NOT day_open), 0) END AS afternoon, CASE WHEN NOT bool_or(odd) THEN coalesce(sum(s) FILTER (WHERE closes), 0) END AS closing,
  CASE WHEN NOT bool_or(odd) THEN round(coalesce(sum(v) FILTER (WHERE normal AND v < 200), 0) + 3e-9, 6) END AS small_amount, CASE WHEN NOT bool_or(odd) THEN round(coalesce(sum(v) FILTER (WHERE normal AND v >= 200 AND v < 2000), 0) + 3e-9, 6) END AS medium_amount, CASE WHEN NOT bool_or(odd) THEN round(coalesce(sum(v) FILTER (WHERE normal AND v >= 2000), 0) + 3e-9, 6) END AS large_amount,
  CASE WHEN NOT bool_or(odd) THEN count(*) FILTER (WHERE normal AND v < 200) END AS n_small, CASE WHEN NOT bool_or(odd) THEN count(*) FILTER (WHERE normal AND v >= 200 AND v < 2000) END AS n_medium, CASE WHEN NOT bool_or(odd) THEN count(*) FILTER (WHERE normal AND v >= 2000) END AS n_large
FROM g GROUP BY user_id, day"""


def profiles_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart each user's profiles by value are: of all events, and of clicks."""
    t = _ticks(spark, sf_dir).select("user_id", F.floor("value").alias("bin"), "k", "event_type")
    return profile.profile_distance(t, t.where("event_type = 'click'"), ["user_id"], "bin", "k").select("user_id", _r("distance"))


_APART = """
WITH t AS (SELECT user_id, floor(value) AS bin, json_extract(props, '$.k')::DOUBLE AS k, event_type FROM events),
b AS (SELECT user_id, bin, sum(k) AS x, coalesce(sum(k) FILTER (WHERE event_type = 'click'), 0) AS y FROM t GROUP BY 1, 2),
c AS (SELECT *, sum(x) OVER u AS tx, sum(y) OVER u AS ty FROM b WINDOW u AS (PARTITION BY user_id))
SELECT user_id, round(sum(abs(x / tx - y / ty)) / 2 + 3e-9, 6) AS distance FROM c WHERE tx > 0 AND ty > 0 GROUP BY 1"""


def redundant_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 80 pairs of an embedding's components that go together most, of which some are not known."""
    e = table(spark, sf_dir, "embeddings")
    width = e.select(F.max(F.size("embedding"))).first()[0]
    x = lambda i: F.get("embedding", F.lit(i)).cast("double")
    wide = e.select(*(F.when((F.col("vec_id") + i) % 7 > 0, x(i)).alias(f"x{i}") for i in range(width)))
    return describe.correlations(wide, wide.columns, 0.05, 100, 80).select("a", "b", _r("r"))


_REDUNDANT = """
WITH e AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) v(i) WHERE i < len(embedding) AND (vec_id + i) % 7 > 0),
r AS (SELECT a.i, b.i AS j, corr(a.x, b.x) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL HAVING count(*) >= 100)
SELECT 'x' || i AS a, 'x' || j AS b, round(r + 3e-9, 6) AS r FROM r WHERE abs(r) >= 0.05 ORDER BY abs(r) DESC, i, j LIMIT 80"""


def chars_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.histogram(table(spark, sf_dir, "documents"), "n_chars", 0.0, 10000.0, 20)


def filled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.calendar_grid(_bars(spark, sf_dir).select("code", "day", "va"), "code", "day", ["va"], 3)


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus", F.lit(1).cast("long").alias("n"))
    return describe.pivoted(o, "year", "o_orderstatus", "n", ["F", "O", "P"])


def sector_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = panel.bars_frames()
    bars = _bars(spark, sf_dir).withColumns({"r": F.col("c") / F.lag("c").over(f.by) - 1, "w": F.lag("va").over(f.by)}).where("r IS NOT NULL")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("n_regionkey").cast("string").alias("region"))
    out = describe.weighted_by_group(bars.join(s, "code"), "day", "region", F.col("r"), F.col("w"))
    return out.select("day", "region", F.round(F.col("mean") + 3e-7, 5).alias("mean"))


_SECTOR = f"""
WITH {sql.BARS}, r AS (SELECT code, day, c / {sql.lag("c")} - 1 AS r, {sql.lag("va")} AS w FROM bars), s AS (SELECT s_suppkey AS code, n_regionkey::VARCHAR AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT day, CASE WHEN grouping(region) = 1 THEN 'ALL' ELSE region END AS region, round(sum(r * w) / sum(w) + 3e-7, 5) AS mean FROM r JOIN s USING (code) WHERE r IS NOT NULL GROUP BY GROUPING SETS ((day, region), (day))"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.turn_stats(table(spark, sf_dir, "conversations")).withColumn("user_share", F.round(F.col("user_share") + 3e-9, 6))


def hex_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _bars(spark, sf_dir).select(F.hex(F.col("code") * 4096 + F.datediff("day", F.lit("1995-01-01"))).alias("code"))
    return describe.code_runs(bars, "code")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"), (F.length("html") - F.length(F.regexp_replace("html", "<a ", "")) > 0).alias("has_link"))


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ticks(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


def market_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _bars(spark, sf_dir).groupBy("day").agg(F.avg("c").alias("c"), F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("day")  # one row for each day, whatever the number of keys
    return m.select("day", "n", F.round(F.col("c") + 3e-7, 3).alias("level"), F.round((F.col("c") / F.lag("c", 20).over(w) - 1) * 100 + 3e-7, 3).alias("ret_20"), F.round((F.col("c") / F.avg("c").over(w.rowsBetween(-199, 0)) - 1) * 100 + 3e-7, 3).alias("gap_200"))


def beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing beta to the market over 120 rows, at least 60 of them, drawn to 1 by a third."""
    f = panel.bars_frames()
    bars = _bars(spark, sf_dir)
    m = bars.groupBy("day").agg(F.avg("c").alias("mc"))
    m = m.select("day", (F.log("mc") - F.lag(F.log("mc")).over(Window.partitionBy(F.lit(0)).orderBy("day"))).alias("mr"))
    d = bars.select("code", "day", F.log("c").alias("lc")).withColumn("r", F.col("lc") - F.lag("lc").over(f.by)).join(m, "day").where("r IS NOT NULL AND mr IS NOT NULL")
    w = f.trailing(120)
    raw = F.when(F.count("*").over(w) >= 60, F.covar_pop("r", "mr").over(w) / F.var_pop("mr").over(w))
    return d.select("code", "day", F.round(raw * F.lit(2 / 3) + F.lit(1 / 3) + 3e-7, 4).alias("beta"))


_BETA = f"""
WITH {sql.BARS}, m0 AS (SELECT day, avg(c) AS mc FROM bars GROUP BY day), m AS (SELECT day, ln(mc) - lag(ln(mc)) OVER (ORDER BY day) AS mr FROM m0), r AS (SELECT code, day, ln(c) - {sql.lag("ln(c)")} AS r FROM bars),
d AS (SELECT * FROM r JOIN m USING (day) WHERE r IS NOT NULL AND mr IS NOT NULL)
SELECT code, day, round(CASE WHEN {sql.over("count(*)", -119, 0)} >= 60 THEN {sql.over("covar_pop(r, mr)", -119, 0)} / {sql.over("var_pop(mr)", -119, 0)} END * (2 / 3.0) + 1 / 3.0 + 3e-7, 4) AS beta FROM d"""


def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's bars of all windows that the watermark has passed, once what is there has been processed."""
    path = f"{shared_folder(spark)}/tidewell-stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = streams.tick_stream(spark, f"{sf_dir}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.run_available(streams.stream_bars(stream, "event_type", "ts", F.col("value").cast("decimal(18,4)")), f"{path}/rows", f"{path}/state")
    out = spark.read.parquet(f"{path}/rows")
    return out.select("at", "event_type", "n", *(F.col(c).cast("double").alias(c) for c in ("low", "high", "total")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "tech_macd_rsi": macd_rsi,
        "eval_auc": auc_by_source,
        "eval_within_auc": within_auc,
        "eval_average_precision": precision_recall,
        "eval_ndcg": ndcg_by_source,
        "eval_group_bootstrap": bootstrap,
        "eval_walk_forward": folds,
        "eval_wilson": wilson,
        "knn_euclid": _near("squared", 0),
        "knn_apart": _near("squared", 20),
        "knn_wasserstein": _near("wasserstein", 0),
        "knn_graph": graph,
        "session_buckets": sessions,
        "auction_sessions": auctions,
        "profiles_apart": profiles_apart,
        "minute_bars": minute_bars,
        "volume_profile": volume_profile,
        "volume_value_area": value_area,
        "residual_income": residual_income,
        "cash_flow_grid": cash_flow,
        "axis_scores": axis_scores,
        "daily_picks": picks,
        "monthly_first": monthly_first,
        "column_profile": profiled,
        "correlations": correlated,
        "redundant_columns": redundant_components,
        "histogram": chars_histogram,
        "calendar_grid": filled_grid,
        "pivot": pivot,
        "sector_returns": sector_returns,
        "nested_turns": nested,
        "hex_runs": hex_runs,
        "page_titles": pages,
        "event_json": event_json,
        "market_environment": market_env,
        "trailing_beta": beta,
        "stream_hours": stream_hours,
    }


def oracle_sql() -> dict[str, str]:
    ranked = f"WITH {_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2 AS r FROM s), g AS (SELECT source, count(*) AS n, sum(label)::BIGINT AS n_pos, sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2 AS wins, sum(label) * (count(*) - sum(label)) AS pairs FROM r GROUP BY source) "
    return {
        "tech_macd_rsi": _MACD,
        "eval_auc": ranked + "SELECT source, n, n_pos, round(CASE WHEN pairs > 0 THEN wins / pairs END + 3e-9, 6) AS auc FROM g",
        "eval_within_auc": ranked + "SELECT count(*) AS n_groups, sum(pairs)::BIGINT AS n_pairs, round(sum(wins) / sum(pairs) + 3e-9, 6) AS within_auc FROM g WHERE pairs > 0",
        "eval_average_precision": f"WITH {_SCORES}, p AS (SELECT source, score, count(*) AS n, sum(label) AS p FROM s GROUP BY ALL), c AS (SELECT source, p, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM p WINDOW w AS (PARTITION BY source ORDER BY score DESC)) SELECT source, round(sum(p * cp / cn) / sum(p) + 3e-9, 6) AS average_precision FROM c GROUP BY source",
        "eval_ndcg": f"WITH {_SCORES}, r AS (SELECT source, label, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY label DESC, doc_id) AS b FROM s), t AS (SELECT source, sum(label / log2(a + 1)) FILTER (WHERE a <= 10) AS x, sum(label / log2(b + 1)) FILTER (WHERE b <= 10) AS y FROM r GROUP BY source) SELECT source, round(CASE WHEN y > 0 THEN x / y END + 3e-9, 6) AS ndcg FROM t",
        "eval_walk_forward": f"WITH {sql.BARS}, p AS (SELECT f::INTEGER AS fold, (DATE '1997-01-01' + to_months(6 * f::INTEGER))::DATE AS test_from, (DATE '1997-01-01' + to_months(6 * f::INTEGER + 6))::DATE AS test_to FROM range(8) r(f)), q AS (SELECT *, test_from - 30 AS train_to FROM p) SELECT fold, test_from, test_to, train_to, count(*) FILTER (WHERE day < train_to) AS n_train, count(*) FILTER (WHERE day >= test_from) AS n_test FROM q JOIN bars ON day < train_to OR (day >= test_from AND day < test_to) GROUP BY ALL",
        "eval_wilson": f"WITH {_SCORES}, g AS (SELECT source, count(*) AS n, avg(label) AS p FROM s GROUP BY source), h AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS c, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS e FROM g) SELECT source, n, round(p + 3e-9, 6) AS p, round(c - e + 3e-9, 6) AS low, round(c + e + 3e-9, 6) AS high FROM h",
        "knn_euclid": _near_sql(_L2, 0),
        "knn_apart": _near_sql(_L2, 20),
        "knn_wasserstein": _near_sql(_W1, 0),
        "knn_graph": f"WITH n AS ({_near_sql(_L2, 20)}) SELECT a.label, count(*) AS n_edges, count(DISTINCT n.id) AS n_targets, max(distance) AS furthest, round(avg((a.label = b.label)::INT) + 3e-9, 6) AS same_label FROM n JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = n.id GROUP BY a.label",
        "auction_sessions": _AUCTIONS,
        "profiles_apart": _APART,
        "session_buckets": "WITH t AS (SELECT user_id, ts::DATE AS day, hour(ts) * 60 + minute(ts) AS m, value, json_extract(props, '$.k')::BIGINT AS k FROM events) SELECT user_id, day, CASE WHEN m < 540 THEN 'before' WHEN m < 690 THEN 'morning' WHEN m < 750 THEN 'break' WHEN m < 925 THEN 'afternoon' ELSE 'close' END AS session, count(*) AS n, sum(k)::BIGINT AS shares, round(sum(value * k) / nullif(sum(k), 0) + 3e-9, 6) AS vwap FROM t GROUP BY ALL",
        "minute_bars": "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS at, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS v FROM events GROUP BY ALL",
        "volume_profile": _PROFILE,
        "volume_value_area": _VALUE_AREA,
        "eval_group_bootstrap": _BOOTSTRAP,
        "residual_income": _RI,
        "cash_flow_grid": _DCF,
        "axis_scores": _AXES,
        "daily_picks": f"WITH {sql.BARS}, r AS (SELECT day, code, va, min(v) OVER (PARTITION BY day) AS m, row_number() OVER (PARTITION BY day ORDER BY va DESC, code) AS place FROM bars) SELECT day, code, va, place FROM r WHERE m > 2 AND place <= 2",
        "monthly_first": f"WITH {sql.BARS}, r AS (SELECT day, code, v, row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY day, v DESC, code) AS place FROM bars WHERE v >= 80) SELECT * FROM r WHERE place <= 2",
        "column_profile": _profile_sql(),
        "redundant_columns": _REDUNDANT,
        "correlations": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) + 3e-9, 6) AS r FROM lineitem" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))),
        "histogram": "SELECT least(greatest(floor(n_chars / 500), 0), 19)::INTEGER AS bin, count(*) AS n FROM documents GROUP BY 1",
        "calendar_grid": f"WITH {sql.BARS}, g AS (SELECT code, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM bars GROUP BY 1) SELECT code, day, last_value(va IGNORE NULLS) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS va FROM g LEFT JOIN bars USING (code, day)",
        "pivot": "SELECT year(o_orderdate)::INTEGER AS year, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1",
        "sector_returns": _SECTOR,
        "nested_turns": "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE role = 'user') AS n_user, max(length(text))::BIGINT AS longest, sum(length(text))::BIGINT AS n_chars, round(coalesce(sum(length(text)) FILTER (WHERE role = 'user'), 0) / nullif(sum(length(text)), 0) + 3e-9, 6) AS user_share, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id",
        "hex_runs": f"WITH {sql.BARS}, n AS (SELECT DISTINCT code * 4096 + (day - DATE '1995-01-01') AS n FROM bars), i AS (SELECT n, n >> 20 AS b, n - row_number() OVER (PARTITION BY n >> 20 ORDER BY n) AS i FROM n) SELECT min(n) AS first, max(n) AS last, count(*) AS size FROM i GROUP BY i, b",
        "page_titles": "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, contains(html, '<a ') AS has_link FROM pages",
        "event_json": "SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract(props, '$.k')::BIGINT) AS top FROM events GROUP BY 1",
        "market_environment": f"WITH {sql.BARS}, m AS (SELECT day, avg(c) AS c, count(*) AS n FROM bars GROUP BY day) SELECT day, n, round(c + 3e-7, 3) AS level, round((c / lag(c, 20) OVER (ORDER BY day) - 1) * 100 + 3e-7, 3) AS ret_20, round((c / avg(c) OVER (ORDER BY day ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) - 1) * 100 + 3e-7, 3) AS gap_200 FROM m",
        "trailing_beta": _BETA,
        "stream_hours": """WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS "at", event_type, count(*) AS n, min(value) AS low, max(value) AS high, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL) SELECT * FROM b WHERE "at" + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events)""",
    }
