"""Queries of profiles over windows, shapes of cases, definitions, folds and exports, with their SQL twins; and the feature mart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import compare, feeds, panel, profile, windows
from tidewell.operators.asof import asof_calendar, asof_join
from tidewell.plans import bars_sql as sql
from tidewell.plans.choices import _CANDIDATES, candidates
from tidewell.plans.summaries import _OUTCOMES, _outcomes
from tidewell.sources.tables import daily_bars, table


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _r(c: str, digits: int = 6):
    return F.round(F.col(c) + 3e-9, digits).alias(c)


def _rounded(x: str, name: str, digits: int = 6) -> str:
    return f"round({x} + 3e-9, {digits}) AS {name}"


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_quantity").alias("s"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.profile_windows(_trades(spark, sf_dir), _bars(spark, sf_dir), "code", "day", "p", "s", (1, 5, 20), 100.0)
    return out.select("code", "day", F.col("span").cast("long").alias("span"), "shares", _r("vwap", 5), "poc", _r("above", 5), _r("near", 5))


def profile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven features of each of three windows of a key's trades, which an order's number puts into a time of the day."""
    t = _trades(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem")
    ticks = lines.select(F.col("l_suppkey").alias("code"), F.timestamp_seconds(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) + 9 * 3600 + (F.col("l_orderkey") * 7919 + F.col("l_linenumber")) % 23400).alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.col("l_quantity").alias("s"))
    sessions = profile.auction_sessions(ticks, "code", "ts", "p", "s", "ts")
    out = compare.profile_features(t, sessions, _bars(spark, sf_dir), "code", "day", "p", "s", (1, 5, 20), 100.0)
    # as _r(c, 5), but without a decimal for each of 33 values a row
    return out.select("code", "day", *((F.floor((F.col(c) + 3e-9) * 100_000 + 0.5) / 100_000).alias(c) for c in out.columns if c not in ("code", "day")))


_PROFILES = f"""WITH {sql.BARS}, ix AS (SELECT code, day, c, {sql.ROW} AS i FROM bars), t AS (SELECT l_suppkey AS code, l_shipdate::DATE AS day, floor(l_extendedprice / l_quantity / 100) AS b, sum(l_quantity) AS s, sum(l_extendedprice / l_quantity * l_quantity) AS a FROM lineitem GROUP BY ALL),
k AS (SELECT code, i, b, s, a FROM t JOIN ix USING (code, day)), j AS (SELECT x.code, x.day, x.c, n AS span, b, sum(s) AS s, sum(a) AS a FROM ix x, (VALUES (1), (5), (20)) v(n), k WHERE k.code = x.code AND k.i <= x.i AND k.i > x.i - n AND x.i >= n GROUP BY ALL)
SELECT code, day, span::BIGINT AS span, sum(s) AS shares, {_rounded('sum(a) / sum(s)', 'vwap', 5)}, (arg_max(b, (s, -b)) + 0.5) * 100::DOUBLE AS poc, {_rounded('sum(CASE WHEN (b + 0.5) * 100 > c THEN s ELSE 0 END) / sum(s) * 100', 'above', 5)}, {_rounded('sum(CASE WHEN (b + 0.5) * 100 >= c * 0.98::DOUBLE AND (b + 0.5) * 100 <= c * 1.02::DOUBLE THEN s ELSE 0 END) / sum(s) * 100', 'near', 5)} FROM j GROUP BY code, day, span"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile in which some days are off, held against the bars: how many days have which status."""
    t = _trades(spark, sf_dir).withColumn("k", (F.col("code") * 7 + F.dayofmonth("day")) % 11)
    p = t.where("k <> 1").groupBy("code", "day", "k").agg((F.sum("s") + F.when(F.col("k") == 2, 1.0).otherwise(0.0)).alias("shares"), (F.sum(F.col("p") * F.col("s")) + F.when(F.col("k") == 3, 5.0).otherwise(0.0)).alias("amount"), (F.min("p") - F.when(F.col("k") == 4, 1.0).otherwise(0.0)).alias("low"), F.max("p").alias("high"))
    b = _bars(spark, sf_dir).withColumn("k", (F.col("code") * 7 + F.dayofmonth("day")) % 11).where("k <> 5")  # a table that lacks some days
    return compare.reconciled(p, b, ["code", "day"])


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.case_shapes(_bars(spark, sf_dir), panel.bars_frames(), 60, 50, 12)
    return out.select("code", "day", *(F.round(F.get(v, F.lit(i)) + 3e-9, 5).alias(f"{v}_{i}") for v in ("shape", "flow") for i in (0, 5, 11)))


def pair_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.array_sort("embedding"), lambda x: x.cast("double")).alias("v"))
    return compare.pair_scale(e, "vec_id", "v", 150).select("n_pairs", _r("scale"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return compare.scaled_states(c, "grp", ["p1", "p3", "score"]).select("id", _r("z_p1", 5), _r("z_p3", 5), _r("z_score", 5))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = compare.one_factor_at_a_time({"need": 0.1, "end_need": 0.0}, {"need": [0.05, 0.1, 0.2, 0.4], "end_need": [-0.05, 0.0, 0.1]})
    out = compare.definitions(_outcomes(spark, sf_dir), configs, "best", "end")
    return out.select(F.col("config").cast("long").alias("config"), "need", "end_need", "n", _r("rate"), _r("end_if"), _r("end_else"))


def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("fold", F.col("id") % 5)
    return compare.out_of_fold(c, "fold", "p3", "label").select("id", _r("oof"))


def fixed_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.fixed_folds(candidates(spark, sf_dir), "day", "1998-01-01", 6, 24, 6, 30)


def fetch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return compare.fetch_order(c, c.where("p1 > 80"), "code", "day", 400)


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    out = compare.aligned([c.select("id", "code", "p1"), c.where("p2 > 50").select("id", F.col("code").cast("double").alias("code"), "p2"), c.where("p3 > 70").select("id", F.col("code").cast("string").alias("code"), "p3")], ["code"])
    return out.groupBy("code").agg(F.count("*").alias("n"), F.count("p1").alias("n1"), F.count("p2").alias("n2"), F.count("p3").alias("n3"))


def day_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.by_day_json(candidates(spark, sf_dir).where("p1 >= 80"), "day", ["id"], ["id", "code", "label"])


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    manifest = d.where("lang <> 'fr'").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256).alias("digest"))
    return compare.hash_check(d.where("lang <> 'es'"), manifest, "doc_id", "text", "digest")


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of groups of keys by day, and the group's number of days so far: an index by date or by code."""
    b = _bars(spark, sf_dir).withColumn("grp", F.col("code") % 7)
    per = b.groupBy("grp", "day").agg(*(F.avg(x).alias(x) for x in ("o", "h", "l", "c")), F.count("*").alias("members"))
    n = F.row_number().over(Window.partitionBy("grp").orderBy("day"))
    return per.select("grp", "day", *(_r(x, 4) for x in ("o", "h", "l", "c")), "members", n.cast("long").alias("session"))


def seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quarter's share of last year's whole, as of each order: of the same quarter and entity, known 40 days after the quarter's end."""
    from tidewell.plans.panels import _quarters

    f = _quarters(spark, sf_dir)
    whole = f.where("q = 4").select("entity", F.col("fy").alias("wy"), F.col("cum").alias("whole"))
    f = f.withColumn("wy", F.col("fy") - 1).join(whole, ["entity", "wy"]).withColumns({"share": F.when(F.col("whole") > 0, F.col("cum") / F.col("whole") * 100), "known": F.date_add(F.add_months(F.make_date("fy", F.col("q") * 3, F.lit(1)), 1), 39)})
    rows = candidates(spark, sf_dir).select("id", F.col("code").alias("entity"), "day", F.quarter(F.add_months("day", -6)).alias("q"))
    return asof_join(rows, f, ["entity", "q"], "day", "known", ["share", "fy"], tolerance_days=400).select("id", "fy", _r("share"))


def mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature mart: fresh breaks with their outcome, recent changes, volatility factors, the market's state, and events of their key, as known on the day."""
    bars = _bars(spark, sf_dir)
    f = panel.bars_frames()
    p = panel.forward_label(panel.price_panel(bars, rows=60, cooldown=5))
    p = windows.volatility_factors(windows.recent_changes(p, f), f)
    rows = p.where("fresh_break").select("code", "day", "label", "ret_1", "ret_5", "gap_open", "vol_short", F.round((F.col("c") / F.col("prior_high") - 1) * 100 + 3e-9, 6).alias("margin"))
    market = bars.groupBy("day").agg(F.avg("c").alias("level"))
    w = Window.partitionBy(F.lit(0)).orderBy("day")  # one row a day
    market = market.withColumn("market_20", (F.col("level") / F.lag("level", 20).over(w) - 1) * 100)
    rows = asof_calendar(rows, market, "day", "day", ["market_20"])
    events = bars.where("v >= 60").select("code", F.date_add("day", 1).alias("at"), F.col("v").alias("size"))
    rows = feeds.event_features(rows, events, "code", "day", "at", ["size"], {"n_120": 120}, clip=365)
    return rows.select("code", "day", "label", _r("ret_1"), _r("ret_5"), _r("gap_open"), _r("vol_short", 5), "margin", _r("market_20"), "days", "size", "n_120")


def _mart_sql() -> str:
    from tidewell.plans.moves import _panel_sql

    sd = lambda n, least: f"(CASE WHEN {sql.over('count(r)', 1 - n, 0)} >= {least} THEN {sql.over('stddev_samp(r)', 1 - n, 0)} END)"
    return f"""WITH {_panel_sql(60, 5)}, fa AS (SELECT *, c / {sql.lag('c')} - 1 AS r, lead(o) OVER w AS entry, CASE WHEN {sql.over("count(c)", 1, 20)} >= 20 THEN {sql.over("max(c)", 1, 20)} END AS top, lead(c, 20) OVER w AS fin, {sql.gap("c", sql.lag("c"))} AS ret_1, {sql.gap("c", sql.lag("c", 5))} AS ret_5, {sql.gap("o", sql.lag("c"))} AS gap_open FROM pf WINDOW w AS (PARTITION BY code ORDER BY day)),
fb AS (SELECT *, top >= entry * (1 + 0.1) AND fin > entry AS label, {sd(5, 4)} / nullif({sd(20, 20)}, 0) AS vol_short FROM fa),
mk AS (SELECT day, (level / lag(level, 20) OVER (ORDER BY day) - 1) * 100 AS m FROM (SELECT day, avg(c) AS level FROM bars GROUP BY day)), ev AS (SELECT code, day + 1 AS t, v AS size FROM bars WHERE v >= 60), rw AS (SELECT * FROM fb WHERE fresh_break)
SELECT rw.code, rw.day, label, {_rounded('ret_1', 'ret_1')}, {_rounded('ret_5', 'ret_5')}, {_rounded('gap_open', 'gap_open')}, {_rounded('vol_short', 'vol_short', 5)}, {_rounded('(c / prior_high - 1) * 100', 'margin')}, {_rounded('m', 'market_20')}, least(rw.day - e.t, 365) AS days, e.size, (SELECT count(*) FROM ev x WHERE x.code = rw.code AND x.t <= rw.day AND x.t > rw.day - 120) AS n_120
FROM rw LEFT JOIN mk USING (day) ASOF LEFT JOIN ev e ON e.code = rw.code AND e.t <= rw.day"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "profile_windows": profiles, "profile_features": profile_features, "profile_reconciled": checked, "case_shapes": shapes, "pair_scale": pair_scale, "scaled_states": states, "label_definitions": definitions, "out_of_fold": out_of_fold, "fixed_test_folds": fixed_folds, "fetch_order": fetch_order, "aligned_ids": aligned, "day_json": day_json, "hash_check": hashes, "index_bars": index_bars,
        "seasonal_progress": seasonal, "feature_mart": mart,
    }


def oracle_sql() -> dict[str, str]:
    c = f"WITH {_CANDIDATES}"
    k = "(code * 7 + day(day)) % 11"
    vec = lambda s, i: f"{s}[floor(({i} + 0.5) / 12 * (len({s}) - 1))::INT + 1] + (({i} + 0.5) / 12 * (len({s}) - 1) - floor(({i} + 0.5) / 12 * (len({s}) - 1))) * ({s}[ceil(({i} + 0.5) / 12 * (len({s}) - 1))::INT + 1] - {s}[floor(({i} + 0.5) / 12 * (len({s}) - 1))::INT + 1])"
    configs = compare.one_factor_at_a_time({"need": 0.1, "end_need": 0.0}, {"need": [0.05, 0.1, 0.2, 0.4], "end_need": [-0.05, 0.0, 0.1]})
    z = lambda x: f"least(greatest((t_{x} - avg(t_{x}) OVER g) / nullif(stddev_pop(t_{x}) OVER g, 0), -6), 6) + 0 * t_{x}"
    q = lambda x: f"quantile_cont({x}, 0.01) AS a_{x}, quantile_cont({x}, 0.99) AS b_{x}, (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) / 2 AS h_{x}"
    return {
        "profile_windows": _PROFILES,
        "profile_reconciled": f"WITH {sql.BARS}, t AS (SELECT DISTINCT code, day, {k} AS k FROM bars) SELECT code, day, CASE k WHEN 1 THEN 'missing' WHEN 2 THEN 'volume' WHEN 3 THEN 'turnover' WHEN 4 THEN 'range' WHEN 5 THEN 'unexpected' ELSE 'ok' END AS status FROM t",
        "case_shapes": f"WITH {sql.BARS}, r AS (SELECT code, day, ln(c) - {sql.lag('ln(c)')} AS r, CASE WHEN v > 0 THEN ln(v) END AS lv FROM bars), w AS (SELECT code, day, {sql.over('list(r) FILTER (WHERE r IS NOT NULL)', -59, 0)} AS rs, {sql.over('avg(r)', -59, 0)} AS m, {sql.over('stddev_pop(r)', -59, 0)} AS sd, {sql.over('list(lv) FILTER (WHERE lv IS NOT NULL)', -59, 0)} AS vs, {sql.over('avg(lv)', -59, 0)} AS vm FROM r), s AS (SELECT code, day, CASE WHEN len(rs) >= 50 AND sd > 0 THEN list_sort(list_transform(rs, lambda x: (x - m) / sd)) END AS s, CASE WHEN len(vs) >= 50 THEN list_sort(list_transform(vs, lambda x: x - vm)) END AS f FROM w) SELECT code, day, " + ", ".join(f"{_rounded(vec(s, i), f'{n}_{i}', 5)}" for s, n in (("s", "shape"), ("f", "flow")) for i in (0, 5, 11)) + " FROM s",
        "pair_scale": "WITH h AS (SELECT list_sort(embedding)::DOUBLE[] AS v, row_number() OVER (ORDER BY md5('0:' || vec_id)) - 1 AS n FROM embeddings), p AS (SELECT a.v AS x, b.v AS y FROM h a JOIN h b ON b.n = a.n + 1 WHERE a.n % 2 = 0 AND a.n < 300), d AS (SELECT list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))) / len(x) AS d FROM p) SELECT count(*) AS n_pairs, " + _rounded("median(d)", "scale") + " FROM d",
        "scaled_states": f"{c}, q AS (SELECT grp, {q('p1')}, {q('p3')}, {q('score')} FROM c GROUP BY grp), t AS (SELECT id, grp, " + ", ".join(f"CASE WHEN {x} IS NOT NULL THEN asinh(least(greatest({x}, a_{x}), b_{x}) / h_{x}) END AS t_{x}" for x in ("p1", "p3", "score")) + " FROM c JOIN q USING (grp)) SELECT id, " + ", ".join(_rounded(z(x), f"z_{x}", 5) for x in ("p1", "p3", "score")) + " FROM t WINDOW g AS (PARTITION BY grp)",
        "label_definitions": f"WITH {_OUTCOMES} " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS config, {d['need']}::DOUBLE AS need, {d['end_need']}::DOUBLE AS end_need, count(*) AS n, {_rounded(f'''avg((best >= {d['need']}::DOUBLE AND fin >= {d['end_need']}::DOUBLE)::INT)''', 'rate')}, {_rounded(f'''avg(fin) FILTER (WHERE best >= {d['need']}::DOUBLE AND fin >= {d['end_need']}::DOUBLE)''', 'end_if')}, {_rounded(f'''avg(fin) FILTER (WHERE NOT (best >= {d['need']}::DOUBLE AND fin >= {d['end_need']}::DOUBLE))''', 'end_else')} FROM oc" for i, d in enumerate(configs)),
        "out_of_fold": f"{c}, l AS (SELECT f, regr_slope(label, p3) AS s, regr_intercept(label, p3) AS b FROM range(5) v(f), c WHERE c.id % 5 <> f GROUP BY f) SELECT id, {_rounded('b + s * p3', 'oof')} FROM c JOIN l ON c.id % 5 = f",
        "fixed_test_folds": f"{c}, p AS (SELECT f::INTEGER AS fold, (DATE '1998-01-01' + to_months(6 * f::INTEGER))::DATE AS test_from FROM range(6) v(f)), q AS (SELECT fold, ((test_from - 30) - to_months(24))::DATE AS train_from, test_from - 30 AS train_to, test_from, (test_from + to_months(6))::DATE AS test_to FROM p) SELECT fold, train_from, train_to, test_from, test_to, count(*) FILTER (WHERE day >= train_from AND day < train_to) AS n_train, count(*) FILTER (WHERE day >= test_from AND day < test_to) AS n_test FROM q JOIN c ON (day >= train_from AND day < train_to) OR (day >= test_from AND day < test_to) GROUP BY ALL",
        "fetch_order": f"{c} SELECT k.code, f.last FROM (SELECT DISTINCT code FROM c) k LEFT JOIN (SELECT code, max(day) AS last FROM c WHERE p1 > 80 GROUP BY code) f USING (code) ORDER BY f.last NULLS FIRST, k.code LIMIT 400",
        "aligned_ids": f"{c}, u AS (SELECT code::VARCHAR AS code, p1, NULL::DOUBLE AS p2, NULL::DOUBLE AS p3 FROM c UNION ALL SELECT code::VARCHAR, NULL, p2, NULL FROM c WHERE p2 > 50 UNION ALL SELECT code::VARCHAR, NULL, NULL, p3 FROM c WHERE p3 > 70) SELECT code, count(*) AS n, count(p1) AS n1, count(p2) AS n2, count(p3) AS n3 FROM u GROUP BY code",
        "day_json": f"{c} SELECT day, count(*) AS n, '[' || string_agg('{{\"id\":' || id || ',\"code\":' || code || ',\"label\":' || label || '}}', ',' ORDER BY id) || ']' AS json FROM c WHERE p1 >= 80 GROUP BY day",
        "hash_check": "SELECT doc_id, CASE lang WHEN 'fr' THEN 'extra' WHEN 'es' THEN 'missing' WHEN 'de' THEN 'changed' ELSE 'ok' END AS state FROM documents",
        "index_bars": f"WITH {sql.BARS} SELECT code % 7 AS grp, day, " + ", ".join(f"round(avg({x}) + 3e-9, 4) AS {x}" for x in "ohlc") + ", count(*) AS members, row_number() OVER (PARTITION BY code % 7 ORDER BY day) AS session FROM bars GROUP BY code % 7, day",
        "seasonal_progress": f"""WITH {_CANDIDATES}, qc AS (SELECT entity, fy, q, (sum(x) OVER (PARTITION BY entity, fy ORDER BY q))::DOUBLE AS cum FROM (SELECT o_custkey AS entity, year(o_orderdate)::INTEGER AS fy, quarter(o_orderdate)::INTEGER AS q, sum(o_totalprice::DECIMAL(18,2)) AS x FROM orders GROUP BY ALL)),
f AS (SELECT a.entity, a.fy, a.q, a.cum / w.cum * 100 AS share, (make_date(a.fy, a.q * 3, 1) + INTERVAL 1 MONTH)::DATE + 39 AS known FROM qc a JOIN qc w ON w.entity = a.entity AND w.fy = a.fy - 1 AND w.q = 4), r AS (SELECT id, code, day, quarter(day - INTERVAL 6 MONTH)::INTEGER AS q FROM c)
SELECT id, CASE WHEN day - known <= 400 THEN fy END AS fy, {_rounded('CASE WHEN day - known <= 400 THEN share END', 'share')} FROM r ASOF LEFT JOIN f ON f.entity = r.code AND f.q = r.q AND f.known <= r.day""",
        "feature_mart": _mart_sql(),
    }
