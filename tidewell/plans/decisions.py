"""Queries of scores, decisions, valuations and positions, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators import asof, positions, scoring, valuation
from tidewell.operators.asof import session_index
from tidewell.plans import bars_sql as sql
from tidewell.plans.choices import _CANDIDATES, candidates
from tidewell.sources.tables import daily_bars, table


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _r(c: str, digits: int = 6):
    return F.round(F.col(c) + 3e-9, digits).alias(c)


def _rounded(x: str, name: str, digits: int = 6) -> str:
    return f"round({x} + 3e-9, {digits}) AS {name}"


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = candidates(spark, sf_dir), F.col("id")
    return c.select(
        "id", (F.col("p1") - 20).alias("eps_growth"), (F.col("p2") - 30).alias("sales_growth"), (F.col("p3") / 3).alias("roe"), (F.col("p1") / 4 - 2).alias("op_margin"), (60 + F.col("p2") * 0.45).alias("high_ratio"), (F.col("p1") * 3).alias("volume_trend"), (F.col("p3") / 4 - 1).alias("credit_ratio"),
        (F.col("p1") * 1.3 - 10).alias("progress"), F.when(k % 5 != 0, (k % 5).cast("int")).alias("quarter"), (F.col("p2") - 5).alias("benchmark"), F.when(k % 3 == 0, "seasonal").when(k % 3 == 1, "floor").otherwise("linear").alias("basis"), (F.col("score") / 10000).alias("turnover"), F.when(k % 7 != 0, F.col("score") / 1000).alias("cap"),
    )


_METRICS = f"""{_CANDIDATES}, m AS (SELECT id, p1 - 20 AS eps_growth, p2 - 30 AS sales_growth, p3 / 3 AS roe, p1 / 4 - 2 AS op_margin, 60 + p2 * 0.45::DOUBLE AS high_ratio, p1 * 3 AS volume_trend, p3 / 4 - 1 AS credit_ratio, p1 * 1.3::DOUBLE - 10 AS progress, CASE WHEN id % 5 <> 0 THEN id % 5 END AS quarter,
  p2 - 5 AS benchmark, CASE id % 3 WHEN 0 THEN 'seasonal' WHEN 1 THEN 'floor' ELSE 'linear' END AS basis, score / 10000 AS turnover, CASE WHEN id % 7 <> 0 THEN score / 1000 END AS cap FROM c)"""


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.eight_axes(_metrics(spark, sf_dir))
    return out.select("id", *(F.round(F.col(f"axis_{a}") + 3e-9, 6).alias(a) for a in scoring.AXES), "tier", "level", "zone", "coverage", _r("total"), _r("strict"))


def pace_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.eight_axes(_metrics(spark, sf_dir), "pace")
    return out.select("id", F.round(F.col("axis_progress") + 3e-9, 6).alias("progress"), _r("total"))


def _axes_sql(pace: bool) -> str:
    lin = lambda x, a, b: f"CASE WHEN {x} IS NOT NULL THEN least(greatest(({x} - {a}) / {b - a} * 10, 0), 10) END"
    share = lambda x, points: "CASE WHEN x < {0} THEN 0 WHEN x > {1} THEN 1 ELSE ".format(points[0], points[-1]).replace("x ", f"({x}) ") + "CASE " + " ".join(f"WHEN ({x}) <= {b} THEN {p} + (({x}) - {a}) / ({b} - {a})::DOUBLE * ({q} - {p})::DOUBLE" for a, b, p, q in zip(points[:-1], points[1:], scoring.PROGRESS_SHARES[:-1], scoring.PROGRESS_SHARES[1:], strict=True)) + " END END"
    table = "CASE quarter " + " ".join(f"WHEN {q} THEN 10 * (CASE WHEN basis IN ('seasonal', 'floor') AND benchmark > 0 THEN {share('progress / benchmark', scoring.PROGRESS_POINTS['seasonal'][q])} ELSE {share(f'progress / {q * 25.0}', scoring.PROGRESS_POINTS['linear'][q])} END)" for q in (1, 2, 3)) + " END"
    progress = "CASE WHEN quarter BETWEEN 1 AND 3 THEN least(greatest(5 + (progress - quarter * 25) / 2, 0), 10) END" if pace else table
    decay = "CASE level " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in scoring.VOLUME_DECAY.items()) + " ELSE 1 END"
    names = ", ".join(scoring.AXES)
    out = ", ".join(_rounded(a, a) for a in scoring.AXES) + ", tier, level, zone, len(list_filter(l, lambda x: x IS NOT NULL)) AS coverage, " + _rounded("list_sum(l) / len(list_filter(l, lambda x: x IS NOT NULL))", "total") + ", " + _rounded("list_sum(l) / 8", "strict")
    return f"""WITH {_METRICS}, t AS (SELECT *, CASE WHEN turnover >= 30 THEN 'mega' WHEN turnover >= 10 THEN 'high' WHEN turnover >= 5 THEN 'moderate' WHEN turnover >= 1 THEN 'low' ELSE 'none' END AS tier FROM m), u AS (SELECT *, CASE WHEN cap < 100 THEN 'cap_low' ELSE tier END AS level FROM t),
a AS (SELECT id, tier, level, {lin('eps_growth', 0, 50)} AS eps, {lin('sales_growth', 0, 40)} AS sales, {lin('roe', 5, 25)} AS roe, {lin('op_margin', 0, 20)} AS margin, CASE WHEN high_ratio >= 98 THEN 10 WHEN high_ratio >= 90 THEN 8 + (high_ratio - 90) / 8 * 1.5::DOUBLE WHEN high_ratio >= 80 THEN 6 + (high_ratio - 80) / 5 ELSE greatest(high_ratio / 80 * 6, 0) END AS technical,
  least(greatest(least(greatest(5 + (volume_trend - 100) / 20, 0), 10) * ({decay})::DOUBLE, 0), 10) AS volume, CASE WHEN credit_ratio < 0 THEN NULL WHEN credit_ratio <= 1 THEN 10 WHEN credit_ratio <= 3 THEN 10 - (credit_ratio - 1) * 1.5::DOUBLE WHEN credit_ratio <= 10 THEN 7 - (credit_ratio - 3) / 7 * 5 WHEN credit_ratio IS NOT NULL THEN greatest(0, 2 - (credit_ratio - 10) / 5) END AS supply,
  ({progress})::DOUBLE AS progress, CASE WHEN high_ratio >= 98 THEN 'BREAKOUT' WHEN high_ratio >= 90 THEN 'HANDLE' WHEN high_ratio >= 80 THEN 'BASE' ELSE 'CORRECTION' END AS zone FROM u),
z AS (SELECT *, [{names}] AS l FROM a)
SELECT id, {out if not pace else _rounded('progress', 'progress') + ', ' + _rounded('list_sum(l) / len(list_filter(l, lambda x: x IS NOT NULL))', 'total')} FROM z"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("p3", F.when(F.col("id") % 99 != 0, F.coalesce("p3", F.lit(60.0))))
    return scoring.decisions(c, "day", ["p1", "p2", "p3"], "score", "id", 50.0, 2, 2)


_DECIDED = f"""{_CANDIDATES}, d0 AS (SELECT * EXCLUDE (p3), CASE WHEN id % 99 <> 0 THEN coalesce(p3, 60) END AS p3 FROM c), d1 AS (SELECT *, CASE WHEN p3 IS NOT NULL THEN least(p1, p2, p3) END AS p_min, count(*) OVER (PARTITION BY day) AS n_day FROM d0),
d2 AS (SELECT *, coalesce(p_min >= 50, false) AS passed FROM d1), d3 AS (SELECT *, CASE WHEN passed THEN row_number() OVER (PARTITION BY day, passed ORDER BY p_min DESC NULLS LAST, score DESC, id) END AS rank FROM d2)"""


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("day", "id", "p_min", "n_day", "passed", F.col("rank").cast("long").alias("rank"), "picked")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.day_verdicts(_decided(spark, sf_dir), "day", 2, 9, 6)


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    p = ["p1", "p2", "p3"]
    return c.select("id", *(F.round(v + 3e-9, 6).alias(n) for n, v in scoring.radar(p).items()), scoring.border_shape(p, 70.0, 60.0).alias("shape"), scoring.laggard(p).alias("laggard"), F.round(scoring.exit_plan(F.col("score"), 10.0) + 3e-7, 4).alias("target"))


def stored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of late scores on the 101 points kept of the early ones."""
    c = candidates(spark, sf_dir).withColumn("x", F.round("p3"))
    points = F.broadcast(c.where("day < DATE '1999-01-01'").agg(F.percentile("x", [i / 100 for i in range(101)]).alias("points")))  # one row
    late = c.where("day >= DATE '1999-01-01'").join(points)
    return late.select("id", F.round(scoring.on_grid(F.col("x"), F.col("points")) + 3e-9, 6).alias("pct"))


def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("id", F.col("score").alias("cap"), (F.col("p1") * 3000 - 20000).alias("net"), (F.col("p2") * 500).alias("plant"), (F.col("p3") * 400).alias("stock"), (F.col("p1") * 100).alias("soft"), (F.col("p2") + 100).alias("price"))
    out = valuation.asset_stress(c, {"plant": (0.0, 0.2, 0.4), "stock": (0.0, 0.2, 0.4), "soft": (0.0, 0.5, 1.0)}, "net", "cap", "price")
    return out.select("id", *(_r(x) for x in ("low", "high", "mean", "median", "deviation")))


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"month": F.trunc("day", "month"), "multiple": F.col("p3") - 10, "price": F.col("score") / 100})
    out = valuation.peer_prices(c, ["month", "grp"], "id", "multiple", "price", 10)
    return out.select("id", "peers", *(F.round(F.col(x) + 3e-7, 4).alias(x) for x in ("low", "high", "mean", "deviation", "p10", "p50", "p90")))


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    text = valuation.reasons({"no third percentile": F.col("p3").isNull(), "low": F.col("p1") < 10, "old": F.col("day") < F.lit("1996-01-01")})
    return c.select("id", text.alias("reason")).where("reason <> ''")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    steps = valuation.flow(F.col("score") - 5000, [("operating", F.col("p1") * 1000 - 20000), ("ordinary", F.when(F.col("id") % 4 != 0, F.col("p1") * 1000 - 22000 + F.col("p2") * 50)), ("net", F.col("p3") * 500 - 5000)])
    rows = c.select("id", F.posexplode(steps).alias("step", "s"))
    return rows.select("id", (F.col("step") + 1).cast("long").alias("step"), "s.name", _of("value"), _of("out"), _of("gain"), F.col("s.loss").alias("loss"))


def _of(c: str):
    return F.round(F.col(f"s.{c}") + 3e-7, 4).alias(c)


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions lie between each key's last bar and a day, and whether that is too many."""
    b = _bars(spark, sf_dir)
    index = session_index(b, "day").select("day", "session")
    last = b.groupBy("code").agg(F.max("day").alias("day"))
    today = index.agg(F.max("session").alias("now"))
    out = last.join(F.broadcast(index), "day").join(F.broadcast(today))
    return out.select("code", "day", (F.col("now") - F.col("session")).cast("long").alias("age"), ((F.col("now") - F.col("session")) > 2).alias("stale"))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day of the calendar whether a run is due: on a session, or where the last session is not stored; with the reason."""
    b = _bars(spark, sf_dir)
    stored = b.where("v > 60").groupBy("day").agg(F.count("*").alias("n"))
    days = b.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    out = days.join(b.select("day").distinct().withColumn("session", F.lit(True)), "day", "left").join(stored, "day", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    out = out.withColumns({"last_session": F.max(F.when(F.col("session"), F.col("day"))).over(w), "last_stored": F.max(F.when(F.col("n") > 0, F.col("day"))).over(w)})
    reason = F.when(F.col("session"), "session").when(F.col("last_stored").isNull() | (F.col("last_stored") < F.col("last_session")), "behind").otherwise("closed")
    return out.select("day", reason.alias("reason"), (reason != "closed").alias("run"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("code", "day", F.when(F.col("id") % 13 == 0, "cancel").when(F.col("id") % 5 < 2, "sell").otherwise("buy").alias("kind"), F.col("id").alias("entry"), F.col("p1").alias("price"), F.when(F.col("id") % 13 == 0, F.col("id") + 7).alias("ref"))
    return positions.without_cancelled(c, "kind", "ref", "entry")


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each entry of a log with predictions, limits, cancelled and repeated entries."""
    c = candidates(spark, sf_dir)
    name = lambda x: F.md5(x.cast("string"))
    kind = F.when(F.col("id") % 13 == 0, "cancel").when(F.col("id") % 17 == 0, "note").when(F.col("id") % 5 < 2, "sell").when(F.col("id") % 5 == 2, "target").otherwise("buy")
    log = c.select(
        name(F.col("id")).alias("entry"), F.col("id").alias("seq"), kind.alias("kind"), F.col("code").alias("key"), F.when((F.col("id") % 5 >= 3) & (F.col("id") % 3 > 0), F.date_sub("day", 3)).alias("pick"), F.when(F.col("id") % 19 > 0, F.col("day")).alias("day"),
        F.col("p1").alias("price"), F.when(F.col("id") % 2 == 0, F.col("p2")).alias("shares"), (F.col("p3") / 2).alias("percent"), F.when(F.col("id") % 13 == 0, F.substring(name(F.col("id") + 7), 1, (6 + F.col("id") % 9).cast("int"))).alias("ref"),
    )
    out = positions.settled_log(log)
    return out.select("entry", "kind", "key", "issue", "pick", "bought", "price", "shares", "sold", "sold_price", F.size("targets").alias("n_targets"), F.size("entries").alias("n_entries"))


def next_opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bar of each candidate's key after its day, within five days."""
    bars = daily_bars(table(spark, sf_dir, "lineitem"))
    out = asof.next_after(candidates(spark, sf_dir).select("id", "code", "day"), bars.select("code", "day", "o", "c"), ["code"], "day", "day", ["o", "c"], 5)
    return out.select("id", "next_day", "next_o", "next_c")


def outcomes_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the volume of their key's bar of that day, each at most once."""
    bars = daily_bars(table(spark, sf_dir, "lineitem")).select("code", "day", "v")
    one = candidates(spark, sf_dir).groupBy("code", "day").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return asof.one_to_one(one, bars, ["code", "day"]).select("code", "day", "id", "n", "v")


def from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions.matched_positions(_log(spark, sf_dir), "code", "day", "kind", "entry", "price")


_LOG = f"""{_CANDIDATES}, lg0 AS (SELECT code, day, CASE WHEN id % 13 = 0 THEN 'cancel' WHEN id % 5 < 2 THEN 'sell' ELSE 'buy' END AS kind, id AS entry, p1 AS price, CASE WHEN id % 13 = 0 THEN id + 7 END AS ref FROM c),
lg AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day, kind = 'sell', entry) AS i FROM lg0 WHERE kind <> 'cancel' AND entry NOT IN (SELECT ref FROM lg0 WHERE ref IS NOT NULL))"""


def limit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions bought at the close of days of large volume, with a limit of 8 % that becomes 4 % after 9 days."""
    b = _bars(spark, sf_dir)
    p = b.where("v >= 60").select("code", (F.col("code") * 100000 + F.datediff("day", F.lit("1990-01-01"))).cast("long").alias("entry"), F.col("day").alias("bought"), F.col("c").alias("paid"))
    first = p.select("entry", F.col("bought").alias("day"), (F.col("paid") * 1.08).alias("limit"))
    later = p.select("entry", F.date_add("bought", 9).alias("day"), (F.col("paid") * 1.04).alias("limit"))
    return positions.paths(p, b, first.unionByName(later), "code", "entry", "bought", "paid", 10).select("entry", "day", "age", _r("limit"), "met", _r("gain"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "eight_axes": axes, "eight_axes_by_pace": pace_axes, "decision_replay": replay, "day_verdicts": verdicts, "candidate_shapes": shapes, "stored_distribution": stored_positions, "asset_stress": stress, "peer_prices": peers, "availability_reasons": availability, "profit_flow": flows, "freshness": freshness, "run_gate": gate,
        "positions_from_log": from_log, "settled_log": settled, "next_opens": next_opens, "joined_one_to_one": outcomes_joined, "limit_paths": limit_paths,
    }


def oracle_sql() -> dict[str, str]:
    cuts = "FROM (VALUES (0.0), (0.2), (0.4)) p(a), (VALUES (0.0), (0.2), (0.4)) s(b), (VALUES (0.0), (0.5), (1.0)) i(d)"
    return {
        "eight_axes": _axes_sql(False),
        "eight_axes_by_pace": _axes_sql(True),
        "decision_replay": f"WITH {_DECIDED} SELECT day, id, p_min, n_day, passed, rank, coalesce(passed AND n_day >= 2 AND rank <= 2, false) AS picked FROM d3",
        "day_verdicts": f"WITH {_DECIDED}, g AS (SELECT day, count(*) AS n, count_if(passed) AS n_pass, count_if(p_min IS NULL) AS n_missing FROM d3 GROUP BY day), v AS (SELECT *, CASE WHEN n < 2 THEN 'skip' WHEN n_missing > 0 THEN 'unknown' WHEN n_pass = 0 THEN 'none passed' ELSE 'buy' END AS verdict, CASE WHEN n >= 9 THEN 'strong' WHEN n >= 6 THEN 'ok' WHEN n >= 2 THEN 'quiet' ELSE 'skip' END AS kind FROM g) SELECT day, n, n_pass, n_missing, verdict, verdict = 'buy' AS buy, kind FROM v",
        "candidate_shapes": f"WITH {_CANDIDATES}, q AS (SELECT *, (p1 + p2 + p3) / 3 AS mean, least(p1, p2, p3) AS lo, (p1 >= 70)::INT + (p2 >= 70)::INT + (p3 >= 70)::INT AS n FROM c) SELECT id, {_rounded('CASE WHEN p3 IS NOT NULL THEN mean / 100 END', 'mean')}, {_rounded('CASE WHEN p3 IS NOT NULL THEN lo / 100 END', 'low')}, {_rounded('CASE WHEN p3 IS NOT NULL THEN greatest(0, least(1, 1 - sqrt((pow(p1 - mean, 2) + pow(p2 - mean, 2) + pow(p3 - mean, 2)) / 3) / 20)) END', 'agree')}, CASE WHEN p3 IS NULL OR n = 3 THEN NULL WHEN n = 2 THEN CASE WHEN lo >= 90 THEN 'two_high' WHEN lo >= 60 THEN 'two_middle' ELSE 'two_low' END WHEN lo >= 90 THEN 'least_90' WHEN lo >= 60 THEN 'least_85' END AS shape, CASE WHEN p3 IS NULL THEN NULL WHEN p1 = lo THEN 'p1' WHEN p2 = lo THEN 'p2' ELSE 'p3' END AS laggard, round(score * 1.1::DOUBLE + 3e-7, 4) AS target FROM q",
        "stored_distribution": f"WITH {_CANDIDATES}, x AS (SELECT id, day, round(p3) AS x FROM c), g AS (SELECT quantile_cont(x, [{', '.join(f'{i} / 100.0::DOUBLE' for i in range(101))}]) AS g FROM x WHERE day < DATE '1999-01-01'), k AS (SELECT id, x, g, len(list_filter(g, lambda p: p < x)) AS b, len(list_filter(g, lambda p: p <= x)) AS u FROM x, g WHERE day >= DATE '1999-01-01') SELECT id, {_rounded('CASE WHEN x IS NULL THEN NULL WHEN b = 0 THEN CASE WHEN u > 0 THEN (u - 1) / 2 ELSE 0 END WHEN b = 101 THEN 100 WHEN u > b THEN (b + u - 1) / 2 ELSE b - 1 + (x - g[b]) / (g[b + 1] - g[b]) END::DOUBLE', 'pct')} FROM k",
        "asset_stress": f"WITH {_CANDIDATES}, n AS (SELECT id, score AS cap, p1 * 3000 - 20000 AS net, p2 * 500 AS plant, p3 * 400 AS stock, p1 * 100 AS soft, p2 + 100 AS price FROM c), h AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b, d::DOUBLE AS d {cuts}), v AS (SELECT id, CASE WHEN stock IS NOT NULL THEN greatest(net - a * plant - b * stock - d * soft, 0) / cap * price END AS v FROM n, h) SELECT id, {_rounded('min(v)', 'low')}, {_rounded('max(v)', 'high')}, {_rounded('avg(v)', 'mean')}, {_rounded('median(v)', 'median')}, {_rounded('stddev_pop(v)', 'deviation')} FROM v GROUP BY id",
        "peer_prices": f"WITH {_CANDIDATES}, k AS (SELECT id, date_trunc('month', day) AS month, grp, p3 - 10 AS x, score / 100 AS price FROM c WHERE p3 > 10), j AS (SELECT a.id, count(b.id) AS peers, a.price / a.x AS f, min(b.x) AS lo, max(b.x) AS hi, avg(b.x) AS m, stddev_pop(b.x) AS sd, quantile_cont(b.x, 0.1) AS q1, quantile_cont(b.x, 0.5) AS q5, quantile_cont(b.x, 0.9) AS q9 FROM k a LEFT JOIN k b ON b.month = a.month AND b.grp = a.grp AND b.id <> a.id GROUP BY a.id, a.price, a.x) SELECT id, peers, " + ", ".join(f"round(CASE WHEN peers >= 10 THEN {x} * f END + 3e-7, 4) AS {n}" for x, n in (("lo", "low"), ("hi", "high"), ("m", "mean"), ("sd", "deviation"), ("q1", "p10"), ("q5", "p50"), ("q9", "p90"))) + " FROM j",
        "availability_reasons": f"WITH {_CANDIDATES}, r AS (SELECT id, concat_ws('; ', CASE WHEN p3 IS NULL THEN 'no third percentile' END, CASE WHEN p1 < 10 THEN 'low' END, CASE WHEN day < DATE '1996-01-01' THEN 'old' END) AS reason FROM c) SELECT id, reason FROM r WHERE reason <> ''",
        "profit_flow": f"""WITH {_CANDIDATES}, s AS (SELECT id, score - 5000 AS sales, list_filter([{{'n': 'operating', 'v': p1 * 1000 - 20000}}, {{'n': 'ordinary', 'v': CASE WHEN id % 4 <> 0 THEN p1 * 1000 - 22000 + p2 * 50 END}}, {{'n': 'net', 'v': p3 * 500 - 5000}}], lambda x: x.v IS NOT NULL) AS l FROM c),
e AS (SELECT id, sales, l, unnest(range(1, len(l) + 1)) AS step FROM s WHERE sales > 0), p AS (SELECT id, step, l[step].n AS name, l[step].v AS value, CASE WHEN step = 1 THEN sales ELSE l[step - 1].v END AS b, CASE WHEN step > 1 THEN list_min(list_transform(l[1:step - 1], lambda x: x.v)) END AS worst FROM e)
SELECT id, step, name, round(value + 3e-7, 4) AS value, round(CASE WHEN value <= 0 THEN b WHEN b > value THEN b - value END + 3e-7, 4) AS out, round(CASE WHEN value > 0 AND b < value THEN value - b END + 3e-7, 4) AS gain, value <= 0 AS loss FROM p WHERE worst IS NULL OR worst > 0""",
        "freshness": f"WITH {sql.BARS}, d AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM bars)), l AS (SELECT code, max(day) AS day FROM bars GROUP BY code) SELECT code, day, n - i AS age, n - i > 2 AS stale FROM l JOIN d USING (day)",
        "run_gate": f"WITH {sql.BARS}, g AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM bars), s AS (SELECT day, count_if(v > 60) > 0 AS stored FROM bars GROUP BY day), j AS (SELECT g.day, stored IS NOT NULL AS session, max(CASE WHEN stored IS NOT NULL THEN g.day END) OVER w AS ls, max(CASE WHEN stored THEN g.day END) OVER w AS lt FROM g LEFT JOIN s USING (day) WINDOW w AS (ORDER BY g.day)), r AS (SELECT day, CASE WHEN session THEN 'session' WHEN lt IS NULL OR lt < ls THEN 'behind' ELSE 'closed' END AS reason FROM j) SELECT day, reason, reason <> 'closed' AS run FROM r",
        "next_opens": f"""WITH {_CANDIDATES}, {sql.BARS} SELECT id, CASE WHEN b.day - c.day <= 5 THEN b.day END AS next_day, CASE WHEN b.day - c.day <= 5 THEN o END AS next_o, CASE WHEN b.day - c.day <= 5 THEN b.c END AS next_c FROM c ASOF LEFT JOIN bars b ON b.code = c.code AND b.day > c.day""",
        "joined_one_to_one": f"WITH {_CANDIDATES}, {sql.BARS}, g AS (SELECT code, day, max(id) AS id, count(*) AS n FROM c GROUP BY 1, 2) SELECT code, day, id, n, v FROM g LEFT JOIN bars USING (code, day)",
        "positions_from_log": f"""WITH RECURSIVE {_LOG}, r AS (
  SELECT code, i, day, entry, price, kind, CASE WHEN kind = 'buy' THEN [entry] ELSE []::BIGINT[] END AS held, NULL::BIGINT AS closes FROM lg WHERE i = 1
  UNION ALL
  SELECT lg.code, lg.i, lg.day, lg.entry, lg.price, lg.kind, CASE WHEN lg.kind = 'buy' THEN list_append(held, lg.entry) ELSE held[1:len(held) - 1] END, CASE WHEN lg.kind = 'sell' THEN held[len(held)] END FROM r JOIN lg ON lg.code = r.code AND lg.i = r.i + 1)
SELECT b.code, b.entry, b.day AS bought, b.price, s.day AS sold, s.price AS sold_price FROM lg b LEFT JOIN r s ON s.closes = b.entry WHERE b.kind = 'buy'""",
        "limit_paths": f"""WITH {sql.BARS}, b AS (SELECT code, day, h, c, v, {sql.ROW} AS i FROM bars), p AS (SELECT code, code * 100000 + (day - DATE '1990-01-01') AS entry, day AS bought, c AS paid, i FROM b WHERE v >= 60),
x AS (SELECT p.entry, b.day, b.i - p.i AS age, paid * CASE WHEN b.day >= bought + 9 THEN 1.04::DOUBLE ELSE 1.08::DOUBLE END AS lim, h, c, paid FROM p JOIN b ON b.code = p.code AND b.i BETWEEN p.i + 1 AND p.i + 10),
m AS (SELECT *, coalesce(max(h >= lim) OVER (PARTITION BY entry ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM x)
SELECT entry, day, age, {_rounded('lim', '"limit"')}, h >= lim AS met, {_rounded('(CASE WHEN h >= lim THEN lim ELSE c END / paid - 1) * 100', 'gain')} FROM m WHERE NOT over""",
    }
