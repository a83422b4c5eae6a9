"""Queries of evaluation, folds, transforms and exits, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import edges, evaluate, judge, learners, rank, simulate
from tidewell.plans import bars_sql as sql
from tidewell.plans.choices import _CANDIDATES, candidates
from tidewell.sources.tables import daily_bars, table


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _r(c: str, digits: int = 6):
    return F.round(F.col(c) + 3e-9, digits).alias(c)


def _rounded(x: str, name: str, digits: int = 6) -> str:
    return f"round({x} + 3e-9, {digits}) AS {name}"


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).where("p3 IS NOT NULL").withColumn("month", F.trunc("day", "month"))
    per = c.groupBy("month").agg(F.count_if(F.col("p1") > F.col("p3")).alias("wins"), F.count_if(F.col("p1") < F.col("p3")).alias("losses"))
    return per.select("month", "wins", "losses", F.round(judge.sign_test(F.col("wins"), F.col("losses")) + 3e-9, 6).alias("p"))


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.holdout(candidates(spark, sf_dir), "day", 12, 60).groupBy("part").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"year": F.year("day"), "band": F.floor(F.col("score") / 20000)})
    return judge.stratified_folds(c, [["label", "year", "band"], ["label", "year"], ["label"]], "id", 5).select("id", "stratum", F.col("fold").cast("long").alias("fold"))


def time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.time_folds(candidates(spark, sf_dir), "day", 5, 60)


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("coarse", F.floor(F.col("p3") / 5).cast("double"))
    out = judge.report(c, ["grp"], "coarse", "label")
    return out.select("grp", "n", *(_r(x) for x in ("base", "average_precision", "auc", "precision_1", "lift_1", "precision_5", "lift_5", "precision_10", "lift_10")))


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("x", F.col("p1") - 50)
    return judge.interval(evaluate.group_bootstrap(c, "day", "x", 200), "mean").select("n", _r("mean", 5), _r("low", 5), _r("high", 5), _r("share_positive", 5))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("mixed", F.col("p1") + 20 * F.col("label"))
    out = judge.paired_difference(c, "mixed", "p2", "label", "id", 100)
    return judge.interval(out.where("draw > 0"), "diff").select("n", _r("mean"), _r("low"), _r("high"), _r("share_positive"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draw as observed, which is the plain average precision."""
    c = candidates(spark, sf_dir)
    return judge.bootstrap_precision(c, "p3", "label", "id", 3).where("draw = 0").select("draw", _r("average_precision"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return c.select("id", judge.band_of(F.col("p3"), [(10.0, "low"), (50.0, "middle"), (90.0, "high"), (100.0, "top")]).alias("band"))


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all earlier mean percentiles that a row's mean percentile exceeds."""
    c = candidates(spark, sf_dir).withColumn("mean", (F.col("p1") + F.col("p2") + F.col("p3")) / 3)
    history = c.where("day < DATE '1999-01-01'")
    return rank.share_below(c.where("day >= DATE '1999-01-01'").select("id", "mean"), history, "mean", "mean", "pct").select("id", "pct")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated chances of the label, which rise with the score."""
    c = candidates(spark, sf_dir).withColumn("s", (F.col("p1") + 40 * F.col("label")) / 140)
    points = simulate.isotonic(c, "s", "label", 10)
    return c.select(F.floor(F.col("s") * 10).alias("band"), simulate.calibrated(F.col("s"), points).alias("chance")).groupBy("band").agg(F.count("*").alias("n"), F.min("chance").alias("low"), F.max("chance").alias("high")).select("band", "n", _r("low"), _r("high"))


def _edge(spark: SparkSession, sf_dir: str, draws: int) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("gain", F.col("p1") + F.col("score") / 10000)
    return edges.edge_draws(c, "day", "score", "gain", 5.0, draws)


def edge_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best 5 % by score have over all in the median, and the interval of 200 draws of days."""
    return judge.interval(_edge(spark, sf_dir, 201).where("draw > 0"), "diff")


def edge_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge(spark, sf_dir, 1).select("n", _r("top_median"), _r("all_median"), _r("diff"))


_EDGE = f"""
WITH {_CANDIDATES}, g AS (SELECT score, p1 + score / 10000 AS gain FROM c), t AS (SELECT * FROM g QUALIFY row_number() OVER (ORDER BY score DESC) <= (SELECT floor(count(*) * 0.05::DOUBLE + 1e-9) FROM g))
SELECT count(*) AS n, round((SELECT median(gain) FROM t) + 3e-9, 6) AS top_median, round(median(gain) + 3e-9, 6) AS all_median, round((SELECT median(gain) FROM t) - median(gain) + 3e-9, 6) AS diff FROM g"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of candidates by three rounds of k-means on two scores: size, rate of the label, and mean scores."""
    c = candidates(spark, sf_dir)
    centres = learners.kmeans(c, ["p1", "p2"], "id", 8, 3)
    return c.withColumn("cell", learners.nearest_centre(["p1", "p2"], centres)).groupBy("cell").agg(F.count("*").alias("n"), F.avg("label").alias("rate"), F.avg("p1").alias("p1"), F.avg("p2").alias("p2")).select("cell", "n", _r("rate"), _r("p1"), _r("p2"))


def _cells_sql() -> str:
    step = lambda i: f"a{i} AS (SELECT c.id, min({{'d': pow(c.p1 - e.x, 2) + pow(c.p2 - e.y, 2), 'e': e.e}}).e AS e FROM c, e{i} e GROUP BY c.id), e{i + 1} AS (SELECT e.e, coalesce(n.x, e.x) AS x, coalesce(n.y, e.y) AS y FROM e{i} e LEFT JOIN (SELECT e, avg(p1) AS x, avg(p2) AS y FROM a{i} JOIN c USING (id) GROUP BY e) n USING (e))"
    return f"WITH {_CANDIDATES}, e0 AS (SELECT row_number() OVER (ORDER BY md5('0:' || id)) - 1 AS e, p1 AS x, p2 AS y FROM c QUALIFY e < 8), {step(0)}, {step(1)}, {step(2)}, {step(3)} SELECT e AS cell, count(*) AS n, round(avg(label) + 3e-9, 6) AS rate, round(avg(p1) + 3e-9, 6) AS p1, round(avg(p2) + 3e-9, 6) AS p2 FROM a3 JOIN c USING (id) GROUP BY e"


def chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of the label by a logit on four columns, fitted outside of each row's fold."""
    c = candidates(spark, sf_dir).withColumns({"fold": F.col("id") % 5, "year": F.year("day")})
    return learners.out_of_fold_chances(c, "fold", ["p1", "p3", "score", "year"], "label").select("id", "fold", _r("oof"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.cluster_error(candidates(spark, sf_dir), ["grp"], "p3", "code").select("grp", "n", "clusters", _r("mean"), _r("error"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("x", F.when(F.col("day") >= F.lit("2000-01-01"), F.col("p3") / 2).otherwise(F.col("p3")))
    return judge.area_between(c, ["grp"], "x", F.col("day") >= F.lit("2000-01-01")).select("grp", _r("w1"), _r("down"), _r("up"), "n_recent", "n_before")


def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumns({"a": F.col("p1") - 50, "b": F.col("p3") - 40, "d": F.floor(F.col("p3") / 20).cast("double"), "e": F.when(F.col("id") % 2 == 0, F.col("p2"))})
    t = judge.fitted(c.where("day < DATE '1999-01-01'"), {"score": "clip", "a": "asinh", "b": "log", "d": "mode", "e": "-1"}, (0.05, 0.95))
    return c.select("id", *(F.round(v + 3e-9, 6).alias(n) for n, (v, _) in t.items()), *(flag.alias(f"{n}_missing") for n, (_, flag) in t.items() if flag is not None))


def odd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.unusual(candidates(spark, sf_dir), ["p1", "p3"]).select("id", _r("distance", 5))


def exit_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.exits(_bars(spark, sf_dir), 20, 0.15, 0.2).select("code", "day", "held", _r("result"), _r("best"), _r("fall"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.held_states(_bars(spark, sf_dir), F.col("v") >= 60, 10).select("code", "day", "age", _r("ret"), _r("best"), _r("drop"), _r("change"))


def in_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and lift within strata of the score."""
    c = candidates(spark, sf_dir).withColumn("stratum", F.floor(F.col("score") / 100000))
    return judge.report(c, ["stratum"], "p1", "label", (5.0,)).select("stratum", "n", _r("base"), _r("auc"), _r("precision_5"), _r("lift_5"))


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of one column each, held against each other: the label's rate among the first 5 % by it."""
    c = candidates(spark, sf_dir)
    rows = c.select("id", "label", F.explode(F.create_map(F.lit("p1"), F.col("p1"), F.lit("p2 down"), 100 - F.col("p2"), F.lit("p3"), F.col("p3"), F.lit("score"), F.col("score"))).alias("rule", "x"))
    return judge.report(rows, ["rule"], "x", "label", (5.0,)).select("rule", "n", _r("base"), _r("average_precision"), _r("lift_5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "sign_tests": signs, "holdout_split": holdout, "stratified_folds": strata, "time_series_folds": time_folds, "evaluation_report": reported, "bootstrap_interval": bootstrap_interval, "paired_bootstrap": paired, "bootstrap_observed": observed, "band_lookup": bands, "consensus_percentile": consensus, "calibration_bands": calibration, "kmeans_cells": cells, "edge_interval": edge_interval, "edge_observed": edge_observed, "out_of_fold_chances": chances,
        "cluster_errors": clusters, "distribution_areas": areas, "fitted_transforms": transforms, "unusual_rows": odd_rows, "exit_rule": exit_rule, "held_states": states, "stratified_evaluation": in_strata, "rule_baselines": baselines,
    }


def _report_sql(source: str, by: str, percents: tuple[int, ...], columns: str) -> str:
    """source: a CTE s with by, x (never null) and label."""
    tops = ", ".join(f"sum(greatest(least((greatest(floor(n * {p} / 100), 1) - r + 1) / m, 1), 0) * label) / sum(greatest(least((greatest(floor(n * {p} / 100), 1) - r + 1) / m, 1), 0)) AS precision_{p}" for p in percents)
    return f"""WITH {_CANDIDATES}, {source},
r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x DESC) AS r, count(*) OVER (PARTITION BY {by}, x) AS m, count(*) OVER (PARTITION BY {by}) AS n, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2 AS ar FROM s),
t AS (SELECT {by}, x, count(*) AS n, sum(label) AS p FROM s GROUP BY 1, 2), cv AS (SELECT {by}, p, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM t WINDOW w AS (PARTITION BY {by} ORDER BY x DESC)),
ap AS (SELECT {by}, sum(p * cp / cn) / sum(p) AS average_precision FROM cv GROUP BY 1),
g AS (SELECT {by}, any_value(n) AS n, avg(label) AS base, sum(label) AS np, sum(CASE WHEN label = 1 THEN ar END) AS sr, {tops} FROM r GROUP BY 1),
z AS (SELECT *, (sr - np * (np + 1) / 2) / (np * (n - np)) AS auc FROM g JOIN ap USING ({by}))
SELECT {by}, n, {columns} FROM z"""


def oracle_sql() -> dict[str, str]:
    c = f"WITH {_CANDIDATES}"
    lift = lambda p: f"{_rounded(f'precision_{p}', f'precision_{p}')}, {_rounded(f'precision_{p} / base', f'lift_{p}')}"
    return {
        "kmeans_cells": _cells_sql(),
        "edge_observed": _EDGE,
        "sign_tests": f"{c}, m AS (SELECT date_trunc('month', day)::DATE AS month, count_if(p1 > p3) AS wins, count_if(p1 < p3) AS losses FROM c WHERE p3 IS NOT NULL GROUP BY 1) SELECT month, wins, losses, {_rounded('least(1, 2 * list_sum(list_transform(range(greatest(wins, losses)::BIGINT, (wins + losses + 1)::BIGINT), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)))))', 'p')} FROM m",
        "holdout_split": f"{c}, b AS (SELECT (max(day) - INTERVAL 12 MONTH)::DATE AS t FROM c) SELECT CASE WHEN day >= t THEN 'test' WHEN day > t - 87 THEN 'embargo' ELSE 'train' END AS part, count(*) AS n, min(day) AS first, max(day) AS last FROM c, b GROUP BY 1",
        "stratified_folds": f"{c}, k AS (SELECT id, label, year(day)::INTEGER AS year, floor(score / 20000)::BIGINT AS band FROM c), s AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY label, year, band) >= 5 THEN '0|' || label || '|' || year || '|' || band WHEN count(*) OVER (PARTITION BY label, year) >= 5 THEN '1|' || label || '|' || year ELSE '2|' || label END AS stratum FROM k) SELECT id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || id), id) - 1) % 5 AS fold FROM s",
        "time_series_folds": f"{c}, d AS (SELECT day - DATE '1970-01-01' AS d FROM c), q AS (SELECT quantile_cont(d, [1 / 6.0::DOUBLE, 2 / 6.0::DOUBLE, 3 / 6.0::DOUBLE, 4 / 6.0::DOUBLE, 5 / 6.0::DOUBLE, 1.0::DOUBLE]) AS q FROM d), f AS (SELECT i::INTEGER AS fold, floor(q[i + 1])::INTEGER AS a, floor(q[i + 2])::INTEGER AS b, floor(q[i + 1])::INTEGER - 87 AS t FROM q, range(5) r(i)) SELECT fold, DATE '1970-01-01' + a AS test_from, DATE '1970-01-01' + b AS test_to, DATE '1970-01-01' + t AS train_to, count(*) FILTER (WHERE d <= t) AS n_train, count(*) FILTER (WHERE d > a AND d <= b) AS n_test FROM f, d GROUP BY fold, a, b, t",
        "evaluation_report": _report_sql("s AS (SELECT grp, label, coalesce(floor(p3 / 5), min(floor(p3 / 5)) OVER (PARTITION BY grp) - 1) AS x FROM c)", "grp", (1, 5, 10), f"{_rounded('base', 'base')}, {_rounded('average_precision', 'average_precision')}, {_rounded('auc', 'auc')}, {lift(1)}, {lift(5)}, {lift(10)}"),
        "bootstrap_interval": f"WITH RECURSIVE {_CANDIDATES}, g AS (SELECT day, sum(p1 - 50) AS s, count(*) AS n FROM c GROUP BY day), p AS (SELECT 0 AS k, exp(-1::DOUBLE) AS t, exp(-1::DOUBLE) AS c UNION ALL SELECT k + 1, t / (k + 1), c + t / (k + 1) FROM p WHERE k < 11), l AS (SELECT list(c ORDER BY k) AS cdf FROM p), w AS (SELECT draw, s, n, len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('0:' || draw || ':' || day), 1, 12))::BIGINT::DOUBLE / 281474976710656)) AS w FROM g, l, range(200) v(draw)), m AS (SELECT draw, sum(w * s) / sum(w * n) AS x FROM w GROUP BY draw) SELECT count(*) AS n, {_rounded('avg(x)', 'mean', 5)}, {_rounded('quantile_cont(x, 0.025)', 'low', 5)}, {_rounded('quantile_cont(x, 0.975)', 'high', 5)}, {_rounded('avg((x > 0)::INT)', 'share_positive', 5)} FROM m",
        "bootstrap_observed": f"{c}, t AS (SELECT p3, count(*) AS n, sum(label) AS p FROM c WHERE p3 IS NOT NULL GROUP BY 1), v AS (SELECT p, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM t WINDOW w AS (ORDER BY p3 DESC)) SELECT 0::INTEGER AS draw, {_rounded('sum(p * cp / cn) / sum(p)', 'average_precision')} FROM v",
        "band_lookup": f"{c} SELECT id, CASE WHEN p3 <= 10 THEN 'low' WHEN p3 <= 50 THEN 'middle' WHEN p3 <= 90 THEN 'high' WHEN p3 IS NOT NULL THEN 'top' END AS band FROM c",
        "consensus_percentile": f"{c}, m AS (SELECT id, day, (p1 + p2 + p3) / 3 AS x FROM c), h AS (SELECT x FROM m WHERE day < DATE '1999-01-01' AND x IS NOT NULL), v AS (SELECT x, count(*) AS n FROM h GROUP BY x), a AS (SELECT x, sum(n) OVER (ORDER BY x) AS upto FROM v), r AS (SELECT id, m.x, (SELECT coalesce(max(upto), 0) FROM a WHERE a.x < m.x) AS k FROM m WHERE day >= DATE '1999-01-01') SELECT id, CASE WHEN x IS NOT NULL THEN round(100.0::DOUBLE * k / (SELECT count(*) FROM h), 1) END AS pct FROM r",
        "cluster_errors": f"{c}, m AS (SELECT grp, avg(p3) AS mean, count(p3) AS n FROM c GROUP BY grp), k AS (SELECT grp, code, sum(p3 - mean) AS s FROM c JOIN m USING (grp) WHERE p3 IS NOT NULL GROUP BY 1, 2) SELECT grp, any_value(n) AS n, count(*) AS clusters, {_rounded('any_value(mean)', 'mean')}, {_rounded('sqrt(sum(s * s) * count(*) / (count(*) - 1)) / any_value(n)', 'error')} FROM k JOIN m USING (grp) GROUP BY grp",
        "distribution_areas": f"{c}, x AS (SELECT grp, CASE WHEN day >= DATE '2000-01-01' THEN p3 / 2 ELSE p3 END AS x, day >= DATE '2000-01-01' AS q FROM c WHERE p3 IS NOT NULL), p AS (SELECT grp, x, count_if(q) AS a, count_if(NOT q) AS b FROM x GROUP BY 1, 2), d AS (SELECT grp, a, b, (sum(a) OVER w) / (sum(a) OVER g) - (sum(b) OVER w) / (sum(b) OVER g) AS d, lead(x) OVER (PARTITION BY grp ORDER BY x) - x AS h FROM p WINDOW w AS (PARTITION BY grp ORDER BY x), g AS (PARTITION BY grp)) SELECT grp, {_rounded('sum(abs(d) * h)', 'w1')}, {_rounded('sum(greatest(d, 0) * h)', 'down')}, {_rounded('sum(greatest(-d, 0) * h)', 'up')}, sum(a)::BIGINT AS n_recent, sum(b)::BIGINT AS n_before FROM d GROUP BY grp",
        "fitted_transforms": f"{c}, t AS (SELECT id, day, score, p1 - 50 AS a, p3 - 40 AS b, floor(p3 / 20) AS d, CASE WHEN id % 2 = 0 THEN p2 END AS e FROM c), f AS (SELECT quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi, (quantile_cont(a, 0.75) - quantile_cont(a, 0.25)) / 2 AS s, quantile_cont(b, 0.5) AS mb FROM t WHERE day < DATE '1999-01-01'), o AS (SELECT d AS md FROM t WHERE day < DATE '1999-01-01' AND d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1) SELECT id, {_rounded('least(greatest(score, lo), hi)', 'score')}, {_rounded('asinh(a / s)', 'a')}, {_rounded('ln(1 + greatest(coalesce(b, mb), 0))', 'b')}, {_rounded('coalesce(d, md)', 'd')}, {_rounded('coalesce(e, -1)', 'e')}, (b IS NULL)::INT AS b_missing, (d IS NULL)::INT AS d_missing, (e IS NULL)::INT AS e_missing FROM t, f, o",
        "unusual_rows": f"{c}, m AS (SELECT avg(p1) AS a, avg(p3) AS b, var_samp(p1) AS va, var_samp(p3) AS vb, covar_samp(p1, p3) AS ab FROM c WHERE p3 IS NOT NULL) SELECT id, {_rounded('sqrt((vb * pow(p1 - a, 2) - 2 * ab * (p1 - a) * (p3 - b) + va * pow(p3 - b, 2)) / (va * vb - ab * ab))', 'distance', 5)} FROM c, m",
        "exit_rule": f"""WITH {sql.BARS}, w AS (SELECT code, day, lead(o) OVER (PARTITION BY code ORDER BY day) AS entry, list(c) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS cs FROM bars),
t AS (SELECT *, list_transform(range(1, 21), lambda i: greatest(entry, list_max(cs[1:i]))) AS tops FROM w),
f AS (SELECT *, CASE WHEN len(cs) = 20 THEN coalesce(list_min(list_filter(range(1, 21), lambda i: cs[i] >= entry * (1 + 0.15) OR cs[i] < tops[i] * (1 - 0.2))), 20) END AS k FROM t)
SELECT code, day, k AS held, {_rounded('(cs[k] / entry - 1) * 100', 'result')}, {_rounded('(tops[k] / entry - 1) * 100', 'best')}, {_rounded('CASE WHEN k IS NOT NULL THEN greatest(0, list_max(list_transform(range(1, k + 1), lambda i: 1 - cs[i] / tops[i]))) * 100 END', 'fall')} FROM f""",
        "held_states": f"WITH {sql.BARS}, w AS (SELECT code, day, v, lead(o) OVER (PARTITION BY code ORDER BY day) AS entry, list(c) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS cs FROM bars), r AS (SELECT *, unnest(range(1, len(cs) + 1)) AS age FROM w WHERE v >= 60 AND entry IS NOT NULL), b AS (SELECT *, greatest(entry, list_max(cs[1:age])) AS top FROM r) SELECT code, day, age, {_rounded('(cs[age] / entry - 1) * 100', 'ret')}, {_rounded('(top / entry - 1) * 100', 'best')}, {_rounded('(1 - cs[age] / top) * 100', 'drop')}, {_rounded('CASE WHEN age > 1 THEN (cs[age] / cs[age - 1] - 1) * 100 END', 'change')} FROM b",
        "stratified_evaluation": _report_sql("s AS (SELECT floor(score / 100000)::BIGINT AS stratum, label, p1 AS x FROM c)", "stratum", (5,), f"{_rounded('base', 'base')}, {_rounded('auc', 'auc')}, {lift(5)}"),
        "rule_baselines": _report_sql("q AS (SELECT 'p1' AS rule, label, p1 AS y FROM c UNION ALL SELECT 'p2 down', label, 100 - p2 FROM c UNION ALL SELECT 'p3', label, p3 FROM c UNION ALL SELECT 'score', label, score FROM c), s AS (SELECT rule, label, coalesce(y, min(y) OVER (PARTITION BY rule) - 1) AS x FROM q)", "rule", (5,), f"{_rounded('base', 'base')}, {_rounded('average_precision', 'average_precision')}, {_rounded('precision_5 / base', 'lift_5')}"),
    }
