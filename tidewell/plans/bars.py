"""Bar queries: their Spark form and SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import panel, scans
from tidewell.plans import bars_sql as sql
from tidewell.sources.tables import daily_bars, table


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _indicators(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = _bars(spark, sf_dir)
        out = build(bars)
        return out.select("code", "day", *(F.round(F.col(c).cast("double") + 3e-7, 4).alias(c) for c in out.columns if c not in bars.columns))

    return query


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir).select("code", "day", "o", "h", "l", "c", "v", "va")


def new_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.price_panel(_bars(spark, sf_dir)).select("code", "day", "c", "prior_high", "new_high", "fresh_break")


def forward_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.forward_label(_bars(spark, sf_dir)).select("code", "day", "entry", "max_ahead", "min_ahead", "end_close", "above_ahead", "label")


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.drawdown(_bars(spark, sf_dir)).select("code", "day", F.round("depth", 4).alias("depth"), "high_age")


def breaks_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: fresh breaks of the 368-row high by year, with their 20-row outcome from the next open."""
    df = panel.forward_label(panel.price_panel(_bars(spark, sf_dir))).where("fresh_break")
    return df.groupBy(F.year("day").alias("year")).agg(F.count("*").alias("n"), F.count("label").alias("n_known"), F.sum(F.col("label").cast("int")).alias("n_hit"), F.round(F.avg(F.col("max_ahead") / F.col("entry") - 1), 6).alias("mean_rise"))


def _breaks_sql() -> str:
    return f"""
WITH p AS ({sql.price_panel()}), f AS ({sql.forward_label()}),
j AS (SELECT year(day) AS year, label, max_ahead, entry FROM p JOIN f USING (code, day) WHERE fresh_break)
SELECT year::INTEGER AS year, count(*) AS n, count(label) AS n_known, sum(label::INT)::BIGINT AS n_hit, round(avg(max_ahead / entry - 1), 6) AS mean_rise FROM j GROUP BY 1"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "bars_daily": bars_daily,
        "panel_new_high": new_high,
        "panel_forward_label": forward_label,
        "panel_drawdown": drawdown,
        "panel_breaks_by_year": breaks_by_year,
        "tech_moving_averages": _indicators(panel.moving_averages),
        "tech_channels": _indicators(panel.channels),
        "tech_momentum": _indicators(panel.momentum),
        "tech_volatility": _indicators(panel.volatility),
        "tech_volume": _indicators(panel.volume),
        "tech_candles": _indicators(panel.candles),
        "tech_recursive": _indicators(scans.recursive_indicators),
        **{f"tech_{g}": _indicators(lambda b, g=g: scans.recursive_indicators(b, (g,))) for g in scans.GROUPS},
    }


def oracle_sql() -> dict[str, str]:
    return {
        "bars_daily": "WITH " + sql.BARS + " SELECT code, day, o, h, l, c, v, va FROM bars",
        "panel_new_high": sql.price_panel(),
        "panel_forward_label": sql.forward_label(),
        "panel_drawdown": sql.drawdown(),
        "panel_breaks_by_year": _breaks_sql(),
        "tech_moving_averages": sql.moving_averages(),
        "tech_channels": sql.channels(),
        "tech_momentum": sql.momentum(),
        "tech_volatility": sql.volatility(),
        "tech_volume": sql.volume(),
        "tech_candles": sql.candles(),
        "tech_recursive": sql.all_recursive(),
        **{f"tech_{g}": build() for g, build in sql.RECURSIVE.items()},
    }
