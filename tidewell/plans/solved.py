"""Queries that need a numeric solver; none has a SQL twin, tests hold them to identities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import solvers
from tidewell.sources.tables import table


def tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") / 500) * 500 + 250).alias("price"), "l_quantity")
    bins = lines.groupBy("code", "price").agg(F.sum("l_quantity").alias("shares"))
    mean = bins.groupBy("code").agg((F.sum(F.col("price") * F.col("shares")) / F.sum("shares") * 1.1).alias("known_mean"))
    return solvers.tilted_profile(bins, "code", "price", "shares", mean, "known_mean")


def _supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") * 12).alias("price"), F.col("s_acctbal").alias("base"), ((F.col("s_suppkey") % 5) / 100.0 + 0.05).alias("cost"))


def implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.implied_growth(_supplier(spark, sf_dir), "price", "base", "cost")


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.simulated_value(_supplier(spark, sf_dir), "s_suppkey", "base", "cost", 0.02, 0.1)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 9).alias("v"))
    return solvers.whitened(e, "label", "vec_id", "v")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"tilted_profile": tilted, "implied_growth": implied, "simulated_value": simulated, "whitened_states": states}


def oracle_sql() -> dict[str, str]:
    return {}
