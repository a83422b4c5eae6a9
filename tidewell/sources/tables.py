"""Reading tables, and daily bars derived from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_or_empty(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """A table, or no rows of the schema where nothing is stored; columns that are missing are null."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    stored = where.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(where)
    df = spark.read.option("mergeSchema", "true").parquet(path) if stored else spark.createDataFrame([], schema)
    wanted = [f for f in schema if columns is None or f.name in columns]
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def csv_table(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> DataFrame:
    """Plain or gzipped CSV by an explicit schema; malformed fields become null, a broken archive fails."""
    return spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(path)


def json_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """code, day, o, h, l, c, v and va: one bar for each supplier and ship day.

    The price of a line is its price per unit; first and last go by order and line number (under 1,024), as one number: then all that is
    gathered has a fixed width, and lines are summed by hash where they are read, without a sort.
    """
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.col("l_orderkey").cast("long") * 1024 + F.col("l_linenumber")
    lines = lineitem.select(F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("day"), px.alias("px"), order.alias("ord"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("a"))
    return lines.groupBy("code", "day").agg(F.min_by("px", "ord").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", "ord").alias("c"), F.sum("q").alias("v"), F.sum(F.col("a").cast("decimal(18,2)")).cast("double").alias("va"))
