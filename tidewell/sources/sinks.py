"""Storage by day or year: sorted partitions, replacing whole days, keyed upserts, frozen history and first-write snapshots.

Each write is one Spark job that replaces whole partitions, so that a repeated or restarted write gives the same files' contents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_days(df: DataFrame, path: str, on: str, order: list[str], parts: int = 1, mode: str = "overwrite") -> None:
    """df as Parquet by day (column ``date``), each file sorted; the days in df replace what is stored of them, others stay.

    A day is dealt over ``parts`` files by a hash of its rows, for days that are too large for one task.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(parts))
    days = df.withColumn("date", F.col(on).cast("date"))
    days = days.repartition("date", salt) if parts > 1 else days.repartition("date")
    days.sortWithinPartitions("date", *order).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def clean_days(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """df without exact repeats, and the keys that are left with several rows, which a caller should refuse."""
    rows = df.distinct()
    return rows, rows.groupBy(*key).count().where("count > 1")


def day_stats(df: DataFrame, on: str, key: str) -> DataFrame:
    return df.groupBy(F.col(on).cast("date").alias("date")).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))


def upsert_years(new: DataFrame, path: str, key: list[str], on: str, by: list[str]) -> None:
    """Merge new rows into a table by year: of each key the last by the columns ``by`` stays, a new row before an old equal one.

    Only the years that new holds are read and rewritten. They are staged beside the table first, since a table can't be read and replaced
    in one job. Files hold ranges of keys, however many rows a year has.
    """
    spark = new.sparkSession
    new = new.withColumn("year", F.year(on))
    years = [r.year for r in new.select("year").distinct().collect()]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = new.withColumn("_new", F.lit(1))
    if system.exists(where):
        rows = spark.read.parquet(path).where(F.col("year").isin(years)).withColumn("_new", F.lit(0)).unionByName(rows)
    best = rows.groupBy("year", *key).agg(F.max_by(F.struct(*new.columns), F.struct(*by, "_new")).alias("r")).select("r.*")
    stage = f"{path.rstrip('/')}-stage-{uuid.uuid4().hex}"
    best.repartitionByRange("year", *key).sortWithinPartitions("year", *key).write.partitionBy("year").parquet(stage)
    spark.read.parquet(stage).repartitionByRange("year", *key).sortWithinPartitions("year", *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(stage), True)


def frozen(published: DataFrame, fresh: DataFrame, on: str) -> DataFrame:
    """Fresh rows of days that were never published, and the published rows of all others: what was once given out stays."""
    return published.unionByName(fresh.join(published.select(on).distinct(), on, "left_anti").select(published.columns))


def first_snapshot(stored: DataFrame, fresh: DataFrame, on: str, keep_days: int) -> DataFrame:
    """frozen(), less the rows that are more than keep_days older than the latest."""
    out = frozen(stored, fresh, on)
    latest = out.agg(F.max(on).alias("_last"))
    return out.join(F.broadcast(latest), F.datediff("_last", on) <= keep_days).select(stored.columns)


def changed_entries(listing: DataFrame, manifest: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """The listed files that the manifest lacks or has with other marks (size, time)."""
    old = manifest.select(key, F.struct(*marks).alias("_old"))
    return listing.join(old, key, "left").where(~F.struct(*marks).eqNullSafe(F.col("_old"))).select(listing.columns)


def write_mart(df: DataFrame, path: str, order: list[str], on: str) -> None:
    """df as Parquet in ranges of ``order``, and beside it (path-info) what it holds: rows, first and last day, columns. The table is written first."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    info = stored.agg(F.count("*").alias("n_rows"), F.min(on).cast("string").alias("first"), F.max(on).cast("string").alias("last")).withColumn("columns", F.array(*(F.lit(c) for c in stored.columns)))
    info.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}-info")


def mart_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n_rows long, first string, last string, columns array<string>").json(f"{path.rstrip('/')}-info")


def forgotten(manifest: DataFrame, on: str, first: str, last: str | None = None) -> DataFrame:
    """The manifest without the days from first on (up to last), so that they are fetched again."""
    gone = F.col(on) >= F.lit(first).cast("date")
    return manifest.where(~(gone & (F.col(on) <= F.lit(last).cast("date")) if last else gone))


def readjusted(stored: DataFrame, factors: DataFrame, key: str, on: str, price: str, at: str, factor: str) -> DataFrame:
    """stored with adjusted: the price times all of its key's factors that take effect after its day. One sort of both sides by key and day."""
    shape = stored.select(F.struct("*")).schema[0].dataType
    f = factors.groupBy(F.col(key).alias("_k"), F.col(at).alias("_t")).agg(F.product(F.coalesce(F.col(factor), F.lit(1.0))).alias("_f")).withColumn("_row", F.lit(None).cast(shape))
    rows = stored.select(F.col(key).alias("_k"), F.col(on).alias("_t"), F.lit(1.0).alias("_f"), F.struct("*").alias("_row"))
    later = Window.partitionBy("_k").orderBy(F.col("_t").desc(), F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = f.unionByName(rows).withColumn("_all", F.product("_f").over(later)).where("_row IS NOT NULL")
    return out.select("_row.*", (F.col(f"_row.{price}") * F.col("_all")).alias("adjusted"))
