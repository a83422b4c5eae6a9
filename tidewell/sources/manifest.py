"""A table by day whose commits are one log: data is written under a name of its own, and seen once an entry of the log names it.

    path/data/<version>/date=.../part-*.parquet    what commits wrote, seen or not
    path/_log/0000000001.json                      one file for each commit, a row for each of its days

An entry appears by one rename that fails if its number is taken. So a job that dies after it wrote its data and before its entry leaves
the view that was there, of two jobs that commit at once the second takes the next number, and a repeated job replaces its days. What was
fetched, what is confirmed and what is to be fetched again is read off the same log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "seq long, action string, day date, version string, n_rows long, confirmed boolean"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def log(spark: SparkSession, path: str) -> DataFrame:
    """All entries, in no order: seq, action (put or forget), day, version, n_rows, confirmed. None where nothing was committed."""
    files, where = _files(spark, f"{path}/_log")
    return spark.read.schema(SCHEMA).json(f"{path}/_log") if files.exists(where) else spark.createDataFrame([], SCHEMA)


def _append(spark: SparkSession, path: str, entries: DataFrame) -> int:
    """Make entries (action, day, version, n_rows, confirmed) the next commit, and give its number."""
    jvm = spark._jvm.org.apache.hadoop.fs
    files, folder = _files(spark, f"{path}/_log")
    files.mkdirs(folder)
    context = jvm.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)  # without OVERWRITE a rename onto a file fails
    while True:
        names = [int(s.getPath().getName()[:10]) for s in files.listStatus(folder) if s.getPath().getName()[:10].isdigit()]
        seq, stage = max(names, default=0) + 1, f"{path}/_stage/{uuid.uuid4().hex}"
        entries.select(F.lit(seq).alias("seq"), "action", "day", "version", "n_rows", "confirmed").coalesce(1).write.json(stage)
        part = next(s.getPath() for s in files.listStatus(_files(spark, stage)[1]) if s.getPath().getName().startswith("part-"))
        try:
            context.rename(context.makeQualified(part), context.makeQualified(jvm.Path(f"{path}/_log/{seq:010d}.json")), keep)
        except Exception as problem:
            if "FileAlreadyExists" not in str(problem):
                raise
            continue
        finally:
            files.delete(_files(spark, stage)[1], True)
        return seq


def put_days(df: DataFrame, path: str, on: str, order: list[str], days: DataFrame | None = None, today: str | None = None, lag: int = 0) -> int:
    """Commit the days of df, each replacing what is seen of it; those of ``days`` (column day) that df lacks are committed as empty.

    An empty day is confirmed once it is ``lag`` days old on ``today``: before, its rows may still be published. Files are sorted by ``order``. The
    driver handles no rows: the log gets a row for each day by a job of its own.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    rows = df.withColumn("date", F.col(on).cast("date"))
    target = f"{path}/data/{version}"
    rows.repartition("date").sortWithinPartitions("date", *order).write.partitionBy("date").parquet(target)
    written = spark.read.schema(rows.schema).parquet(target).groupBy(F.col("date").alias("day")).agg(F.count("*").alias("n_rows"))
    if days is not None:
        written = written.join(days.select(F.col("day").cast("date")).distinct(), "day", "full")
    n, age = F.coalesce("n_rows", F.lit(0)).cast("long"), F.datediff(F.lit(today).cast("date") if today else F.current_date(), "day")
    return _append(spark, path, written.select(F.lit("put").alias("action"), "day", F.lit(version).alias("version"), n.alias("n_rows"), ((n > 0) | (age >= lag)).alias("confirmed")))


def forget(spark: SparkSession, path: str, first: str, last: str | None = None) -> int:
    """Have the days from first on (up to last) fetched again. They stay seen as they are until then."""
    day = F.col("day")
    gone = current(spark, path).where((day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date") if last else F.lit(True)))
    return _append(spark, path, gone.select(F.lit("forget").alias("action"), "day", "version", "n_rows", F.lit(False).alias("confirmed")))


def current(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """day, version, n_rows, confirmed, seq: the last word of the log on each day, as of commit ``upto`` if given."""
    rows = log(spark, path)
    rows = rows if upto is None else rows.where(F.col("seq") <= upto)
    last = F.row_number().over(Window.partitionBy("day").orderBy(F.col("seq").desc()))
    return rows.withColumn("_p", last).where("_p = 1").select("day", "version", "n_rows", "confirmed", "seq")


def view(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """The table as committed (or as of a commit): column date and those of the schema. Only the days' own folders are read, whose names the driver lists."""
    seen = current(spark, path, upto).where("n_rows > 0").select("day", "version").collect()  # a row a day
    if not seen:
        return spark.createDataFrame([], f"{schema}, date date")
    rows = None
    for version in sorted({r.version for r in seen}):
        days = sorted(r.day.isoformat() for r in seen if r.version == version)
        part = spark.read.schema(schema).option("basePath", f"{path}/data/{version}").parquet(*(f"{path}/data/{version}/date={d}" for d in days)).withColumn("date", F.col("date").cast("date"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def to_fetch(spark: SparkSession, path: str, calendar: DataFrame) -> DataFrame:
    """The days of a calendar (column day) that the log lacks, or has as not confirmed or forgotten, in order."""
    done = current(spark, path).where("confirmed").select("day")
    return calendar.select(F.col("day").cast("date")).distinct().join(done, "day", "left_anti").orderBy("day")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete what no commit names, of jobs that died, and give the versions' names. Not while a commit is under way."""
    files, folder = _files(spark, f"{path}/data")
    named = {r.version for r in log(spark, path).select("version").distinct().collect()}  # a row a commit
    gone = [s.getPath().getName() for s in (files.listStatus(folder) if files.exists(folder) else []) if s.getPath().getName() not in named]
    for name in gone:
        files.delete(_files(spark, f"{path}/data/{name}")[1], True)
    return sorted(gone)
