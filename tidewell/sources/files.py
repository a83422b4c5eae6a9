"""Files as they come: exports with title rows, wide tables, archives, and payloads of which each version was kept."""

from __future__ import annotations

import fnmatch
import gzip
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.session import ship


def titled_csv(spark: SparkSession, path: str, schema: StructType, data_row: str) -> DataFrame:
    """The rows of CSV files that begin with titles: lines that match ``data_row``, by schema; fields that don't parse are null."""
    lines = spark.read.text(path).where(F.col("value").rlike(data_row))
    return lines.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " ")).alias("r")).select("r.*")


def long_series(df: DataFrame, on: str, names: list[str]) -> DataFrame:
    """on, name and value of a wide table's columns, unknown values left out; "-" and empty texts are unknown."""
    value = lambda c: F.regexp_replace(F.trim(F.col(c).cast("string")), ",", "").try_cast("double")
    return df.select(on, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), value(n).alias("value")) for n in names))).alias("s")).select(on, "s.*").where("value IS NOT NULL")


def last_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The parts together, of each key the row of the last part that has it."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.groupBy(*key).agg(F.max_by(F.struct(*(c for c in out.columns if c not in (*key, "_part"))), "_part").alias("_r")).select(*key, "_r.*")


def zipped_csv(spark: SparkSession, path: str, schema: StructType, member: str = "*.csv", encoding: str = "utf-8", separator: str = ",") -> DataFrame:
    """The rows of the CSV members of ZIP archives, with file, member and problem. One archive is one row of a task: archives are small, their number is not.

    A broken archive, or a member that can't be read, gives one row with its problem and nulls, so that nothing is missing unnoticed.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in schema]
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                lost = lambda name, problem, where=where: pd.DataFrame([[None] * len(names)], columns=names, dtype=object).assign(file=where, member=name, problem=problem)
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield lost(None, "broken archive")
                    continue
                for name in sorted(archive.namelist()):
                    if fnmatch.fnmatch(name, member):
                        try:
                            rows = pd.read_csv(io.BytesIO(archive.read(name)), sep=separator, encoding=encoding, dtype=str, keep_default_na=False)
                        except (zipfile.BadZipFile, OSError, ValueError, zlib.error) as problem:
                            yield lost(name, type(problem).__name__)
                            continue
                        for missing in set(names) - set(rows.columns):
                            rows[missing] = None
                        yield rows[names].assign(file=where, member=name, problem=None)

    ship(spark)
    text = StructType().add("file", "string").add("member", "string").add("problem", "string")
    for f in schema:
        text = text.add(f.name, "string")
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, StructType([*text.fields[3:], *text.fields[:3]]))
    return raw.select("file", "member", "problem", *(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))


def gzip_check(spark: SparkSession, path: str) -> DataFrame:
    """file, ok and size (unpacked, null for a broken one) of gzip files, which are read in blocks."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for where, content in zip(batch["path"], batch["content"], strict=True):
                size, ok = 0, True
                try:
                    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
                        while block := f.read(1 << 20):
                            size += len(block)
                except (OSError, EOFError):
                    ok = False
                rows.append((where, ok, size if ok else None))
            yield pd.DataFrame(rows, columns=["file", "ok", "size"]).astype({"size": "Int64"})

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(test, "file string, ok boolean, size long")


def read_days(spark: SparkSession, path: str, first: str, last: str, key: str | None = None, keys: list | None = None, columns: list[str] | None = None) -> DataFrame:
    """Stored days (see sinks.write_days()) from first to last, of some keys and columns: partitions are pruned and the keys pushed down."""
    out = spark.read.parquet(path).where((F.col("date") >= F.lit(first).cast("date")) & (F.col("date") <= F.lit(last).cast("date")))
    if keys is not None:
        out = out.where(F.col(key).isin(*keys))
    return out.select(*columns) if columns else out


def version_spans(versions: DataFrame, key: str, at: str, payload: str, schema: str) -> DataFrame:
    """key, the payload's fields, valid_from and valid_to of each state that a key's versions went through; repeats of a state are one span."""
    parsed = versions.select(key, at, F.from_json(payload, schema).alias("r"))
    by = Window.partitionBy(key).orderBy(at)
    changed = parsed.withColumn("_new", ~F.col("r").eqNullSafe(F.lag("r").over(by)) | (F.row_number().over(by) == 1)).where("_new")
    return changed.select(key, "r.*", F.col(at).alias("valid_from"), F.lead(at).over(by).alias("valid_to"))
