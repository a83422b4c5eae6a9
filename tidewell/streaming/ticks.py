"""Streams of ticks: bars, gaps between a key's events, and an idempotent keyed sink. These extend the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def tick_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_bars(ticks: DataFrame, key: str, ts: str, price: Column, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars by tumbling windows; a window is given out once the watermark has passed it."""
    t = ticks.withWatermark(ts, late).withColumn("_p", price)
    return t.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.min("_p").alias("low"), F.max("_p").alias("high"), F.sum("_p").alias("total")).select(F.col("window.start").alias("at"), key, "n", "low", "high", "total")


def stream_sessions(ticks: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return ticks.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there as Parquet and stop; a rerun goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def upsert_available(stream: DataFrame, key: list[str], order: list[str], path: str, checkpoint: str) -> None:
    """Keep the latest row of each key of a stream: each batch is written under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_versions(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The current view of what upsert_available() wrote: of each key the latest version of all batches, however late it came."""
    rows = spark.read.parquet(path).drop("batch")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in key)), F.struct(*order)).alias("r")).select(*key, "r.*")


def stream_cooldown(ticks: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """The events of a stream that are at least ``seconds`` after the last one given out of their key; the state is that event's time.

    Events of one trigger are taken in their order; one that comes later than an event already given out counts by its own time.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values([ts, tie], kind="stable")
        keep = []
        for at in rows[ts].astype("datetime64[us]").astype("int64").tolist():
            ok = last is None or at - last >= seconds * 1_000_000
            last = at if ok else last
            keep.append(ok)
        state.update((last,))
        yield rows[keep]

    return ticks.groupBy(key).applyInPandasWithState(step, ticks.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def stream_live(changes: DataFrame, key: str, ts: str, value: str, days: int) -> DataFrame:
    """Of a stream of positions the changes to their total: each counts from its day on and expires ``days`` later. Sum these up to a day for the total."""
    start = changes.select(key, F.col(ts).cast("date").alias("day"), F.col(value).alias("change"))
    end = changes.select(key, F.date_add(F.col(ts).cast("date"), days).alias("day"), (-F.col(value)).alias("change"))
    return start.union(end)
