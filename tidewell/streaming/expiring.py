"""State that expires by event time: the live total of what each of a key's holders last reported, given out when it changes."""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a key's holders that are kept together.
PARTS = 16


def _processor(life: int, least: float, parts: int) -> StatefulProcessor:
    """A class of its own for each stream: it goes to the workers by value, some of which run outside of any task and lack this package."""

    def rows_of(rows: list[tuple]) -> pd.DataFrame:
        keys, at, totals, holders = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pd.DataFrame({"key": pd.Series(keys, dtype=object), "at": pd.Series(at, dtype="int64"), "total": pd.Series(totals, dtype="float64"), "holders": pd.Series(holders, dtype="int64")})

    class Live(StatefulProcessor):
        """Reports wait for the watermark at their own time, so that they are taken in the order of event time, whatever order they came in.

        Holders are dealt by hash into a fixed number of parts, and state holds a part's reports together, of one time or live: a trip to the state store
        for each part, not for each holder, and memory for a part at a time.
        """

        def __init__(self, life: int, least: float):
            self.life, self.least = life, least

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getMapState("waiting", "at long, part int", "packed binary")
            self.live = handle.getMapState("live", "part int", "packed binary")

        def held(self, state: object, place: tuple) -> dict:
            return pickle.loads(bytes(state.getValue(place)[0])) if state.containsKey(place) else {}

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            best: dict[tuple[int, int], dict[str, tuple[float, int]]] = {}
            for table in rows:
                for at, holder, value, number in zip(table["at"].tolist(), table["holder"].tolist(), table["value"].tolist(), table["number"].tolist(), strict=True):
                    reports = best.setdefault((at, zlib.crc32(holder.encode()) % parts), {})
                    if holder not in reports or reports[holder][1] <= number:
                        reports[holder] = (value, number)
            for place, reports in best.items():
                kept = self.held(self.waiting, place)
                for holder, report in reports.items():
                    if holder not in kept or kept[holder][1] <= report[1]:
                        kept[holder] = report
                self.waiting.updateValue(place, (pickle.dumps(kept),))
            for at in {at for at, _ in best}:  # a timer that is set while timers fire waits for the next trigger: both are set here
                self.handle.registerTimer(at)
                self.handle.registerTimer(at + self.life)
            yield rows_of([])

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
            now, totals, holders = expiredTimerInfo.getExpiryTimeInMs(), [], 0
            for part in range(parts):
                live, due = self.held(self.live, (part,)), self.held(self.waiting, (now, part))
                left = {h: v for h, v in live.items() if v[1] > now and h not in due} | {h: (value, now + self.life) for h, (value, _) in due.items()}
                if due:
                    self.waiting.removeKey((now, part))
                if left and (due or len(left) < len(live)):
                    self.live.updateValue((part,), (pickle.dumps(left),))
                elif live and not left:
                    self.live.removeKey((part,))
                counted = [value for value, _ in left.values() if value >= self.least]
                totals.append(math.fsum(counted))
                holders += len(counted)
            yield rows_of([(key[0], now, math.fsum(totals), holders)])

        def close(self) -> None:
            pass

    return Live(life, least)


def live_totals(reports: DataFrame, key: str, holder: str, ts: str, value: str, number: str, days: int, least: float = 0.0, late: str = "1 day") -> DataFrame:
    """key, at, total and holders: at each time that a report takes effect or expires, the sum of the last reports of all holders, and their number.

    A report counts from its time on until the holder's next one, ``days`` at most; one under ``least`` counts nothing (a position that was closed). Of
    several of one holder and time the one with the largest number counts. Reports are taken in the order of their times once the watermark,
    ``late`` behind the latest, has passed: what comes later than that is dropped by Spark and counted in its progress. State
    holds waiting reports and each holder's last, and a holder that expired is removed, so that it does not grow with the stream's age.
    """
    spark = reports.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = reports.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_millis(F.col(ts)).alias("at"), F.coalesce(F.col(holder).cast("string"), F.lit("")).alias("holder"), F.col(value).cast("double").alias("value"), F.col(number).cast("long").alias("number")).withWatermark("ts", late)
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(_processor(days * 86_400_000, least, PARTS), f"key {kind}, at long, total double, holders long", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_millis("at").alias("at"), "total", "holders")
