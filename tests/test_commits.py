"""Commits that fail between data and log, two at once, what is seen and fetched again; and live totals that expire, over restarts and late rows."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.sources import manifest
from tidewell.streaming import expiring, ticks

SCHEMA = "k int, ts timestamp, x int"


def rows(spark, days, x):
    return spark.createDataFrame([(k, datetime(2024, 1, d, 5), x) for d in days for k in range(3)], SCHEMA)


def seen(spark, path, upto=None):
    return {(r.date.day, r.x): r.n for r in manifest.view(spark, path, SCHEMA, upto).groupBy("date", "x").agg(F.count("*").alias("n")).collect()}


def test_a_commit_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    assert seen(spark, path) == {} and manifest.to_fetch(spark, path, spark.createDataFrame([(date(2024, 1, 1),)], "day date")).count() == 1
    assert manifest.put_days(rows(spark, [1, 2], 0), path, "ts", ["k"]) == 1
    with monkeypatch.context() as m:
        m.setattr(manifest, "_append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            manifest.put_days(rows(spark, [2, 3], 1), path, "ts", ["k"])
    assert seen(spark, path) == {(1, 0): 3, (2, 0): 3}
    assert len(manifest.vacuum(spark, path)) == 1 and manifest.vacuum(spark, path) == []
    assert manifest.put_days(rows(spark, [2, 3], 1), path, "ts", ["k"]) == 2
    assert seen(spark, path) == {(1, 0): 3, (2, 1): 3, (3, 1): 3}
    assert seen(spark, path, upto=1) == {(1, 0): 3, (2, 0): 3}


def test_two_commits_at_once(spark, tmp_path):
    """The number that a commit chose is taken when it comes to rename: it takes the next."""
    path = f"file://{tmp_path}/t"
    manifest.put_days(rows(spark, [1], 0), path, "ts", ["k"])
    entries = manifest.current(spark, path).select(F.lit("put").alias("action"), "day", "version", "n_rows", "confirmed")
    files = manifest._files

    def race(s, where):
        if where.startswith(f"{path}/_stage") and not (tmp_path / "t/_log/0000000002.json").exists():
            (tmp_path / "t/_log/0000000002.json").write_text('{"seq":2,"action":"put","day":"2024-01-09","version":"other","n_rows":0,"confirmed":true}\n')
        return files(s, where)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(manifest, "_files", race)
        assert manifest._append(spark, path, entries) == 3
    assert sorted(r.seq for r in manifest.log(spark, path).collect()) == [1, 2, 3]


def test_empty_days_wait_for_publication(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    calendar = spark.createDataFrame([(date(2024, 1, d),) for d in range(1, 7)], "day date")
    manifest.put_days(rows(spark, [1, 3], 0), path, "ts", ["k"], calendar.where("day <= '2024-01-05'"), "2024-01-06", 3)
    todo = lambda: [r.day.day for r in manifest.to_fetch(spark, path, calendar).collect()]
    assert todo() == [4, 5, 6]
    manifest.forget(spark, path, "2024-01-01", "2024-01-02")
    assert todo() == [1, 2, 4, 5, 6] and seen(spark, path) == {(1, 0): 3, (3, 0): 3}
    manifest.put_days(rows(spark, [1], 7), path, "ts", ["k"])
    assert todo() == [2, 4, 5, 6] and seen(spark, path) == {(1, 7): 3, (3, 0): 3}


REPORTS = "key string, holder string, ts timestamp, value double, number long"


def timeline(reports, days, least, upto):
    """(key, day) to the total and the number of holders at each time that something takes effect or expires."""
    last = {}
    for key, holder, day, value, number in reports:
        if (key, holder, day) not in last or last[key, holder, day][1] <= number:
            last[key, holder, day] = (value, number)
    out = {}
    for key in {k for k, _, _ in last}:
        for at in sorted({d + e for k, _, d in last if k == key for e in (0, days)}):
            live = {}
            for (k, holder, day), (value, _) in sorted(last.items()):
                if k == key and day <= at:
                    live[holder] = (value, day + days)
            counted = [v for v, until in live.values() if until > at and v >= least]
            if at <= upto:
                out[key, at] = (sum(counted), len(counted))
    return out


def test_live_totals_over_restarts_and_late_rows(spark, tmp_path):
    """Three runs over files as they come, from one checkpoint; a report behind the watermark is dropped, one within it is taken in its place."""
    start = datetime(2024, 1, 1)
    parts = [
        [("a", "x", 0, 5.0, 1), ("a", "y", 1, 7.0, 2), ("b", "x", 2, 1.0, 3), ("a", "x", 4, 6.0, 4), ("a", "x", 4, 8.0, 5)],
        [("a", "y", 3, 9.0, 6), ("a", "z", 9, 0.5, 7), ("b", "y", 8, 2.0, 8)],
        [("a", "late", 1, 100.0, 9), ("b", "x", 20, 3.0, 10), ("a", "x", 22, 4.0, 11)],
    ]
    got = {}
    for part in parts:
        df = spark.createDataFrame([(k, h, start + timedelta(d), v, n) for k, h, d, v, n in part], REPORTS)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ticks.tick_stream(spark, f"{tmp_path}/in", df.schema)
        ticks.run_available(expiring.live_totals(stream, "key", "holder", "ts", "value", "number", 6, 1.0, "2 days"), f"{tmp_path}/out", f"{tmp_path}/state")
        got = {(r["key"], (r["at"] - start).days): (r.total, r.holders) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    kept = [r for part in parts for r in part if r[1] != "late"]
    assert got == timeline(kept, 6, 1.0, 20) and len(got) > 10


def test_live_totals_take_parts_of_state(spark):
    """State is read and written by parts of holders, not by holder."""
    trips = []

    class Held(dict):
        def containsKey(self, k):
            return trips.append(k) or k in self

        def getValue(self, k):
            return trips.append(k) or self[k]

        def updateValue(self, k, v):
            trips.append(k)
            self[k] = v

        def removeKey(self, k):
            trips.append(k)
            del self[k]

    timers = set()
    handle = type("Handle", (), {"getMapState": lambda self, *a: Held(), "registerTimer": lambda self, at: timers.add(at)})()
    live = expiring._processor(10, 2.0, 4)
    live.init(handle)
    rows = pd.DataFrame({"at": [i % 3 for i in range(6000)], "holder": [f"h{i % 1000}" for i in range(6000)], "value": [float(i % 5) for i in range(6000)], "number": range(6000)})
    list(live.handleInputRows(("k",), iter([rows[:2500], rows[2500:]]), None))
    got = {at: next(live.handleExpiredTimer(("k",), None, type("Info", (), {"getExpiryTimeInMs": lambda self, at=at: at})())).iloc[0] for at in sorted(timers)}
    assert sorted(got) == [0, 1, 2, 10, 11, 12] and len(trips) < 200
    last: dict[str, tuple[int, float]] = {}
    for at in got:
        last |= {r.holder: (at, r.value) for r in rows[rows["at"] == at].itertuples()}
        counted = [v for since, v in last.values() if since + 10 > at and v >= 2.0]
        assert (got[at]["total"], got[at]["holders"]) == (sum(counted), len(counted))
