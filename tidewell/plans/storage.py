"""Queries that store and read again, of payload versions and streams, with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import describe
from tidewell.plans import bars_sql as sql
from tidewell.plans.choices import _CANDIDATES, candidates
from tidewell.session import shared_folder
from tidewell.sources import files, manifest, sinks
from tidewell.sources.tables import daily_bars, table
from tidewell.streaming import expiring
from tidewell.streaming import ticks as streams


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(table(spark, sf_dir, "lineitem"))


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidewell-{name}-{uuid.uuid4().hex}"


def mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "mart")
    sinks.write_mart(_bars(spark, sf_dir), path, ["day", "code"], "day")
    return sinks.mart_info(spark, path).select("n_rows", "first", "last", F.size("columns").cast("long").alias("n_columns"))


def days_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "read")
    sinks.write_days(table(spark, sf_dir, "events"), path, "ts", ["user_id", "ts", "event_id"])
    return files.read_days(spark, path, "2024-01-05", "2024-01-09", "user_id", [3, 8, 21], ["date", "user_id", "event_id", "value"])


def forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = candidates(spark, sf_dir).select("day").distinct()
    return sinks.forgotten(manifest, "day", "1999-03-01", "1999-06-30")


def readjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).select("code", "day", "c")
    f = b.where("day(day) = 17").select("code", F.date_add("day", 1).alias("at"), F.when(F.month("day") % 2 == 0, 0.5).otherwise(2.0).alias("factor"))
    return sinks.readjusted(b, f, "code", "day", "c", "at", "factor")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of each user's payload by kind of event, in the order of time."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.to_json(F.struct((F.get_json_object("props", "$.k").cast("int") % 2).alias("odd"), F.col("event_type").alias("kind"))).alias("payload"))
    out = files.version_spans(e, "user_id", "at", "payload", "odd int, kind string")
    return out.select("user_id", "odd", "kind", F.col("valid_from.event_id").alias("first_event"), F.col("valid_to.event_id").alias("next_event"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = candidates(spark, sf_dir).select("id", F.format_number("score", 2).alias("score"), F.when(F.col("p3").isNull(), "-").otherwise(F.col("p3").cast("string")).alias("third"))
    return files.long_series(wide, "id", ["score", "third"])


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    per = lambda d: d.groupBy("day").agg(F.max("score").alias("x"))
    return files.last_wins([per(c), per(c.where("p1 > 60")), per(c.where("p2 > 80"))], ["day"])


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to evaluate on: all, and those whose added figure exists, by group."""
    c = candidates(spark, sf_dir)
    have = c.where("p3 IS NOT NULL AND p1 > 50").select("id")
    every, some = c.groupBy("grp").agg(F.count("*").alias("n_all")), c.join(have, "id", "left_semi").groupBy("grp").agg(F.count("*").alias("n_covered"))
    return every.join(some, "grp", "left")


def pivot_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last score of each group by day, on all sessions."""
    c = candidates(spark, sf_dir)
    names = ["1-URGENT", "2-HIGH", "5-LOW"]
    per = c.groupBy("day").pivot("grp", names).agg(F.max_by("score", "id"))
    return c.select("day").distinct().join(per, "day", "left").select("day", *(F.col(f"`{n}`").alias(f"v{n[0]}") for n in names))


def unstacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).select("day", (F.col("code") % 3).cast("string").alias("g"), F.col("v").cast("decimal(18,2)").alias("v"))
    out = describe.pivoted(b, "day", "g", "v", ["0", "1", "2"])
    return out.select("day", *(F.col(f"`{i}`").cast("double").alias(f"g{i}") for i in range(3)))


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "latest")
    stream = streams.tick_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    streams.upsert_available(stream, ["user_id", "event_type"], ["ts", "event_id"], f"{path}/rows", f"{path}/state")
    return streams.merged_versions(spark, f"{path}/rows", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def stream_cooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "cooled")
    stream = streams.tick_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    streams.run_available(streams.stream_cooldown(stream.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 86400), f"{path}/rows", f"{path}/state")
    return spark.read.parquet(f"{path}/rows").select("user_id", "event_id")


def stream_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live total of each kind of event, over what each user last reported within ten days, at each time that it changed, as a stream gives it out."""
    path = f"{shared_folder(spark)}/tidewell-stream-{uuid.uuid4().hex}"
    stream = streams.tick_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    stream = stream.withColumns({"day": F.date_trunc("day", "ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("double")})
    streams.run_available(expiring.live_totals(stream, "event_type", "user_id", "day", "k", "event_id", 10, 20.0), f"{path}/rows", f"{path}/state")
    return spark.read.parquet(f"{path}/rows").select("event_type", F.col("at").cast("date").alias("day"), "total", "holders")


_TIMELINE = """
WITH r AS (SELECT event_type, user_id, ts::DATE AS d, arg_max(json_extract(props, '$.k')::DOUBLE, event_id) AS k FROM events GROUP BY ALL),
u AS (SELECT *, least(lead(d) OVER (PARTITION BY event_type, user_id ORDER BY d), d + 10) AS until FROM r),
t AS (SELECT DISTINCT event_type, unnest([d, d + 10]) AS day FROM r)
SELECT t.event_type, t.day, coalesce(sum(k) FILTER (WHERE k >= 20), 0)::DOUBLE AS total, count(*) FILTER (WHERE k >= 20) AS holders
FROM t LEFT JOIN u ON u.event_type = t.event_type AND u.d <= t.day AND coalesce(u.until, u.d + 10) > t.day
WHERE t.day <= (SELECT max(ts)::DATE - 1 FROM events) GROUP BY ALL"""


def committed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events committed by day in three steps, the last of which replaces some days, and what is to be fetched after some were forgotten."""
    path = f"{shared_folder(spark)}/tidewell-manifest-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    calendar = spark.range(40).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    manifest.put_days(e.where("day < '2024-01-16'").drop("day"), path, "ts", ["user_id", "ts", "event_id"])
    manifest.put_days(e.where("day >= '2024-01-16'").drop("day"), path, "ts", ["user_id", "ts", "event_id"], calendar.where("day >= '2024-01-16'"), "2024-02-09", 3)
    manifest.put_days(e.where("day BETWEEN '2024-01-05' AND '2024-01-07' AND event_type = 'click'").drop("day"), path, "ts", ["user_id", "ts", "event_id"])
    manifest.forget(spark, path, "2024-01-10", "2024-01-12")
    seen = manifest.view(spark, path, table(spark, sf_dir, "events").schema.simpleString()[7:-1].replace(":", " ")).groupBy(F.col("date").alias("day")).agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_keys"), F.sum("event_id").alias("ids"))
    again = manifest.to_fetch(spark, path, calendar).withColumn("again", F.lit(True))
    return calendar.join(seen, "day", "left").join(again, "day", "left").select("day", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.coalesce("n_keys", F.lit(0)).cast("long").alias("n_keys"), "ids", F.coalesce("again", F.lit(False)).alias("again"))


_COMMITTED = """
WITH c AS (SELECT (DATE '2024-01-01' + i::INTEGER)::DATE AS day FROM range(40) v(i)),
e AS (SELECT ts::DATE AS day, * FROM events WHERE ts::DATE NOT BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' OR event_type = 'click'),
g AS (SELECT day, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys, sum(event_id)::BIGINT AS ids FROM e GROUP BY day)
SELECT day, coalesce(n_rows, 0) AS n_rows, coalesce(n_keys, 0) AS n_keys, ids, (day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') OR (n_rows IS NULL AND DATE '2024-02-09' - day < 3) AS again FROM c LEFT JOIN g USING (day)"""


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live total of each user at the end of January, of positions that expire after ten days."""
    path = _path(spark, "live")
    stream = streams.tick_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    streams.run_available(streams.stream_live(stream.withColumn("k", F.get_json_object("props", "$.k").cast("long")), "user_id", "ts", "k", 10), f"{path}/rows", f"{path}/state")
    return spark.read.parquet(f"{path}/rows").where("day <= DATE '2024-01-25'").groupBy("user_id").agg(F.sum("change").alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "stream_live_timeline": stream_timeline, "committed_days": committed_days,
        "mart_info": mart, "stored_days_read": days_read, "forgotten_days": forgotten, "store_readjusted": readjusted, "version_spans": spans, "long_series": series, "last_part_wins": merged, "evaluation_keys": covered, "pivot_last": pivot_last, "unstacked_groups": unstacked, "stream_latest": stream_latest, "stream_cooldown": stream_cooled, "stream_live_totals": stream_totals,
    }


def oracle_sql() -> dict[str, str]:
    c = f"WITH {_CANDIDATES}"
    return {
        "mart_info": f"WITH {sql.BARS} SELECT count(*) AS n_rows, min(day)::VARCHAR AS first, max(day)::VARCHAR AS last, 8::BIGINT AS n_columns FROM bars",
        "stored_days_read": "SELECT ts::DATE AS date, user_id, event_id, value FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' AND user_id IN (3, 8, 21)",
        "forgotten_days": f"{c} SELECT DISTINCT day FROM c WHERE day < DATE '1999-03-01' OR day > DATE '1999-06-30'",
        "store_readjusted": f"WITH {sql.BARS}, f AS (SELECT code, day + 1 AS t, CASE WHEN month(day) % 2 = 0 THEN 0.5 ELSE 2.0 END::DOUBLE AS f FROM bars WHERE day(day) = 17) SELECT code, day, c, c * coalesce((SELECT product(f) FROM f WHERE f.code = bars.code AND f.t > bars.day), 1) AS adjusted FROM bars",
        "version_spans": "WITH e AS (SELECT user_id, ts, event_id, json_extract(props, '$.k')::INTEGER % 2 AS odd, event_type AS kind FROM events), l AS (SELECT *, lag((odd, kind)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM e), k AS (SELECT * FROM l WHERE b IS NULL OR b <> (odd, kind)) SELECT user_id, odd, kind, event_id AS first_event, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM k",
        "long_series": f"{c} SELECT id, 'score' AS name, round(score, 2) AS value FROM c UNION ALL SELECT id, 'third', p3 FROM c WHERE p3 IS NOT NULL",
        "last_part_wins": f"{c} SELECT day, coalesce(max(score) FILTER (WHERE p2 > 80), max(score) FILTER (WHERE p1 > 60), max(score)) AS x FROM c GROUP BY day",
        "evaluation_keys": f"{c} SELECT grp, count(*) AS n_all, nullif(count(*) FILTER (WHERE p3 IS NOT NULL AND p1 > 50), 0) AS n_covered FROM c GROUP BY grp",
        "pivot_last": f"{c} SELECT day, " + ", ".join(f"arg_max(score, id) FILTER (WHERE grp = '{n}') AS v{n[0]}" for n in ("1-URGENT", "2-HIGH", "5-LOW")) + " FROM c GROUP BY day",
        "unstacked_groups": f"WITH {sql.BARS} SELECT day, " + ", ".join(f"sum(v) FILTER (WHERE code % 3 = {i}) AS g{i}" for i in range(3)) + " FROM bars GROUP BY day",
        "stream_live_timeline": _TIMELINE, "committed_days": _COMMITTED,
        "stream_latest": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
        "stream_cooldown": "WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, event_id, i, ts AS last, true AS ok FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.ts - r.last >= INTERVAL 1 DAY THEN e.ts ELSE r.last END, e.ts - r.last >= INTERVAL 1 DAY FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id FROM r WHERE ok",
        "stream_live_totals": "SELECT user_id, (sum(k) FILTER (WHERE d <= DATE '2024-01-25') - coalesce(sum(k) FILTER (WHERE d + 10 <= DATE '2024-01-25'), 0))::BIGINT AS total FROM (SELECT user_id, ts::DATE AS d, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY user_id HAVING min(d) <= DATE '2024-01-25'",
    }
