"""Similar past cases: of those whose outcome was complete before a day, the ones with the nearest shape, and what came of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.compare import pair_scale
from tidewell.operators.similar import Best, matrix, scan_tiles
from tidewell.session import shared_folder, ship

#: Bytes of query vectors that are broadcast at once.
BLOCK_BYTES = 8 << 20


def _best_before(sent: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, gates, q = sent.value
        best = Best(len(q), k)
        for batch in batches:
            if batch.num_rows and len(q):
                ids, done = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                order = np.argsort(done, kind="stable")  # with queries in the order of their days, tiles that are all too late pass by
                barred = lambda lo, hi, a, b, done=done[order]: gates[lo:hi, None] <= done[None, a:b]
                scan_tiles(best, q, matrix(batch.column(2))[order], ids[order], "absolute", barred)
        yield best.batch(asked)

    return scan


def nearest_before(pool: DataFrame, queries: DataFrame, id_col: str, done: str, day: str, vector: str, k: int) -> DataFrame:
    """query_id, id, distance and place: of the pool's rows whose ``done`` is before a query's ``day``, the k nearest by the sum of absolute differences.

    Queries meet the pool in blocks of BLOCK_BYTES, each broadcast for itself and released. A task keeps the k best of each query, so that what is shuffled
    grows with queries and tasks, not with the pool. Ties go by id. Rows with a null vector or date are left out.
    """
    spark = pool.sparkSession
    shared_folder(spark)
    ship(spark)
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01")).cast("long")
    known = pool.where(F.col(vector).isNotNull() & F.col(done).isNotNull()).select(F.col(id_col).cast("long"), number(done), F.col(vector).cast("array<double>"))
    queries = queries.where(F.col(vector).isNotNull() & F.col(day).isNotNull()).select(F.col(id_col).cast("long").alias("_q"), number(day).alias("_d"), F.col(vector).cast("array<double>").alias("_v"))
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("width")).first()
    blocks, out = -(-size.n * (size.width or 1) * 8 // BLOCK_BYTES), spark.createDataFrame([], "query_id long, id long, distance double, place int")
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == i).toArrow().sort_by("_d").combine_chunks()
        sent = spark.sparkContext.broadcast((rows["_q"].to_numpy(), rows["_d"].to_numpy(), matrix(rows["_v"].combine_chunks())))
        found = known.mapInArrow(_best_before(sent, k), "query_id long, id long, distance double")
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("place") <= k).checkpoint()
        sent.destroy()
        out = out.union(found)
    return out


def _scaled(shape: str, flow: str, scales: tuple[float, float]) -> Column:
    """One vector whose sum of absolute differences is the sum of both mean differences, each on its scale."""
    part = lambda c, s: F.transform(c, lambda x: x / (F.size(c) * F.lit(s)))
    return F.concat(part(shape, scales[0]), part(flow, scales[1]))


def similar_cases(cases: DataFrame, candidates: DataFrame, days: DataFrame, id_col: str, day: str, done: str, shape: str, flow: str, outcome: str, hit: str, k: int = 50, least: int = 300, pairs: int = 20_000, bad: float = -10.0) -> DataFrame:
    """What came of the past cases most like each candidate: a row for each, and one without an id for a day that has none or too small a pool.

    Columns: day, status (ok, no_candidates, pool_small), n_pool (cases complete before the day), id, n, p10, p25, p50, p75, p90 (of outcome), hit_share
    and bad_share in percent, shape_distance and flow_distance (means over the neighbours). cases: id, done (when the outcome was complete,
    null: never), shape and flow (sorted values, as quantile vectors are), outcome, hit. candidates: id, day, shape and flow. days: day.

    Distance is the mean difference of the shapes plus that of the flows, each on its scale: the median distance of pairs of cases that
    were complete before the first day (pair_scale(); 1 without one), so that no day's scale knows what came later. Cases or
    candidates without both vectors are left out.
    """
    both = F.col(shape).isNotNull() & F.col(flow).isNotNull()
    shared_folder(cases.sparkSession)
    pool = cases.where(both & F.col(done).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(done).alias("_done"), F.col(shape).alias("_shape"), F.col(flow).alias("_flow"), F.col(outcome).alias("_y"), F.col(hit).alias("_hit")).checkpoint()
    days = days.select(F.col(day).alias("day")).distinct()
    first = days.agg(F.min("day")).first()[0]
    base = pool.where(F.col("_done") < F.lit(first))
    scales = tuple((pair_scale(base, "_id", v, pairs, seed).first().scale or 1.0) for seed, v in enumerate(("_shape", "_flow")))
    asked = candidates.where(both).select(F.col(id_col).cast("long").alias("_id"), F.col(day).alias("_day"), F.col(shape).alias("_shape"), F.col(flow).alias("_flow"))
    asked = asked.join(days.select(F.col("day").alias("_day")), "_day", "left_semi").checkpoint()
    # one row a day: how many cases were complete before
    dated = pool.groupBy(F.col("_done").alias("day")).agg(F.count("*").alias("_n")).join(days.withColumn("_asked", F.lit(True)), "day", "full")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dated.withColumn("n_pool", before).where("_asked").select("day", "n_pool").join(asked.groupBy(F.col("_day").alias("day")).agg(F.count("*").alias("_c")), "day", "left")
    status = F.when(F.col("_c").isNull(), "no_candidates").when(F.col("n_pool") < least, "pool_small").otherwise("ok")
    counts = counts.select("day", status.alias("status"), "n_pool").checkpoint()
    ready = asked.join(F.broadcast(counts.where("status = 'ok'").select(F.col("day").alias("_day"))), "_day").checkpoint()
    found = nearest_before(pool.select("_id", "_done", _scaled("_shape", "_flow", scales).alias("_v")), ready.select("_id", "_day", _scaled("_shape", "_flow", scales).alias("_v")), "_id", "_done", "_day", "_v", k)
    gap = lambda a, b, s: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x) / F.size(a) / F.lit(s)
    near = found.join(pool.select(F.col("_id").alias("id"), "_y", "_hit", F.col("_shape").alias("_s"), F.col("_flow").alias("_f")), "id").join(ready.withColumnRenamed("_id", "query_id"), "query_id")
    points = F.percentile("_y", [0.1, 0.25, 0.5, 0.75, 0.9])  # of k values
    rows = near.groupBy("query_id", "_day").agg(F.count("*").alias("n"), points.alias("_p"), (F.avg(F.col("_hit").cast("double")) * 100).alias("hit_share"), (F.avg((F.col("_y") < bad).cast("double")) * 100).alias("bad_share"), F.avg(gap("_shape", "_s", scales[0])).alias("shape_distance"), F.avg(gap("_flow", "_f", scales[1])).alias("flow_distance"))
    named = [F.get("_p", F.lit(i)).alias(name) for i, name in enumerate(("p10", "p25", "p50", "p75", "p90"))]
    rows = rows.select(F.col("_day").alias("day"), F.col("query_id").alias("id"), "n", *named, "hit_share", "bad_share", "shape_distance", "flow_distance")
    return counts.join(rows, "day", "left").select("day", "status", "n_pool", *(c for c in rows.columns if c != "day"))
