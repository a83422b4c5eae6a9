"""Distances between vectors: nearest neighbours of a stated query set, and Wasserstein distances of sorted values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import shared_folder, ship

#: Bytes of query vectors that one block has at most: each block is broadcast by itself.
BLOCK_BYTES = 8 << 20
#: Queries and rows of a tile, and pairs whose exact distances are held at once.
QUERIES, ROWS, PAIRS = 256, 1024, 1 << 14


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def wasserstein(a: Column, b: Column) -> Column:
    """Mean distance of the sorted values of two vectors of one length."""
    return F.aggregate(F.zip_with(F.array_sort(a), F.array_sort(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _distances(x: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    """The exact distance of each row of x and the row of q beside it."""
    far = (x - q) ** 2 if kind == "squared" else np.abs(x - q)
    return far.mean(-1) if kind == "wasserstein" else far.sum(-1)


def _rough(x: np.ndarray, q: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All distances between the rows of q and of x up to rounding, and for each row of q what that may come to."""
    with np.errstate(all="ignore"):  # rows that aren't finite are at no distance
        size = [(v * v if kind == "squared" else np.abs(v)).sum(1) for v in (q, x)]
        reach = size[0] + size[1][np.isfinite(size[1])].max(initial=0.0)
        if kind == "squared":
            return size[0][:, None] - 2 * (q @ x.T) + size[1][None, :], 1e-15 * (q.shape[1] + 8) * reach
        small = np.nanmax(reach, initial=0.0) < 1e30  # else too large for numbers of 32 bits
        x, q = (np.ascontiguousarray(v.T, np.float32 if small else np.float64) for v in (x, q))
        out, step = (np.zeros((q.shape[1], x.shape[1]), x.dtype) for _ in range(2))
        for mine, other in zip(q, x, strict=True):
            np.subtract(mine[:, None], other[None, :], out=step)
            out += np.abs(step, out=step)
        share = len(x) if kind == "wasserstein" else 1
        return out / x.dtype.type(share), (1.2e-7 if small else 1e-15) * (len(x) + 8) * reach / share


def nearest(pool: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, distance: str = "squared", apart: int = 0) -> DataFrame:
    """query_id, id, distance and place of the k nearest rows of pool for each row of queries, other than those within ``apart`` ids.

    The query set is stated and meets the pool in blocks of BLOCK_BYTES, each broadcast by itself and released. A task scores its part of the pool in
    tiles (squared distances by one matrix product, those that may be among the best again exactly) and keeps the k best of each query; so
    what is shuffled grows with the queries and the tasks, not with the pool. Ties go by id. Rows with a null vector are left out.
    """
    spark = pool.sparkSession
    shared_folder(spark)
    ship(spark)
    queries, pool = (df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")) for df in (queries, pool))
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("width")).first()
    blocks, out = -(-size.n * (size.width or 1) * 8 // BLOCK_BYTES), spark.createDataFrame([], "query_id long, id long, distance double, place int")
    for i in range(blocks):
        block = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == i)).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((block["_id"].to_numpy(), matrix(block["_v"].combine_chunks())))
        found = pool.mapInArrow(_best_of(sent, k, distance, apart), "query_id long, id long, distance double")
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("place") <= k).checkpoint()
        sent.destroy()
        out = found if i == 0 else out.union(found)
    return out


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), len(flat) // max(1, len(vectors)))


class Best:
    """The k best of each query so far: distances and ids, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.far, self.ids = k, np.full((n, k), np.inf), np.full((n, k), -1, np.int64)

    def put(self, lo: int, hi: int, q: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        """More for the queries lo to hi: of query q (counted from lo) the row ids at distance far."""
        have, places = np.nonzero(np.isfinite(self.far[lo:hi]))
        q, far, ids = np.r_[have, q], np.r_[self.far[lo:hi][have, places], far], np.r_[self.ids[lo:hi][have, places], ids]
        order = np.lexsort((ids, far, q))
        q, far, ids = q[order], far[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(hi - lo))[q]
        kept = place < self.k
        self.far[lo + q[kept], place[kept]], self.ids[lo + q[kept], place[kept]] = far[kept], ids[kept]

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.far))
        return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(self.ids[i, j]), pa.array(self.far[i, j])], names=["query_id", "id", "distance"])


def scan_tiles(best: Best, q: np.ndarray, x: np.ndarray, ids: np.ndarray, kind: str, barred: Callable[[int, int, int, int], np.ndarray]) -> None:
    """Put the rows x into ``best``: tile by tile, of a tile only those pairs whose rough distance is not over the k-th best of their query.

    barred(lo, hi, a, b): which pairs of the queries lo to hi and the rows a to b don't count.
    """
    for lo in range(0, len(q), QUERIES):
        mine = q[lo : lo + QUERIES]
        hi = lo + len(mine)
        for a in range(0, len(x), ROWS):
            part = x[a : a + ROWS]
            out = barred(lo, hi, a, a + len(part))
            if out.all():
                continue
            rough, slack = _rough(part, mine, kind)
            rough[out] = np.inf
            bound = best.far[lo:hi, -1]
            if len(part) > best.k and not np.isfinite(bound).all():
                bound = np.minimum(bound, np.partition(rough, best.k - 1, axis=1)[:, best.k - 1] + slack)
            i, j = np.nonzero((rough <= (bound + slack)[:, None]) & np.isfinite(rough))
            for at in range(0, len(i), PAIRS):
                ii, jj = i[at : at + PAIRS], j[at : at + PAIRS]
                best.put(lo, hi, ii, _distances(part[jj], mine[ii], kind), ids[a + jj])


def _best_of(sent: Broadcast, k: int, kind: str, apart: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = sent.value
        q = q if kind == "squared" else np.sort(q, axis=1)
        best = Best(len(q), k)
        for batch in batches:
            if batch.num_rows and len(q):
                ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
                barred = lambda lo, hi, a, b, ids=ids: np.abs(query_ids[lo:hi, None] - ids[None, a:b]) <= apart
                scan_tiles(best, q, x if kind == "squared" else np.sort(x, axis=1), ids, kind, barred)
        yield best.batch(query_ids)

    return scan


def graph_summary(edges: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """For each label of the source: edges, distinct targets, the largest distance, and the share of targets of the same label."""
    a, b = labels.select(F.col(id_col).alias("query_id"), F.col(label).alias("label")), labels.select(F.col(id_col).alias("id"), F.col(label).alias("_other"))
    e = edges.join(a, "query_id").join(b, "id")
    return e.groupBy("label").agg(F.count("*").alias("n_edges"), F.countDistinct("id").alias("n_targets"), F.max("distance").alias("furthest"), F.avg((F.col("label") == F.col("_other")).cast("double")).alias("same_label"))
