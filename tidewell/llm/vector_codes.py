"""Product quantisation of vectors in integers, whose nearest entries are found by a VA-file: cells first, distances of what overlaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_arrow, materialise

#: Parts of a vector, entries of each part's codebook (two hex digits number 256), rounds that move the entries, and the factor of components.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a cell's number in each coordinate of the VA-file.
BITS = 4
#: Vectors that are compared at once; components up to which 64-bit sums of squares are exact (beyond, Python's integers).
BATCH, SMALL = 2048, 1 << 26
#: Bits of the digits in which sums of components are shuffled, so that none overflows.
DIGIT_BITS = 40
#: Labels up to which their sums are broadcast; they are counted first.
FEW_LABELS = 50_000


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite x; where that is large, exactly, as Python's integers."""
    scaled = np.floor(values.astype(np.float64) * scale) if len(values) and np.abs(values).max() <= SMALL / scale else None
    if scaled is not None or not len(values):
        return scaled.astype(np.int64) if len(values) else np.zeros(0, np.int64)
    exact = (float(x).as_integer_ratio() for x in values)
    return np.array([a * scale // b for a, b in exact], object)


class Cells:
    """The VA-file of one part's codebook: each entry's cell in each coordinate, and the edges of cells.

    A coordinate's edges are quantiles of the entries' values, so that cells hold about as many each; cell c is edges[c] to
    edges[c + 1], both included.
    """

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, (n, width) = entries, entries.shape
        cells = min(1 << bits, n)
        ranked = np.sort(entries, axis=0)
        self.edges = ranked[(np.arange(cells + 1) * (n - 1)) // cells].T  # coordinate, edge
        inner = self.edges[:, 1:-1]
        self.cell = np.array([[int(np.searchsorted(inner[d], entries[e, d], "left")) for d in range(width)] for e in range(n)], np.int64).reshape(n, width)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nearest entry, ties to the lower, and its squared distance.

        A query's tables hold the least and the largest squared distance to each cell of each coordinate; their sums bound the distance
        to each entry. Entries whose lower bound is above the least upper bound are out; distances of the others are exact.
        """
        m, (n, width) = len(queries), self.entries.shape
        lower, upper = (np.zeros((m, n), queries.dtype) for _ in range(2))
        for d in range(width):
            below, above = self.edges[d, :-1][None, :] - queries[:, d, None], queries[:, d, None] - self.edges[d, 1:][None, :]
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[:, self.cell[:, d]]
            upper += (far * far)[:, self.cell[:, d]]
        rows, at = np.nonzero(lower <= upper.min(axis=1)[:, None])
        gap = queries[rows] - self.entries[at]
        distance = (gap * gap).sum(axis=1) if width else np.zeros(len(rows), np.int64)
        first = np.searchsorted(rows, np.arange(m))
        least = np.minimum.reduceat(distance, first) if m else distance
        hit = np.flatnonzero(distance == least[rows])  # in order of entry, so the first of a row is the lowest
        return at[hit[np.searchsorted(rows[hit], np.arange(m))]], least


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, coordinate], integers; n_parts parts of width coordinates each."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()

    def parts_of(self, batch: pa.RecordBatch | pa.Table, column: int) -> np.ndarray:
        """The vectors of a column as [row, part, coordinate]."""
        parts, _, width = self.entries.shape
        vectors = batch.column(column)
        rows = integers(vectors.flatten().to_numpy(zero_copy_only=False), self.scale).reshape(len(vectors), parts, width)
        return rows.astype(object) if self.entries.dtype == object else rows

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's entry and squared distance, [row, part]."""
        books = self.entries.astype(object) if rows.dtype == object else self.entries
        found = [Cells(books[p]).nearest(rows[:, p]) for p in range(len(books))]
        return np.stack([at for at, _ in found], 1), np.stack([far for _, far in found], 1)

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for: the middle of each component's step."""
        at = [int(code[2 * p : 2 * p + 2], 16) for p in range(len(self.entries))]
        return [(int(x) + 0.5) / self.scale for p, e in enumerate(at) for x in self.entries[p, e]]


def _finite(vector: str) -> Column:
    """Whether a vector holds finite numbers only; false for null."""
    limit = float(np.finfo(np.float64).max)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > limit)
    return F.coalesce(~F.exists(F.col(vector), bad), F.lit(False))


def _kept(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(_finite("vector"))


def _moved(kept: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round: each entry is the floor of the mean of the parts nearest to it, or stays where none is.

    A task adds up its own rows; counts and the digits of sums are summed by part, entry and coordinate. The driver gets these.
    """
    parts, entries, width = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                rows = books.parts_of(batch.slice(lo, BATCH), 0)
                at, _ = books.assign(rows)
                for p in range(parts):
                    own = np.zeros((entries, width), rows.dtype)
                    np.add.at(own, at[:, p], rows[:, p])
                    sums[p] += own.astype(object)
                    counts[p] += np.bincount(at[:, p], minlength=entries)
        out = []
        for p, e in zip(*np.nonzero(counts), strict=True):
            out.append((p, e, -1, 0, int(counts[p, e])))
            for d, total in enumerate(sums[p, e]):
                sign, rest, digit = (-1 if total < 0 else 1), abs(int(total)), 0
                while rest:
                    out.append((p, e, d, digit, sign * (rest & ((1 << DIGIT_BITS) - 1))))
                    rest, digit = rest >> DIGIT_BITS, digit + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32() if i < 4 else pa.int64()) for i in range(5)], names=["part", "entry", "coordinate", "digit", "n"])

    rows = map_arrow(kept.select("vector"), add, "part int, entry int, coordinate int, digit int, n long").groupBy("part", "entry", "coordinate", "digit").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect()
    counts = {(r.part, r.entry): int(r.n) for r in rows if r.coordinate < 0}
    sums: dict[tuple[int, int, int], int] = {}
    for r in rows:
        if r.coordinate >= 0:
            sums[r.part, r.entry, r.coordinate] = sums.get((r.part, r.entry, r.coordinate), 0) + (int(r.n) << (DIGIT_BITS * r.digit))
    out = books.entries.copy()
    for (p, e), n in counts.items():
        for d in range(width):
            out[p, e, d] = sums.get((p, e, d), 0) // n
    return Codebooks(out, books.scale)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks that begin with the parts of the ``entries`` smallest ids' vectors and are moved ``rounds`` times, each time over all vectors.

    Null ids come last, rows of one id in the order of their vectors; with fewer vectors there are fewer entries. None without a
    vector of finite numbers. The driver holds parts * entries * width integers and the starting vectors.
    """
    kept = _kept(vectors, id_col, vector_col)
    start = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not start:
        return None
    length = len(start[0].vector)
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    first = [integers(np.array(r.vector, np.float64), scale) for r in start if len(r.vector) == length]
    kind = object if any(x.dtype == object for x in first) else np.int64
    books = Codebooks(np.array([x.astype(kind) for x in first], kind).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy(), scale)
    for _ in range(rounds):
        books = _moved(kept.where(F.size("vector") == length), books)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, code (two hex digits for each part), error (the sum of squared distances, null beyond a long) and the columns ``carry``.

    Rows whose vector is null, or holds null, infinity or NaN, or has another length than the codebooks, are dropped. Repeated rows
    are rows of their own.
    """
    parts, _, width = books.entries.shape
    rows = vectors.where(_finite(vector_col) & (F.size(vector_col) == parts * width)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), *(F.col(c).alias(f"carried_{c}") for c in carry))
    kinds = ", ".join(["vec_id long, code string, error long", *(f"`carried_{c}` {kind}" for c, (_, kind) in zip(carry, rows.dtypes[2:], strict=True))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                at, far = books.assign(books.parts_of(batch, 1))
                names = at.astype(np.uint8).tobytes().hex()
                codes = [names[i * 2 * parts : (i + 1) * 2 * parts] for i in range(len(at))]
                errors = [None if e >= 1 << 63 else int(e) for e in far.sum(axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string()), pa.array(errors, pa.int64()), *batch.columns[2:]], names=["vec_id", "code", "error", *batch.schema.names[2:]])

    return map_arrow(rows, code, kinds)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector of finite numbers: vec_id, code, error, label_error (error summed over its label, nulls together), codebooks_sha256.

    See fit() and encode() for what begins the codebooks and which rows are dropped. No such vector gives no rows. Sums of labels
    are made from task sums and written before they are joined; they are broadcast up to FEW_LABELS labels, which are counted.
    """
    spark, out = vectors.sparkSession, "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    books = fit(vectors, parts, entries, rounds, scale, id_col, vector_col)
    if books is None:
        return spark.createDataFrame([], out)
    codes = materialise(encode(vectors, books, id_col, vector_col, (label_col,)).withColumnRenamed(f"carried_{label_col}", "label"))
    totals = materialise(codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")).select(F.col("label").alias("of"), F.expr("try_cast(total AS long)").alias("label_error")))
    totals = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals
    return codes.join(totals, codes["label"].eqNullSafe(totals["of"])).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
