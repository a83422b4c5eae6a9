"""Shared helpers: the cluster's shared folder, and array kernels over Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidewell.session import ship

#: Bytes of text that one vectorised step looks at. A longer text is a slice of its own, which the kernels go through in pieces.
SLICE_BYTES = 1 << 20
PIECE_BYTES = 4 << 20
#: Bytes of a row group, and of an Arrow batch, of tables whose rows are blocks of about a megabyte.
GROUP_BYTES = 8 << 20

#: The bytes of [\x20\x09-\x0D].
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``, or else what the context was given. Only a local session that names none (a test) gets a
    temporary folder; on a cluster, where no machine's own folder would do, that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidewell-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewell-{name}-{uuid.uuid4().hex}"


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow() on workers that have this package, in batches of GROUP_BYTES at most (or one row), whatever the rows are like and however large a partition is."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", GROUP_BYTES)
    return df.mapInArrow(function, schema)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a checkpoint in the shared folder, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, group_bytes: int | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """df as a table of the shared folder, and a function that removes it, for what is needed for some steps only.

    As Parquet it takes a fraction of a checkpoint's space. group_bytes: of a row group, where rows are large; Spark reads up to 4,096 rows of a group at once.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 1).option("parquet.block.size.row.check.min", 1)
    writer.parquet(path)

    return spark.read.parquet(path), lambda: remove(spark, path)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi`` of a string column with their UTF-8 bytes and the offsets of each text in these.

    Nulls are texts without bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of word bytes, none of which spans two texts, and for each text its first run."""
    n = len(is_word)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            _INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
    return _POWERS[:n], _INVERSES[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = PIECE_BYTES) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: differences of one running polynomial, scaled back to position 0.

    The runs are in order and apart; they are gone through in pieces, so that memory stays a small multiple of the piece.
    """
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + piece, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo > piece:  # one long run: the parts' polynomials, each moved to its place
            total = np.uint64(0)
            for at in range(lo, hi, piece):
                part = data[at : min(at + piece, hi)]
                moved = np.uint64(pow(int(_BASE), at - lo, 1 << 64))
                with np.errstate(over="ignore"):
                    total = total + (_BYTE_CODES[part] * _powers(len(part))[0]).sum(dtype=np.uint64) * moved
            out[i] = mix64(np.array([total]) + np.uint64(hi - lo))[0]
        else:
            powers, inverses = _powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE_CODES[data[lo:hi]] * powers[: hi - lo], out=sums[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix64((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64))
        i = j
    return out


def stretch_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As run_hashes(), of each words[start:end], where words are hashes themselves."""
    n = len(words)
    powers, inverses = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANKS)] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and for each text its first word."""
    starts, ends, first = word_bounds(_IS_WORD[data], offsets)
    return run_hashes(_LOWER[data] if len(data) else data, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles in order, and for each text its first one.

    A text of fewer than k words, but not none, has one shingle: all its words.
    """
    counts = np.diff(first)
    each = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(each)])
    if bounds[-1] == 0:
        return np.zeros(0, np.uint64), bounds
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], each)
    length = np.repeat(np.minimum(counts, k), each)
    total = length.astype(np.uint64)
    for j in range(k):
        factor = np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) & (2**64 - 1) | 1)
        inside = j < length
        total = total + np.where(inside, words[np.where(inside, at + j, 0)] * factor, np.uint64(0))
    return mix64(total), bounds
