"""Resampling towards a target's distribution of hashed n-grams, by a sparse matrix of documents and buckets kept as CSR blocks."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import GROUP_BYTES, map_arrow, materialise, stored, text_slices
from tidewell.llm.decontam import folded

#: Buckets of features, the longest run of words that is a feature, and the factor of integer gains and noise.
BUCKETS, LONGEST, SCALE = 10_000, 1, 1000
#: Documents of fewer words are never drawn; the share in per cent that is; what the noise is seeded with.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Features of more bytes get their checksum one by one, and features that are hashed at once.
LONG_FEATURE, PIECE = 48, 1 << 19

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> np.uint32(1)), _CRC >> np.uint32(1)).astype(np.uint32)

_NAMES = ("doc_ids", "n_words", "n_features", "indptr", "buckets", "counts")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
_SCHEMA = "doc_ids array<long>, n_words array<long>, n_features array<long>, indptr array<int>, buckets array<int>, counts array<int>"


def crc32_of_stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each data[start:end], byte position by byte position over all that are long enough."""
    size = np.minimum(ends - starts, LONG_FEATURE + 1).astype(np.uint8)
    order = np.argsort(size, kind="stable")[::-1]
    at, state = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    reach = np.cumsum(np.bincount(size, minlength=LONG_FEATURE + 2)[::-1])[::-1]
    for i in range(int(size.max(initial=0))):
        now = state[: reach[i + 1]]
        state[: reach[i + 1]] = (now >> np.uint32(8)) ^ _CRC[(now ^ data[at[: reach[i + 1]] + i]) & np.uint32(255)]
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > LONG_FEATURE):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def count_matrix(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sparse matrix of documents and buckets, a row for each CSR block: doc_ids, n_words, n_features, indptr, buckets, counts.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; features are all runs of 1 to ``longest`` words joined by one
    space, repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. A null or empty text is an
    empty row of the matrix. A block holds about a megabyte of text, or one longer text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                text, bounds, places, first = folded(data, offsets)
                words = np.diff(first)
                row = np.repeat(np.arange(len(words)), words)
                last = first[1:][row]
                # a blank follows each word: before the next word, or at the end of the text
                ends = np.where(np.arange(len(row)) + 1 < last, np.append(places[1:], 0)[: len(row)], bounds[1:][row]) - 1
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for run in range(1, longest + 1):
                    start = np.flatnonzero(np.arange(len(places)) + run <= last)
                    for at in range(0, len(start), PIECE):
                        some = start[at : at + PIECE]
                        bucket = crc32_of_stretches(text, places[some], ends[some + run - 1]) % np.uint32(buckets)
                        found, n = np.unique(row[some] * buckets + bucket, return_counts=True)
                        keys, where = np.unique(np.concatenate([keys, found]), return_inverse=True)
                        counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
                indptr = np.searchsorted(keys, np.arange(hi - lo + 1) * buckets)
                features = sum(np.maximum(words - run + 1, 0) for run in range(1, longest + 1))
                ids = batch.column(0).slice(lo, hi - lo)
                block = [ids, words, features, indptr, keys % buckets, counts]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t)) for x, t in zip(block, _TYPES, strict=True)], names=_NAMES)

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), count, _SCHEMA)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """The sum of each bucket's column: a task adds up its blocks, then buckets are summed over tasks. The driver gets a row for each bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(0), batch.column(1), strict=True):
                at, n = (np.asarray(x.values) for x in (at, n))
                for lo in range(0, len(at), PIECE):
                    total += np.bincount(at[lo : lo + PIECE], weights=n[lo : lo + PIECE], minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return dict(map_arrow(blocks.select("buckets", "counts"), add, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect())


def log_gains(own: dict[int, int], target: dict[int, int], buckets: int = BUCKETS, scale: int = SCALE) -> np.ndarray:
    """Each bucket's floor(scale * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))): smoothed shares of the target against the documents' own."""
    all_own, all_target = float(sum(own.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(scale * math.log((target.get(b, 0) + 1.0) * all_own / ((own.get(b, 0) + 1.0) * all_target))) for b in range(buckets)], np.int64)


def row_weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document: the matrix times the vector of gains, block by block."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in zip(*batch.columns, strict=True):
                ids, words, features, indptr, at, n = (x.values for x in block)
                sums = np.zeros(len(at) + 1, np.int64)
                np.cumsum(gains[np.asarray(at)] * np.asarray(n), out=sums[1:])
                indptr = np.asarray(indptr)
                yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(sums[indptr[1:]] - sums[indptr[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return map_arrow(blocks.select(*_NAMES), product, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """floor(-scale * ln(-ln(u))), Gumbel noise, of u from the SHA-256 of seed and id. A null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, scale: int = SCALE, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text"
) -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, rank, all long.

    weight is the sum of the gains (log_gains()) of a document's features, score is weight plus noise(), and rank numbers those drawn:
    of the N documents with ``least_words`` or more, the floor(percent * N / 100) highest scores, ties to the smaller id (a null id
    last); the rank of others is null. A text without words weighs 0. Repeated rows are documents of their own, with one score
    and ranks that follow each other. No documents give no rows; an empty target has no features, and then rare
    buckets gain. Only the two columns named are read. The matrix is written once, as CSR blocks, and read for the column sums
    and for the product; ranks come from one sort by ranges of score and id, however many documents share a score.
    """
    blocks, drop = stored(count_matrix(docs, buckets, longest, id_col, text_col), "csr", GROUP_BYTES)
    gains = log_gains(column_sums(blocks, buckets), column_sums(count_matrix(target, buckets, longest, target_id, target_text), buckets), buckets, scale)
    long_enough = blocks.select(F.sum(F.size(F.filter("n_words", lambda n: n >= least_words))).alias("n")).first().n or 0
    drawn = percent * long_enough // 100
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    scored = row_weights(blocks, gains).select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed, scale)).alias("score"), (F.col("n_words") >= least_words).alias("open"))
    # the id has the number of the range in its upper bits and the place in it in the lower 33
    placed = materialise(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    drop()
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))  # a row for each range
    rank = F.col("start") + place + 1
    out = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, **settings: object) -> DataFrame:
    """The rows of docs that importance() draws, with all their columns. Of rows with one id all stay if one is drawn; a row with a null id goes."""
    id_col = settings.get("id_col", "doc_id")
    drawn = importance(docs, target, **settings).where("rank IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(drawn, id_col, "left_semi").select(docs.columns)
