"""Removal of runs of lines that occurred before: winnowed line hashes find the places, matches are extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import BLANKS, map_arrow, materialise, mix64, run_hashes, text_slices, word_bounds

#: A window is RUN lines, or fewer if these hold LONG words: the shortest run that is removed. Its fingerprint is its smallest line hash.
RUN = 3
LONG = 25

_WORD = np.ones(256, bool)
_WORD[list(BLANKS)] = False


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and words of each line with a word, and for each text its first such line."""
    starts, ends, _ = word_bounds(data != 0x0A, offsets)
    words, _, _ = word_bounds(_WORD[data], offsets)
    counts = np.searchsorted(words, ends) - np.searchsorted(words, starts)
    some = counts > 0
    starts, ends = starts[some], ends[some]
    return starts, ends, counts[some], np.searchsorted(starts, offsets)


def windows_of(lines: np.ndarray, counts: np.ndarray, first: np.ndarray, run: int, long: int) -> tuple[np.ndarray, ...]:
    """For each line that a window begins at: the line, the window's lines, its mark's line, and the hash of all its lines."""
    n = len(lines)
    at, total = np.arange(n), np.concatenate([[0], np.cumsum(counts)])
    size = np.full(n, run)
    for j in range(run - 1, 0, -1):
        size[total[np.minimum(at + j, n)] - total[:-1] >= long] = j
    at = np.flatnonzero(size <= np.repeat(first[1:], np.diff(first)) - at)  # the window ends in its own text
    size = size[at]
    best, where, whole = lines[at].copy(), at.copy(), mix64(lines[at] + size.astype(np.uint64))
    for j in range(1, run):
        inside = j < size
        h = lines[np.where(inside, at + j, at)]
        less = inside & (h <= best)  # of equal hashes the last, so that long repetitions have few marks
        best[less], where[less] = h[less], at[less] + j
        whole[inside] = mix64(whole[inside] * np.uint64(0x9E3779B97F4A7C15) + h[inside])
    return at, size, where, whole


def fingerprints(docs: DataFrame, run: int, long: int) -> DataFrame:
    """doc_id, tag, mark (a winnowed line hash), start (of the first window it was selected in), and the windows' hashes and sizes in lines."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                starts, ends, counts, first = _lines(data, offsets)
                lines = run_hashes(data, starts, ends)
                at, size, where, whole = windows_of(lines, counts, first, run, long)
                if not len(at):
                    continue
                owner = np.repeat(np.arange(hi - lo), np.diff(first))[at]
                begin = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])))
                bounds = pa.array(np.append(begin, len(at)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (whole.view(np.int64), size.astype(np.int32))]
                at, owner, where = at[begin], owner[begin], where[begin]
                columns = [pa.array(ids[lo + owner], pa.int64()), pa.array(tags[lo + owner], pa.int64()), pa.array(lines[where].view(np.int64)), pa.array(at - first[owner], pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "mark", "start", "windows", "sizes"])

    return map_arrow(docs.select("doc_id", "tag", "text"), select, "doc_id long, tag long, mark long, start long, windows array<long>, sizes array<int>")


def _named(id_col: str, text_col: str) -> list[Column]:
    """What a row is told by: its id, and a hash of its text where rows share an id."""
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag")]


def repeated_runs(docs: DataFrame, run: int = RUN, long: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag and runs: [first, end) of the lines (counted among a text's lines with a word) that repeat an earlier place's.

    A run is one or more windows, each of ``run`` lines, or of fewer that hold ``long`` words together. Earlier is a smaller id, or of one
    id the text with the smaller hash (tag), or a place before in the same text; there the lines of the first place itself
    stay. Marks that occur once are dropped first; around the others, every window is matched with its first place in the corpus,
    and windows that touch or overlap are one run: so matches extend as far as the lines agree. Null ids have no runs. Rows of
    one id and one text are one document; rows of one id with different texts are documents of their own.
    """
    docs = docs.select(*_named(id_col, text_col), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    marks = materialise(fingerprints(docs, run, long))
    # what is summed by a mark is written before it is joined by it: such a join can be split where a mark is hot
    shared = materialise(marks.groupBy("mark").agg(F.count("*").alias("n"), F.max(F.size("windows")).alias("m")).where("n > 1 OR m > 1").select("mark"))
    near = marks.join(shared, "mark", "left_semi").select("mark", F.struct("doc_id", "tag").alias("doc"), "start", F.posexplode(F.arrays_zip("windows", "sizes")).alias("i", "w"))
    near = materialise(near.select("mark", F.col("w.windows").alias("window"), F.col("w.sizes").alias("lines"), "doc", (F.col("start") + F.col("i")).alias("start")))
    earliest = materialise(near.groupBy("mark", "window").agg(F.min("doc").alias("x"), F.count("*").alias("n")).where("n > 1").drop("n"))
    placed = materialise(near.join(earliest, ["mark", "window"]))
    origin = materialise(placed.where("doc = x").groupBy("mark", "window").agg(F.min("start").alias("s")))
    later = placed.join(origin, ["mark", "window"]).where("doc > x OR start > s")
    end = F.col("start") + F.col("lines")
    first = F.when(F.col("doc") == F.col("x"), F.greatest("start", F.col("s") + F.col("lines"))).otherwise(F.col("start"))
    spans = later.select("doc.doc_id", "doc.tag", first.alias("first"), end.alias("end")).where("first < end").distinct()
    # at most one span begins at each line of a text, so a frame is no longer than the text
    order = Window.partitionBy("doc_id", "tag").orderBy("first", "end")
    spans = spans.withColumn("new", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) < F.col("first"), F.lit(True)))
    spans = spans.withColumn("k", F.sum(F.col("new").cast("int")).over(order)).groupBy("doc_id", "tag", "k").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return spans.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("runs"))


def drop_repeated_lines(docs: DataFrame, run: int = RUN, long: int = LONG, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less its repeated runs, and n_lines (with a word), n_removed and removed_runs in place of columns of these names.

    See repeated_runs(). Lines without a word stay. A null text stays null with no lines; an empty one stays empty.
    """
    runs = materialise(repeated_runs(docs, run, long, id_col, text_col))
    keep = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed", "removed_runs")]
    held = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), *_named(id_col, text_col), F.col(text_col).alias("text")).join(runs, ["doc_id", "tag"], "left")
    held = held.select(*(f"c{i}" for i in range(len(keep))), "text", F.coalesce("runs", F.array().cast("array<struct<first: bigint, end: bigint>>")).alias("runs"))
    k = len(keep)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            column, runs = batch.column(k), batch.column(k + 1).to_pylist()
            for lo, hi, data, offsets in text_slices(column):
                starts, ends, _, first = _lines(data, offsets)
                raw = data.tobytes()
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    counts.append(b - a)
                    at, parts, gone = int(offsets[i]), [], 0
                    for r in runs[lo + i]:
                        gone += r["end"] - r["first"]
                        for line in range(a + r["first"], a + r["end"]):
                            parts.append(raw[at : starts[line]])
                            at = min(int(ends[line]) + 1, int(offsets[i + 1]))
                    parts.append(raw[at : offsets[i + 1]])
                    texts.append(b"".join(parts).decode() if column[lo + i].is_valid else None)
                    removed.append(gone)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), batch.column(k + 1)], names=[*batch.schema.names[: k + 1], "n_lines", "n_removed", "removed_runs"])

    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "text string, n_lines long, n_removed long, removed_runs array<struct<first: long, end: long>>"])
    return map_arrow(held, cut, schema).toDF(*keep, text_col, "n_lines", "n_removed", "removed_runs")
