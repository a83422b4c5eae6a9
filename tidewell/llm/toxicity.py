"""Toxicity scores: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is log(1 + an n-gram's count in the text) times the n-gram's ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import PIECE_BYTES, map_arrow, text_slices
from tidewell.llm.decontam import folded

#: Bytes of the n-grams, and the bits of their hashed feature numbers.
GRAMS = (5, 6, 7, 8)
BITS = 20
#: The bound on what a model is fitted to: rows of each label, bytes of a text that is taken whole, and pieces that stand for a longer one.
SAMPLE_ROWS = {1: 900, 0: 1800}
SAMPLE_BYTES, SAMPLE_PIECES = 1 << 13, 4
ROUNDS = 40
#: Texts that an n-gram occurs in at least.
LEAST_DOCUMENTS = 3
THRESHOLD = 0.7
#: Label 1 counts for this share of the fit at least: at a rarer one the penalty would hold its n-grams back.
LEAST_SHARE = 0.3
#: Texts whose gradient is taken together.
PART = 100

_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**31, max(GRAMS), np.uint32) * np.uint32(2) + np.uint32(1)


def _fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with blanks around them, lower-cased also among the two-byte letters of Latin-1."""
    text, bounds, _, _ = folded(data, offsets)
    if len(text) > 1:
        upper = (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97)
        text[1:][upper] += 0x20
    return text, bounds


def _features(text: np.ndarray) -> list[np.ndarray]:
    """For each n of GRAMS the feature number of the n-gram at each place."""
    out, total = [], np.zeros(len(text), np.uint32)
    codes = text.astype(np.uint32) + np.uint32(1)
    for j in range(max(GRAMS)):
        end = max(0, len(text) - j)
        total = total[:end] + codes[j:] * _FACTORS[j]
        if j + 1 in GRAMS:
            h = total * np.uint32(0x9E3779B1)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            out.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _of_text(features: list[np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of the text from a to b, in order, with log(1 + count)."""
    found = np.sort(np.concatenate([f[a : max(a, b - n + 1)] for n, f in zip(GRAMS, features, strict=True)]))
    ends = np.flatnonzero(np.append(found[1:] != found[:-1], len(found) > 0))
    return found[ends], np.log1p(np.diff(ends, prepend=-1)).astype(np.float32)


def _of_long_text(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _of_text(), of a whole long text: counts of the pieces, which overlap by what n-grams reach over, are added up."""
    counts = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(text), PIECE_BYTES):
        for n, f in zip(GRAMS, _features(text[at : at + PIECE_BYTES + max(GRAMS) - 1]), strict=True):
            counts += np.bincount(f[:PIECE_BYTES], minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), np.log1p(counts[found]).astype(np.float32)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Each whole text's chance of label 1."""
        z = np.full(len(column), self.bias)
        for lo, _, data, offsets in text_slices(column):
            text, bounds = _fold(data, offsets)
            if len(text) > PIECE_BYTES:  # a slice of one text
                found, value = _of_long_text(text)
                z[lo] += self.weights[found] @ value
                continue
            features = _features(text)
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                found, value = _of_text(features, a, b)
                z[lo + i] += self.weights[found] @ value
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(texts: list[str], labels: np.ndarray, prior: float, rounds: int = ROUNDS) -> Scorer:
    """Logistic regression on x * r, r being log((p + 0.1) / |p|) - log((q + 0.1) / |q|) for each n-gram's counts p and q.

    The counts are taken for each thousand n-grams of a document, so that long documents do not outweigh short ones.

    The labels are weighted so that label 1 has the share ``prior``.
    """
    rows, values = [], []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        text, bounds = _fold(data, np.array([0, len(data)]))
        found, value = _of_text(_features(text), 0, int(bounds[1]))
        rows.append(found)
        values.append(value)
    labels = np.asarray(labels, np.float64)
    size = 1 << BITS
    p, q, held = np.zeros(size), np.zeros(size), np.zeros(size)
    for found, value, y in zip(rows, values, labels, strict=True):
        count = np.expm1(value)
        (p if y else q)[found] += 1000 * count / max(count.sum(), 1)
        held[found] += 1
    ratio = np.log((p + 0.1) / (p + 0.1).sum()) - np.log((q + 0.1) / (q + 0.1).sum())
    ratio[held < LEAST_DOCUMENTS] = 0
    used = np.flatnonzero(ratio)
    number = np.full(size, -1, np.int32)
    number[used] = np.arange(len(used))
    for i, r in enumerate(rows):  # in place, so that each text is held once
        known = number[r] >= 0
        rows[i] = number[r[known]]
        values[i] = values[i][known] * ratio[used[rows[i]]].astype(np.float32)
    parts = [slice(i, i + PART) for i in range(0, len(rows), PART)]
    owners = [np.repeat(np.arange(len(rows[k])), [len(r) for r in rows[k]]).astype(np.int32) for k in parts]
    rows, values = ([np.concatenate(x[k]) for k in parts] for x in (rows, values))
    ones = labels.mean()
    weight = np.where(labels == 1, prior / max(ones, 1e-9), (1 - prior) / max(1 - ones, 1e-9)) / len(labels)
    w, bias = np.zeros(len(used)), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    first, second, b1, b2, decay = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, 1e-2
    for step in range(1, rounds + 1):
        d, db = decay * w, 0.0
        for k, owner, index, value in zip(parts, owners, rows, values, strict=True):
            z = np.bincount(owner, value * w[index], minlength=len(labels[k])) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[k]) * weight[k]
            d += np.bincount(index, value * g[owner], minlength=len(used))
            db += g.sum()
        first += 0.1 * (d - first)
        second += 0.01 * (d * d - second)
        b1 += 0.1 * (db - b1)
        b2 += 0.01 * (db * db - b2)
        up, down = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.02 * (first / up) / (np.sqrt(second / down) + 1e-8)
        bias -= 0.02 * (b1 / up) / (np.sqrt(b2 / down) + 1e-12)
    weights = np.zeros(size, np.float32)
    weights[used] = w * ratio[used]
    return Scorer(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: dict[int, int] | None = None) -> Scorer | None:
    """A scorer fitted to about ``sample_rows`` documents of each label (twice as many at most), taken by a hash of their ids.

    labels holds id_col and label_col, 0 or 1; rows with a null in either don't count, nor do null texts. Of a text over SAMPLE_BYTES
    SAMPLE_PIECES pieces stand for it, from its beginning to its end, of SAMPLE_BYTES characters in all. Only the labels taken, a bounded
    number, are broadcast to the documents. Without rows of both labels there is no scorer.
    """
    sample_rows = sample_rows or SAMPLE_ROWS
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    totals = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(totals) < 2:
        return None
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    limits = {k: (1 << 30) if n <= sample_rows[k] else int((1 << 30) * sample_rows[k] / n) for k, n in totals.items()}
    taken = [rows.where((F.col("label") == k) & (part < limits[k])).limit(2 * sample_rows[k]) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = SAMPLE_BYTES // SAMPLE_PIECES
    piece = lambda j: F.substr(F.col("text"), (F.floor((F.length("text") - size) * j / (SAMPLE_PIECES - 1)) + 1).cast("int"), F.lit(size))
    part_of = F.when(F.octet_length("text") <= SAMPLE_BYTES, F.col("text")).otherwise(F.concat_ws("\n", *(piece(j) for j in range(SAMPLE_PIECES))))
    sample = texts.join(F.broadcast(taken[0].union(taken[1])), "id").select("label", part_of.alias("text")).collect()
    if len({r.label for r in sample}) < 2:
        return None
    sample = sorted(sample)
    return train([r.text for r in sample], np.array([r.label for r in sample]), max(LEAST_SHARE, totals[1] / (totals[0] + totals[1])))


def score(docs: DataFrame, scorer: Scorer | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with score, the chance of label 1 from 0 to 1, in place of a column of that name.

    Every whole text counts, in every row; a null or empty text has the score of the model's bias; without a scorer all have 0.
    """
    keep = [c for c in keep if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = sent.value.scores(batch.column(0)) if sent.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(z)], names=[*(f"c{i}" for i in range(len(keep))), "score"])

    held = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    return map_arrow(held, judge, ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "score double"])).toDF(*keep, "score")
