"""Language identification by a byte convolutional network, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_arrow, text_slices

#: Bytes of a window; windows overlap by the widest filter less one byte.
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: The bound on what a model is fitted to: labelled rows, and windows of each, spread evenly over the whole text.
SAMPLE_ROWS = 3000
#: Different texts of a language that are sampled, if it has so many, however rare it is.
LEAST_ROWS = 100
SAMPLE_WINDOWS = 3
EPOCHS = 10
UNKNOWN = "und"
#: Windows that go through the network together.
BATCH = 2048


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the texts: its text, its start and how many bytes it holds."""
    step = WINDOW - max(WIDTHS) + 1
    sizes = np.diff(offsets)
    each = np.maximum(1, -(-(sizes - max(WIDTHS) + 1) // step)) * (sizes > 0)
    owner = np.repeat(np.arange(len(sizes)), each)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[:-1][owner] + place * step
    return owner, start, np.minimum(WINDOW, offsets[1:][owner] - start)


def _spell(data: np.ndarray, start: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Windows as rows of bytes, filled up with 0."""
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    return np.where(inside, data[np.where(inside, at, 0)], 0).astype(np.uint8)


@dataclass
class ByteNet:
    """classes, and the weights: embedding, filters by width (width x embedding x FILTERS), their biases, and the output layer."""

    classes: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each place of the widest filter, what each byte adds to each of the filters there."""
        tables = []
        for j in range(max(WIDTHS)):
            parts = [self.embedding @ f[j] if j < len(f) else np.zeros((256, FILTERS), np.float32) for f in self.filters]
            tables.append(np.ascontiguousarray(np.concatenate(parts, axis=1)))
        return tables

    @staticmethod
    def pooled(x: np.ndarray, tables: list[np.ndarray], where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter over each window, and its place if asked for."""
        columns = np.ascontiguousarray(x.T)
        shape = (len(x), tables[0].shape[1])
        best, now, part = np.full(shape, -np.inf, np.float32), np.empty(shape, np.float32), np.empty(shape, np.float32)
        place = np.zeros(shape, np.int16) if where else None
        for t in range(WINDOW - len(tables) + 1):
            np.take(tables[0], columns[t], axis=0, out=now, mode="clip")
            for j in range(1, len(tables)):
                np.take(tables[j], columns[t + j], axis=0, out=part, mode="clip")
                np.add(now, part, out=now)
            if place is not None:
                place[now > best] = t
            np.maximum(best, now, out=best)
        return best, place

    def probabilities(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        best, _ = self.pooled(x, tables)
        z = np.maximum(best + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: list[str], epochs: int = EPOCHS, seed: int = 11) -> ByteNet:
    """Fit by Adam on cross entropy. x: windows of bytes; y: class of each."""
    rng = np.random.Generator(np.random.PCG64(seed))
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = ByteNet(classes, normal(256, EMBEDDING, scale=0.5), [normal(w, EMBEDDING, FILTERS, scale=0.5 / w**0.5) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), normal(FILTERS * len(WIDTHS), len(classes), scale=0.1), np.zeros(len(classes), np.float32))
    weights = [net.embedding, *net.filters, net.bias, net.out, net.out_bias]
    first, second, step, size = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0, 128
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), size):
            rows = order[i : i + size]
            xb = x[rows]
            best, place = net.pooled(xb, net.tables(), where=True)
            hidden = np.maximum(best + net.bias, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            d_hidden = (p @ net.out.T) * (hidden > 0)
            d_embedding = np.zeros_like(net.embedding)
            d_filters = []
            for k, f in enumerate(net.filters):
                g = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
                at = place[:, k * FILTERS : (k + 1) * FILTERS].astype(np.int64)
                d = np.empty_like(f)
                for j in range(len(f)):
                    seen = xb[np.arange(len(rows))[:, None], at + j]
                    d[j] = np.einsum("mfe,mf->ef", net.embedding[seen], g)
                    np.add.at(d_embedding, seen.ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, EMBEDDING))
                d_filters.append(d)
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for w, d, m, v in zip(weights, [d_embedding, *d_filters, d_hidden.sum(0), hidden.T @ p, p.sum(0)], first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> ByteNet | None:
    """A network fitted to about ``sample_rows`` different texts, taken by a hash of each, and of a rare language up to LEAST_ROWS more.

    Each language has its own threshold, from the number of its different texts, so that none is left out because it is rare, and
    copies of one text count once. The sample is bounded by twice sample_rows and LEAST_ROWS for each language. Rows with a null
    language or without a letter don't count. Without any such row there is no network.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(has_letter(F.col("text"))).withColumn("h", F.xxhash64("text"))
    totals = {r.lang: r.n for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    share = {lang: min(1.0, max(sample_rows / sum(totals.values()), LEAST_ROWS / n)) for lang, n in totals.items()}
    limit = F.create_map(*(x for lang, part in share.items() for x in (F.lit(lang), F.lit(int((1 << 30) * part)))))
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) < limit[F.col("lang")])
    n = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda j: F.substr(F.col("text"), (F.floor(F.greatest(n - WINDOW // 2, F.lit(0)) * j / SAMPLE_WINDOWS) + 1).cast("int"), F.lit(WINDOW)))
    sample = rows.select("lang", "h", pieces.alias("pieces")).dropDuplicates(["lang", "h"]).select("lang", "pieces").limit(2 * sample_rows + LEAST_ROWS * len(totals)).collect()
    if not sample:
        return None
    classes = sorted({r.lang for r in sample})
    x, y = [], []
    for r in sorted(sample):
        for piece in dict.fromkeys(r.pieces):
            data = np.frombuffer(piece.encode()[:WINDOW], np.uint8)
            x.append(np.pad(data, (0, WINDOW - len(data))))
            y.append(classes.index(r.lang))
    return train(np.array(x), np.array(y), classes)


def _judge(net: ByteNet | None, tables: list[np.ndarray] | None, column: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language (index into classes, -1: unknown) and score of each text."""
    n = len(column)
    best, score = np.full(n, -1), np.zeros(n)
    if net is None:
        return best, score
    for lo, hi, data, offsets in text_slices(column):
        owner, start, held = _windows(offsets)
        total = np.zeros((hi - lo, len(net.classes)))
        for i in range(0, len(owner), BATCH):
            some = slice(i, i + BATCH)
            np.add.at(total, owner[some], net.probabilities(_spell(data, start[some], held[some]), tables) * held[some, None])
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
        best[lo:hi], score[lo:hi] = total.argmax(axis=1), np.minimum(total.max(axis=1), 1)
    best[~letters], score[~letters] = -1, 0
    return best, score


def identify(docs: DataFrame, net: ByteNet | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of docs with lang_pred and score, in place of any of these names.

    The whole text counts: every window's probabilities, weighted by its bytes. lang_pred is ``und`` with score 0 if the text is
    null, empty or without a letter, or if there is no network. Repeated rows each get their row; other columns are not read.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        names = [*(net.classes if net else []), UNKNOWN]
        for batch in batches:
            best, score = _judge(net, tables, batch.column(0), np.asarray(batch.column(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array([names[i] for i in best], pa.string()), pa.array(score)], names=[*(f"c{i}" for i in range(len(keep))), "lang_pred", "score"])

    text = F.col(text_col)
    held = docs.select(text.alias("text"), has_letter(text).alias("letters"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    out = map_arrow(held, predict, ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "lang_pred string, score double"]))
    return out.toDF(*keep, "lang_pred", "score")


def keep_identified(docs: DataFrame, net: ByteNet | None, least: float) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a letter and a language of score ``least`` or more.

    Without a network only texts without a letter go.
    """
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in batches:
            _, score = _judge(net, tables, batch.column(at), np.ones(batch.num_rows, bool))
            yield batch.filter(pa.array(score >= least)) if net else batch

    return map_arrow(docs.where(has_letter(F.col("text"))), keep, docs.schema)
