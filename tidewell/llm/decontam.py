"""Benchmark decontamination by Wu-Manber search for many patterns at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import PIECE_BYTES, map_arrow, materialise, run_hashes, text_slices, word_bounds

#: Words of a window; a benchmark item with fewer is one window.
WINDOW = 10
#: Benchmark text that one block of patterns is made from, and the bound on what is broadcast at once: a larger benchmark is searched in passes.
BLOCK_BYTES = 4 << 20
SENT_BYTES = 64 << 20
#: Blocks whose tables a worker keeps, and the text that it reads before it goes through the blocks of a benchmark with more.
KEPT_BLOCKS = 2
HELD_BYTES = 32 << 20
#: Patterns of similar length are searched together, since the shortest decides how far a search may skip.
LENGTH_CLASSES = (1, 12, 28)
#: Bytes that each cursor of a search covers.
STRIDE = 2048
TABLE_BITS = 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[0x00:0x30] = False
_WORD[0x3A:0x61] = False
_WORD[0x7B:0x80] = False
_WORD[65:91] = True


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as " word word ... word ": their bytes and offsets, the place of each word, and each text's first word.

    A long text, which is a slice of its own, is gone through in pieces that end between words.
    """
    if len(data) <= PIECE_BYTES or len(offsets) != 2:
        return _folded(data, offsets)
    parts, places, at, done = [np.full(1, 0x20, np.uint8)], [], 0, 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data) and _WORD[data[end - 1]]:
            gap = np.flatnonzero(~_WORD[data[end : end + PIECE_BYTES]])
            end = end + int(gap[0]) + 1 if len(gap) else min(end + PIECE_BYTES, len(data))
        text, _, place, _ = _folded(data[at:end], np.array([0, end - at]))
        parts.append(text[1:])
        places.append(place + done)
        at, done = end, done + len(text) - 1
    places = np.concatenate(places)
    return np.concatenate(parts), np.array([0, done + 1]), places, np.array([0, len(places)])


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(_WORD[data], offsets)
    words = np.diff(first)
    # one blank follows each word and one precedes each text, also a text without words
    lengths = ends - starts + 1
    text_of = np.repeat(np.arange(len(words)), words)
    ahead = np.concatenate([[0], np.cumsum(lengths)])
    places = ahead[:-1] + text_of + 1
    total = int(ahead[-1]) + len(words)
    out = np.full(total, 0x20, np.uint8)
    size = ends - starts
    if len(size):
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(places, size) + within] = _FOLD[data[np.repeat(starts, size) + within]]
    bounds = np.concatenate([ahead[first[:-1]] + np.arange(len(words)), [total]])
    return out, bounds, places, first


class Windows:
    """The distinct windows of benchmark items as stretches of one text, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw = [t.encode() for _, t in items]
        self.names = [i for i, _ in items]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        text, edges, places, first = _folded(np.frombuffer(b"".join(raw), np.uint8), bounds)
        words = np.diff(first)
        each = np.where(words > 0, np.maximum(words - window + 1, 1), 0)
        owner = np.repeat(np.arange(len(words)), each)
        at = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        last = at + np.minimum(words[owner], window)
        # from the blank before the first word to the one after the last, which is before the next word or ends the text
        ends = np.where(last < first[1:][owner], np.append(places, 0)[np.minimum(last, len(places))], edges[1:][owner])
        starts = places[at] - 1 if len(at) else at
        # windows overlap, which run_hashes() does not take: every window-th of an item is apart from the others
        code = np.empty(len(at), np.uint64)
        phase = (np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)) % max(window, 1)
        for k in range(min(window, int(phase.max()) + 1 if len(phase) else 0)):
            some = phase == k
            code[some] = run_hashes(text, starts[some] + 1, ends[some])
        _, where, number = np.unique(code, return_index=True, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.text, self.raw = text, text.tobytes()
        self.starts, self.ends, self.words = starts[where], ends[where], last[where] - at[where]
        self.owners, self.owner_at = owner[order], np.searchsorted(number[order], np.arange(len(where) + 1))

    def items(self, window: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.owner_at[window] : self.owner_at[window + 1]].tolist()]


class WuManber:
    """Patterns with block shift tables and suffix buckets; ``find`` moves one cursor per stretch of text, all in step.

    All tables are arrays: of the patterns, stretches of ``windows``, in the order of their suffixes.
    """

    def __init__(self, windows: Windows, some: np.ndarray):
        self.windows = windows
        starts = windows.starts[some]
        self.reach = int((windows.ends[some] - starts).min())
        self.block = min(8, max(1, self.reach // 2))
        most = self.reach - self.block + 1
        padded = np.concatenate([windows.text, np.zeros(8, np.uint8)])
        self.shift = np.full(1 << TABLE_BITS, most, np.int64)
        for at in range(most):  # the block that ends at + block bytes into the pattern
            suffixes = self._keys(padded, starts + at)
            np.minimum.at(self.shift, self._slot(suffixes), most - 1 - at)
        order = np.argsort(suffixes, kind="stable")
        self.patterns, self.suffixes = some[order], suffixes[order]

    def _keys(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The block of bytes at each place."""
        blocks = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
        return np.ascontiguousarray(blocks[at]).view("<u8")[:, 0] & np.uint64((1 << 8 * self.block) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, data: np.ndarray, raw: bytes) -> list[tuple[int, int]]:
        """(start, window) of every occurrence in the text, which raw repeats."""
        n = len(data)
        if n < self.reach:
            return []
        last, tail = n - self.reach, self.reach - self.block
        cursor = np.arange(0, last + 1, STRIDE)
        stop = np.minimum(cursor + STRIDE, last + 1)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        found = []
        while len(cursor):
            keys = self._keys(padded, cursor + tail)
            step = self.shift[self._slot(keys)]
            if not step.all():
                hit = step == 0
                at, suffix = cursor[hit], keys[hit]
                low, high = np.searchsorted(self.suffixes, suffix), np.searchsorted(self.suffixes, suffix, "right")
                sure = low < high
                found += zip(at[sure].tolist(), low[sure].tolist(), high[sure].tolist(), strict=True)
                step = np.maximum(step, 1)
            cursor = cursor + step
            more = cursor < stop
            if not more.all():
                cursor, stop = cursor[more], stop[more]
        w, out = self.windows, []
        for start, low, high in found:
            for i in self.patterns[low:high].tolist():
                if raw.startswith(w.raw[w.starts[i] : w.ends[i]], start):
                    out.append((start, i))
        return out


def _machines(items: list[tuple[str, str]], window: int) -> tuple[Windows, list[WuManber]]:
    windows = Windows(items, window)
    length = windows.ends - windows.starts
    kinds = [np.flatnonzero((length >= low) & (length < high)) for low, high in zip(LENGTH_CLASSES, [*LENGTH_CLASSES[1:], 1 << 60], strict=True)]
    return windows, [WuManber(windows, k) for k in kinds if len(k)]


#: Tables that this worker has built, by the broadcast's name, block and window: a worker serves many tasks.
_built: dict[tuple[str, int, int], tuple[Windows, list[WuManber]]] = {}


def _tables(sent: Broadcast, block: int, window: int) -> tuple[Windows, list[WuManber]]:
    name, blocks = sent.value
    key = (name, block, window)
    if key not in _built:
        while len(_built) >= KEPT_BLOCKS:
            _built.pop(next(iter(_built)))
        _built[key] = _machines(blocks[block], window)
    return _built[key]


def _passes(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, sent_bytes: int) -> Iterator[list[list[tuple[str, str]]]]:
    """The items in blocks, as many at a time as may be broadcast; none, once, if there are no items."""
    blocks, block, size, total, any_sent = [], [], 0, 0, False
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item_id, text in rows.toLocalIterator():
        block.append((item_id, text))
        size += len(text.encode())
        if size >= block_bytes:
            blocks, block, total, size = [*blocks, block], [], total + size, 0
        if total >= sent_bytes:
            yield blocks
            blocks, total, any_sent = [], 0, True
    if block:
        blocks.append(block)
    if blocks or not any_sent:
        yield blocks


class _Found:
    """What occurs in the texts of one slice."""

    def __init__(self, n: int, form: tuple[np.ndarray, ...]):
        self.text, self.bounds, self.places, self.first = form
        self.hit = np.zeros(len(self.places) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(n)]

    def search(self, windows: Windows, machines: list[WuManber]) -> None:
        raw = self.text.tobytes()
        for machine in machines:
            for start, i in machine.find(self.text, raw):
                word = int(np.searchsorted(self.places, start + 1))
                self.hit[word] += 1
                self.hit[word + int(windows.words[i])] -= 1
                self.items[int(np.searchsorted(self.bounds, start, "right")) - 1].update(windows.items(i))

    def spans(self) -> list[list[dict[str, int]]]:
        on, out = (np.cumsum(self.hit)[:-1] > 0).astype(np.int64), []
        for a, b, some in zip(self.first[:-1], self.first[1:], self.items, strict=True):
            edge = np.diff(np.concatenate([[0], on[a:b], [0]])) if some or self.hit[a:b].any() else np.zeros(0, np.int64)
            out.append([{"first": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
        return out


def _searched(batches: Iterator[pa.RecordBatch], at: int, sent: Broadcast, blocks: int, window: int) -> Iterator[tuple[pa.RecordBatch, int, int, _Found]]:
    """(batch, lo, hi, found) of each slice of the texts in column ``at``. Few slices are held at once: one where tables are kept, HELD_BYTES of text else."""

    def work(held: list[tuple[pa.RecordBatch, int, int, _Found]]) -> list[tuple[pa.RecordBatch, int, int, _Found]]:
        for block in range(blocks):
            tables = _tables(sent, block, window)
            for *_, found in held:
                found.search(*tables)
        return held

    held, size = [], 0
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(at)):
            held.append((batch, lo, hi, _Found(hi - lo, folded(data, offsets))))
            size += len(data)
            if blocks <= KEPT_BLOCKS or size >= HELD_BYTES:
                yield from work(held)
                held, size = [], 0
    yield from work(held)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, sent_bytes: int = SENT_BYTES
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids of items with an occurring window) and hit_spans.

    A window is ``window`` consecutive words of an item, words being ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing
    A-Z; an item with fewer words is one window, an item without words or with a null text has none. A document's word
    is hit if it lies in any occurrence of a window. hit_spans holds [first word, end word) of the merged hits.
    A null or empty text has no words. Repeated documents each get their row; columns other than the two named are
    not read. An empty benchmark hits nothing.

    The benchmark is the stated query set. It is broadcast up to SENT_BYTES, in blocks of ``block_bytes`` of which a worker keeps few
    tables; a larger one is searched in passes, each of which writes the few texts that it hits, by their digest. Documents are
    never shuffled but to meet these hits where there is more than one pass.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    passes = _passes(benchmark, item_col, item_text_col, block_bytes, sent_bytes)
    blocks = next(passes)
    later = next(passes, None)
    if later is None:
        return map_arrow(docs, _scanner(docs, blocks, window, False), f"id {kind}, {_FOUND}").withColumnRenamed("id", id_col)
    docs, hits = docs.select("id", "text", F.md5("text").alias("digest")), None
    texts = docs.select("digest", "text")
    while blocks is not None:
        found = materialise(map_arrow(texts, _scanner(docs, blocks, window, True), f"digest string, {_FOUND}"))
        hits = found if hits is None else hits.union(found)
        blocks, later = later, next(passes, None)
    hits = hits.dropDuplicates(["digest", "items", "hit_spans"])
    # of all the passes' spans of a text, those that touch or overlap are one
    merge = lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["first"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["first"].alias("first"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s)))
    spans = F.aggregate(F.array_sort(F.flatten(F.collect_list("hit_spans"))), F.array().cast(_SPANS), merge)
    hits = hits.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), spans.alias("hit_spans"))
    counts = map_arrow(docs, _scanner(docs, [], window, False), f"id {kind}, {_FOUND}, digest string")
    out = counts.drop("n_hit", "items", "hit_spans").withColumn("key", F.coalesce("digest", F.md5(F.concat(F.lit("none"), F.col("id").cast("string"))), F.lit(""))).join(hits.withColumnRenamed("digest", "key"), "key", "left")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    out = out.select("id", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hit_spans", F.array().cast(_SPANS)).alias("hit_spans"))
    return out.withColumnRenamed("id", id_col)


_SPANS = "array<struct<first: bigint, end: bigint>>"
_FOUND = "n_words long, n_hit long, items array<string>, hit_spans array<struct<first: long, end: long>>"


def _scanner(docs: DataFrame, blocks: list[list[tuple[str, str]]], window: int, hit_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the columns (name, text, ...), a row of name, _FOUND, ... for each text, or for each in which something occurs."""
    sent, n = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, blocks)), len(blocks)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, found in _searched(batches, 1, sent, n, window):
            spans = found.spans()
            columns = [np.diff(found.first), [sum(s["end"] - s["first"] for s in x) for x in spans], [sorted(x) for x in found.items], spans]
            rest = batch.slice(lo, hi - lo)
            out = pa.RecordBatch.from_arrays([rest.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *rest.columns[2:]], names=[rest.schema.names[0], "n_words", "n_hit", "items", "hit_spans", *rest.schema.names[2:]])
            yield out.filter(pa.array([bool(s) for s in spans])) if hit_only else out

    return scan


def contamination_digest(found: DataFrame) -> DataFrame:
    """find_contamination() with the items as their number and the SHA-256 of their ids, comma-joined."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns.

    The verdict is made in the same pass as the rows are read: a document is never joined back by its id. Null and empty texts
    stay, and so do all if the benchmark is empty. A benchmark over SENT_BYTES takes a pass for each part of it.
    """
    at, first = docs.columns.index(text_col), True
    for blocks in _passes(benchmark, item_col, item_text_col, block_bytes, sent_bytes):
        docs = map_arrow(docs if first else materialise(docs), _filter(docs, blocks, at), docs.schema)
        first = False
    return docs


def _filter(docs: DataFrame, blocks: list[list[tuple[str, str]]], at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    sent, n = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, blocks)), len(blocks)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, found in _searched(batches, at, sent, n, WINDOW):
            yield batch.slice(lo, hi - lo).filter(pa.array([not x for x in found.items], pa.bool_()))

    return keep
