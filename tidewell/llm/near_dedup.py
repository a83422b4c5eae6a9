"""MinHash near-deduplication whose table keys combine pairs from two smaller collections of hashes (tensored banding)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_arrow, materialise, mix64, shingle_hashes, text_slices, word_hashes
from tidewell.llm.components import connected_components
from tidewell.session import ship

#: MinHash values of half a key, and the chance to miss a pair at the threshold itself.
HALF = 3
MISS = 1e-4
#: Members of a table on one side of a comparison in blocks, and shingles that are compared at once.
BLOCK = 128
SHINGLE_BLOCK = 8192


def collection_size(percent: int, half: int = HALF, miss: float = MISS) -> int:
    """Half keys of each collection.

    A pair of similarity s meets in a table if it agrees in a half key of the one collection and in one of the other: with chance
    (1 - (1 - s^half)^m)^2. 2 * m * half hashes give m * m tables.
    """
    return math.ceil(math.log(miss / 2) / math.log(1 - (percent / 100) ** half))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def _half_keys(shingles: np.ndarray, starts: np.ndarray, m: int, half: int) -> np.ndarray:
    """For each of the texts that begin at starts, its 2 * m half keys."""
    factors, terms = _functions(2 * m * half)
    out = np.empty((len(starts), 2 * m), np.uint64)
    buffer = np.empty_like(shingles)
    for i in range(2 * m):
        key = np.full(len(starts), np.uint64(i + 1))
        for j in range(i * half, (i + 1) * half):
            np.multiply(shingles, factors[j], out=buffer)
            np.add(buffer, terms[j], out=buffer)
            key = mix64(key ^ np.minimum.reduceat(buffer, starts))
        out[:, i] = key
    return out


def signatures(docs: DataFrame, words: int, m: int, half: int) -> DataFrame:
    """doc_id, n_shingles, digest (16 bytes that name the set of shingles), and the half keys a and b; null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                hashes, first = word_hashes(data, offsets)
                shingles, bounds = shingle_hashes(hashes, first, words)
                counts, digests = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    if a == b:
                        counts.append(0)
                        digests.append(None)
                        continue
                    each = np.unique(shingles[a:b])
                    counts.append(len(each))
                    digests.append(np.array([each.sum(dtype=np.uint64), mix64(each ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes())
                some = np.diff(bounds) > 0
                keys = _half_keys(shingles, bounds[:-1][some], m, half).view(np.int64) if some.any() else np.zeros((0, 2 * m), np.int64)
                at = np.concatenate([[0], np.cumsum(some)]) * m
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.ascontiguousarray(part).ravel())) for part in (keys[:, :m], keys[:, m:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), *lists], names=["doc_id", "n_shingles", "digest", "a", "b"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), sign, "doc_id long, n_shingles long, digest binary, a array<long>, b array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node (the doc_id) and the whole set of a text's shingle hashes, sorted, as bytes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                hashes, first = word_hashes(data, offsets)
                shingles, bounds = shingle_hashes(hashes, first, words)
                sets = [np.unique(shingles[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), gather, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= percent * union."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["u", "v"])

    left, right = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"set_{n}")) for n in ("u", "v"))
    return map_arrow(pairs.join(left, "u").join(right, "v").select("u", "v", "set_u", "set_v"), verify, "u long, v long")


def _links_left(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of one table that are in different components.

    members: key, ka (the half of the key from the first collection), node, component, without the tables' smallest nodes, which
    have been compared with the others. Tables of one half are taken together. In each, the members outside of its smallest
    component make up the left side and all members the right side; both are dealt into blocks of about BLOCK, and each pair
    of blocks is worked on by itself: a row for each member and opposite block is sent, never one for each pair of members.
    """
    open_keys = materialise(members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key"))
    rest = materialise(members.join(open_keys, "key", "left_semi").select("ka", "node", "component").distinct())
    sizes = materialise(rest.groupBy("ka").agg(F.min("component").alias("main"), F.count("*").alias("n")))
    rest = materialise(rest.join(sizes, "ka"))
    others = materialise(rest.where("component <> main").groupBy("ka").agg(F.count("*").alias("m")))
    rest = materialise(rest.join(others, "ka"))
    left_of, right_of = F.ceil(F.col("m") / BLOCK), F.ceil(F.col("n") / BLOCK)
    left = rest.where("component <> main").select("ka", F.pmod(F.xxhash64("node"), left_of).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), right_of - 1)).alias("y"), F.lit(True).alias("is_left"), "node", "component")
    right = rest.select("ka", F.explode(F.sequence(F.lit(0).cast("long"), left_of - 1)).alias("x"), F.pmod(F.xxhash64("node", F.lit(1)), right_of).alias("y"), F.lit(False).alias("is_left"), "node", "component")

    def compare(table: pa.Table) -> pa.Table:
        side = np.asarray(table["is_left"].combine_chunks())
        node, component = (table[c].to_numpy() for c in ("node", "component"))
        members = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["shingles"]]
        rows, columns = np.flatnonzero(side), np.flatnonzero(~side)
        size = np.array([len(x) for x in members])
        common = np.zeros((len(rows), len(columns)), np.float32)
        known = np.unique(np.concatenate([members[i] for i in rows] or [np.zeros(0, np.uint64)]))
        for lo in range(0, len(known), SHINGLE_BLOCK):
            some = known[lo : lo + SHINGLE_BLOCK]

            def spread(which: np.ndarray, some: np.ndarray = some) -> np.ndarray:
                out = np.zeros((len(which), len(some)), np.float32)
                for k, i in enumerate(which):
                    x = members[i]
                    x = x[np.searchsorted(x, some[0]) : np.searchsorted(x, some[-1], "right")]
                    at = np.searchsorted(some, x)
                    out[k, at[some[at] == x]] = 1
                return out

            common += spread(rows) @ spread(columns).T
        union = size[rows][:, None] + size[columns][None, :] - common
        good = (100 * common.astype(np.float64) >= percent * union) & (component[rows][:, None] != component[columns][None, :])
        r, c = np.nonzero(good)
        u, v = node[rows][r], node[columns][c]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    ship(members.sparkSession)
    work = left.union(right).join(sets, "node").select("ka", "x", "y", "is_left", "node", "component", "shingles")
    return work.groupBy("ka", "x", "y").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", half: int = HALF) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable over links) and kept.

    A document's set holds the distinct shingles of ``words`` words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with fewer words,
    all of them as one shingle; a null text or one without words has no shingle and is linked with nothing. Documents are
    linked if 100 * intersection >= percent * union. Ids are integers; rows of one id stand for one document. A row with a null
    id is linked with nothing, has a null component_id and is kept. No rows give no rows. Only the two columns named are read.

    Documents of equal sets are one node. Nodes meet where they share a half key of the first collection, and of these only
    where they share one of the second also. In each table a node is compared with the table's smallest node, by whole sets;
    then every pair of a table that is in different components still and that has not been compared is compared as well. So
    groups of copies cost one comparison for each copy, while no link between components that met is lost.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    m = collection_size(percent, half)
    signed = materialise(signatures(docs, words, m, half))
    classes = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = materialise(classes)

    first = classes.select("node", F.explode("a").alias("ka"))
    # what is summed by a key is written before it is joined by it: such a join can be split where a key is hot
    shared = materialise(first.groupBy("ka").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("ka"))
    met = first.join(shared, "ka", "left_semi").join(classes.select("node", "b"), "node")
    tables = met.select("node", "ka", F.explode("b").alias("kb")).select(F.xxhash64("ka", "kb").alias("key"), "ka", "node")
    heads = materialise(tables.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("y")).where("head < y").select("key", "head"))
    members = materialise(tables.join(heads, "key").where("node <> head"))

    pairs = materialise(members.select(F.col("head").alias("u"), F.col("node").alias("v")).distinct())
    nodes = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
    sets = materialise(shingle_sets(docs.join(nodes, "doc_id", "left_semi"), words))
    links = materialise(confirmed(pairs, sets, percent))
    found = materialise(connected_components(links))

    own = lambda c: F.coalesce("component", F.col(c)).alias("component")
    late = materialise(_links_left(members.join(found, "node", "left").select("key", "ka", "node", own("node")), sets, percent))
    if not late.isEmpty():
        found = materialise(connected_components(links.union(late)))

    by_class = classes.select("digest", "node").join(found, "node", "left").select("digest", own("node"))
    out = signed.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    # rows without words have no digest: they pass by the join, which would hold them all in one task
    out = out.unionByName(signed.where("digest IS NULL").select("doc_id", "n_shingles", "digest", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns; of rows with one id, one stays.

    Rows with a null id stay. Which of several rows of one id stays is open if they differ.
    """
    judged = materialise(near_duplicates(docs, words, percent))
    gone = judged.where("NOT kept").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = judged.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialise(again)
    if again.isEmpty():
        return out
    once = out.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return out.join(again, "doc_id", "left_anti").select(docs.columns).union(once)
