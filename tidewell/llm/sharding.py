"""Shards of near-equal bytes: a minimax contiguous partition of ordered atomic groups, with DataFrame functions only.

The driver holds sums of ranges of groups, never the groups: 65,536 ranges at first, of which only those are split further that
a cut may fall into.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialise

#: Bits of a group's key, of the first ranges, and by which a range is split.
KEY_BITS, FIRST_BITS, MORE_BITS = 60, 16, 8
#: Hex digits that deal a shard's documents into buckets to number them.
BUCKET_DIGITS = 3


class _Ladder:
    """Sums of sizes up to known keys; what lies between two of these is one group ("atomic") or can be looked into."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.ranges = self._ranges(KEY_BITS - FIRST_BITS, None, 0)
        self._index()

    def _ranges(self, shift: int, cells: list[int] | None, parent_shift: int) -> list[tuple[int, int, int, bool]]:
        rows = self.groups if cells is None else self.groups.where(F.shiftright("key", parent_shift).isin(cells))
        sums = rows.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.min("key").alias("key"), F.sum("size").alias("size"), F.count("*").alias("n"))
        return sorted((r.key, r.size, shift, r.n == 1) for r in sums.collect())

    def _index(self) -> None:
        self.ranges.sort()
        self.sums = [0, *accumulate(size for _, size, _, _ in self.ranges)]
        self.total = self.sums[-1]

    def split(self, touched: set[int]) -> None:
        by_shift: dict[int, list[int]] = {}
        for i in touched:
            key, _, shift, _ = self.ranges[i]
            by_shift.setdefault(shift, []).append(key >> shift)
        rest = [r for i, r in enumerate(self.ranges) if i not in touched]
        for shift, cells in by_shift.items():
            rest += self._ranges(max(0, shift - MORE_BITS), cells, shift)
        self.ranges = rest
        self._index()

    def open_at(self, x: int) -> int | None:
        """The range that x lies within, if it can be split there."""
        i = bisect_right(self.sums, x) - 1
        return None if i >= len(self.ranges) or self.sums[i] == x or self.ranges[i][3] else i

    def floor(self, x: int, touched: set[int]) -> int:
        if (i := self.open_at(x)) is not None:
            touched.add(i)
        return self.sums[bisect_right(self.sums, x) - 1]

    def ceil(self, x: int, touched: set[int]) -> int:
        if (i := self.open_at(x)) is not None:
            touched.add(i)
        return self.sums[min(bisect_left(self.sums, x), len(self.sums) - 1)]

    def chain(self, capacity: int, shards: int, least: bool) -> list[int]:
        """Where greedy filling to ``capacity`` cuts: at known sums (least), or as far as unknown sums might let it come."""
        out, at = [], 0
        for _ in range(shards):
            x = min(at + capacity, self.total)
            at = x if not least and self.open_at(x) is not None else self.sums[bisect_right(self.sums, x) - 1]
            out.append(at)
        return out

    def exact(self, work: Callable[[set[int]], object]) -> object:
        while True:
            touched: set[int] = set()
            out = work(touched)
            if not touched:
                return out
            self.split(touched)


def _smallest(feasible: Callable[[int], bool], low: int, high: int) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity at which the groups (key, size), in the order of key, fit into so many runs, and the keys at which the runs begin.

    Capacity is searched by halving, each value checked by greedy filling. With the capacity found, each cut is the sum nearest
    to its equal share among those that leave both sides feasible (the lower of two). Sizes are 1 or more.
    """
    ladder = _Ladder(groups)
    if ladder.total == 0:
        return 0, []

    def search(touched: set[int]) -> int:
        reach = lambda least: lambda c: ladder.chain(c, shards, least)[-1] == ladder.total
        low = _smallest(reach(False), -(-ladder.total // shards), ladder.total)
        high = _smallest(reach(True), low, ladder.total)
        if low < high:
            for a, b in zip(ladder.chain(low, shards, True), ladder.chain(high, shards, False), strict=True):
                first, last = bisect_right(ladder.sums, a) - 1, bisect_right(ladder.sums, b) - 1
                touched.update(i for i in range(first, min(last + 1, len(ladder.ranges))) if not ladder.ranges[i][3])
        return high

    capacity = ladder.exact(search)

    def cut(touched: set[int]) -> list[int]:
        furthest, nearest, out, at = [0], [ladder.total], [], 0
        for _ in range(shards):
            furthest.append(ladder.floor(min(furthest[-1] + capacity, ladder.total), touched))
            nearest.append(ladder.ceil(max(nearest[-1] - capacity, 0), touched))
        nearest.reverse()
        for k in range(1, shards):
            low, high = max(nearest[k], at), min(furthest[k], ladder.floor(min(at + capacity, ladder.total), touched))
            share = k * ladder.total // shards
            below, above = ladder.floor(share, touched), ladder.ceil(share, touched)
            best = below if share - below <= above - share else above
            at = min(max(best, low), high)
            out.append(at)
        return out

    places = ladder.exact(cut)
    keys = [r[0] for r in ladder.ranges]
    return capacity, [keys[i] if (i := bisect_left(ladder.sums, at)) < len(keys) else 1 << KEY_BITS for at in places]


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ("bytes"), shard, slot, grown_shard (null), and the columns ``carry``.

    Rows of equal texts are a group and stay together; groups are ordered by the leading 60 bits of their text's MD5, null texts
    first. Shards are runs of groups whose largest sum of sizes is as small as can be. slot numbers a shard's rows from 0
    without gaps, in the order of the leading digits of the MD5 of their ids and groups, then ids, then texts; equal rows in any
    order. A null text has size 1 and a null text_crc32. Repeated rows and null ids get their slots like others. Shards may stay
    empty where there are fewer groups. Columns named like one of these are not carried; without ``carry`` only the two columns
    named are read. With it, docs is read twice: it should be a table.
    """
    names = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    carry = [c for c in carry or [] if c not in names]
    key = F.coalesce(F.conv(F.substring(F.md5(F.col(text_col)), 1, KEY_BITS // 4), 16, 10).cast("long"), F.lit(-1).cast("long"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col(text_col)).alias("text_crc32"), key.alias("key"), *([F.struct(*carry).alias("carried")] if carry else []))
    rows = rows if carry else materialise(rows)  # what is carried would be written once more
    _, cuts = minimax_cuts(materialise(rows.groupBy("key").agg(F.sum("size").alias("size"))), shards)
    shard = F.lit(0)
    for at in cuts:
        shard = shard + (F.col("key") >= F.lit(at)).cast("int")
    bucket = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("key").cast("string"))), 1, BUCKET_DIGITS)
    rows = rows.withColumns({"shard": shard, "bucket": bucket})
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "key", "size"))
    out = rows.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + place - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *(["carried"] if carry else []))
    return out.select(*names, "carried.*") if carry else out
