"""Sharding by minimax contiguous partition.

Atomic groups are rows of equal text, ordered by a 60-bit digest. The smallest feasible shard capacity is
found by binary search; a capacity is checked greedily, shard after shard, and the cuts are made there.
The driver never sees all groups: it holds prefix sums over ranges of the digest, decides a check from the
bounds that the ranges give, and splits only those ranges that leave a check open. A split costs one job
and at most ``FANOUT`` rows for each open range, whatever the corpus.

A row's shard is then the number of cuts at or below its digest: no join, and no shuffle of texts. Groups
heavier than a fair shard get one of their own; the others share the rest evenly under the capacity.

Null text: size 1, as for an empty text, and the same group. Repeated rows are separate rows of one group.
An empty table has no rows. Null ids sort first. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

KEY_BITS, FIRST_BITS, STEP_BITS = 60, 14, 10
FANOUT = 1 << STEP_BITS


def group_key(text: Column) -> Column:
    """The first 60 bits of the text's MD5; equal texts have equal keys."""
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


class PrefixSums:
    """Weights of ordered atomic groups as ranges of keys, split where a question needs it."""

    def __init__(self, weigh: Callable[[list[tuple[int, int]], int], dict[tuple[int, int], tuple[int, bool]]]):
        """``weigh(ranges, bits)``: for sub-ranges (range start, index): their weight and whether one group fills them."""
        self.weigh = weigh
        self.cells = self._cells([(0, KEY_BITS)], FIRST_BITS)
        self._sum()

    def _cells(self, ranges: list[tuple[int, int]], step: int) -> list[list]:
        got: dict[tuple[int, int], list] = {}
        by_width: dict[int, list[int]] = {}
        for start, width in ranges:
            by_width.setdefault(width, []).append(start)
        out = []
        for width, starts in by_width.items():
            narrow = max(width - step, 0)
            found = self.weigh([(s, s + (1 << width) - 1) for s in starts], narrow)
            out += [[k, narrow, w, single] for k, (w, single) in found.items()]
        return sorted(out)

    def _sum(self) -> None:
        self.starts, total = [], 0
        for c in self.cells:
            self.starts.append(total)
            total += c[2]
        self.total = total

    def floor(self, x: int, exact: bool) -> tuple[int, int]:
        """The largest known boundary at most x, and the index of the cell behind it; exact: refine first."""
        i = bisect_right(self.starts, x) - 1
        if self.starts[i] + self.cells[i][2] <= x:
            i += 1
        return (self.total if i >= len(self.cells) else self.starts[i]), i

    def open_at(self, x: int) -> int | None:
        """The cell that hides boundaries around x, if one does."""
        at, i = self.floor(x, False)
        return i if i < len(self.cells) and not self.cells[i][3] and at < x else None

    def refine(self, indices: set[int]) -> None:
        fresh = self._cells([(self.cells[i][0], self.cells[i][1]) for i in indices], STEP_BITS)
        self.cells = sorted([c for i, c in enumerate(self.cells) if i not in indices] + fresh)
        self._sum()


def feasible(sums: PrefixSums, capacity: int, shards: int) -> tuple[bool, bool, set[int]]:
    """Greedy check: feasible at known boundaries, feasible at best, and the cells that leave it open."""
    low = high = 0
    unsure: set[int] = set()
    for _ in range(shards):
        for at in (low, high):
            if at < sums.total and (i := sums.open_at(at + capacity)) is not None:
                unsure.add(i)
        low = sums.floor(low + capacity, False)[0] if low < sums.total else low
        if high < sums.total:
            at, i = sums.floor(high + capacity, False)
            high = at if i >= len(sums.cells) or sums.cells[i][3] else high + capacity
    return low >= sums.total, high >= sums.total, unsure


def minimax(sums: PrefixSums, shards: int) -> int:
    """The smallest capacity by which contiguous runs of groups fit into the shards."""
    lo, hi = -(-sums.total // shards) if sums.total else 0, sums.total
    while lo < hi:
        mid = (lo + hi) // 2
        sure, possible, unsure = feasible(sums, mid, shards)
        if sure:
            hi = mid
        elif not possible:
            lo = mid + 1
        else:
            sums.refine(unsure)
    return lo


def cuts(sums: PrefixSums, capacity: int, shards: int) -> list[int]:
    """Keys at which shards 1, 2, ... start. Each shard aims at a fair share of what is left, within capacity."""
    at, out = 0, []
    for left in range(shards, 1, -1):
        if at >= sums.total:
            break
        while True:
            rest = sums.total - at
            heavy = []
            while True:  # groups above the fair share of the others stand alone
                n = left - len(heavy)
                fair = -(-(rest - sum(heavy)) // max(n, 1))
                more = [c[2] for c, s in zip(sums.cells, sums.starts) if s >= at and c[3] and c[2] > fair]
                if len(more) <= len(heavy) or len(more) >= left:
                    break
                heavy = more
            unsure = {i for x in (at + capacity, at + fair) if (i := sums.open_at(x)) is not None}
            if not unsure:
                break
            sums.refine(unsure)
        near, i = sums.floor(at + fair, True)
        most = sums.floor(at + capacity, True)[0]
        if i < len(sums.cells) and near < at + fair:
            after = near + sums.cells[i][2]
            if near == at or (after <= most and after - at - fair < at + fair - near):
                near = after
        # what is left must fit into the other shards: go on to later boundaries until it does
        while near < most and not _fits(sums, near, capacity, left - 1):
            near = near + sums.cells[sums.floor(near, True)[1]][2]
        at = near
        i = sums.floor(at, True)[1]
        if i < len(sums.cells):
            out.append(sums.cells[i][0])
    return out


def _fits(sums: PrefixSums, at: int, capacity: int, shards: int) -> bool:
    while True:
        unsure, x = set(), at
        for _ in range(shards):
            if x < sums.total:
                if (i := sums.open_at(x + capacity)) is not None:
                    unsure.add(i)
                x = sums.floor(x + capacity, True)[0]
        if x >= sums.total or not unsure:
            return x >= sums.total
        sums.refine(unsure)


def plan(sized: DataFrame, shards: int) -> tuple[list[int], int]:
    """Cut keys and capacity for rows of (key, size)."""
    groups = materialise(sized.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")

    def weigh(ranges: list[tuple[int, int]], bits: int) -> dict[int, tuple[int, bool]]:
        inside = F.lit(len(ranges) == 1 and ranges[0][1] == (1 << KEY_BITS) - 1)
        for lo, hi in ranges:
            inside = inside | F.col("key").between(lo, hi)
        cell = F.shiftleft(F.shiftright("key", bits), bits)
        rows = groups.where(inside).groupBy(cell.alias("cell")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("key").alias("k"))
        out = {}
        for r in rows.collect():  # at most FANOUT rows for each open range
            out[r["k"] if r["n"] == 1 else r["cell"]] = (r["w"], r["n"] == 1)
        return out

    sums = PrefixSums(weigh)
    if not sums.cells:
        return [], 0
    capacity = minimax(sums, shards)
    return cuts(sums, capacity, shards), capacity


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, key, size, text_crc32, shard and slot of every row; slots are gapless in order of doc_id."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", group_key(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    sized = materialise(sized, "shard-sizes")
    starts, _ = plan(sized, shards)
    shard = F.lit(0)
    for s in starts:
        shard = shard + (F.col("key") >= s).cast("int")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = sized.withColumn("shard", shard).repartitionByRange(parts, "doc_id", "key").sortWithinPartitions("doc_id", "key")
    # the running id keeps the order of partitions and of rows in them; written, it stays as it is
    ordered = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n")).collect()  # shards x partitions
    before, seen = [], dict.fromkeys(range(shards), 0)
    for r in sorted(counts, key=lambda r: (r["part"], r["shard"])):
        before.append((r["part"], r["shard"], seen[r["shard"]]))
        seen[r["shard"]] += r["n"]
    offsets = spark.createDataFrame(before, "part long, shard int, before long")
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy("at"))
    ranked = ordered.withColumn("part", part).withColumn("rank", rank)
    joined = ranked.join(F.broadcast(offsets), ["part", "shard"])  # one row for each shard and partition
    return joined.select("doc_id", "key", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """Write the documents as Parquet under ``path``, one folder for each shard, and give back the assignment."""
    spark = docs.sparkSession
    placed = assign(docs, shards)
    starts = {r["shard"]: r["key"] for r in placed.groupBy("shard").agg(F.min("key").alias("key")).collect()}  # one row per shard
    key = group_key(F.coalesce(F.col("text"), F.lit("")))
    shard = F.lit(0)
    ordered = sorted(starts.items())
    for (a, _), (b, k) in zip(ordered, ordered[1:]):
        shard = shard + (key >= k).cast("int") * (b - a)
    docs.withColumn("shard", shard + (ordered[0][0] if ordered else 0)).write.partitionBy("shard").parquet(path)
    return placed
