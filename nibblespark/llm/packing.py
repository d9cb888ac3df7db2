"""Best-fit packing by patterns of lengths.

The driver sees only the histogram of piece lengths (as many numbers as a sequence has tokens). Patterns of
few documents, on lengths rounded up to a grid, are fitted to it by non-negative least squares; their
repeat counts are rounded and filled with exact lengths, as far as there are any. What is left goes best-fit, longest first,
into the smallest gap that takes it, else into new sequences. The result is a list of runs: so many
pieces of one length, at one offset of consecutive sequences. Pieces are numbered within their length and
look up their run; this numbering is the only shuffle, and it carries no text.

Null text: an empty one, so a piece of the end id alone. Null ids and repeated rows are packed as rows of
their own. An empty table has no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _tokens
from ._common import materialise, small_batches

LIMIT, END_ID = 4096, 1
#: The grid has so many steps to a sequence; patterns have so many documents, and waste so many steps at most.
STEPS, FEW, WASTE = 64, 4, 1


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by cyclic coordinate descent."""
    gram, rhs = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    grad = -rhs
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(x)):
            new = max(0.0, x[j] - grad[j] / gram[j, j])
            if new != x[j]:
                grad += gram[:, j] * (new - x[j])
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 0.5:
            break
    return x


def patterns(present: list[int], steps: int = STEPS, few: int = FEW, waste: int = WASTE) -> list[tuple[int, ...]]:
    """Multisets of at most ``few`` grid lengths that fill a sequence up to ``waste`` steps."""
    return [p for n in range(1, few + 1) for p in combinations_with_replacement(present, n) if steps - waste <= sum(p) <= steps]


def plan(histogram: np.ndarray, limit: int = LIMIT) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset, pieces to a sequence) and the number of sequences.

    ``histogram[n]`` is the number of pieces of n tokens.
    """
    left = histogram.astype(np.int64).copy()
    groups: list[list] = []  # [sequences, tokens used, [(length, times)]]
    if left[limit]:
        groups.append([int(left[limit]), limit, [(limit, 1)]])
        left[limit] = 0
    step = max(1, limit // STEPS)
    by_bin = {k: [n for n in range((k - 1) * step + 1, min(k * step, limit - 1) + 1) if left[n]][::-1] for k in range(1, STEPS + 1)}
    present = [k for k, v in by_bin.items() if v and k >= 4]
    found = patterns(present)
    if found:
        bins = {k: i for i, k in enumerate(present)}
        a = np.zeros((len(present), len(found)))
        for j, p in enumerate(found):
            for k in p:
                a[bins[k], j] += 1
        x = nnls(a, np.array([left[by_bin[k]].sum() for k in present], float))
        for j in np.argsort(-x):
            repeat = int(x[j] + 0.5)
            while repeat:
                lengths = []
                for k in found[j]:  # the longest that are left of each grid length
                    fit = next((n for n in by_bin[k] if left[n] > lengths.count(n)), None)
                    if fit is None:
                        break
                    lengths.append(fit)
                if len(lengths) < len(found[j]):
                    break
                times = {n: lengths.count(n) for n in lengths}
                take = min([repeat, *(int(left[n]) // t for n, t in times.items())])
                for n, t in times.items():
                    left[n] -= take * t
                groups.append([take, sum(lengths), sorted(times.items(), reverse=True)])
                repeat -= take
    gaps: dict[int, list[int]] = {}
    order: list[int] = []

    def free(g: int) -> None:
        gap = limit - groups[g][1]
        if gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append(g)

    for g in range(len(groups)):
        free(g)
    for n in range(limit - 1, 0, -1):
        count = int(left[n])
        while count:
            i = bisect_left(order, n)
            if i == len(order):
                each = limit // n
                full, rest = divmod(count, each)
                for sequences, times in ((full, each), (1, rest)):
                    if sequences and times:
                        groups.append([sequences, n * times, [(n, times)]])
                        free(len(groups) - 1)
                break
            gap = order[i]
            g = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            each = min(gap // n, count)
            sequences = min(groups[g][0], count // each)
            if sequences < groups[g][0]:  # part of the group stays as it is
                groups.append([groups[g][0] - sequences, groups[g][1], list(groups[g][2])])
                free(len(groups) - 1)
                groups[g][0] = sequences
            groups[g][1] += n * each
            groups[g][2].append((n, each))
            count -= sequences * each
            free(g)
    runs, rank, base = [], np.zeros(limit + 1, np.int64), 0
    for sequences, _, slots in groups:
        offset = 0
        for n, times in slots:
            runs.append((n, int(rank[n]), sequences * times, base, offset, times))
            rank[n] += sequences * times
            offset += n * times
        base += sequences
    return sorted(runs), base


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece, and ``at``, a number for each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokens.encoder(tokenizer, False).encode
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), encode([t or "" for t in b.column("text").to_pylist()])):
                raw += end
                for k, i in enumerate(range(0, len(raw), 4 * limit)):
                    part = raw[i : i + 4 * limit]
                    rows.append((doc_id, k, i // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    cut = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return materialise(cut.withColumn("at", F.monotonically_increasing_id()), "pieces")


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces that have ``length`` and ``at``."""
    spark = cut.sparkSession
    part = F.shiftright("at", 33)
    counts = cut.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"))
    histogram = np.zeros(limit + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``limit`` rows
        histogram[r["length"]] = r["n"]
    runs, _ = plan(histogram, limit)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("part", "length").orderBy("at"))
    ranked = cut.withColumn("part", part).withColumn("rank", rank - 1).join(before, ["part", "length"])
    ranked = ranked.select(*cut.columns, (F.col("before") + F.col("rank")).alias("rank"))
    table = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 6))  # its size hangs on the limit, not on the corpus

    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = table.value
        top = int((r[:, 1] + r[:, 2]).max()) + 1 if len(r) else 1
        keys = r[:, 0] * top + r[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            n, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = r[np.searchsorted(keys, n * top + k, "right") - 1]
            local = k - at[:, 1]
            sequence = at[:, 3] + local // at[:, 5]
            offset = at[:, 4] + local % at[:, 5] * n
            keep = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, tokenizer, limit, end_id), limit).drop("at")
