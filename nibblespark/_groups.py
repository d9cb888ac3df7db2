"""Python over whole groups, many of them at once: rows sorted by key go through Arrow batches.

A call for each group would cost milliseconds for a few dozen rows. Here a task holds one batch, what a group
began in the batches before, and ``CELLS`` cells of results (or those of a single group).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells that are computed at once, unless a single group has more.
CELLS = 1 << 18

#: The groups' keys, the first row of each, the group of each row, and the other columns.
Groups = tuple[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Groups]:
    """Batches sorted by their first column, cut anew so that no group is parted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        more = held and b.column(0)[b.num_rows - 1] == held[-1].column(0)[0]
        held.append(b)
        if more and len(_starts(b.column(0))) == 1:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        last = int(_starts(rows.column(0))[-1])
        held = [rows.slice(last)]
        if last:
            yield _grouped(rows.slice(0, last))
    if held:
        yield _grouped(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _starts(key: pa.Array) -> np.ndarray:
    none, value = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (none[1:] != none[:-1])])


def _grouped(rows: pa.RecordBatch) -> Groups:
    starts = _starts(rows.column(0))
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
    return rows.column(0).take(pa.array(starts)), starts, group, [c.to_numpy(zero_copy_only=False) for c in rows.columns[1:]]


def chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of groups with ``CELLS`` cells together at most, or of one group."""
    first, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > first and total + n > CELLS:
            yield first, k
            first, total = k, 0
        total += n
    if len(sizes):
        yield first, len(sizes)


def by_key(rows: DataFrame, f: Callable[[pa.Array, np.ndarray, np.ndarray, list[np.ndarray]], Iterator[list]], schema: str) -> DataFrame:
    """Rows (a whole number as key, other columns) through ``f``, which gets whole groups and gives columns for ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]
    cut = whole_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in cut(batches):
            for out in f(*groups):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    key = rows.columns[0]
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
