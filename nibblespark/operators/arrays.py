"""One-dimensional arrays in long form: ``pos`` (from 0, gapless) and ``v``.

A DataFrame is a lazy view: slices and gathers are index arithmetic that Catalyst folds together. Writes
are functional updates. Nothing here gathers an array into one row or one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_positions(df: DataFrame, order: list[str], bucket: Column, name: str = "pos", keys: tuple[str, ...] = ()) -> DataFrame:
    """Number rows in the order of ``order`` without a global window.

    ``bucket`` is a monotone function of the leading order column. Counts of the buckets are summed up (one
    small row each), and rows are numbered inside their bucket, so no task sees more than a bucket.
    """
    rows = df.withColumn("__bucket", bucket)
    counts = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    numbered = rows.withColumn("__inside", inside).join(offsets, [*keys, "__bucket"])
    return numbered.withColumn(name, (F.col("__before") + F.col("__inside") - 1).cast("long")).drop("__bucket", "__inside", "__before")


def range_bucket(df: DataFrame, column: str, parts: int = 64) -> Column:
    """A monotone bucket of a numeric column: how many of some quantiles (``parts`` numbers at most) lie below."""
    edges = sorted({float(x) for x in df.select(F.col(column).cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 1 / (4 * parts))})
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(column)))


def running(df: DataFrame, value: Column, block: Column, order: Column, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative sum in two levels: inside blocks, plus the totals of the blocks before."""
    rows = df.withColumn("__block", block).withColumn("__x", value)
    totals = rows.groupBy(*keys, "__block").agg(F.sum("__x").alias("__total"))
    before = F.sum("__total").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__total")
    inside = F.sum("__x").over(Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__inside", inside).join(totals, [*keys, "__block"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__block", "__x", "__inside", "__before")


def normal_index(i: Column, n: Column) -> Column:
    """Negative indices count from the end; others outside the array raise."""
    at = F.when(i < 0, i + n).otherwise(i)
    return F.when((at >= 0) & (at < n), at).otherwise(F.raise_error(F.lit("index out of range")).cast("long"))


def slice_bounds(start: int | None, stop: int | None, step: int, n: int) -> range:
    return range(n)[slice(start, stop, step)]


def take_slice(a: DataFrame, start: int | None, stop: int | None, step: int, n: int) -> DataFrame:
    """``a[start:stop:step]`` of an array of n elements, numbered anew."""
    r = slice_bounds(start, stop, step, n)
    if not len(r):
        return a.where(F.lit(False))
    lo, hi = min(r[0], r[-1]), max(r[0], r[-1])
    inside = a.where(F.col("pos").between(lo, hi))
    if abs(step) > 1:
        inside = inside.where(F.pmod(F.col("pos") - r[0], F.lit(abs(step))) == 0)
    new = F.col("pos") - r[0] if step == 1 else F.floor((F.col("pos") - r[0]) / step)
    return inside.withColumn("pos", new.cast("long"))


def get(a: DataFrame, i: int, n: int) -> DataFrame:
    if not -n <= i < n:
        raise IndexError("index out of range")
    return a.where(F.col("pos") == i % n)


def gather(a: DataFrame, indices: DataFrame, n: int | None = None, mode: str = "raise") -> DataFrame:
    """Values at (k, i): duplicates and order are kept. Modes: raise, clip, wrap."""
    size = F.lit(n).cast("long") if n is not None else None
    if size is None:
        counted = a.agg(F.count("*").alias("__n"))
        indices = indices.join(F.broadcast(counted))  # one row
        size = F.col("__n")
    i = F.col("i").cast("long")
    at = {"raise": lambda: normal_index(i, size), "clip": lambda: F.greatest(F.lit(0).cast("long"), F.least(size - 1, i)), "wrap": lambda: F.pmod(i, size)}[mode]()
    return indices.select("k", at.alias("pos")).join(a, "pos").select("k", "v")


def scatter(a: DataFrame, updates: DataFrame) -> DataFrame:
    """The array with (step, pos, v) written in order of step: the last write to a place wins."""
    last = updates.groupBy("pos").agg(F.max_by("v", "step").alias("__new"))
    return a.join(last, "pos", "left").select("pos", F.coalesce("__new", "v").alias("v"))


def count_value(a: DataFrame, value: int, name: str = "n") -> DataFrame:
    return a.agg(F.count_if(F.col("v") == value).alias(name))


def find(a: DataFrame, needle: list[int], block: int = 4096, name: str = "at") -> DataFrame:
    """Place of the first occurrence of ``needle``, or -1. An empty needle is at 0.

    Elements meet by start: element at p is symbol p - s of the needle that starts at s, for the places s
    where it is the right symbol. A start with all symbols is an occurrence.
    """
    if not needle:
        return a.agg(F.lit(0).cast("long").alias(name))
    wanted = F.array(*(F.lit(x) for x in needle))
    starts = F.filter(F.transform(wanted, lambda x, j: F.when(x == F.col("v"), F.col("pos") - j)), lambda s: s.isNotNull() & (s >= 0))
    hits = a.where(F.col("v").isin(needle)).select(F.explode(starts).alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") == len(needle))
    return hits.agg(F.coalesce(F.min("s"), F.lit(-1)).cast("long").alias(name))


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Places where two arrays differ, an absent element included."""
    left, right = a.select("pos", F.col("v").alias("x")), b.select("pos", F.col("v").alias("y"))
    return left.join(right, "pos", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))


def equals(a: DataFrame, b: DataFrame) -> DataFrame:
    return mismatches(a, b).agg((F.count("*") == 0).alias("equal"))


def binary(a: DataFrame, b: DataFrame, f, keys: tuple[str, ...] = ("pos",)) -> DataFrame:
    """f(x, y) of elements at the same index."""
    left, right = a.withColumnRenamed("v", "__x"), b.withColumnRenamed("v", "__y")
    return left.join(right, list(keys)).select(*keys, f(F.col("__x"), F.col("__y")).alias("v"))


def concat(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Arrays one after the other; each comes with its length."""
    out, offset = [], 0
    for a, n in parts:
        out.append(a.select((F.col("pos") + offset).alias("pos"), "v"))
        offset += n
    return reduce(DataFrame.unionByName, out)


def to_rows(a: DataFrame, width: int) -> DataFrame:
    """Long form to rows of at most ``width`` values."""
    by = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return a.groupBy(F.floor(F.col("pos") / width).cast("long").alias("row")).agg(F.transform(by, lambda x: x["v"]).alias("vals"))


def to_long(rows: DataFrame, width: int) -> DataFrame:
    return rows.select("row", F.posexplode("vals").alias("c", "v")).select((F.col("row") * width + F.col("c")).alias("pos"), "v")


# ---------------------------------------------------------------- rows of unequal length


def ragged_from_offsets(a: DataFrame, offsets: DataFrame, block: int = 4096) -> DataFrame:
    """(row, vals) from values and (k, off): row k holds off[k] up to off[k + 1]; empty rows stay.

    Rows and elements meet by blocks of places, an equi-join, not by comparing every row with every element.
    """
    ends = offsets.select((F.col("k") - 1).alias("row"), F.col("off").alias("hi"))
    bounds = offsets.select(F.col("k").alias("row"), F.col("off").alias("lo")).join(ends, "row")
    touched = F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))
    spread = bounds.where("hi > lo").select("row", "lo", "hi", F.explode(touched).alias("block"))
    cells = a.withColumn("block", F.floor(F.col("pos") / block)).join(spread, "block").where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
    packed = cells.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vals"))
    return bounds.select("row").join(packed, "row", "left").select("row", F.coalesce("vals", F.array().cast(packed.schema["vals"].dataType)).alias("vals"))


def check_offsets(offsets: list[int], length: int) -> list[int]:
    if not offsets or offsets[0] != 0 or offsets[-1] != length or any(x > y for x, y in zip(offsets, offsets[1:])):
        raise ValueError("offsets must start at 0, not fall, and end at the length")
    return offsets


def matrix_cells(a: DataFrame, cols: int) -> DataFrame:
    """Long form of one dimension to (i0, i1, v), row-major."""
    return a.select(F.floor(F.col("pos") / cols).cast("long").alias("i0"), (F.col("pos") % cols).alias("i1"), "v")
