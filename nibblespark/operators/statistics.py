"""Aggregates, running functions, searching, sorting and sets over long-form arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import range_bucket

# ---------------------------------------------------------------- aggregates of a value column


def sum_(v: Column) -> Column:
    return F.coalesce(F.sum(v), F.lit(0))


def _odd_logs() -> tuple[list[int], list[int]]:
    """Every odd byte is (-1)**sign * 5**power modulo 256: both tables, by value."""
    sign, power = [0] * 256, [0] * 256
    for s in range(2):
        for k in range(64):
            x = pow(-1, s) * pow(5, k, 256) % 256
            sign[x], power[x] = s, k
    return sign, power


def prod_byte(v: Column, over=None) -> Column:
    """Product modulo 256 from sums: of factors two, and of the logarithms of the odd parts.

    So it aggregates partially, and as a window function it is a running sum.
    """
    sign, power = _odd_logs()
    value = v.cast("int").bitwiseAND(F.lit(255))
    twos = F.length(F.bin(value.cast("long"))) - F.length(F.rtrim(F.bin(value.cast("long")), F.lit("0")))
    odd = F.call_function("shiftright", value, F.when(value == 0, 0).otherwise(twos).cast("int"))
    table = lambda t: F.array(*(F.lit(x) for x in t))
    put = (lambda c: F.sum(c)) if over is None else (lambda c: F.sum(c).over(over))
    zeros = put((value == 0).cast("long"))
    two = put(F.when(value == 0, 8).otherwise(twos).cast("long"))
    s = put(F.get(table(sign), odd).cast("long")) % 2
    k = put(F.get(table(power), odd).cast("long")) % 64
    fives = F.get(F.array(*(F.lit(pow(5, i, 256)) for i in range(64))), k.cast("int"))
    part = F.pmod(F.when(s == 1, -fives).otherwise(fives), F.lit(256))
    shifted = F.call_function("shiftleft", part.cast("long"), F.least(two, F.lit(8)).cast("int"))
    return F.when((zeros > 0) | (two >= 8), F.lit(0).cast("long")).otherwise(shifted.bitwiseAND(F.lit(255).cast("long")))


def prod(v: Column) -> Column:
    return F.product(v)


def minimum(v: Column) -> Column:
    """NaN if any value is NaN."""
    return F.when(F.max(F.isnan(v)), F.lit(float("nan"))).otherwise(F.min(v))


def maximum(v: Column) -> Column:
    return F.max(v)


def variance(v: Column, correction: float = 0) -> Column:
    if correction == 0:
        return F.var_pop(v)
    return F.var_pop(v) * F.count(v) / F.nullif(F.count(v) - F.lit(correction), F.lit(0.0))


def std(v: Column, correction: float = 0) -> Column:
    return F.sqrt(variance(v, correction))


def all_(v: Column) -> Column:
    return F.coalesce(F.bool_and(v), F.lit(True))


def any_(v: Column) -> Column:
    return F.coalesce(F.bool_or(v), F.lit(False))


def count_nonzero(v: Column) -> Column:
    return F.count_if(v != 0)


def argmax(pos: Column, v: Column) -> Column:
    """First place of the largest value."""
    return F.max_by(pos, F.struct(v, -pos))


def argmin(pos: Column, v: Column) -> Column:
    return F.min_by(pos, F.struct(v, pos))


# ---------------------------------------------------------------- running functions


def cumulative(df: DataFrame, keys: list[str], order: str, how: str = "sum", include_initial: bool = False) -> DataFrame:
    """Running sum, product (modulo 256), minimum or maximum of ``v`` inside each key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("v")
    value = {"sum": lambda: F.sum(v).over(w), "max": lambda: F.max(v).over(w), "min": lambda: F.min(v).over(w), "prod": lambda: prod_byte(v, w)}[how]()
    out = df.withColumn("v", value)
    if include_initial:
        first = df.select(*keys).distinct().withColumn(order, F.lit(0).cast("long")).withColumn("v", F.lit(1 if how == "prod" else 0).cast("long"))
        out = out.withColumn(order, F.col(order) + 1).select(*keys, order, "v").unionByName(first.select(*keys, order, "v"))
    return out


def diff(df: DataFrame, keys: list[str], order: str, n: int = 1, byte: bool = False) -> DataFrame:
    """n-th difference along ``order``; ``byte``: wrapped to 0..255."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df
    for _ in range(n):
        step = F.col("v") - F.lag("v").over(w)
        out = out.withColumn("v", step).where(F.col("v").isNotNull())
    out = out.withColumn(order, F.row_number().over(w).cast("long") - 1)
    return out.withColumn("v", F.pmod(F.col("v"), F.lit(256))) if byte else out


# ---------------------------------------------------------------- sorting and searching


def sort(df: DataFrame, keys: list[str], order: str, descending: bool = False, stable: bool = True) -> DataFrame:
    """Sorted values of each key: rank, v, and the place each came from."""
    by = [F.col("v").desc() if descending else F.col("v").asc(), F.col(order).asc()]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("rank"), "v", F.col(order).alias("source"))


def searchsorted(sorted_values: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (k, x): how many values are below (left) and at or below (right).

    Counts of distinct values are summed up once, in two levels: inside ranges of values, and over the ranges.
    Each wanted value takes the sum of the last value at or below it.
    """
    counts = sorted_values.groupBy("v").agg(F.count("*").alias("n"))
    points = counts.select(F.col("v").cast("double").alias("x"), "n", F.lit(None).cast("long").alias("k")).unionByName(wanted.select(F.col("x").cast("double").alias("x"), F.lit(0).cast("long").alias("n"), "k"))
    points = points.withColumn("bucket", range_bucket(points, "x"))
    totals = points.groupBy("bucket").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("x").rangeBetween(Window.unboundedPreceding, 0))
    same = F.sum("n").over(Window.partitionBy("bucket", "x"))
    offsets = totals.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    placed = points.withColumn("inside", inside).withColumn("same", same).join(offsets, "bucket")
    placed = placed.withColumn("right", F.col("before") + F.col("inside")).withColumn("left", F.col("right") - F.col("same"))
    return placed.where(F.col("k").isNotNull()).select("k", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))


def nonzero(a: DataFrame) -> DataFrame:
    return a.where(F.col("v") != 0).drop("v")


# ---------------------------------------------------------------- sets


def unique_all(a: DataFrame) -> DataFrame:
    """Each value with its first place, its count, and its rank among the values."""
    found = a.groupBy("v").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    return found.withColumn("inverse", (F.row_number().over(Window.orderBy("v")) - 1).cast("long"))  # one row per value of a narrow array


def unique_inverse(a: DataFrame) -> DataFrame:
    """Each element's rank among the distinct values."""
    ranks = unique_all(a).select("v", "inverse")
    return a.join(F.broadcast(ranks), "v").select("pos", "inverse")  # 2**bits rows at most


def isin(a: DataFrame, test: DataFrame, invert: bool = False) -> DataFrame:
    """Elements with a flag: is the value among ``test.v``?"""
    hit = test.select("v").distinct().withColumn("__hit", F.lit(True))
    flag = F.coalesce("__hit", F.lit(False))
    return a.join(hit, "v", "left").select("pos", "v", (~flag if invert else flag).alias("found"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").union(b.select("v")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").distinct().join(b.select("v").distinct(), "v", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").distinct().join(b.select("v").distinct(), "v", "left_anti")
