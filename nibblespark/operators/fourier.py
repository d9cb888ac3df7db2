"""Fourier transforms: a short one as sums of columns, any other by Arrow batches of whole signals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._groups import by_key, chunks
from .._ship import ship_package

NAMES = ("fft", "ifft", "rfft", "irfft", "hfft", "ihfft", "fft2", "ifft2", "rfft2", "irfft2", "fftn", "ifftn", "rfftn", "irfftn")


#: Elements of a block that share a row of columns in ``dft``.
PIECE = 16


def dft(a: DataFrame, keys: list[str], n: int, inverse: bool = False) -> DataFrame:
    """Transform of length n of (keys, pos, v): elements become columns by pieces of a block, then each block gives n outputs."""
    sign, scale = (1.0, 1.0 / n) if inverse else (-1.0, 1.0)
    m = min(n, PIECE)
    turn = F.lit(2 * math.pi / n)
    at = F.pmod(F.col("pos"), F.lit(n).cast("long"))
    places = [F.sum(F.when(F.col("__at") == j, F.col("v"))).cast("double") for j in range(m)]
    pieces = a.select(*keys, F.floor(at / m).cast("long").alias("__piece"), (at % m).alias("__at"), "v").groupBy(*keys, "__piece").agg(*(p.alias(f"__v{j}") for j, p in enumerate(places)))
    known = F.coalesce(*(F.col(f"__v{j}") for j in range(m))).isNotNull()
    pieces = pieces.select(*keys, "__piece", known.alias("__known"), *(F.coalesce(f"__v{j}", F.lit(0.0)).alias(f"__v{j}") for j in range(m)))
    if n <= m:

        def output(k: int) -> Column:
            part = lambda f, x: sum((F.col(f"__v{j}") * f(2 * math.pi / n * (k * j % n)) for j in range(1, n)), F.col("__v0") * f(0.0)) * x
            return F.struct(F.lit(k).cast("long").alias("k"), F.when(F.col("__known"), part(math.cos, scale)).alias("re"), F.when(F.col("__known"), part(math.sin, sign * scale)).alias("im"))

        return pieces.select(*keys, F.explode(F.array(*map(output, range(n)))).alias("o")).select(*keys, "o.k", "o.re", "o.im")
    wide = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k"))
    angle = [turn * ((F.col("k") * (F.col("__piece") * m + j)) % n) for j in range(m)]
    part = lambda f: F.sum(F.when(F.col("__known"), sum((F.col(f"__v{j}") * f(angle[j]) for j in range(1, m)), F.col("__v0") * f(angle[0]))))
    return wide.groupBy(*keys, "k").agg((part(F.cos) * scale).alias("re"), (part(F.sin) * (sign * scale)).alias("im"))


def transform(stack: DataFrame, name: str, shape: tuple[int, ...]) -> DataFrame:
    """Any transform of NumPy's for each key: rows (key, pos, re, im), pos row-major in ``shape``."""
    if name not in NAMES:
        raise ValueError(f"unknown transform {name}")
    ship_package(stack.sparkSession)
    size, rank = int(np.prod(shape)), len(shape)
    kind = getattr(np.fft, name)
    axes = {"axis": -1} if name.rstrip("2n") == name else {"axes": (-2, -1) if name.endswith("2") else tuple(range(-rank, 0))}

    def run(keys, starts, group, columns):
        pos, re, im = columns
        ends = np.r_[starts[1:], len(pos)]
        for a, b in chunks(np.full(len(starts), size)):
            of = slice(starts[a], ends[b - 1])
            x = np.zeros((b - a, size), complex)
            x[group[of] - a, pos[of]] = re[of] + 1j * im[of]
            x = x.reshape(b - a, *shape)
            x = x.real if name in ("rfft", "ihfft", "rfft2", "rfftn") else x
            y = np.asarray(kind(x, **axes), complex).reshape(b - a, -1)
            n = y.shape[1]
            yield [keys.take(np.repeat(np.arange(a, b), n)), np.tile(np.arange(n), b - a), y.real.ravel(), y.imag.ravel()]

    rows = stack.select(F.col("key").cast("long").alias("key"), "pos", F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    return by_key(rows, run, "key long, pos long, re double, im double")


def fftfreq(spark: SparkSession, n: int, d: float = 1.0) -> DataFrame:
    k = F.col("id")
    return spark.range(n).select(k.alias("i0"), (F.when(k < (n + 1) // 2, k).otherwise(k - n) / F.lit(n * d)).alias("v"))


def rfftfreq(spark: SparkSession, n: int, d: float = 1.0) -> DataFrame:
    return spark.range(n // 2 + 1).select(F.col("id").alias("i0"), (F.col("id") / F.lit(n * d)).alias("v"))


def fftshift(a: DataFrame, n: int, axis: str = "i0", inverse: bool = False) -> DataFrame:
    return a.withColumn(axis, F.pmod(F.col(axis) + (-(n // 2) if inverse else n // 2), F.lit(n).cast("long")))
