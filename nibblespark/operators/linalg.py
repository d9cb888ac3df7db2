"""Linear algebra over long-form matrices (i0, i1, v), and dense decompositions by Arrow batches of whole matrices.

Products are equi-joins on the contracted index with a partial aggregate. Decompositions work on stacks of
matrices that each fit one task, grouped by a key; sizes beyond that need a blocked method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._groups import by_key, chunks
from .._ship import ship_package


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("i0", F.col("i1").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i0").alias("k"), "i1", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i0", "i1").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matrix_power(a: DataFrame, n: int, size: int) -> DataFrame:
    from .ndarray import eye

    out, square = eye(a.sparkSession, size, size), a
    while n:
        if n & 1:
            out = matmul(out, square)
        n >>= 1
        square = matmul(square, square) if n else square
    return out


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i0").alias("i1"), F.col("v").alias("y"))
    return a.select("i0", F.col("v").alias("x")).crossJoin(right).select("i0", "i1", (F.col("x") * F.col("y")).alias("v"))  # every cell is asked for


def tensordot(a: DataFrame, a_rank: int, b: DataFrame, b_rank: int, a_axes: tuple[int, ...], b_axes: tuple[int, ...]) -> DataFrame:
    a_free = [k for k in range(a_rank) if k not in a_axes]
    b_free = [k for k in range(b_rank) if k not in b_axes]
    left = a.select(*(F.col(f"i{k}").alias(f"a{k}") for k in a_free), *(F.col(f"i{k}").alias(f"k{j}") for j, k in enumerate(a_axes)), F.col("v").alias("x"))
    right = b.select(*(F.col(f"i{k}").alias(f"b{k}") for k in b_free), *(F.col(f"i{k}").alias(f"k{j}") for j, k in enumerate(b_axes)), F.col("v").alias("y"))
    free = [*(f"a{k}" for k in a_free), *(f"b{k}" for k in b_free)]
    out = left.join(right, [f"k{j}" for j in range(len(a_axes))]).groupBy(*free).agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return out.select(*(F.col(c).alias(f"i{j}") for j, c in enumerate(free)), "v")


def vecdot(a: DataFrame, b: DataFrame, keys: list[str], along: str) -> DataFrame:
    left, right = a.withColumnRenamed("v", "x"), b.withColumnRenamed("v", "y")
    return left.join(right, [*keys, along]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def diagonal(a: DataFrame, offset: int = 0) -> DataFrame:
    on = a.where(F.col("i1") - F.col("i0") == offset)
    return on.select((F.col("i0") if offset >= 0 else F.col("i1")).alias("i0"), "v")


def trace(a: DataFrame, offset: int = 0) -> DataFrame:
    return diagonal(a, offset).agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"))


def vector_norm(v: Column, order: float = 2) -> Column:
    if order == float("inf"):
        return F.max(F.abs(v))
    if order == float("-inf"):
        return F.min(F.abs(v))
    if order == 0:
        return F.count_if(v != 0).cast("double")
    return F.pow(F.sum(F.pow(F.abs(v), F.lit(float(order)))), F.lit(1.0 / order))


def matrix_norm(a: DataFrame, order: float | str = "fro") -> DataFrame:
    if order == "fro":
        return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))
    along = {1: "i1", float("inf"): "i0"}[order]
    return a.groupBy(along).agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("v"))


def cross(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Cross product of 3-vectors (keys, i0, v)."""
    side = lambda x, n: x.groupBy(*keys).agg(*(F.max(F.when(F.col("i0") == k, F.col("v"))).alias(f"{n}{k}") for k in range(3)))
    both = side(a, "x").join(side(b, "y"), keys)
    cells = [F.struct(F.lit(k).cast("long").alias("i0"), (F.col(f"x{(k + 1) % 3}") * F.col(f"y{(k + 2) % 3}") - F.col(f"x{(k + 2) % 3}") * F.col(f"y{(k + 1) % 3}")).alias("v")) for k in range(3)]
    return both.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.i0", "c.v")


def _shapes(group: np.ndarray, n: int, *index: np.ndarray) -> np.ndarray:
    """Rows and columns of each of n matrices: its greatest indices and one; 0 where it has no cells."""
    out = np.zeros((n, len(index)), int)
    for k, i in enumerate(index):
        np.maximum.at(out[:, k], group, i + 1)
    return out


def _stacks(shapes: np.ndarray) -> Iterator[np.ndarray]:
    """Which matrices are worked on at once: those of one shape, bounded by their cells."""
    kinds, kind = np.unique(shapes, axis=0, return_inverse=True)
    for k in range(len(kinds)):
        of = np.flatnonzero(kind.ravel() == k)
        for a, b in chunks(np.full(len(of), int(kinds[k].prod()))):
            yield of[a:b]


def _dense(of: np.ndarray, shape: np.ndarray, group: np.ndarray, i0: np.ndarray, i1: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The matrices ``of`` (sorted groups) as one stack."""
    if not shape.all():
        raise ValueError("a matrix without cells")
    out = np.zeros((len(of), *shape))
    at = np.searchsorted(of, group)
    on = of[np.minimum(at, len(of) - 1)] == group
    out[at[on], i0[on], i1[on]] = v[on]
    return out


def _long(keys: pa.Array, of: np.ndarray, name: str, x: np.ndarray) -> list:
    """Columns of a part: scalars and vectors are single rows."""
    x = np.asarray(x, float)
    x = x.reshape(len(of), *((1,) * (3 - x.ndim)), *x.shape[1:])
    _, i, j = np.indices(x.shape)
    return [keys.take(pa.array(np.repeat(of, x[0].size))), pa.repeat(name, x.size), i.ravel(), j.ravel(), x.ravel()]


#: Each gives named parts of square or rectangular matrices of one shape.
DECOMPOSITIONS: dict[str, Callable[[np.ndarray], dict[str, np.ndarray]]] = {
    "cholesky": lambda m: {"lower": np.linalg.cholesky(m)},
    "det": lambda m: {"det": np.linalg.det(m)},
    "slogdet": lambda m: dict(zip(("sign", "log"), np.linalg.slogdet(m))),
    "inv": lambda m: {"inverse": np.linalg.inv(m)},
    "pinv": lambda m: {"inverse": np.linalg.pinv(m)},
    "qr": lambda m: dict(zip(("q", "r"), np.linalg.qr(m))),
    "svd": lambda m: dict(zip(("u", "s", "vh"), np.linalg.svd(m, full_matrices=False))),
    "svdvals": lambda m: {"s": np.linalg.svd(m, compute_uv=False)},
    "eigh": lambda m: dict(zip(("values", "vectors"), np.linalg.eigh(m))),
    "eigvalsh": lambda m: {"values": np.linalg.eigvalsh(m)},
    "matrix_rank": lambda m: {"rank": np.linalg.matrix_rank(m)},
    "cond": lambda m: {"cond": np.linalg.cond(m)},
    "norm_2": lambda m: {"norm": np.linalg.norm(m, 2, (-2, -1))},
    "norm_nuc": lambda m: {"norm": np.linalg.norm(m, "nuc", (-2, -1))},
}


def decompose(stack: DataFrame, name: str) -> DataFrame:
    """(key, part, i0, i1, v) for each matrix (key, i0, i1, v) of a stack."""
    ship_package(stack.sparkSession)
    f = DECOMPOSITIONS[name]

    def run(keys, starts, group, columns):
        i0, i1, v = columns
        shapes = _shapes(group, len(starts), i0, i1)
        for of in _stacks(shapes):
            for part, x in f(_dense(of, shapes[of[0]], group, i0, i1, v)).items():
                yield _long(keys, of, part, x)

    return by_key(_cells(stack), run, "key long, part string, i0 long, i1 long, v double")


def _cells(stack: DataFrame, *more: Column) -> DataFrame:
    return stack.select(F.col("key").cast("long").alias("key"), "i0", "i1", F.col("v").cast("double").alias("v"), *more)


def solve(stack: DataFrame) -> DataFrame:
    """x of a @ x = b for each key: rows (key, i0, i1, v) with ``side`` 'a' or 'b'."""
    ship_package(stack.sparkSession)

    def run(keys, starts, group, columns):
        sides = [[c[columns[3] == n] for c in (group, *columns[:3])] for n in (0, 1)]
        shapes = np.hstack([_shapes(g, len(starts), i0, i1) for g, i0, i1, _ in sides])
        for of in _stacks(shapes):
            a, b = (_dense(of, shapes[of[0]][2 * n : 2 * n + 2], *sides[n]) for n in (0, 1))
            yield _long(keys, of, "x", np.linalg.solve(a, b))

    side = F.when(F.col("side") == "a", 0).when(F.col("side") == "b", 1).otherwise(2)
    return by_key(_cells(stack, side.alias("side")), run, "key long, part string, i0 long, i1 long, v double")
