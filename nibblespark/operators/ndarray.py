"""N-dimensional arrays in long form: index columns ``i0``, ``i1``, ... and ``v``."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ArraySpec


def axes(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def linear(spec: ArraySpec) -> Column:
    """Row-major place of an index."""
    return reduce(lambda acc, x: acc + x, (F.col(f"i{k}") * s for k, s in enumerate(spec.strides)), F.lit(0).cast("long"))


def unravel(place: Column, shape: tuple[int, ...]) -> list[Column]:
    return [(F.floor(place / s).cast("long") % n).alias(f"i{k}") for k, (n, s) in enumerate(zip(shape, ArraySpec(shape).strides))]


def from_linear(a: DataFrame, shape: tuple[int, ...], place: str = "pos") -> DataFrame:
    return a.select(*unravel(F.col(place), shape), "v")


def grid(spark: SparkSession, shape: tuple[int, ...], fill: Column | None = None) -> DataFrame:
    """Every index of a shape, with a value: made by a range, so it is spread over tasks."""
    spec = ArraySpec(shape)
    cells = spark.range(spec.size).withColumnRenamed("id", "pos")
    return cells.select(*unravel(F.col("pos"), shape), (F.lit(0) if fill is None else fill).alias("v"))


def affine_view(root: DataFrame, shape: tuple[int, ...], strides: tuple[int, ...], offset: int, size: int) -> DataFrame:
    """A view of a flat root (pos, v): element (i0, i1, ..) reads offset + sum of i * stride.

    Strides may be negative, or 0 for a broadcast axis. The footprint is checked before anything is read.
    """
    if len(shape) != len(strides) or len(shape) > 64 or any(n < 0 for n in shape):
        raise ValueError("invalid view")
    reach = [(n - 1) * s for n, s in zip(shape, strides)]
    if all(shape) and not (0 <= offset + sum(min(r, 0) for r in reach) and offset + sum(max(r, 0) for r in reach) < size):
        raise ValueError("view outside its storage")
    index = grid(root.sparkSession, shape).drop("v")
    place = reduce(lambda acc, x: acc + x, (F.col(f"i{k}") * s for k, s in enumerate(strides)), F.lit(offset).cast("long"))
    return index.withColumn("pos", place).join(root, "pos").drop("pos")


def normal_axes(axis: int | tuple[int, ...] | None, rank: int) -> tuple[int, ...]:
    if axis is None:
        return tuple(range(rank))
    given = (axis,) if isinstance(axis, int) and not isinstance(axis, bool) else tuple(axis)
    if any(isinstance(k, bool) or not -rank <= k < rank for k in given):
        raise ValueError("axis out of range")
    out = tuple(k % rank for k in given)
    if len(set(out)) < len(out):
        raise ValueError("duplicate axis")
    return out


def reduce_axes(a: DataFrame, spec: ArraySpec, aggregate: Column, axis=None, keepdims: bool = False, empty: Column | None = None) -> DataFrame:
    """Aggregate over axes. With ``empty``, cells that have no elements appear with that value."""
    rank = len(spec.shape)
    gone = normal_axes(axis, rank)
    kept = [k for k in range(rank) if k not in gone]
    out = a.groupBy(*(f"i{k}" for k in kept)).agg(aggregate.alias("v"))
    if empty is not None and kept and any(spec.shape[k] == 0 for k in gone):
        cells = grid(a.sparkSession, tuple(spec.shape[k] for k in kept)).drop("v")
        cells = cells.select(*(F.col(f"i{j}").alias(f"i{k}") for j, k in enumerate(kept)))
        out = cells.join(out, [f"i{k}" for k in kept], "left").withColumn("v", F.coalesce("v", empty))
    if keepdims:
        for k in gone:
            out = out.withColumn(f"i{k}", F.lit(0).cast("long"))
        return out.select(*axes(rank), "v")
    return out.select(*(F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(kept)), "v")


def sums_of_all_axes(a: DataFrame, rank: int) -> DataFrame:
    """Sums over every subset of the axes at once."""
    return a.cube(*axes(rank)).agg(F.grouping_id().cast("long").alias("gone"), F.sum("v").cast("long").alias("v"))


def broadcast_to(a: DataFrame, shape: tuple[int, ...], target: tuple[int, ...]) -> DataFrame:
    """Stretch axes of size 1, and add axes in front."""
    lead = len(target) - len(shape)
    padded = (1,) * lead + tuple(shape)
    if any(n not in (1, m) for n, m in zip(padded, target)):
        raise ValueError("can't broadcast to that shape")
    own = a.select(*(F.col(f"i{k}").alias(f"i{k + lead}") for k in range(len(shape))), "v")
    for k, (n, m) in enumerate(zip(padded, target)):
        if k < lead or n != m:
            own = own.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))) if m else F.explode(F.array().cast("array<bigint>")))
    return own.select(*axes(len(target)), "v")


def elementwise(a: DataFrame, a_shape: tuple[int, ...], b: DataFrame, b_shape: tuple[int, ...], f) -> DataFrame:
    """f(x, y) with broadcasting: an equi-join on the axes that both have; only size-1 axes repeat."""
    from ..functions.numeric import broadcast_shapes

    target = broadcast_shapes(a_shape, b_shape)
    rank = len(target)

    def placed(x: DataFrame, shape: tuple[int, ...], name: str) -> tuple[DataFrame, set[int]]:
        lead = rank - len(shape)
        real = {k + lead for k, n in enumerate(shape) if n == target[k + lead] and n != 1 or target[k + lead] == 1}
        return x.select(*(F.col(f"i{k - lead}").alias(f"i{k}") for k in sorted(real)), F.col("v").alias(name)), real

    left, la = placed(a, a_shape, "__x")
    right, rb = placed(b, b_shape, "__y")
    shared = [f"i{k}" for k in sorted(la & rb)]
    joined = left.join(right, shared) if shared else left.crossJoin(right)  # an outer product by definition
    for k in range(rank):
        if k not in la | rb:
            joined = joined.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(target[k] - 1).cast("long"))))
    return joined.select(*axes(rank), f(F.col("__x"), F.col("__y")).alias("v"))


# ---------------------------------------------------------------- indexing


def basic_index(a: DataFrame, spec: ArraySpec, key: tuple) -> tuple[DataFrame, tuple[int, ...]]:
    """Integers, slices, None and ``...``, as filters and index arithmetic. Gives the view and its shape."""
    rank = len(spec.shape)
    used = sum(k is not None and k is not Ellipsis for k in key)
    if used > rank or sum(k is Ellipsis for k in key) > 1:
        raise IndexError("too many indices")
    full = []
    for k in key if Ellipsis in key else (*key, Ellipsis):
        full += [slice(None)] * (rank - used) if k is Ellipsis else [k]
    axis, out, shape, rows = 0, [], [], a
    for k in full:
        if k is None:
            out.append(F.lit(0).cast("long"))
            shape.append(1)
            continue
        n, at = spec.shape[axis], F.col(f"i{axis}")
        if isinstance(k, slice):
            r = range(n)[k]
            if len(r) < n or r.step != 1:
                lo, hi = (min(r[0], r[-1]), max(r[0], r[-1])) if len(r) else (0, -1)
                rows = rows.where(at.between(lo, hi) & (F.pmod(at - (r[0] if len(r) else 0), F.lit(abs(r.step))) == 0))
            out.append(F.floor((at - (r[0] if len(r) else 0)) / r.step).cast("long"))
            shape.append(len(r))
        else:
            if not -n <= k < n:
                raise IndexError("index out of range")
            rows = rows.where(at == k % n)
        axis += 1
    return rows.select(*(c.alias(f"i{j}") for j, c in enumerate(out)), "v"), tuple(shape)


def boolean_mask(a: DataFrame, mask: DataFrame, spec: ArraySpec) -> DataFrame:
    """Elements where the mask (same index, v boolean) is true, in row-major order: (pos, v)."""
    from .arrays import with_positions

    names = axes(len(spec.shape))
    hit = a.join(mask.where("v").select(*names), names).withColumn("__place", linear(spec))
    return with_positions(hit, ["__place"], F.floor(F.col("__place") / 65_536)).select("pos", "v")


def take_axis(a: DataFrame, indices: list[int], axis: int, shape: tuple[int, ...]) -> DataFrame:
    """``take`` along an axis: index k of the result reads indices[k]."""
    n = shape[axis]
    if any(not -n <= i < n for i in indices):
        raise IndexError("index out of range")
    places: dict[int, list[int]] = {}
    for k, i in enumerate(indices):
        places.setdefault(i % n, []).append(k)
    m = F.create_map(*[x for i, ks in places.items() for x in (F.lit(i).cast("long"), F.array(*(F.lit(k).cast("long") for k in ks)))])
    return a.where(F.col(f"i{axis}").isin(list(places))).withColumn(f"i{axis}", F.explode(F.element_at(m, F.col(f"i{axis}"))))


def take_along_axis(a: DataFrame, index: DataFrame, axis: int, shape: tuple[int, ...]) -> DataFrame:
    names, n = axes(len(shape)), shape[axis]
    want = index.select(*names, F.when(F.col("v") < 0, F.col("v") + n).otherwise(F.col("v")).cast("long").alias("__at"))
    have = a.withColumnRenamed(f"i{axis}", "__at")
    return want.join(have, [*(x for x in names if x != f"i{axis}"), "__at"]).select(*names, "v")


def assign_view(root: DataFrame, targets: DataFrame) -> DataFrame:
    """Write (step, pos, v) into a flat root; sources are read before, and the last write to a place wins."""
    from .arrays import scatter

    return scatter(root, targets)


# ---------------------------------------------------------------- manipulation


def permute(a: DataFrame, order: tuple[int, ...]) -> DataFrame:
    return a.select(*(F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(order)), "v")


def move_axis(a: DataFrame, rank: int, source: int, target: int) -> DataFrame:
    order = [k for k in range(rank) if k != source % rank]
    order.insert(target % rank, source % rank)
    return permute(a, tuple(order))


def reshape(a: DataFrame, spec: ArraySpec, shape: tuple[int, ...]) -> DataFrame:
    if ArraySpec(shape).size != spec.size:
        raise ValueError("sizes differ")
    return a.withColumn("__p", linear(spec)).select(*unravel(F.col("__p"), shape), "v")


def expand_dims(a: DataFrame, rank: int, axis: int) -> DataFrame:
    k = axis % (rank + 1)
    names = [F.col(f"i{j}") for j in range(rank)]
    names.insert(k, F.lit(0).cast("long"))
    return a.select(*(c.alias(f"i{j}") for j, c in enumerate(names)), "v")


def squeeze(a: DataFrame, shape: tuple[int, ...], axis: int) -> DataFrame:
    if shape[axis] != 1:
        raise ValueError("only axes of size 1 can go")
    return permute(a, tuple(k for k in range(len(shape)) if k != axis % len(shape)))


def flip(a: DataFrame, shape: tuple[int, ...], axis: int) -> DataFrame:
    return a.withColumn(f"i{axis}", shape[axis] - 1 - F.col(f"i{axis}"))


def roll(a: DataFrame, shape: tuple[int, ...], shift: int, axis: int | None = None) -> DataFrame:
    if axis is None:
        spec = ArraySpec(shape)
        return a.withColumn("__p", F.pmod(linear(spec) + shift, F.lit(max(spec.size, 1)))).select(*unravel(F.col("__p"), shape), "v")
    return a.withColumn(f"i{axis}", F.pmod(F.col(f"i{axis}") + shift, F.lit(max(shape[axis], 1)).cast("long")))


def tile(a: DataFrame, shape: tuple[int, ...], times: tuple[int, ...]) -> DataFrame:
    out = a
    for k, t in enumerate(times):
        steps = F.sequence(F.lit(0).cast("long"), F.lit(t - 1).cast("long")) if t else F.array().cast("array<bigint>")
        out = out.withColumn("__t", F.explode(steps)).withColumn(f"i{k}", F.col(f"i{k}") + F.col("__t") * shape[k]).drop("__t")
    return out


def repeat(a: DataFrame, times: int, axis: int) -> DataFrame:
    steps = F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long")) if times else F.array().cast("array<bigint>")
    return a.withColumn("__t", F.explode(steps)).withColumn(f"i{axis}", F.col(f"i{axis}") * times + F.col("__t")).drop("__t")


def stack(parts: list[DataFrame], rank: int, axis: int = 0) -> DataFrame:
    out = []
    for n, a in enumerate(parts):
        names = [F.col(f"i{j}") for j in range(rank)]
        names.insert(axis, F.lit(n).cast("long"))
        out.append(a.select(*(c.alias(f"i{j}") for j, c in enumerate(names)), "v"))
    return reduce(DataFrame.unionByName, out)


def unstack(a: DataFrame, shape: tuple[int, ...], axis: int = 0) -> list[DataFrame]:
    rest = tuple(k for k in range(len(shape)) if k != axis)
    return [permute(a.where(F.col(f"i{axis}") == n), rest) for n in range(shape[axis])]


def concat_axis(parts: list[tuple[DataFrame, tuple[int, ...]]], axis: int) -> DataFrame:
    out, offset = [], 0
    for a, shape in parts:
        out.append(a.withColumn(f"i{axis}", F.col(f"i{axis}") + offset))
        offset += shape[axis]
    return reduce(DataFrame.unionByName, out)


def triangle(a: DataFrame, k: int, lower: bool) -> DataFrame:
    off = F.col("i1") - F.col("i0")
    return a.withColumn("v", F.when(off <= k if lower else off >= k, F.col("v")).otherwise(F.lit(0)))


# ---------------------------------------------------------------- creation


def arange(spark: SparkSession, start: float, stop: float, step: float = 1) -> DataFrame:
    n = max(0, -int(-(stop - start) // step))
    return spark.range(n).select(F.col("id").alias("i0"), (F.lit(start) + F.col("id") * step).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, num: int, endpoint: bool = True) -> DataFrame:
    gap = (stop - start) / max(num - int(endpoint), 1)
    return spark.range(num).select(F.col("id").alias("i0"), (F.lit(float(start)) + F.col("id") * F.lit(gap)).alias("v"))


def eye(spark: SparkSession, rows: int, cols: int, k: int = 0) -> DataFrame:
    return grid(spark, (rows, cols)).withColumn("v", F.when(F.col("i1") - F.col("i0") == k, 1).otherwise(0))


def full(spark: SparkSession, shape: tuple[int, ...], value) -> DataFrame:
    return grid(spark, shape, F.lit(value))


def like(a: DataFrame, value) -> DataFrame:
    return a.withColumn("v", F.lit(value))


def meshgrid(first: DataFrame, n: int, second: DataFrame, m: int, indexing: str = "xy") -> tuple[DataFrame, DataFrame]:
    """Two coordinate matrices; ``xy`` puts the first array along columns."""
    spark = first.sparkSession
    rows = spark.range(m if indexing == "xy" else n).withColumnRenamed("id", "__r")
    cols = spark.range(n if indexing == "xy" else m).withColumnRenamed("id", "__c")
    cells = rows.crossJoin(cols)  # the cells of the result
    one, two = ("__c", "__r") if indexing == "xy" else ("__r", "__c")
    x = cells.join(first.withColumnRenamed("i0", one), one).select(F.col("__r").alias("i0"), F.col("__c").alias("i1"), "v")
    y = cells.join(second.withColumnRenamed("i0", two), two).select(F.col("__r").alias("i0"), F.col("__c").alias("i1"), "v")
    return x, y


def index_product(shape: tuple[int, ...]) -> list[tuple[int, ...]]:
    """All indices of a small shape, on the driver."""
    return list(product(*map(range, shape)))
