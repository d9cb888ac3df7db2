"""Array objects over DataFrames, for code that wants lengths, indices and operators.

``Array``, ``Matrix`` and ``RaggedArray`` hold a DataFrame and its spec. Slices, arithmetic and comparisons are
lazy; ``len`` and shapes come from the spec; reading a value, ``tolist`` and ``tobytes`` run a job. Writes give a
new array. Arithmetic is that of unsigned bytes, and its results keep eight bits.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits as B
from .functions import numeric as N
from .operators import arrays as R
from .schema import ArraySpec, check_bits, checked
from .sources import convert


class Array:
    """One dimension: (pos, v)."""

    def __init__(self, df: DataFrame, spec: ArraySpec):
        self.df, self.spec = df, spec

    @classmethod
    def of(cls, spark: SparkSession, values: Iterable[int], bits: int = 8, layout: str = "packed") -> Array:
        data = list(values)
        return cls(convert.from_values(spark, data, bits, layout), ArraySpec((len(data),), bits, layout))

    shape = property(lambda self: self.spec.shape)
    bits = property(lambda self: self.spec.bits)
    layout = property(lambda self: self.spec.layout)
    nbytes = property(lambda self: self.spec.nbytes)
    size = property(lambda self: self.spec.size)
    ndim, dtype = 1, "uint8"

    def __len__(self) -> int:
        return self.spec.size

    def __bool__(self) -> bool:
        if len(self) != 1:
            raise ValueError("only an array of one value has a truth value")
        return bool(self[0])

    def _like(self, df: DataFrame, n: int | None = None, bits: int | None = None) -> Array:
        return Array(df, ArraySpec((len(self) if n is None else n,), bits or self.bits, self.layout))

    def __getitem__(self, key):
        if isinstance(key, slice):
            r = range(len(self))[key]
            return self._like(R.take_slice(self.df, key.start, key.stop, r.step, len(self)), len(r))
        return R.get(self.df, operator.index(key), len(self)).first()["v"]

    def put(self, i: int, value: int) -> Array:
        """The array with one element replaced."""
        if not 0 <= operator.index(value) < 1 << self.bits:
            raise ValueError("a value needs more bits than the array has")
        if not -len(self) <= i < len(self):
            raise IndexError("index out of range")
        new = F.when(F.col("pos") == i % len(self), F.lit(int(value))).otherwise(F.col("v")).cast("smallint")
        return self._like(self.df.withColumn("v", new))

    def gather(self, indices: Sequence[int], mode: str = "raise") -> Array:
        at = [operator.index(i) for i in indices]
        if mode == "raise" and any(not -len(self) <= i < len(self) for i in at):
            raise IndexError("index out of range")
        rows = self.df.sparkSession.createDataFrame(list(enumerate(at)), "k long, i long")
        return self._like(R.gather(self.df, rows, len(self), mode).withColumnRenamed("k", "pos"), len(at))

    def count(self, value: int) -> int:
        return R.count_value(self.df, operator.index(value)).first()["n"]

    def count_nonzero(self) -> int:
        return len(self) - self.count(0)

    def find(self, needle: Sequence[int]) -> int:
        """First place of a subsequence, or -1. Values that can't occur raise, unless the needle is an Array."""
        if isinstance(needle, Array):
            needle = needle.tolist()
        elif any(not 0 <= operator.index(x) < 1 << self.bits for x in needle):
            raise ValueError("a value needs more bits than the array has")
        return -1 if len(needle) > len(self) else R.find(self.df, list(needle)).first()["at"]

    def sum(self) -> int:
        return self.df.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()["v"]

    def equals(self, other) -> bool:
        return isinstance(other, Array) and len(self) == len(other) and R.equals(self.df, other.df).first()["equal"]

    def copy(self) -> Array:
        return self

    def tolist(self) -> list[int]:
        return convert.to_list(self.df)

    def tobytes(self) -> bytes:
        return bytes(self.tolist())

    def words(self) -> DataFrame:
        """Packed words in the array's layout: (word_id, word)."""
        return B.pack_rows(self.df, self.bits, self.layout != "packed")

    def widened(self, bits: int) -> Array:
        return self._like(self.df, bits=check_bits(max(bits, self.bits)))

    def checked(self) -> Array:
        return self._like(self.df.withColumn("v", checked(F.col("v"), self.bits)))

    def _binary(self, other, name: str, swap: bool = False) -> Array:
        f = N.BYTE_BINARY[name]
        g = (lambda x, y: f(y, x)) if swap else f
        if isinstance(other, Array):
            if len(other) != len(self):
                raise ValueError("lengths differ")
            return self._like(R.binary(self.df, other.df, g), bits=8)
        return self._like(self.df.select("pos", g(F.col("v").cast("int"), F.lit(int(other))).alias("v")), bits=8)

    def _unary(self, name: str) -> Array:
        return self._like(self.df.withColumn("v", N.BYTE_UNARY[name](F.col("v").cast("int"))), bits=8)

    __neg__ = lambda self: self._unary("negative")
    __pos__ = lambda self: self
    __abs__ = lambda self: self._unary("abs")
    __invert__ = lambda self: self._unary("bitwise_invert")
    __hash__ = None


_OPERATORS = {
    "add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "floordiv": "floor_divide", "mod": "remainder",
    "and": "bitwise_and", "or": "bitwise_or", "xor": "bitwise_xor", "lshift": "bitwise_left_shift", "rshift": "bitwise_right_shift",
}
for _op, _name in _OPERATORS.items():
    setattr(Array, f"__{_op}__", lambda self, other, name=_name: self._binary(other, name))
    setattr(Array, f"__r{_op}__", lambda self, other, name=_name: self._binary(other, name, True))
for _op, _name in {"eq": "equal", "ne": "not_equal", "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal"}.items():
    setattr(Array, f"__{_op}__", lambda self, other, name=_name: self._binary(other, name))


class Matrix:
    """Rows of equal length, as (i0, i1, v)."""

    def __init__(self, flat: Array, shape: tuple[int, int]):
        if shape[0] * shape[1] != len(flat):
            raise ValueError("shape doesn't match the number of values")
        self.flat, self.shape = flat, shape

    @classmethod
    def of(cls, spark: SparkSession, rows: Sequence[Sequence[int]], bits: int = 8, layout: str = "packed") -> Matrix:
        rows = [list(r) for r in rows]
        if len({len(r) for r in rows}) > 1:
            raise ValueError("rows must have the same length")
        return cls(Array.of(spark, [x for r in rows for x in r], bits, layout), (len(rows), len(rows[0]) if rows else 0))

    @property
    def cells(self) -> DataFrame:
        return R.matrix_cells(self.flat.df, self.shape[1])

    def __getitem__(self, key):
        if isinstance(key, tuple):
            r, c = key
            if not (-self.shape[0] <= r < self.shape[0] and -self.shape[1] <= c < self.shape[1]):
                raise IndexError("index out of range")
            return self.flat[r % self.shape[0] * self.shape[1] + c % self.shape[1]]
        if isinstance(key, slice):
            rows = range(self.shape[0])[key]
            picked = [self[i].tolist() for i in rows] if rows.step != 1 else None
            if picked is not None:
                return Matrix.of(self.flat.df.sparkSession, picked, self.flat.bits, self.flat.layout)
            return Matrix(self.flat[rows.start * self.shape[1] : rows.stop * self.shape[1]], (len(rows), self.shape[1]))
        r = range(self.shape[0])[key]
        return self.flat[r * self.shape[1] : (r + 1) * self.shape[1]]

    def count(self, value: int) -> int:
        return self.flat.count(value)

    def equals(self, other) -> bool:
        return isinstance(other, Matrix) and self.shape == other.shape and self.flat.equals(other.flat)

    def tolist(self) -> list[list[int]]:
        values, n = self.flat.tolist(), self.shape[1]
        return [values[i * n : (i + 1) * n] for i in range(self.shape[0])]

    def tobytes(self) -> bytes:
        return self.flat.tobytes()


class RaggedArray:
    """Rows of any length over one flat array and its offsets."""

    def __init__(self, flat: Array, offsets: Sequence[int]):
        self.flat, self.offsets = flat, R.check_offsets(list(offsets), len(flat))

    @classmethod
    def of(cls, spark: SparkSession, rows: Sequence[Sequence[int]], bits: int = 8, layout: str = "packed") -> RaggedArray:
        offsets = [0]
        for r in rows:
            offsets.append(offsets[-1] + len(r))
        return cls(Array.of(spark, [x for r in rows for x in r], bits, layout), offsets)

    shape = property(lambda self: (len(self), None))
    nbytes = property(lambda self: self.flat.nbytes + 8 * len(self.offsets))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> Array:
        r = range(len(self))[i]
        return self.flat[self.offsets[r] : self.offsets[r + 1]]

    @property
    def rows(self) -> DataFrame:
        at = self.flat.df.sparkSession.createDataFrame(list(enumerate(self.offsets)), "k long, off long")
        return R.ragged_from_offsets(self.flat.df, at)

    def count(self, value: int) -> int:
        return self.flat.count(value)

    def equals(self, other) -> bool:
        return isinstance(other, RaggedArray) and self.offsets == other.offsets and self.flat.equals(other.flat)

    def tolist(self) -> list[list[int]]:
        values = self.flat.tolist()
        return [values[i:j] for i, j in zip(self.offsets, self.offsets[1:])]
