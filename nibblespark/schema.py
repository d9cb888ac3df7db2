"""Widths, layouts and shapes of narrow arrays as metadata, and the checks that go with them.

A value of ``bits`` bits (1 to 8) is unsigned. Arrays come in three forms:

* long: one row per element, index columns ``i0``, ``i1``, ... (or ``pos``) and a value ``v``;
* row: one row per array, values in an array column ``vals``;
* packed: one row per array, ``n`` values as 64-bit ``words``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED, ALIGNED = "packed", "word-aligned"


@dataclass(frozen=True)
class ArraySpec:
    """What a DataFrame can't say about an array by itself: an empty axis has no rows."""

    shape: tuple[int, ...]
    bits: int = 8
    layout: str = PACKED

    def __post_init__(self):
        check_bits(self.bits)
        if self.layout not in (PACKED, ALIGNED):
            raise ValueError(f"layout must be {PACKED!r} or {ALIGNED!r}")
        if any(n < 0 for n in self.shape):
            raise ValueError("sizes can't be negative")

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def strides(self) -> tuple[int, ...]:
        """Elements from one index to the next, row-major."""
        return tuple(prod(self.shape[k + 1 :]) for k in range(len(self.shape)))

    @property
    def nbytes(self) -> int:
        return 8 * max(1, word_count(self.size, self.bits, self.layout == ALIGNED))


def check_bits(bits: int) -> int:
    if not 1 <= bits <= 8:
        raise ValueError("bits must be from 1 to 8")
    return bits


def word_count(n: int, bits: int, aligned: bool) -> int:
    return -(-n // (64 // bits)) if aligned else -(-n * bits // 64)


def value_field(spec: ArraySpec, name: str = "v") -> T.StructField:
    return T.StructField(name, T.ShortType(), False, {"bits": spec.bits, "layout": spec.layout, "shape": list(spec.shape)})


def with_spec(df: DataFrame, spec: ArraySpec, name: str = "v") -> DataFrame:
    return df.withMetadata(name, {"bits": spec.bits, "layout": spec.layout, "shape": list(spec.shape)})


def spec_of(df: DataFrame, name: str = "v") -> ArraySpec | None:
    m = df.schema[name].metadata
    return ArraySpec(tuple(m["shape"]), m["bits"], m["layout"]) if "bits" in m else None


def checked(value: Column, bits: int) -> Column:
    """The value, or an error where it doesn't fit: it is never cut to fit."""
    check_bits(bits)
    error = F.raise_error(F.concat(F.lit("a value needs more bits than the array has: "), value.cast("string")))
    return F.when(value.between(0, (1 << bits) - 1), value).otherwise(error.cast("long"))


def minimum_bits(value: Column) -> Column:
    """Aggregate: the fewest bits that hold all values, at least one."""
    return F.greatest(F.lit(1), F.length(F.bin(F.coalesce(F.max(value), F.lit(0)).cast("long")))).cast("int")


def widened(old_bits: int, value: Column, strict: bool = False) -> Column:
    """Aggregate: width after an assignment. ``strict`` raises where it would have to grow."""
    need = F.greatest(F.lit(old_bits), minimum_bits(value))
    if not strict:
        return need
    return F.when(need <= old_bits, need).otherwise(F.raise_error(F.lit("assignment needs a wider storage")).cast("int"))
