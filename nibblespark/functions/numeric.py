"""Elementwise functions with NumPy's semantics as column expressions.

``UNARY`` and ``BINARY`` hold them by name. A float is a DOUBLE; unsigned bytes are computed in a wider
type and wrapped to 0..255. Where Spark gives NULL or an error (logarithms outside their domain, division
by zero, shifts past the width), the result is NumPy's: infinities, NaN or zero.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def inf() -> Column:
    return F.lit(INF)


def nan() -> Column:
    return F.lit(NAN)


def wrap(x: Column, bits: int = 8) -> Column:
    """The low bits of an integer."""
    return x.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def _log(f: Callable[[Column], Column], edge: float) -> Callable[[Column], Column]:
    def out(x: Column) -> Column:
        return F.when(F.isnan(x), x).when(x > edge, f(x)).when(x == edge, -inf()).otherwise(nan())

    return out


def is_ordered(x: Column, y: Column) -> Column:
    return ~(F.isnan(x) | F.isnan(y))


def signbit(x: Column) -> Column:
    return (x < 0) | (x.cast("string") == "-0.0")


def is_inf(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) == INF)


#: From here on every double is whole; below it fits a 64-bit integer.
WHOLE = float(1 << 53)


def trunc(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(F.signum(x) * F.floor(F.abs(x)).cast("double"))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= WHOLE), x).otherwise(f(x).cast("double"))


UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "acos": F.acos,
    "acosh": F.acosh,
    "asin": F.asin,
    "asinh": F.asinh,
    "atan": F.atan,
    "atanh": F.atanh,
    "ceil": _whole(F.ceil),
    "conj": lambda x: x,
    "cos": F.cos,
    "cosh": F.cosh,
    "exp": F.exp,
    "expm1": F.expm1,
    "floor": _whole(F.floor),
    "imag": lambda x: F.lit(0.0),
    "isfinite": lambda x: ~F.isnan(x) & (F.abs(x) < INF),
    "isinf": is_inf,
    "isnan": F.isnan,
    "log": _log(F.log, 0.0),
    "log1p": _log(F.log1p, -1.0),
    "log2": _log(F.log2, 0.0),
    "log10": _log(F.log10, 0.0),
    "logical_not": lambda x: x == 0,
    "negative": lambda x: -x,
    "positive": lambda x: x,
    "real": lambda x: x,
    "reciprocal": lambda x: divide(F.lit(1.0), x),
    "round": F.rint,
    "sign": lambda x: F.when(F.isnan(x), x).otherwise(F.signum(x)),
    "signbit": signbit,
    "sin": F.sin,
    "sinh": F.sinh,
    "sqrt": F.sqrt,
    "square": lambda x: x * x,
    "tan": F.tan,
    "tanh": F.tanh,
    "trunc": trunc,
}


def divide(x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    by_zero = F.when(F.isnan(x) | (x == 0), nan()).otherwise(F.when(signbit(x) == signbit(y), inf()).otherwise(-inf()))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def floor_divide(x: Column, y: Column) -> Column:
    return UNARY["floor"](divide(x, y))


def remainder(x: Column, y: Column) -> Column:
    """With the sign of the divisor."""
    x, y = x.cast("double"), y.cast("double")
    left = F.try_mod(x, y)  # exact, with the sign of x
    moved = F.when((left != 0) & ((left < 0) != (y < 0)), left + y).otherwise(left)
    unmoved = F.when((x < 0) != (y < 0), F.when(x == 0, x).otherwise(y)).otherwise(x)
    return F.when(F.isnan(x) | F.isnan(y) | (y == 0) | is_inf(x), nan()).when(is_inf(y), unmoved).otherwise(moved)


def minimum(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), nan()).otherwise(F.least(x, y))


def logaddexp(x: Column, y: Column) -> Column:
    top = F.greatest(x, y)
    return F.when(is_inf(top), top).otherwise(top + F.log1p(F.exp(-F.abs(x - y))))


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: x + y,
    "atan2": F.atan2,
    "copysign": lambda x, y: F.abs(x) * F.when(signbit(y), -1.0).otherwise(1.0),
    "divide": divide,
    "equal": lambda x, y: (x == y) & is_ordered(x, y),
    "floor_divide": floor_divide,
    "greater": lambda x, y: (x > y) & is_ordered(x, y),
    "greater_equal": lambda x, y: (x >= y) & is_ordered(x, y),
    "hypot": F.hypot,
    "less": lambda x, y: (x < y) & is_ordered(x, y),
    "less_equal": lambda x, y: (x <= y) & is_ordered(x, y),
    "logaddexp": logaddexp,
    "logical_and": lambda x, y: (x != 0) & (y != 0),
    "logical_or": lambda x, y: (x != 0) | (y != 0),
    "logical_xor": lambda x, y: (x != 0) != (y != 0),
    "maximum": F.greatest,
    "minimum": minimum,
    "multiply": lambda x, y: x * y,
    "not_equal": lambda x, y: (x != y) | ~is_ordered(x, y),
    "pow": F.pow,
    "remainder": remainder,
    "subtract": lambda x, y: x - y,
}


def _byte_pow(x: Column, y: Column) -> Column:
    steps = F.array_repeat(x.cast("long"), y.cast("int"))
    return F.aggregate(steps, F.lit(1).cast("long"), lambda acc, b: (acc * b).bitwiseAND(F.lit(255).cast("long"))).cast("int")


def _byte_shift(f: str) -> Callable[[Column, Column], Column]:
    return lambda x, y: F.when(y >= 8, 0).otherwise(wrap(F.call_function(f, x.cast("int"), y.cast("int"))))


#: On unsigned bytes, wrapped to 0..255.
BYTE_UNARY: dict[str, Callable[[Column], Column]] = {
    "negative": lambda x: wrap(256 - x),
    "bitwise_invert": lambda x: wrap(F.bitwise_not(x.cast("long"))),
    "square": lambda x: wrap(x * x),
    "abs": lambda x: x,
    "sign": lambda x: F.signum(x).cast("int"),
    "ceil": lambda x: x,
    "floor": lambda x: x,
    "trunc": lambda x: x,
    "round": lambda x: x,
    "logical_not": lambda x: x == 0,
}
BYTE_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: wrap(x + y),
    "subtract": lambda x, y: wrap(x - y + 256),
    "multiply": lambda x, y: wrap(x * y),
    "divide": divide,
    "floor_divide": lambda x, y: F.when(y == 0, 0).otherwise(F.floor(F.try_divide(x, y)).cast("int")),
    "remainder": lambda x, y: F.when(y == 0, 0).otherwise(F.try_mod(x, y)),
    "pow": _byte_pow,
    "bitwise_and": lambda x, y: x.bitwiseAND(y),
    "bitwise_or": lambda x, y: x.bitwiseOR(y),
    "bitwise_xor": lambda x, y: x.bitwiseXOR(y),
    "bitwise_left_shift": _byte_shift("shiftleft"),
    "bitwise_right_shift": _byte_shift("shiftright"),
    "maximum": F.greatest,
    "minimum": F.least,
    "equal": lambda x, y: x == y,
    "not_equal": lambda x, y: x != y,
    "less": lambda x, y: x < y,
    "less_equal": lambda x, y: x <= y,
    "greater": lambda x, y: x > y,
    "greater_equal": lambda x, y: x >= y,
}


def clip(x: Column, low: Column | None, high: Column | None) -> Column:
    out = x if low is None else F.greatest(x, low)
    return out if high is None else F.least(out, high)


def astype_byte(x: Column) -> Column:
    """A cast to an unsigned byte, which wraps."""
    return wrap(x.cast("long"))


def nextafter(x: Column, y: Column) -> Column:
    """The next double from x toward y; the one elementwise function that needs Arrow batches."""

    @F.pandas_udf("double")
    def step(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(a.to_numpy(), b.to_numpy()))

    return step(x.cast("double"), y.cast("double"))


# ---------------------------------------------------------------- complex numbers: struct<re, im>


def complex_(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def complex_add(x: Column, y: Column) -> Column:
    return complex_(x["re"] + y["re"], x["im"] + y["im"])


def complex_multiply(x: Column, y: Column) -> Column:
    return complex_(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"])


def complex_conj(x: Column) -> Column:
    return complex_(x["re"], -x["im"])


def complex_abs(x: Column) -> Column:
    return F.hypot(x["re"], x["im"])


def complex_exp(x: Column) -> Column:
    size = F.exp(x["re"])
    return complex_(size * F.cos(x["im"]), size * F.sin(x["im"]))


def complex_sqrt(x: Column) -> Column:
    """The root with a real part that isn't negative; the sign of zero in ``im`` decides on the negative axis."""
    size = complex_abs(x)
    re, im = F.sqrt((size + x["re"]) / 2), F.sqrt(F.greatest(size - x["re"], F.lit(0.0)) / 2)
    return complex_(re, F.when(signbit(x["im"]), -im).otherwise(im))


#: On complex structs: what ``UNARY`` has by the same names for real numbers.
COMPLEX_UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": complex_abs,
    "conj": complex_conj,
    "exp": complex_exp,
    "imag": lambda x: x["im"],
    "negative": lambda x: complex_(-x["re"], -x["im"]),
    "positive": lambda x: x,
    "real": lambda x: x["re"],
    "sqrt": complex_sqrt,
    "square": lambda x: complex_multiply(x, x),
}


# ---------------------------------------------------------------- dtypes (on the driver)

_INTEGERS = {"uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767), "uint32": (0, 2**32 - 1), "int32": (-(2**31), 2**31 - 1), "uint64": (0, 2**64 - 1), "int64": (-(2**63), 2**63 - 1)}
#: The Spark type that holds each dtype; unsigned ones take the next wider signed type.
SPARK_TYPES = {"bool": "boolean", "uint8": "smallint", "int8": "tinyint", "uint16": "int", "int16": "smallint", "uint32": "bigint", "int32": "int", "uint64": "decimal(20,0)", "int64": "bigint", "float32": "float", "float64": "double", "complex64": "struct<re:double,im:double>", "complex128": "struct<re:double,im:double>"}


def iinfo(dtype: str) -> dict:
    lo, hi = _INTEGERS[dtype]
    return {"min": lo, "max": hi, "bits": int(dtype.lstrip("uint"))}


def finfo(dtype: str) -> dict:
    f = np.finfo(dtype)
    return {"bits": f.bits, "eps": float(f.eps), "max": float(f.max), "min": float(f.min), "smallest_normal": float(f.smallest_normal)}


def result_type(*dtypes: str) -> str:
    return str(np.result_type(*dtypes))


def can_cast(source: str, target: str) -> bool:
    return bool(np.can_cast(source, target))


def isdtype(dtype: str, kind: str) -> bool:
    kinds = {"bool": ("bool",), "signed integer": ("int8", "int16", "int32", "int64"), "unsigned integer": ("uint8", "uint16", "uint32", "uint64"), "real floating": ("float32", "float64"), "complex floating": ("complex64", "complex128")}
    kinds["integral"] = kinds["signed integer"] + kinds["unsigned integer"]
    kinds["numeric"] = kinds["integral"] + kinds["real floating"] + kinds["complex floating"]
    return dtype in kinds.get(kind, (kind,))


def broadcast_shapes(*shapes: tuple[int, ...]) -> tuple[int, ...]:
    rank = max(map(len, shapes), default=0)
    out = []
    for sizes in zip(*((1,) * (rank - len(s)) + tuple(s) for s in shapes)):
        wide = {n for n in sizes if n != 1}
        if len(wide) > 1:
            raise ValueError(f"shapes can't be broadcast together: {shapes}")
        out.append(wide.pop() if wide else 1)
    return tuple(out)
