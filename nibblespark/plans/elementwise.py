"""Queries over elementwise functions, on floats and on unsigned bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources.tables import table
from .catalogue import query

Maker = Callable[[Column, Column], Column]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ROWS = "r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - 25.5) / 10 AS x, round(l_discount * 100) / 10 - 0.5 AS y, CAST(l_quantity AS BIGINT) * 5 % 256 AS u, CAST(l_linenumber - 1 AS BIGINT) AS w FROM lineitem)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem")
    return r.select(*KEYS, ((F.col("l_quantity") - 25.5) / 10).alias("x"), (F.round(F.col("l_discount") * 100) / 10 - 0.5).alias("y"), (F.col("l_quantity").cast("int") * 5 % 256).alias("u"), (F.col("l_linenumber") - 1).alias("w"))


def _shown(c: Column) -> Column:
    """Six decimals; what isn't finite is shown apart."""
    return F.when(~F.isnan(c) & (F.abs(c) < N.INF), F.round(c, 6) + 0.0)


def _kind(c: Column) -> Column:
    return F.when(F.isnan(c), "nan").when(c == N.INF, "inf").when(c == -N.INF, "-inf").otherwise("finite")


def _float_query(name: str, columns: dict[str, tuple[Maker, str]], kinds: dict[str, tuple[Maker, str]] | None = None, flags: dict[str, tuple[Maker, str]] | None = None) -> None:
    kinds, flags = kinds or {}, flags or {}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, y = F.col("x"), F.col("y")
        out = [_shown(c(x, y).cast("double")).alias(k) for k, (c, _) in columns.items()]
        out += [_kind(c(x, y)).alias(k) for k, (c, _) in kinds.items()] + [c(x, y).alias(k) for k, (c, _) in flags.items()]
        return _rows(spark, sf_dir).select(*KEYS, *out)

    parts = [f"round(CAST({s} AS DOUBLE), 6) + 0.0 AS {k}" for k, (_, s) in columns.items()]
    parts += [f"{s} AS {k}" for k, (_, s) in (kinds | flags).items()]
    query(f"WITH {ROWS} SELECT {', '.join(KEYS)}, {', '.join(parts)} FROM r", name)(run)


u = N.UNARY
_float_query("ew_rounding", {
    "abs_": (lambda x, y: u["abs"](x), "abs(x)"), "ceil_": (lambda x, y: u["ceil"](x), "ceil(x)"), "floor_": (lambda x, y: u["floor"](x), "floor(x)"), "trunc_": (lambda x, y: u["trunc"](x), "trunc(x)"),
    "round_": (lambda x, y: u["round"](x * 10), "round_even(x * 10, 0)"), "sign_": (lambda x, y: u["sign"](x), "sign(x)"), "negative_": (lambda x, y: u["negative"](x), "-x"), "positive_": (lambda x, y: u["positive"](x), "x"),
    "square_": (lambda x, y: u["square"](x), "x * x"), "real_": (lambda x, y: u["real"](x), "x"), "imag_": (lambda x, y: u["imag"](x), "0"), "conj_": (lambda x, y: u["conj"](x), "x"),
}, flags={"signbit_": (lambda x, y: u["signbit"](x), "x < 0"), "isfinite_": (lambda x, y: u["isfinite"](x), "true"), "isnan_": (lambda x, y: u["isnan"](x), "false"), "isinf_": (lambda x, y: u["isinf"](x), "false"), "not_": (lambda x, y: u["logical_not"](y), "y = 0")})
_float_query("ew_trigonometric", {
    "acos_": (lambda x, y: u["acos"](y), "acos(y)"), "acosh_": (lambda x, y: u["acosh"](x + 4), "acosh(x + 4)"), "asin_": (lambda x, y: u["asin"](y), "asin(y)"), "asinh_": (lambda x, y: u["asinh"](x), "asinh(x)"),
    "atan_": (lambda x, y: u["atan"](x), "atan(x)"), "atanh_": (lambda x, y: u["atanh"](y), "atanh(y)"), "cos_": (lambda x, y: u["cos"](x), "cos(x)"), "cosh_": (lambda x, y: u["cosh"](x), "cosh(x)"), "sin_": (lambda x, y: u["sin"](x), "sin(x)"),
    "sinh_": (lambda x, y: u["sinh"](x), "sinh(x)"), "tan_": (lambda x, y: u["tan"](y), "tan(y)"), "tanh_": (lambda x, y: u["tanh"](x), "tanh(x)"), "atan2_": (lambda x, y: N.BINARY["atan2"](x, y + 3), "atan2(x, y + 3)"), "hypot_": (lambda x, y: N.BINARY["hypot"](x, y), "sqrt(x * x + y * y)"),
})
LOG = "CASE WHEN {0} > {1} THEN {2} END"
KIND = "CASE WHEN {0} > {1} THEN 'finite' WHEN {0} = {1} THEN '-inf' ELSE 'nan' END"
_float_query("ew_exponential", {
    "exp_": (lambda x, y: u["exp"](x), "exp(x)"), "expm1_": (lambda x, y: u["expm1"](x), "exp(x) - 1"), "log_": (lambda x, y: u["log"](y), LOG.format("y", 0, "ln(y)")), "log1p_": (lambda x, y: u["log1p"](x), LOG.format("x", -1, "ln(1 + x)")),
    "log2_": (lambda x, y: u["log2"](y), LOG.format("y", 0, "log2(y)")), "log10_": (lambda x, y: u["log10"](y), LOG.format("y", 0, "log10(y)")), "sqrt_": (lambda x, y: u["sqrt"](x), LOG.format("x", -1e-9, "sqrt(x)")),
    "reciprocal_": (lambda x, y: u["reciprocal"](y), "CASE WHEN y <> 0 THEN 1 / y END"), "logaddexp_": (lambda x, y: N.BINARY["logaddexp"](x, y), "greatest(x, y) + ln(1 + exp(-abs(x - y)))"),
}, kinds={"log_kind": (lambda x, y: u["log"](y), KIND.format("y", 0)), "log1p_kind": (lambda x, y: u["log1p"](x), KIND.format("x", -1)), "reciprocal_kind": (lambda x, y: u["reciprocal"](y), "CASE WHEN y <> 0 THEN 'finite' ELSE 'inf' END")})
b = N.BINARY
_float_query("ew_binary", {
    "add_": (lambda x, y: b["add"](x, y), "x + y"), "subtract_": (lambda x, y: b["subtract"](x, y), "x - y"), "multiply_": (lambda x, y: b["multiply"](x, y), "x * y"), "divide_": (lambda x, y: b["divide"](x, y), "CASE WHEN y <> 0 THEN x / y END"),
    "floor_divide_": (lambda x, y: b["floor_divide"](x, y + 2), "floor(x / (y + 2))"), "remainder_": (lambda x, y: b["remainder"](x, F.lit(-0.7)), "x - floor(x / -0.7) * -0.7"), "maximum_": (lambda x, y: b["maximum"](x, y), "greatest(x, y)"),
    "minimum_": (lambda x, y: b["minimum"](x, y), "least(x, y)"), "pow_": (lambda x, y: b["pow"](F.abs(x), y), "pow(abs(x), y)"), "copysign_": (lambda x, y: b["copysign"](x, y), "abs(x) * CASE WHEN y < 0 THEN -1 ELSE 1 END"),
    "clip_": (lambda x, y: N.clip(x, F.lit(-1.0), F.lit(1.0)), "least(greatest(x, -1.0), 1.0)"),
}, kinds={"divide_kind": (lambda x, y: b["divide"](x, y), "CASE WHEN y <> 0 THEN 'finite' WHEN x > 0 THEN 'inf' ELSE '-inf' END")},
flags={n + "_": (lambda x, y, n=n: b[n](x, y), s) for n, s in {"equal": "x = y", "not_equal": "x <> y", "less": "x < y", "less_equal": "x <= y", "greater": "x > y", "greater_equal": "x >= y", "logical_and": "x <> 0 AND y <> 0", "logical_or": "x <> 0 OR y <> 0", "logical_xor": "(x <> 0) <> (y <> 0)"}.items()})

BYTES = {
    "add": "(u + w) % 256", "subtract": "(u - w + 256) % 256", "multiply": "u * w % 256", "floor_divide": "CASE WHEN w = 0 THEN 0 ELSE u // w END", "remainder": "CASE WHEN w = 0 THEN 0 ELSE u % w END",
    "bitwise_and": "u & w", "bitwise_or": "u | w", "bitwise_xor": "xor(u, w)", "bitwise_left_shift": "CASE WHEN w >= 8 THEN 0 ELSE (u << w) % 256 END", "bitwise_right_shift": "CASE WHEN w >= 8 THEN 0 ELSE u >> w END",
    "maximum": "greatest(u, w)", "minimum": "least(u, w)", "pow": "list_reduce(list_concat([CAST(1 AS BIGINT)], [u for i in range(w)]), lambda p, q: p * q % 256)",
}
UNARY_BYTES = {"negative": "(256 - u) % 256", "bitwise_invert": "255 - u", "square": "u * u % 256", "abs": "u", "sign": "sign(u)"}


@query("WITH " + ROWS + f" SELECT {', '.join(KEYS)}, " + ", ".join(f"CAST({s} AS BIGINT) AS {n}_" for n, s in (BYTES | UNARY_BYTES).items()) + " FROM r")
def ew_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned bytes wrap to 0..255."""
    two = [N.BYTE_BINARY[n](F.col("u"), F.col("w")).cast("long").alias(f"{n}_") for n in BYTES]
    one = [N.BYTE_UNARY[n](F.col("u")).cast("long").alias(f"{n}_") for n in UNARY_BYTES]
    return _rows(spark, sf_dir).select(*KEYS, *two, *one)


@query("WITH " + ROWS + f" SELECT {', '.join(KEYS)}, round(x * y - (x + 1) * 2, 6) + 0.0 AS re, round(x * 2 + y * (x + 1), 6) + 0.0 AS im, round(sqrt(x * x + (x + 1) * (x + 1)), 6) + 0.0 AS size FROM r")
def ew_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex numbers as structs: (x + (x + 1)i) (y + 2i)."""
    x, y = F.col("x"), F.col("y")
    a, c = N.complex_(x, x + 1), N.complex_(y, F.lit(2.0))
    z = N.complex_multiply(a, c)
    return _rows(spark, sf_dir).select(*KEYS, (F.round(z["re"], 6) + 0.0).alias("re"), (F.round(z["im"], 6) + 0.0).alias("im"), (F.round(N.complex_abs(N.complex_conj(a)), 6) + 0.0).alias("size"))


SPECIAL = "CASE l_linenumber WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN CAST('infinity' AS DOUBLE) WHEN 3 THEN CAST('-infinity' AS DOUBLE) WHEN 4 THEN -CAST(0 AS DOUBLE) WHEN 5 THEN 1e300 WHEN 6 THEN -1e300 ELSE x END"


@query(f"WITH {ROWS}, z AS (SELECT *, {SPECIAL} AS z FROM r) SELECT {', '.join(KEYS)}, isnan(z) AS isnan_, isinf(z) AS isinf_, isfinite(z) AS isfinite_, signbit(z) AS signbit_, NOT isnan(z) AND floor(z) = z AS floor_same, NOT isnan(z) AND ceil(z) = z AS ceil_same, NOT isnan(z) AND trunc(z) = z AS trunc_same, NOT isnan(z) AND NOT isnan(y) AND z > y AS greater_, isnan(z) OR z <> y AS not_equal_, CASE WHEN isnan(z) OR isinf(z) THEN 'nan' ELSE 'finite' END AS remainder_kind, CASE WHEN isnan(z) THEN 'nan' WHEN z = 'infinity' THEN 'inf' WHEN z = '-infinity' THEN '-inf' ELSE 'finite' END AS maximum_kind FROM z")
def ew_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN, infinities, minus zero and numbers beyond 64-bit integers."""
    n, x, y = F.col("l_linenumber"), F.col("x"), F.col("y")
    values = {1: N.NAN, 2: N.INF, 3: -N.INF, 4: -0.0, 5: 1e300, 6: -1e300}
    z = F.coalesce(*(F.when(n == k, F.lit(v)) for k, v in values.items()), x)
    rows = _rows(spark, sf_dir).withColumn("z", z)
    z, same = F.col("z"), lambda f: u[f](F.col("z")) == F.col("z")
    return rows.select(
        *KEYS, *(u[f](z).alias(f"{f}_") for f in ("isnan", "isinf", "isfinite", "signbit")), *((~F.isnan(z) & same(f)).alias(f"{f}_same") for f in ("floor", "ceil", "trunc")),
        b["greater"](z, y).alias("greater_"), b["not_equal"](z, y).alias("not_equal_"), _kind(b["remainder"](z, F.lit(0.7))).alias("remainder_kind"), _kind(b["maximum"](z, F.when(n == 3, F.lit(-N.INF)).otherwise(F.lit(-2e300)))).alias("maximum_kind"),
    )


@query("WITH " + ROWS + f" SELECT {', '.join(KEYS)}, nextafter(x, y) AS v FROM r")
def ew_nextafter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select(*KEYS, N.nextafter(F.col("x"), F.col("y")).alias("v"))
