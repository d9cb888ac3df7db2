"""Python, NumPy, Arrow and DLPack values to arrays and back; packed Parquet as a sink and source."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..schema import ALIGNED, ArraySpec, check_bits, checked, with_spec


def from_values(spark: SparkSession, values: Iterable[int], bits: int = 8, layout: str = "packed") -> DataFrame:
    """A one-dimensional array; values are read once, and each must be an integer that fits."""
    check_bits(bits)
    data = list(values)
    for x in data:
        if not hasattr(x, "__index__"):
            raise TypeError("values must be integers")
        if not 0 <= x.__index__() < 1 << bits:
            raise ValueError("a value needs more bits than the array has")
    t = pa.table({"pos": pa.array(range(len(data)), pa.int64()), "v": pa.array([int(x) for x in data], pa.int16())})
    return with_spec(spark.createDataFrame(t), ArraySpec((len(data),), bits, layout))


def from_numpy(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """An N-dimensional array in long form; the width is the least that holds it."""
    x = np.asarray(x)
    index = np.indices(x.shape).reshape(x.ndim, -1)
    flat = x.ravel()
    columns = {f"i{k}": pa.array(index[k], pa.int64()) for k in range(x.ndim)}
    if flat.dtype == np.uint8:
        bits = max(1, int(flat.max(initial=0)).bit_length())
        t = pa.table(columns | {"v": pa.array(flat.astype(np.int16), pa.int16())})
        return with_spec(spark.createDataFrame(t), ArraySpec(x.shape, bits))
    if np.iscomplexobj(flat):
        return spark.createDataFrame(pa.table(columns | {"v": pa.StructArray.from_arrays([pa.array(flat.real), pa.array(flat.imag)], ["re", "im"])}))
    wide = {"uint16": "int32", "uint32": "int64", "uint64": "object"}.get(str(flat.dtype), str(flat.dtype))
    v = pa.array([int(a) for a in flat], pa.decimal128(20, 0)) if wide == "object" else pa.array(flat.astype(wide))
    return spark.createDataFrame(pa.table(columns | {"v": v}))


def from_dlpack(spark: SparkSession, x) -> DataFrame:
    return from_numpy(spark, np.from_dlpack(x))


def to_numpy(df: DataFrame, shape: Sequence[int], dtype: str = "uint8") -> np.ndarray:
    """A dense copy on the driver, a sink for arrays that fit there."""
    t = df.toArrow()
    out = np.zeros(shape, dtype)
    names = [c for c in t.column_names if c != "v"]
    out[tuple(t.column(c).to_numpy() for c in names)] = t.column("v").to_numpy()
    return out


def to_list(df: DataFrame) -> list:
    return [r["v"] for r in df.orderBy("pos").select("v").toLocalIterator()]


def validated(df: DataFrame, bits: int, name: str = "v") -> DataFrame:
    """The same rows; reading one that doesn't fit raises."""
    return df.withColumn(name, checked(F.col(name), bits))


def write_packed(a: DataFrame, path: str, bits: int, layout: str = "packed", block: int = 1 << 16) -> None:
    """(pos, v) as Parquet rows (block, n, words), in order of blocks, so that ranges prune row groups."""
    aligned = layout == ALIGNED
    cells = a.select(F.floor(F.col("pos") / block).cast("long").alias("block"), (F.col("pos") % block).alias("pos"), checked(F.col("v").cast("long"), bits).alias("v"))
    words = B.pack_rows(cells, bits, aligned, ("block",))
    rows = words.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "word"))), lambda x: x["word"]).alias("words"))
    sizes = cells.groupBy("block").agg(F.count("*").alias("n"))
    rows.join(sizes, "block").withColumn("bits", F.lit(bits)).withColumn("aligned", F.lit(aligned)).repartitionByRange("block").sortWithinPartitions("block").write.parquet(path)


def read_packed(spark: SparkSession, path: str, bits: int, layout: str = "packed", block: int = 1 << 16, start: int | None = None, stop: int | None = None) -> DataFrame:
    """(pos, v) from ``write_packed``; a range reads only its blocks."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where(F.col("block").between(start // block, (stop - 1) // block))
    vals = B.unpack(F.col("words"), F.col("n"), bits, layout == ALIGNED)
    out = rows.select("block", F.posexplode(vals).alias("c", "v")).select((F.col("block") * block + F.col("c")).alias("pos"), "v")
    return out if start is None else out.where(F.col("pos").between(start, stop - 1))
