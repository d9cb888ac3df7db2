"""Shared plumbing of the corpus operators: scratch tables, batch sizes, byte views of text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship_package

#: Rows in one Arrow batch sent to Python; texts of 100 KB then make batches of 50 MB at most.
BATCH_ROWS = 512


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("nibblespark.scratch.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = f"file://{tempfile.mkdtemp(prefix='nibblespark-')}"
    spark.conf.set("nibblespark.scratch.dir", root)
    return root


#: Folders made in each scratch scope that is open, the innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = posixpath.join(scratch_root(spark), f"{tag}-{uuid.uuid4().hex[:12]}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside goes at the end, but for what is ``handed_on``.

    Only for steps whose results are written when they end: a lazy DataFrame would miss its tables. Shuffle files
    of the finished jobs go as well, as soon as the driver's garbage is collected.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()
        spark._jvm.System.gc()


def handed_on(path: str) -> str:
    """Keep a folder beyond the scope that it was made in; an outer scope then has it."""
    if _SCOPES:
        _SCOPES[-1].remove(path)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(path)
    return path


def materialise(df: DataFrame, tag: str, hand_on: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(handed_on(path) if hand_on else path)


def small_batches(spark: SparkSession) -> None:
    """Before Python runs on texts: keep Arrow batches small and have the package at the workers."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system. Else the driver holds what its largest step took for as long as it runs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
