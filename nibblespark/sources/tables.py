"""Tables as narrow arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrays import with_positions

LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Orders whose line items are numbered in one window partition.
ORDERS_PER_BUCKET = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positioned(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Line items in key order: pos, the key columns and any others."""
    wanted = list(dict.fromkeys([*LINEITEM_ORDER, *columns]))
    rows = table(spark, sf_dir, "lineitem").select(*wanted)
    return with_positions(rows, LINEITEM_ORDER, F.floor(F.col("l_orderkey") / ORDERS_PER_BUCKET))


def array(spark: SparkSession, sf_dir: str, value=None) -> DataFrame:
    """(pos, v): line numbers (3 bits) or any other column of the line items, in key order."""
    v = F.col("l_linenumber") if value is None else value
    names = [] if value is None else ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_suppkey", "l_partkey"]
    return positioned(spark, sf_dir, *names).select("pos", v.cast("int").alias("v"))
