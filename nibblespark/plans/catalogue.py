"""Registered queries and their oracle SQL.

Most run over A, the line items in key order: ``pos`` from 0, and a narrow value. Each oracle numbers the
rows with one window in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

A = """a AS (SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS pos,
  CAST(l_linenumber AS BIGINT) AS v, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t, l_suppkey AS s, l_partkey AS p FROM lineitem)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql.replace("{A}", A)
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["pack_unpack_by_chunk"](spark, sf_dir)


from . import arrays, axes, chunks, elementwise, simulations, strings  # noqa: E402, F401
