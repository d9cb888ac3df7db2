"""Rows of Parquet files by name, and findings that wait for them.

A row's name is its block (file and a run of ``BLOCK_ROWS`` rows) and its number in it: any later scan gives
the same names, repeated rows and null ids have names of their own. What an operator finds for rows is written
to a folder for each block; tasks that scan the rows again read the folder of the block they are in. So texts
are never shuffled to meet what was found for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, scratch_path

#: Rows of an input file whose findings lie in one folder.
BLOCK_ROWS = 1 << 14


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` as a plain scan of Parquet files: as it is, or else written first."""
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return docs if plain else materialise(docs, "texts")


def named(docs: DataFrame) -> DataFrame:
    """The rows of a plain scan with their names: ``__block`` and ``__row``."""
    row = F.col("_metadata.row_index")
    block = F.xxhash64(F.col("_metadata.file_path"), F.floor(row / BLOCK_ROWS).cast("long"))
    return docs.select("*", block.alias("__block"), (row % BLOCK_ROWS).cast("long").alias("__row"))


def leave(rows: DataFrame, tag: str) -> str:
    """Write findings (block, row or rows, ...) into a folder for each block; gives the path."""
    path = scratch_path(rows.sparkSession, tag)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    return path


def _flat(found: pa.Table) -> pa.Table:
    """Findings with lists of places (rows, ats) as one row for each."""
    if "rows" not in found.column_names:
        return found
    return pa.table({"row": pc.list_flatten(found.column("rows")), "at": pc.list_flatten(found.column("ats"))})


def without(docs: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """All of ``docs`` but the rows that the findings at ``path`` name; ``rows`` are the same rows with names."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Findings(path)
        for b in batches:
            stay = [found.of(block, row) is None for block, row in zip(b.column("__block").to_pylist(), b.column("__row").to_pylist())]
            yield pa.RecordBatch.from_arrays(b.columns[: len(columns)], names=columns).filter(pa.array(stay, pa.bool_()))

    return rows.select(*(F.col(f"`{c}`") for c in columns), "__block", "__row").mapInArrow(run, docs.schema)


class Findings:
    """What was found for the rows of a block; keeps the block in use.

    A block without a folder has no findings. The mark of a complete write must be there, so a task that can't
    see the shared folder fails instead of finding nothing.
    """

    def __init__(self, path: str):
        self.system, self.folder = fs.FileSystem.from_uri(path)
        if self.system.get_file_info(f"{self.folder}/_SUCCESS").type != fs.FileType.File:
            raise RuntimeError(f"findings are not complete, or not to be seen here: {path}")
        self.block: int | None = None
        self.rows: np.ndarray | None = None
        self.table: pa.Table | None = None

    def of(self, block: int, row: int) -> pa.Table | None:
        if block != self.block:
            self.block, self.table = block, None
            folder = f"{self.folder}/block={block}"
            if self.system.get_file_info(folder).type == fs.FileType.Directory:
                files = [f.path for f in self.system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
                self.table = pa.concat_tables(_flat(pq.read_table(f, filesystem=self.system, partitioning=None)) for f in sorted(files)).sort_by("row")
                self.rows = self.table.column("row").to_numpy()
        if self.table is None:
            return None
        i, j = np.searchsorted(self.rows, [row, row + 1])
        return self.table.slice(i, j - i) if j > i else None
