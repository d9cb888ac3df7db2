"""Worked uses of narrow arrays: genotypes, replay buffers, label patches, edits, state keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import range_bucket, with_positions


def genotype_counts(calls: DataFrame, start: int | None = None, count: int | None = None) -> DataFrame:
    """Missing (-1), reference (0) and alternative (1) calls of each variant, of a region or all."""
    rows = calls if start is None else calls.where(F.col("variant").between(start, start + count - 1))
    kind = lambda c: F.count_if(F.col("call") == c).cast("long")
    return rows.groupBy("variant").agg(kind(-1).alias("missing"), kind(0).alias("ref"), kind(1).alias("alt"))


def sample(observations: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (k, i) of a replay buffer, in order and with repeats."""
    return ids.join(observations.withColumnRenamed("obs_id", "i"), "i")


def dictionary(df: DataFrame, key: str, order: str) -> DataFrame:
    """An id for each key, in order of first appearance: (key, id). Keys are numbered inside ranges of ``order``."""
    first = df.groupBy(key).agg(F.min(order).alias("__first"))
    return with_positions(first, ["__first", key], range_bucket(first, "__first"), "id").select(key, "id")


def patches(voxels: DataFrame, origins: DataFrame, width: int) -> DataFrame:
    """Cubes of a label volume: (p, dz, dy, dx, label) for each origin (p, z, y, x)."""
    steps = F.sequence(F.lit(0), F.lit(width - 1))
    wanted = origins.select("p", *(F.col(c).alias(f"o{c}") for c in "zyx"))
    for c in "zyx":
        wanted = wanted.withColumn(f"d{c}", F.explode(steps))
    wanted = wanted.select("p", "dz", "dy", "dx", *((F.col(f"o{c}") + F.col(f"d{c}")).alias(c) for c in "zyx"))
    return wanted.join(voxels, ["z", "y", "x"]).select("p", "dz", "dy", "dx", "label")


def online_edits(a: DataFrame, edits: DataFrame, states: int) -> DataFrame:
    """Each edit (step, pos) reads a cell, writes (v + 1) modulo the states, and reads again.

    The j-th visit to a cell reads its first value plus j, so nothing runs in order of steps.
    """
    visit = F.row_number().over(Window.partitionBy("pos").orderBy("step")) - 1
    seen = edits.withColumn("__j", visit).join(a, "pos")
    before = (F.col("v") + F.col("__j")) % states
    return seen.select("step", "pos", before.cast("long").alias("before"), ((before + 1) % states).cast("long").alias("after"))


def distinct_states(states: DataFrame, words: str = "words") -> DataFrame:
    """Visited states by their packed words: (words, n)."""
    return states.groupBy(words).agg(F.count("*").alias("n"))


def sparse_difference(state: DataFrame, board: DataFrame) -> DataFrame:
    """Cells (key, pos, v) that differ from a fixed board (pos, v)."""
    return state.join(board.withColumnRenamed("v", "__b"), "pos").where(F.col("v") != F.col("__b")).drop("__b")


def nibbles(packed: DataFrame) -> DataFrame:
    """Two 4-bit values of each byte (pos, v), the lower one first."""
    halves = F.array(F.col("v").bitwiseAND(F.lit(15)), F.call_function("shiftrightunsigned", F.col("v"), F.lit(4)))
    return packed.select("pos", F.posexplode(halves).alias("h", "v")).select((F.col("pos") * 2 + F.col("h")).alias("pos"), "v")


def palette_audit(colors: DataFrame, color: str = "color") -> DataFrame:
    """Distinct colours, the bits of an index to them, and bytes of the indexed image with its palette."""
    distinct = F.count_distinct(color)
    bits = F.greatest(F.lit(1), F.length(F.bin((distinct - 1).cast("long"))))
    return colors.agg(distinct.cast("long").alias("colors"), bits.cast("long").alias("bits"), (8 * F.ceil(F.count("*") * bits / 64) + 4 * distinct).cast("long").alias("bytes"))


def channels(grid: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Channel planes of a grid in long form: (channel, pos, v)."""
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), c.alias("v")) for n, c in parts.items())))
    return grid.select("pos", cells.alias("c")).select("c.channel", "pos", "c.v")
