"""Cellular automata on a torus: cells (y, x, s).

A step deals the cells out by tiles of the grid, each with the rim that it needs of its neighbours. Inside a tile,
``STRIP`` cells of a row and their neighbours become one row of columns, and the rule is an expression over these.
A cell is sent once, and a rim of it once more; there is no self-join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOORE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
#: Rows of a grid whose hashes are joined at once.
DIGEST_ROWS = 1024
VON_NEUMANN = [(-1, 0), (1, 0), (0, -1), (0, 1)]
#: Cells of a row that are worked out together; rows and columns of a tile (a multiple of the strip); cells of a task.
STRIP, TILE_ROWS, TILE_COLS, TASK_CELLS = 8, 32, 512, 1 << 18


def _copies(at: Column, n: int, side: int) -> Column:
    """The parts of ``side`` places of an axis of n in which a place is seen, and where: 0 to side - 1, or -1 or side as rim; some are null."""
    part, inside, last = F.floor(at / side).cast("long"), (at % side).cast("long"), (n - 1) // side
    here = lambda p, i: F.struct(p.cast("long").alias("part"), i.cast("long").alias("at"))
    before = F.when(part == 0, here(F.lit(last), F.lit(n - last * side))).otherwise(here(part - 1, F.lit(side)))
    after = F.when(at == n - 1, here(F.lit(0), F.lit(-1))).otherwise(here(part + 1, F.lit(-1)))
    first, end = inside == 0, (inside == side - 1) | (at == n - 1)
    return F.when(first | end, F.array(here(part, inside), F.when(first, before), F.when(end, after))).otherwise(F.array(here(part, inside)))


def _strips(cells: DataFrame, rows: int, cols: int, slots: dict[str, Column]) -> DataFrame:
    """Aggregates (``slots``, over ``s``, ``dy`` and ``at``) for each row and strip, with y, its first x and its width.

    ``dy`` (-1, 0, 1) and ``at`` (-1 to STRIP) tell where a cell lies from the strip; each pair has one cell.
    """
    spark = cells.sparkSession
    total = rows * cols
    tasks = max(-(-total // TASK_CELLS), min(spark.sparkContext.defaultParallelism, -(-total // 4096)))
    placed = cells.select("y", "x", "s", F.explode(_copies(F.col("y"), rows, TILE_ROWS)).alias("r")).where("r IS NOT NULL")
    placed = placed.select("r", "s", F.explode(_copies(F.col("x"), cols, TILE_COLS)).alias("c")).where("c IS NOT NULL")
    tiles = placed.select(F.col("r.part").alias("ty"), F.col("c.part").alias("tx"), F.col("r.at").alias("r"), F.col("c.at").alias("c"), "s").repartition(tasks, "ty", "tx")
    height, width = F.least(F.lit(TILE_ROWS), rows - F.col("ty") * TILE_ROWS), F.least(F.lit(TILE_COLS), cols - F.col("tx") * TILE_COLS)
    own, inside = F.floor(F.col("c") / STRIP).cast("long"), F.pmod(F.col("c"), F.lit(STRIP).cast("long"))
    strips = F.array(own, F.when(inside == 0, own - 1).when(inside == STRIP - 1, own + 1))
    wide = tiles.select("ty", "tx", "r", "c", "s", F.explode(strips).alias("b")).where((F.col("b") >= 0) & (F.col("b") * STRIP < width))
    wide = wide.select("ty", "tx", "r", "b", "s", (F.col("c") - F.col("b") * STRIP).alias("at"), F.explode(F.array(*(F.lit(dy).cast("long") for dy in (-1, 0, 1)))).alias("dy"))
    wide = wide.withColumn("r", F.col("r") - F.col("dy")).where((F.col("r") >= 0) & (F.col("r") < height))
    out = wide.groupBy("ty", "tx", "r", "b").agg(*(v.alias(k) for k, v in slots.items()))
    return out.select((F.col("ty") * TILE_ROWS + F.col("r")).alias("y"), (F.col("tx") * TILE_COLS + F.col("b") * STRIP).alias("x"), (width - F.col("b") * STRIP).alias("w"), *slots)


def _cells(strips: DataFrame, rule: Callable[[int], Column], known: Callable[[int], Column]) -> DataFrame:
    """The rule's value for each cell of the strips of which anything is known."""
    cell = lambda k: F.when((F.lit(k) < F.col("w")) & known(k), F.struct((F.col("x") + k).alias("x"), rule(k).cast("long").alias("s")))
    wide = strips.select("y", F.explode(F.array(*map(cell, range(STRIP)))).alias("c")).where("c IS NOT NULL")
    return wide.select("y", "c.x", "c.s")


def _column(k: int) -> Column:
    """The sum of three cells, one above the other, at place k from -1 of a strip."""
    return F.col(f"sum{k + 1}")


def _sums() -> dict[str, Column]:
    return {f"sum{k + 1}": F.sum(F.when(F.col("at") == k, F.col("s"))) for k in range(-1, STRIP + 1)}


def _own(prefix: str, dy: int, places: range) -> dict[str, Column]:
    return {f"{prefix}{k + 1}": F.max(F.when((F.col("at") == k) & (F.col("dy") == dy), F.col("s"))) for k in places}


def _nine(k: int) -> Column:
    return sum((F.coalesce(_column(j), F.lit(0)) for j in (k, k + 1)), F.coalesce(_column(k - 1), F.lit(0)))


def _any(k: int) -> Column:
    return F.coalesce(_column(k - 1), _column(k), _column(k + 1)).isNotNull()


def totalistic(cells: DataFrame, rows: int, cols: int, states: int) -> DataFrame:
    """Sum of the nine cells around, modulo the states."""
    return _cells(_strips(cells, rows, cols, _sums()), lambda k: _nine(k) % states, _any)


def life(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Three in the block of nine: alive; four: as before."""
    block = _strips(cells, rows, cols, _sums() | _own("own", 0, range(STRIP)))
    return _cells(block, lambda k: F.when(_nine(k) == 3, 1).when(_nine(k) == 4, F.col(f"own{k + 1}")).otherwise(0), _any)


def cyclic(cells: DataFrame, rows: int, cols: int, states: int) -> DataFrame:
    """A cell moves on if one of its four neighbours is already there."""
    met = _strips(cells, rows, cols, _own("own", 0, range(-1, STRIP + 1)) | _own("up", -1, range(STRIP)) | _own("down", 1, range(STRIP)))
    near = lambda k: [F.col(f"own{k}"), F.col(f"own{k + 2}"), F.col(f"up{k + 1}"), F.col(f"down{k + 1}")]

    def rule(k: int) -> Column:
        own = F.col(f"own{k + 1}")
        nxt = (own + 1) % states
        return F.when(F.array_contains(F.array(*near(k)), nxt), nxt).otherwise(own)

    return _cells(met, rule, lambda k: F.coalesce(F.col(f"own{k + 1}"), *near(k)).isNotNull())


def transport(cells: DataFrame, cols: int) -> DataFrame:
    """Every cell takes the state of its western neighbour: a projection."""
    return cells.withColumn("x", F.pmod(F.col("x") + 1, F.lit(cols)))


def evolve(cells: DataFrame, step: Callable[[DataFrame], DataFrame], steps: int, history: bool = False, cut: Callable[[DataFrame], DataFrame] | None = None, every: int = 8) -> DataFrame:
    """The grid after some steps, or all generations with their time ``t``.

    Long runs grow the plan; ``cut`` (say, DataFrame.checkpoint) is applied every so many steps.
    """
    now, seen = cells, [cells.withColumn("t", F.lit(0).cast("long"))]
    for t in range(1, steps + 1):
        now = step(now)
        if cut is not None and t % every == 0:
            now = cut(now)
        if history:
            seen.append(now.withColumn("t", F.lit(t).cast("long")))
    if not history:
        return now
    out = seen[0]
    for g in seen[1:]:
        out = out.unionByName(g)
    return out


def digest(cells: DataFrame, states: int = 256) -> DataFrame:
    """Sum and an order-free digest of a grid: each row hashed, rows by blocks of ``DIGEST_ROWS``, and the blocks."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "s"))), lambda c: F.lpad(F.hex(c["s"].cast("long")), 2, "0")), "")
    rows = cells.groupBy("y").agg(F.sum("s").alias("sum"), F.sha2(line, 256).alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "h"))), lambda r: r["h"]), ""), 256)
    blocks = rows.groupBy(F.floor(F.col("y") / DIGEST_ROWS).alias("block")).agg(F.sum("sum").alias("sum"), joined.alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda r: r["h"]), "")  # 64 letters for DIGEST_ROWS rows of the grid
    return blocks.agg(F.sum("sum").cast("long").alias("sum"), F.sha2(whole, 256).alias("digest"))


def neighbour_count(cells: DataFrame, rows: int, cols: int, value: Column) -> DataFrame:
    """Sum of the eight cells around."""
    block = _strips(cells.withColumn("s", value), rows, cols, _sums() | _own("own", 0, range(STRIP)))
    return _cells(block, lambda k: _nine(k) - F.coalesce(F.col(f"own{k + 1}"), F.lit(0)), _any).withColumnRenamed("s", "n")
