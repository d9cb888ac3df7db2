"""Steps that once grew too fast with the input: what a task holds, and how often Python is called."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nibblespark import _groups
from nibblespark.operators import automata, fourier, linalg


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [5, 10_000])
def test_signals_go_to_python_many_at_once(spark, size):
    """Also signals longer than an Arrow batch, a null key and elements left out (zeros)."""
    x = np.random.default_rng(5).normal(size=(40, 12))
    x[3, 4:] = 0
    rows = [(k or None, i, float(v), 0.0) for k in range(40) for i, v in enumerate(x[k]) if v]
    df = spark.createDataFrame(rows, "key long, pos long, re double, im double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        for name, shape in (("fft", (12,)), ("irfft", (12,)), ("rfft2", (3, 4)), ("ifftn", (2, 3, 2))):
            out = fourier.transform(df, name, shape)
            assert "FlatMapGroupsInPandas" not in plan(out)
            got = {(r["key"] or 0, r["pos"]): complex(r["re"], r["im"]) for r in out.collect()}
            want = [np.asarray(getattr(np.fft, name)(v.reshape(shape))).ravel() for v in x]
            assert len(got) == sum(map(len, want))
            np.testing.assert_allclose([[got[k, i] for i in range(len(w))] for k, w in enumerate(want)], want, atol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chunks_of_groups_are_bounded(monkeypatch):
    monkeypatch.setattr(_groups, "CELLS", 10)
    assert list(_groups.chunks(np.array([4, 4, 4, 30, 1, 9, 1]))) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert list(_groups.chunks(np.array([], int))) == []


def test_matrices_of_several_shapes_go_to_python_many_at_once(spark):
    rng = np.random.default_rng(6)
    mats = {k: (m := rng.normal(size=(n, n))) @ m.T + 3 * np.eye(n) for k, n in enumerate([3, 1, 4, 3, 3, 4, 2, 3])}
    rows = [(k, i, j, float(v)) for k, m in mats.items() for (i, j), v in np.ndenumerate(m)]
    stack = spark.createDataFrame(rows, "key long, i0 long, i1 long, v double")
    for name, part, f in (("inv", "inverse", np.linalg.inv), ("det", "det", np.linalg.det), ("norm_nuc", "norm", lambda m: np.linalg.norm(m, "nuc")), ("norm_2", "norm", lambda m: np.linalg.norm(m, 2)), ("eigh", "values", np.linalg.eigvalsh), ("svd", "s", lambda m: np.linalg.svd(m, compute_uv=False))):
        out = linalg.decompose(stack, name)
        assert "FlatMapGroupsInPandas" not in plan(out)
        got = {(r["key"], r["i0"], r["i1"]): r["v"] for r in out.where(F.col("part") == part).collect()}
        want = {(k, i, j): v for k, m in mats.items() for (i, j), v in np.ndenumerate(np.atleast_2d(f(m)))}
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)
    side = stack.withColumn("side", F.lit("a"))
    got = {(r["key"], r["i0"]): r["v"] for r in linalg.solve(side.unionByName(side.where("i1 = 0").withColumn("v", F.lit(1.0)).withColumn("side", F.lit("b")))).collect()}
    assert all(abs(got[k, i] - x) < 1e-9 for k, m in mats.items() for i, x in enumerate(np.linalg.solve(m, np.ones(len(m)))))


@pytest.mark.parametrize("rows,cols", [(1, 1), (2, 9), (9, 17), (13, 30)])
def test_automata_by_tiles(spark, monkeypatch, rows, cols):
    """Rims of strips and tiles, and a task for every few cells however many partitions the session has."""
    for name, n in (("TILE_ROWS", 4), ("TILE_COLS", 16), ("TASK_CELLS", 16)):
        monkeypatch.setattr(automata, name, n)
    g = np.random.default_rng(7).integers(0, 2, (rows, cols))
    cells = spark.createDataFrame([(y, x, int(g[y, x])) for y in range(rows) for x in range(cols)], "y long, x long, s long")
    grid = lambda df, v="s": np.array([r[v] for r in df.orderBy("y", "x").collect()]).reshape(rows, cols)
    nine = sum(np.roll(g, d, (0, 1)) for d in automata.MOORE)
    out = automata.totalistic(cells, rows, cols, 8)
    assert rows * cols <= 16 or f", {-(-rows * cols // 16)}), REPARTITION_BY_NUM" in plan(out)
    np.testing.assert_array_equal(grid(out), nine % 8)
    np.testing.assert_array_equal(grid(automata.life(cells, rows, cols)), np.where(nine == 3, 1, np.where(nine == 4, g, 0)))
    np.testing.assert_array_equal(grid(automata.neighbour_count(cells, rows, cols, F.col("s")), "n"), nine - g)


@pytest.mark.parametrize("n", [1, 8, 16, 40])
def test_dft_makes_a_row_of_columns_of_a_block(spark, n):
    x = np.random.default_rng(8).normal(size=(3, n))
    rows = [(k, i, float(v)) for (k, i), v in np.ndenumerate(x)] + [(3, 0, None)]
    a = spark.createDataFrame(rows, "key long, pos long, v double")
    for inverse, f in ((False, np.fft.fft), (True, np.fft.ifft)):
        out = fourier.dft(a, ["key"], n, inverse)
        assert "Generate" not in plan(out).split("Exchange")[-1]
        got = out.orderBy("key", "k").collect()
        assert [(r["key"], r["k"]) for r in got] == [(k, i) for k in range(4) for i in range(n)]
        np.testing.assert_allclose([complex(r["re"], r["im"]) for r in got[: 3 * n]], f(x).ravel(), atol=1e-12)
        assert all(r["re"] is None and r["im"] is None for r in got[3 * n :])


def test_stacked_parts_number_the_rows_once(spark):
    import os

    from nibblespark.plans import axes

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert plan(axes.tile_repeat_stack(spark, "/root/testdata/sf0.001")).count("Window [row_number") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
