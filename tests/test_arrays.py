"""Array, axis, statistics and storage operators against Python and NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nibblespark.operators import arrays as R
from nibblespark.operators import automata, fourier, linalg, sequences, storage
from nibblespark.operators import ndarray as D
from nibblespark.operators import statistics as S
from nibblespark.functions import numeric as N
from nibblespark.schema import ArraySpec
from nibblespark.sources import convert


def long(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, v int")


def back(df):
    return [r["v"] for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize("start,stop,step", [(None, None, 1), (3, 50, 1), (5, None, 3), (None, None, -1), (40, 2, -7), (-10, -2, 1), (9, 9, 1), (90, 200, 2)])
def test_slices(spark, start, stop, step):
    values = [i % 8 for i in range(100)]
    assert back(R.take_slice(long(spark, values), start, stop, step, 100)) == values[slice(start, stop, step)]


def test_positions_without_a_global_window(spark):
    keys = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["pos"] for r in R.with_positions(df, ["k"], F.floor(F.col("k") / 100)).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_gather_modes_and_errors(spark):
    a = long(spark, [5, 6, 7])
    idx = spark.createDataFrame([(0, -1), (1, 0), (2, -1)], "k long, i long")
    assert [r["v"] for r in R.gather(a, idx).orderBy("k").collect()] == [7, 5, 7]
    far = spark.createDataFrame([(0, 9), (1, -9)], "k long, i long")
    assert [r["v"] for r in R.gather(a, far, mode="clip").orderBy("k").collect()] == [7, 5]
    assert [r["v"] for r in R.gather(a, far, mode="wrap").orderBy("k").collect()] == [5, 5]
    with pytest.raises(Exception, match="out of range"):
        R.gather(a, far).collect()


def test_find_like_a_search(spark):
    rng = random.Random(5)
    values = [rng.randrange(3) for _ in range(200)]
    for needle in ([], [1], [0, 1, 2], [2, 2, 0], values[50:90], [9], values + [1]):
        want = next((i for i in range(len(values) - len(needle) + 1) if values[i : i + len(needle)] == needle), -1)
        assert R.find(long(spark, values), needle).first()["at"] == want


def test_equals_and_scatter(spark):
    a = long(spark, [1, 2, 3])
    assert R.equals(a, long(spark, [1, 2, 3])).first()["equal"]
    assert not R.equals(a, long(spark, [1, 2])).first()["equal"]
    updates = spark.createDataFrame([(0, 1, 7), (1, 1, 9)], "step long, pos long, v int")
    assert back(R.scatter(a, updates)) == [1, 9, 3]


def test_ragged_rows_keep_empty_ones(spark):
    a = long(spark, [1, 2, 3, 4])
    offsets = spark.createDataFrame(list(enumerate([0, 0, 2, 2, 4])), "k long, off long")
    got = [r["vals"] for r in R.ragged_from_offsets(a, offsets).orderBy("row").collect()]
    assert got == [[], [1, 2], [], [3, 4]]
    for bad in ([1, 4], [0, 3, 2, 4], [0, 3]):
        with pytest.raises(ValueError):
            R.check_offsets(bad, 4)


CUBE = np.random.default_rng(43).integers(0, 32, (4, 5, 6)).astype(np.uint8)


@pytest.mark.parametrize("axis", [None, 0, 1, (0, 2), (1, 2), ()])
@pytest.mark.parametrize("keep", [False, True])
def test_axis_sums(spark, axis, keep):
    out = D.reduce_axes(convert.from_numpy(spark, CUBE), ArraySpec(CUBE.shape), F.sum("v"), axis, keep)
    want = CUBE.sum(axis=axis, keepdims=keep)
    got = convert.to_numpy(out, want.shape, "int64") if want.ndim else np.int64(out.first()["v"])
    np.testing.assert_array_equal(got, want)


def test_bad_axes(spark):
    for axis in (3, (0, 0), True, -4):
        with pytest.raises(ValueError):
            D.normal_axes(axis, 3) if axis is not True else D.normal_axes((True,), 3)


def test_views_and_manipulation(spark):
    a = convert.from_numpy(spark, CUBE)
    root = spark.createDataFrame(list(enumerate(CUBE.ravel().tolist())), "pos long, v int")
    view = D.affine_view(root, (5, 6, 4), (6, 1, 30), 0, CUBE.size)
    np.testing.assert_array_equal(convert.to_numpy(view, (5, 6, 4)), CUBE.transpose(1, 2, 0))
    with pytest.raises(ValueError):
        D.affine_view(root, (5,), (30,), 5, CUBE.size)
    got, shape = D.basic_index(a, ArraySpec(CUBE.shape), (slice(None, None, -2), None, Ellipsis, 3))
    want = CUBE[::-2, None, ..., 3]
    np.testing.assert_array_equal(convert.to_numpy(got, shape), want)
    for made, want in [
        (D.reshape(a, ArraySpec(CUBE.shape), (10, 12)), CUBE.reshape(10, 12)), (D.flip(a, CUBE.shape, 1), np.flip(CUBE, 1)), (D.roll(a, CUBE.shape, 7), np.roll(CUBE, 7)),
        (D.roll(a, CUBE.shape, -2, 2), np.roll(CUBE, -2, 2)), (D.tile(a, CUBE.shape, (2, 1, 2)), np.tile(CUBE, (2, 1, 2))), (D.repeat(a, 3, 1), np.repeat(CUBE, 3, 1)),
        (D.move_axis(a, 3, 0, 2), np.moveaxis(CUBE, 0, 2)), (D.expand_dims(a, 3, 1), CUBE[:, None]), (D.take_axis(a, [2, 0, -1], 1, CUBE.shape), CUBE.take([2, 0, -1], 1)),
        (D.concat_axis([(a, CUBE.shape), (a, CUBE.shape)], 2), np.concatenate([CUBE, CUBE], 2)), (D.stack([a, a], 3, 1), np.stack([CUBE, CUBE], 1)),
        (D.broadcast_to(D.basic_index(a, ArraySpec(CUBE.shape), (slice(0, 1),))[0], (1, 5, 6), (3, 5, 6)), np.broadcast_to(CUBE[:1], (3, 5, 6))),
    ]:
        np.testing.assert_array_equal(convert.to_numpy(made, want.shape), want)


def test_empty_axis_sums_are_zero(spark):
    empty = spark.createDataFrame([], "i0 long, i1 long, v int")
    out = D.reduce_axes(empty, ArraySpec((3, 0)), F.sum("v"), 1, empty=F.lit(0))
    assert sorted((r["i0"], r["v"]) for r in out.collect()) == [(0, 0), (1, 0), (2, 0)]


def test_broadcast_arithmetic(spark):
    x, y = CUBE[0], CUBE[1, :1]
    got = D.elementwise(convert.from_numpy(spark, x), x.shape, convert.from_numpy(spark, y), y.shape, N.BYTE_BINARY["multiply"])
    np.testing.assert_array_equal(convert.to_numpy(got, x.shape), x * y)
    assert N.broadcast_shapes((3, 1), (4,)) == (3, 4)
    with pytest.raises(ValueError):
        N.broadcast_shapes((3,), (4,))


def test_float_functions_follow_numpy(spark):
    xs = np.array([-np.inf, -2.5, -1.0, -0.5, -0.0, 0.0, 0.5, 1.5, 2.5, np.inf, np.nan])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").orderBy("i")
    with np.errstate(all="ignore"):
        for name, f in {"log": np.log, "log1p": np.log1p, "log2": np.log2, "ceil": np.ceil, "floor": np.floor, "trunc": np.trunc, "round": np.round, "sqrt": np.sqrt, "sign": np.sign, "reciprocal": np.reciprocal}.items():
            got = [r["v"] for r in df.select("i", N.UNARY[name](F.col("x")).alias("v")).orderBy("i").collect()]
            np.testing.assert_allclose(np.array(got, float), f(xs), rtol=1e-12, err_msg=name)
        for name, f in {"signbit": np.signbit, "isfinite": np.isfinite, "isnan": np.isnan, "isinf": np.isinf}.items():
            assert [r["v"] for r in df.select("i", N.UNARY[name](F.col("x")).alias("v")).orderBy("i").collect()] == f(xs).tolist(), name
        pairs = df.crossJoin(df.select(F.col("i").alias("j"), F.col("x").alias("y"))).orderBy("i", "j")
        a, b = np.repeat(xs, len(xs)), np.tile(xs, len(xs))
        for name in ("divide", "minimum", "maximum", "less", "greater_equal", "equal", "not_equal"):
            got = [r["v"] for r in pairs.select("i", "j", N.BINARY[name](F.col("x"), F.col("y")).alias("v")).orderBy("i", "j").collect()]
            np.testing.assert_allclose(np.array(got, float), getattr(np, name)(a, b).astype(float), err_msg=name)


def test_byte_products_by_sums(spark):
    rng = random.Random(2)
    groups = [(g, i, rng.choice([1, 3, 5, 7, 9, 255, 2] if g % 2 else [3, 5, 11, 251])) for g in range(6) for i in range(20)]
    df = spark.createDataFrame(groups, "g int, i long, v int")
    got = {r["g"]: r["v"] for r in df.groupBy("g").agg(S.prod_byte(F.col("v")).alias("v")).collect()}
    running = {(r["g"], r["i"]): r["v"] for r in S.cumulative(df, ["g"], "i", "prod").collect()}
    for g in range(6):
        p = 1
        for _, i, v in sorted(x for x in groups if x[0] == g):
            p = p * v % 256
            assert running[g, i] == p
        assert got[g] == p


def test_searchsorted_matches_numpy(spark):
    values, wanted = [1, 3, 3, 5, 9], [0, 1, 2, 3, 9, 10]
    got = S.searchsorted(long(spark, values), spark.createDataFrame([(k, float(x)) for k, x in enumerate(wanted)], "k long, x double")).orderBy("k").collect()
    assert [r["left"] for r in got] == np.searchsorted(values, wanted, "left").tolist()
    assert [r["right"] for r in got] == np.searchsorted(values, wanted, "right").tolist()


def test_linear_algebra(spark):
    m = np.random.default_rng(1).normal(size=(4, 4))
    spd = m @ m.T + 4 * np.eye(4)
    a = convert.from_numpy(spark, spd)
    np.testing.assert_allclose(convert.to_numpy(linalg.matrix_power(a, 3, 4), (4, 4), float), np.linalg.matrix_power(spd, 3))
    stack = a.withColumn("key", F.lit(1).cast("long"))
    for name, part, want in [("inv", "inverse", np.linalg.inv(spd)), ("cholesky", "lower", np.linalg.cholesky(spd)), ("eigvalsh", "values", np.linalg.eigvalsh(spd)[None])]:
        got = linalg.decompose(stack, name).where(F.col("part") == part).select("i0", "i1", "v")
        np.testing.assert_allclose(convert.to_numpy(got, want.shape, float), want, atol=1e-9)


def test_transforms(spark):
    x = np.random.default_rng(2).normal(size=8)
    rows = spark.createDataFrame([(1, i, float(v), 0.0) for i, v in enumerate(x)], "key long, pos long, re double, im double")
    for name in ("fft", "rfft", "ihfft"):
        got = fourier.transform(rows, name, (8,)).orderBy("pos").collect()
        np.testing.assert_allclose([complex(r["re"], r["im"]) for r in got], getattr(np.fft, name)(x), atol=1e-12)
    got = fourier.dft(rows.select("key", "pos", F.col("re").alias("v")), ["key"], 8).orderBy("k").collect()
    np.testing.assert_allclose([complex(r["re"], r["im"]) for r in got], np.fft.fft(x), atol=1e-12)


def smallest_record(vals):
    """Sizes of all encodings by definition: the least wins."""
    n, colors = len(vals), sorted(set(vals))
    bits = lambda x: max(1, int(x).bit_length())
    packed = lambda n, b: (n * b + 63) // 64 * 8
    if len(colors) == 1:
        return 0
    db, pb = bits(colors[-1]), bits(len(colors) - 1)
    sizes = [packed(n, db), n]
    if pb < db:
        sizes.append(packed(n, pb) + len(colors))
    for p in range(1, min(256, n // 2) + 1):
        if vals[p:] == vals[: n - p]:
            sizes.append(packed(p, db) + 1)
            if pb < db:
                sizes.append(packed(p, pb) + 1 + len(colors))
            break
    runs, k = [], 0
    for i in range(1, n + 1):
        if i == n or vals[i] != vals[i - 1]:
            runs.append(i - k)
            k = i
    sizes.append(sum(1 + max(1, -(-bits(r - 1) // 7)) for r in runs) + (len(colors) if pb < db else 0))
    for value in {vals[0], vals[-1]}:
        first = next(i for i in range(n) if vals[i] != value) if vals[0] == value else 0
        last = n - next(i for i in range(n) if vals[n - 1 - i] != value) if vals[-1] == value else n
        for f, t in {(first, n), (0, last), (first, last)}:
            if (vals[0] == vals[-1] and (f, t) != (first, last)) or (f, t) == (0, n):
                continue
            inner = vals[f:t]
            c = sorted(set(inner))
            sizes.append(packed(len(inner), bits(c[-1])) + 6)
            if len(c) < 256:
                sizes.append(packed(len(inner), bits(len(c) - 1)) + len(c) + 6)
    return min(sizes)


def test_storage_picks_the_smallest_and_round_trips(spark):
    rng = random.Random(927)
    chunks = []
    for i in range(240):
        n = rng.choice([1, 2, 3, 9, 17, 64, 130, 300])
        kind = i % 6
        pool = rng.choice([[0, 1], [128, 255], [0, 64, 129, 255], list(range(128, 159)), list(range(256)), list(range(8))])
        if kind == 0:
            v = [rng.choice(pool) for _ in range(n)]
        elif kind == 1:
            v = [rng.choice(pool)] * n
        elif kind == 2:
            v = (([rng.choice(pool) for _ in range(rng.randrange(1, 40))]) * (n + 1))[:n]
        elif kind == 3:
            v = [x for _ in range(n) for x in [rng.choice(pool)] * rng.choice([1, 20, 130])][:n]
        elif kind == 4:
            v = [pool[0]] * n
            for _ in range(2):
                v[rng.randrange(n)] = rng.choice(pool)
        else:
            edge = rng.randrange(n // 2 + 1)
            v = [pool[-1]] * edge + [rng.choice(pool) for _ in range(n - 2 * edge)] + [pool[-1]] * edge
        chunks.append((i, v))
    df = spark.createDataFrame(chunks, "chunk_id long, vals array<int>")
    sizes = {r["chunk_id"]: (r["stored_bytes"], r["encoding"]) for r in storage.planned(df).collect()}
    for i, v in chunks:
        assert sizes[i][0] == smallest_record(v), (v, sizes[i])
    assert {e for _, e in sizes.values()} >= {"uniform", "rle", "period", "trim", "direct"}
    again = {r["chunk_id"]: r["vals"] for r in storage.decoded(storage.encoded(df)).collect()}
    assert again == dict(chunks)


def test_storage_ranges(spark):
    a = long(spark, [i % 7 for i in range(300)])
    chunked = storage.chunks(a, 64)
    assert back(storage.read_range(chunked, 50, 200, 300, 64)) == [i % 7 for i in range(50, 200)]
    with pytest.raises(IndexError):
        storage.read_range(chunked, 50, 301, 300, 64)


def test_sequences(spark):
    df = spark.createDataFrame([(0, "AAA", 2), (1, "ACA", 1), (2, "CCC", 5), (3, "AAA", 3), (4, "AC", 4), (5, "C", 1), (6, "", 1)], "seq_id long, seq string, weight long")
    for cutoff in range(3):
        got = sorted((r["i"], r["j"], r["v"]) for r in sequences.hamming_neighbours(df, cutoff).collect())
        rows = [(r["seq_id"], r["seq"]) for r in df.collect()]
        want = sorted((i, j, d + 1) for i, s in rows for j, t in rows if len(s) == len(t) and (d := sum(a != b for a, b in zip(s, t))) <= cutoff)
        assert got == want
    with pytest.raises(Exception, match="alphabet"):
        spark.createDataFrame([("AX",)], "s string").select(sequences.codes(F.col("s"), "AC")).collect()
    chosen = spark.createDataFrame([(0, 1), (1, 6), (2, 4)], "k long, i long")
    assert [r["vals"] for r in sequences.padded_batch(df, chosen, "AC").orderBy("k").collect()] == [[0, 1, 0], [-1, -1, -1], [0, 1, -1]]


@pytest.mark.parametrize("rows,cols", [(1, 1), (1, 7), (5, 1), (7, 13)])
def test_automata(spark, rows, cols):
    g = np.random.default_rng(3).integers(0, 4, (rows, cols))
    cells = spark.createDataFrame([(y, x, int(g[y, x])) for y in range(rows) for x in range(cols)], "y long, x long, s long")
    grid = lambda df: np.array([r["s"] for r in df.orderBy("y", "x").collect()]).reshape(rows, cols)
    total = sum(np.roll(g, d, (0, 1)) for d in automata.MOORE)
    np.testing.assert_array_equal(grid(automata.totalistic(cells, rows, cols, 4)), total % 4)
    near = np.any([np.roll(g, d, (0, 1)) == (g + 1) % 4 for d in automata.VON_NEUMANN], axis=0)
    np.testing.assert_array_equal(grid(automata.cyclic(cells, rows, cols, 4)), np.where(near, (g + 1) % 4, g))


def test_records_have_the_bytes_that_the_plan_says(spark):
    rng = np.random.default_rng(31)
    rows = [rng.integers(0, 5, 400), np.repeat([3, 200, 7], [100, 250, 50]), np.tile(rng.integers(0, 200, 19), 20), np.zeros(300, int), np.concatenate([np.full(150, 9), rng.integers(0, 256, 60), np.full(90, 9)]), rng.integers(0, 256, 333), np.array([17]), rng.choice([1, 130, 255], 256)]
    df = spark.createDataFrame([(k, [int(x) for x in r]) for k, r in enumerate(rows)], "chunk_id long, vals array<int>")
    records = storage.encoded(df)
    got = records.select("chunk_id", "encoding", "stored_bytes", storage.record_bytes(records).alias("real")).collect()
    assert all(r["stored_bytes"] == r["real"] for r in got) and {"rle", "period", "uniform", "trim"} <= {r["encoding"] for r in got}
    again = {r["chunk_id"]: r["vals"] for r in storage.decoded(records).collect()}
    assert all(again[k] == list(r) for k, r in enumerate(rows))


def test_damaged_runs_raise(spark):
    from pyspark.errors import PySparkException

    good = bytes([5, 2, 9, 0x80 | 3, 1])
    for raw, n in ((good[:-1], 135), (good, 134), (good[:3], 3)):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(raw, n)], "raw binary, n int").select(storage.runs_of(F.col("raw"), F.col("n"))).collect()
    assert [tuple(r) for r in spark.createDataFrame([(good, 135)], "raw binary, n int").select(storage.runs_of(F.col("raw"), F.col("n")).alias("x")).first()["x"]] == [(5, 3), (9, 132)]


def test_cache_model_over_many_blocks(spark):
    rng = np.random.default_rng(32)
    trace = [(i, int(x)) for i, x in enumerate(rng.integers(0, 12, 300) * 16)]
    trace = trace[:100] + [(s + 400, p) for s, p in trace[100:]]  # blocks without reads in between
    held, hits = [], 0
    for _, p in trace:
        c = p // 16
        hits += c in held
        held = [c, *(x for x in held if x != c)][:5]
    got = storage.simulated_cache(spark.createDataFrame(trace, "step long, pos long"), 16, 5, block=7).first()
    assert (got["hits"], got["misses"]) == (hits, len(trace) - hits)


def test_dictionary_ids_follow_first_appearance(spark):
    from nibblespark.operators import workloads

    keys = [f"k{x}" for x in np.random.default_rng(33).integers(0, 90, 400)]
    got = {r["k"]: r["id"] for r in workloads.dictionary(spark.createDataFrame(list(enumerate(keys)), "at long, k string"), "k", "at").collect()}
    assert got == {k: i for i, k in enumerate(dict.fromkeys(keys))}
