"""The array objects behave like lists of small integers and NumPy's unsigned bytes."""

import numpy as np
import pytest

from nibblespark.api import Array, Matrix, RaggedArray

VALUES = [1, 7, 0, 3, 3, 5, 7, 2, 6, 4]


def test_reading(spark):
    a = Array.of(spark, VALUES, bits=3)
    assert len(a) == 10 and a[-1] == 4 and a[2:8:3].tolist() == VALUES[2:8:3] and a[::-1].tolist() == VALUES[::-1]
    assert (a.count(3), a.count(99), a.sum(), a.count_nonzero()) == (2, 0, sum(VALUES), 9)
    assert a.gather([9, 0, -1, 0]).tolist() == [4, 1, 4, 1] and a.tobytes() == bytes(VALUES)
    assert a.find([3, 5]) == 4 and a.find([5, 3]) == -1 and a.find([]) == 0
    with pytest.raises(ValueError):
        a.find([9])
    for bad in (10, -11):
        with pytest.raises(IndexError):
            a[bad]
        with pytest.raises(IndexError):
            a.gather([bad])
    with pytest.raises(ValueError):
        bool(a)


def test_writes_are_new_arrays(spark):
    a = Array.of(spark, VALUES, bits=3)
    b = a.put(-1, 0)
    assert b.tolist() == VALUES[:-1] + [0] and a.tolist() == VALUES and not a.equals(b)
    assert a.equals(Array.of(spark, VALUES, bits=8, layout="word-aligned")) and not a.equals(VALUES)
    with pytest.raises(ValueError):
        a.put(0, 8)


def test_arithmetic_wraps_like_bytes(spark):
    x, y = np.array(VALUES, np.uint8), np.array(VALUES[::-1], np.uint8)
    a, b = Array.of(spark, VALUES), Array.of(spark, VALUES[::-1])
    with np.errstate(all="ignore"):
        for got, want in [(a + b, x + y), (a - b, x - y), (a * b, x * y), (a // b, x // y), (a % b, x % y), (a & b, x & y), (a | 5, x | 5), (7 ^ a, 7 ^ x), (a << b, x << y), (250 - a, 250 - x), (-a, -x), (~a, ~x), (a == b, x == y), (a < b, x < y), (a >= 3, x >= 3)]:
            assert got.tolist() == want.tolist()


def test_rows(spark):
    cells = [[(3 * i + k * k) % 8 for k in range(4)] for i in range(5)]
    m = Matrix.of(spark, cells, bits=3)
    assert m.shape == (5, 4) and m.tolist() == cells and m.count(4) == sum(r.count(4) for r in cells)
    assert all(m[i, k] == cells[i][k] for i, k in ((0, 0), (4, 3), (-1, -2))) and m[3].tolist() == cells[3]
    assert all(m[key].tolist() == cells[key] for key in (slice(1, 4), slice(None, None, 3), slice(-2, None)))
    lists = [list(range(n)) for n in (2, 0, 5, 1, 0, 0, 3)]
    r = RaggedArray.of(spark, lists, bits=3)
    assert r.tolist() == lists and r.shape == (len(lists), None) and [r[k].tolist() for k in (2, -1)] == [lists[2], lists[-1]]
    assert r.count(1) == sum(x.count(1) for x in lists)
    assert [x["vals"] for x in r.rows.orderBy("row").collect()] == lists
    with pytest.raises(ValueError):
        Matrix.of(spark, [[2, 3], [4]])
