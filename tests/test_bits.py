"""Packing, widths and layouts against Python integers."""

import random

import pytest
from pyspark.sql import functions as F

from nibblespark.functions import bits as B
from nibblespark.schema import ArraySpec, checked, minimum_bits, widened
from nibblespark.sources import convert

#: Around every word boundary of the first words, of both layouts.
LENGTHS = sorted({0, *(k * (64 // b) + d for k in (1, 2) for b in (3, 5, 8) for d in (-1, 0, 1)), *(k * 64 + d for k in (1, 3) for d in (-1, 0, 1))})


def words_of(values, bits, aligned):
    if aligned:
        per = 64 // bits
        out = [sum(v << (i * bits) for i, v in enumerate(values[k : k + per])) for k in range(0, len(values), per)]
    else:
        n = sum(v << (i * bits) for i, v in enumerate(values))
        out = [n >> (64 * k) & (2**64 - 1) for k in range(-(-len(values) * bits // 64))]
    return [w - 2**64 if w >> 63 else w for w in out]


@pytest.mark.parametrize("aligned", [False, True])
def test_every_width_packs_like_integers(spark, aligned):
    rng = random.Random(20_611)
    rows = [(bits, n, [rng.randrange(1 << bits) for _ in range(n)]) for bits in range(1, 9) for n in LENGTHS]
    for bits in range(1, 9):
        mine = [r for r in rows if r[0] == bits]
        df = spark.createDataFrame(mine, "bits int, n long, vals array<int>")
        packed = df.select("n", "vals", B.pack(F.col("vals"), bits, aligned).alias("w"))
        got = packed.select("vals", "w", B.unpack(F.col("w"), F.col("n"), bits, aligned).alias("again"), B.count_packed(F.col("w"), F.col("n"), 1, bits).alias("ones"), B.count_packed(F.col("w"), F.col("n"), 0, bits).alias("zeros")).collect()
        for r in got:
            assert r["w"] == words_of(r["vals"], bits, aligned)
            assert r["again"] == r["vals"]
            if aligned:
                assert (r["ones"], r["zeros"]) == (r["vals"].count(1), r["vals"].count(0))


@pytest.mark.parametrize("bits,aligned", [(3, False), (5, False), (3, True), (8, True)])
def test_long_form_packs_to_the_same_words(spark, bits, aligned):
    values = [random.Random(3).randrange(1 << bits) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v int")
    got = {r["word_id"]: r["word"] for r in B.pack_rows(df, bits, aligned).collect()}
    assert [got.get(k, 0) for k in range(max(got) + 1)] == words_of(values, bits, aligned)


def test_wire_keeps_padding_and_packed_bytes_drop_the_tail(spark):
    word = 0xF123456789ABCDEF
    df = spark.createDataFrame([([word - 2**64, 5],)], "w array<long>")
    r = df.select(B.wire_bytes(F.col("w")).alias("raw"), B.from_wire(B.wire_bytes(F.col("w")), F.lit(2).cast("long")).alias("again"), B.wire_padding(F.col("w"), F.lit(21).cast("long"), 3).alias("pad"), B.packed_bytes(F.col("w")).alias("little")).first()
    assert bytes(r["raw"]) == word.to_bytes(8, "big") + (5).to_bytes(8, "big")
    assert r["again"] == [word - 2**64, 5]
    assert r["pad"] == [-(2**63), 5]
    assert bytes(r["little"]) == word.to_bytes(8, "little") + (5).to_bytes(8, "little")
    tail = spark.createDataFrame([(bytes([255] * 8),)], "raw binary").select(B.from_packed_bytes(F.col("raw"), F.lit(3).cast("long"), 5).alias("w")).first()
    assert tail["w"] == [(1 << 15) - 1]


def test_values_that_do_not_fit_raise(spark):
    for bad in ([8], [-1]):
        with pytest.raises(ValueError):
            convert.from_values(spark, bad, bits=3)
    with pytest.raises(TypeError):
        convert.from_values(spark, [1.5], bits=3)
    with pytest.raises(Exception, match="more bits than the array has"):
        spark.createDataFrame([(9,)], "v int").select(checked(F.col("v"), 3).alias("v")).collect()
    with pytest.raises(ValueError):
        ArraySpec((3,), 9)


def test_width_is_inferred_and_widens(spark):
    df = spark.createDataFrame([(0,), (31,)], "v int")
    r = df.agg(minimum_bits(F.col("v")).alias("b"), widened(3, F.col("v")).alias("w")).first()
    assert (r["b"], r["w"]) == (5, 5)
    with pytest.raises(Exception, match="wider"):
        df.agg(widened(3, F.col("v"), strict=True)).collect()
    assert df.where("v < 0").agg(minimum_bits(F.col("v")).alias("b")).first()["b"] == 1


def test_store_rewrites_one_element(spark):
    values = list(range(32)) * 2
    df = spark.createDataFrame([(values,)], "vals array<int>").select(B.pack(F.col("vals"), 5).alias("w"))
    for i in (0, 12, 25, 63):
        got = df.select(B.unpack(B.store(F.col("w"), F.lit(i).cast("long"), F.lit(17), 5), F.lit(64).cast("long"), 5).alias("v")).first()["v"]
        assert got == [17 if k == i else x for k, x in enumerate(values)]


def test_packed_parquet_round_trip(spark, tmp_path):
    values = [(i * 7) % 32 for i in range(1000)]
    a = convert.from_values(spark, values, bits=5)
    for layout in ("packed", "word-aligned"):
        path = f"file://{tmp_path}/{layout}"
        convert.write_packed(a, path, 5, layout, block=64)
        assert convert.to_list(convert.read_packed(spark, path, 5, layout, block=64)) == values
        assert convert.to_list(convert.read_packed(spark, path, 5, layout, block=64, start=100, stop=300)) == values[100:300]
