"""Queries over one-dimensional arrays: packing, counting, selection, searching, sets, running functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import numeric
from ..operators import arrays as R
from ..operators import statistics as S
from ..schema import minimum_bits
from ..sources.tables import array, positioned, table
from .catalogue import query

#: Signed 64-bit value of an unsigned sum in DuckDB.
SIGNED = "CAST(CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END AS BIGINT)"


def words_sql(bits: int, aligned: bool) -> str:
    if aligned:
        per = 64 // bits
        return f"WITH {{A}}, w AS (SELECT pos // {per} AS word_id, sum(CAST(v & {(1 << bits) - 1} AS HUGEINT) * CAST(pow(2, (pos % {per}) * {bits}) AS HUGEINT)) AS x FROM a GROUP BY 1) SELECT CAST(word_id AS BIGINT) AS word_id, {SIGNED} AS word FROM w"
    return f"""WITH {{A}}, e AS (SELECT pos * {bits} // 64 AS w, pos * {bits} % 64 AS s, CAST(v & {(1 << bits) - 1} AS HUGEINT) AS v FROM a),
p AS (SELECT w, v * CAST(pow(2, s) AS HUGEINT) % 18446744073709551616 AS x FROM e UNION ALL SELECT w + 1, v // CAST(pow(2, 64 - s) AS HUGEINT) FROM e WHERE s + {bits} > 64),
g AS (SELECT w, sum(x) AS x FROM p GROUP BY 1) SELECT CAST(w AS BIGINT) AS word_id, {SIGNED} AS word FROM g"""


def _register_words() -> None:
    for bits, aligned in [(3, False), (5, False), (7, False), (1, False), (8, False), (3, True), (5, True), (6, True), (7, True), (8, True), (2, True), (4, True)]:

        def run(spark: SparkSession, sf_dir: str, bits: int = bits, aligned: bool = aligned) -> DataFrame:
            a = array(spark, sf_dir).withColumn("v", F.col("v").bitwiseAND(F.lit((1 << bits) - 1)))
            return B.pack_rows(a, bits, aligned)

        query(words_sql(bits, aligned), f"pack_words_{'aligned_' if aligned else ''}{bits}bit")(run)


_register_words()


@query("WITH {A}, c AS (SELECT pos // 4096 AS chunk_id, count(*) AS n, sum(v) AS total, count(*) FILTER (WHERE v = 1) AS ones FROM a GROUP BY 1) SELECT CAST(chunk_id AS BIGINT) AS chunk_id, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, CAST(ones AS BIGINT) AS ones FROM c")
def pack_unpack_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.to_rows(array(spark, sf_dir), 4096)
    packed = rows.select("row", F.size("vals").cast("long").alias("n"), B.pack(F.col("vals"), 3).alias("words"))
    vals = packed.select(F.col("row").alias("chunk_id"), "n", B.unpack(F.col("words"), F.col("n"), 3).alias("vals"))
    return vals.select("chunk_id", "n", F.aggregate("vals", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"), F.size(F.filter("vals", lambda x: x == 1)).cast("long").alias("ones"))


def _register_round_trips() -> None:
    for bits in range(1, 9):
        for aligned in (False, True):

            def run(spark: SparkSession, sf_dir: str, bits: int = bits, aligned: bool = aligned) -> DataFrame:
                v = (F.col("l_quantity").cast("long") * 7 + F.col("l_suppkey")).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
                rows = R.to_rows(array(spark, sf_dir, v), 1021)
                back = rows.select("vals", B.unpack(B.pack(F.col("vals"), bits, aligned), F.size("vals").cast("long"), bits, aligned).alias("again"))
                same = F.zip_with("vals", "again", lambda x, y: (x != y).cast("long"))
                return back.agg(F.sum(F.aggregate(same, F.lit(0).cast("long"), lambda acc, x: acc + x)).alias("mismatches"), F.sum(F.aggregate("again", F.lit(0).cast("long"), lambda acc, x: acc + x)).alias("total"))

            query(f"WITH {{A}} SELECT CAST(0 AS BIGINT) AS mismatches, CAST(sum((q * 7 + s) & {(1 << bits) - 1}) AS BIGINT) AS total FROM a", f"pack_roundtrip_{'aligned_' if aligned else ''}{bits}")(run)


_register_round_trips()


@query("WITH {A}, w AS (SELECT pos // 21 AS word_id, sum(CAST(v AS HUGEINT) * CAST(pow(2, (pos % 21) * 3) AS HUGEINT)) AS x FROM a GROUP BY 1) SELECT CAST(word_id AS BIGINT) AS word_id, lpad(hex(CAST(x AS UBIGINT)), 16, '0') AS raw, CAST(x AS BIGINT) AS word, CAST(0 AS BIGINT) AS padding FROM w")
def wire_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = B.pack_rows(array(spark, sf_dir), 3, True)
    one = words.select("word_id", F.array("word").alias("w"))
    raw = one.select("word_id", "w", B.wire_bytes(F.col("w")).alias("raw"))
    # a step of its own: inside a lambda, "raw" would mean the new column of that name
    back = raw.select("word_id", "raw", F.get(B.from_wire(F.col("raw"), F.lit(1).cast("long")), 0).alias("word"), F.get(B.wire_padding(F.col("w"), F.lit(21).cast("long"), 3), 0).alias("padding"))
    return back.select("word_id", F.hex("raw").alias("raw"), "word", "padding")


@query("WITH {A} SELECT CAST(count(*) FILTER (WHERE v = 3) AS BIGINT) AS threes, CAST(count(*) FILTER (WHERE v = 99) AS BIGINT) AS absent, CAST(count(*) FILTER (WHERE d <> 0) AS BIGINT) AS nonzero, CAST(sum(v) AS BIGINT) AS total, CAST(3 AS INTEGER) AS bits FROM a")
def count_and_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("v"), F.round(F.col("l_discount") * 100).cast("int").alias("d"))  # order doesn't matter
    return a.agg(F.count_if(F.col("v") == 3).alias("threes"), F.count_if(F.col("v") == 99).alias("absent"), S.count_nonzero(F.col("d")).alias("nonzero"), S.sum_(F.col("v")).alias("total"), minimum_bits(F.col("v")).alias("bits"))


@query("WITH {A}, r AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS bits) SELECT CAST(bits AS BIGINT) AS bits, CAST(count(*) FILTER (WHERE (q & (CAST(pow(2, bits) AS BIGINT) - 1)) = (CASE WHEN bits > 1 THEN 2 ELSE 1 END)) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE (q & (CAST(pow(2, bits) AS BIGINT) - 1)) = 0) AS BIGINT) AS zeros FROM a, r GROUP BY bits")
def count_in_packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on packed words, without unpacking: words of all widths in one aggregate."""
    q = array(spark, sf_dir, F.col("l_quantity"))

    def cell(bits: int) -> Column:
        lanes = 64 // bits
        v = F.col("v").cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        return F.struct(F.lit(bits).cast("long").alias("bits"), F.floor(F.col("pos") / lanes).alias("word_id"), F.call_function("shiftleft", v, ((F.col("pos") % lanes) * bits).cast("int")).alias("x"))

    words = q.select(F.explode(F.array(*map(cell, range(1, 9)))).alias("c")).groupBy("c.bits", "c.word_id").agg(F.bit_or("c.x").alias("word"), F.count("*").alias("n"))
    per = lambda f: F.coalesce(*(F.when(F.col("bits") == b, f(b)) for b in range(1, 9)))
    hits, zeros = per(lambda b: B.count_in_word(F.col("word"), 2 if b > 1 else 1, b)), per(lambda b: B.count_in_word(F.col("word"), 0, b))
    free = per(lambda b: 64 // b - F.col("n"))  # lanes that hold no element
    return words.groupBy("bits").agg(F.sum(hits).alias("hits"), F.sum(zeros - free).alias("zeros"))


@query("WITH {A} SELECT CAST((pos - 11) // 3 AS BIGINT) AS pos, v FROM a WHERE pos >= 11 AND pos < 50000 AND (pos - 11) % 3 = 0")
def slice_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.take_slice(array(spark, sf_dir), 11, 50_000, 3, 1 << 40).select("pos", F.col("v").cast("long").alias("v"))


@query("WITH {A} SELECT CAST((9000 - pos) // 7 AS BIGINT) AS pos, v FROM a WHERE pos <= 9000 AND pos > 100 AND (9000 - pos) % 7 = 0")
def slice_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.take_slice(array(spark, sf_dir), 9000, 100, -7, 10_000).select("pos", F.col("v").cast("long").alias("v"))


def _indices(spark: SparkSession) -> DataFrame:
    return spark.range(500).select(F.col("id").alias("k"), ((F.col("id") * 7919) % 1000 - 400).alias("i"))


GATHER = "WITH {A}, n AS (SELECT count(*) AS n FROM a), i AS (SELECT k, (k * 7919) % 1000 - 400 AS i FROM range(500) r(k)), c AS (SELECT k, i, n FROM i, n) SELECT CAST(i.k AS BIGINT) AS k, a.v FROM c i JOIN a ON a.pos = {AT}"


@query(GATHER.replace("{AT}", "CASE WHEN i.i < 0 THEN i.i + i.n ELSE i.i END"))
def gather_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gather(array(spark, sf_dir), _indices(spark)).select("k", F.col("v").cast("long").alias("v"))


@query(GATHER.replace("{AT}", "greatest(0, least(i.n - 1, i.i))"))
def take_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gather(array(spark, sf_dir), _indices(spark), mode="clip").select("k", F.col("v").cast("long").alias("v"))


@query(GATHER.replace("{AT}", "((i.i % i.n) + i.n) % i.n"))
def take_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gather(array(spark, sf_dir), _indices(spark), mode="wrap").select("k", F.col("v").cast("long").alias("v"))


@query("WITH {A}, u AS (SELECT (step * 31) % 997 AS pos, max_by(step % 8, step) AS x FROM range(2000) r(step) GROUP BY 1) SELECT a.pos, CAST(coalesce(u.x, a.v) AS BIGINT) AS v FROM a LEFT JOIN u USING (pos)")
def scatter_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("id")
    updates = spark.range(2000).select(step.alias("step"), ((step * 31) % 997).alias("pos"), (step % 8).alias("v"))
    return R.scatter(array(spark, sf_dir).withColumn("v", F.col("v").cast("long")), updates)


@query("WITH {A}, f AS (SELECT pos, v, lead(v) OVER (ORDER BY pos) AS b, lead(v, 2) OVER (ORDER BY pos) AS c FROM a) SELECT CAST(coalesce(min(pos) FILTER (WHERE v = 1 AND b = 2 AND c = 3), -1) AS BIGINT) AS found, CAST(-1 AS BIGINT) AS absent, CAST(0 AS BIGINT) AS empty FROM f")
def find_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir)
    found = R.find(a, [1, 2, 3], name="found")
    return found.join(R.find(a, [7, 0, 7], name="absent")).join(R.find(a, [], name="empty"))


@query("WITH {A} SELECT true AS same, CAST(count(*) FILTER (WHERE v <> (v & 3)) AS BIGINT) AS differences FROM a")
def equals_across_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array against itself unpacked from another layout, and against a narrower one."""
    rows = R.to_rows(array(spark, sf_dir), 4096)
    aligned = R.to_long(rows.select("row", B.unpack(B.pack(F.col("vals"), 3, True), F.size("vals").cast("long"), 3, True).alias("vals")), 4096)
    a = array(spark, sf_dir)
    narrow = a.withColumn("v", F.col("v").bitwiseAND(F.lit(3)))
    return R.equals(a, aligned).withColumnRenamed("equal", "same").join(R.mismatches(a, narrow).agg(F.count("*").alias("differences")))


@query("WITH {A} SELECT v, CAST(min(pos) AS BIGINT) AS first, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS inverse FROM a GROUP BY v")
def unique_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unique_all(array(spark, sf_dir).withColumn("v", F.col("v").cast("long")))


@query("WITH {A} SELECT pos, CAST(dense_rank() OVER (ORDER BY q) - 1 AS BIGINT) AS inverse FROM a")
def unique_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unique_inverse(array(spark, sf_dir, F.col("l_quantity")))


@query("WITH {A} SELECT CAST(count(*) FILTER (WHERE q IN (SELECT p_size FROM part WHERE p_size < 26)) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE q NOT IN (SELECT p_size FROM part WHERE p_size < 26)) AS BIGINT) AS missing FROM a")
def isin_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir, F.col("l_quantity"))
    test = table(spark, sf_dir, "part").where("p_size < 26").select(F.col("p_size").alias("v"))
    return S.isin(a, test).agg(F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing"))


SETS = "WITH x AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS v FROM lineitem WHERE l_quantity > 20), y AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS v FROM part WHERE p_size < 40) "


@query(SETS + "SELECT v FROM x UNION SELECT v FROM y", "set_union")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.union(*_two(spark, sf_dir))


@query(SETS + "SELECT v FROM x INTERSECT SELECT v FROM y", "set_intersect")
def _intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.intersect(*_two(spark, sf_dir))


@query(SETS + "SELECT v FROM x EXCEPT SELECT v FROM y", "set_difference")
def _difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.difference(*_two(spark, sf_dir))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = table(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_quantity").cast("long").alias("v"))
    return x, table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_size").cast("long").alias("v"))


@query("WITH {A} SELECT CAST(pos // 1024 AS BIGINT) AS chunk, pos, CAST(sum(v) OVER w AS BIGINT) AS total, CAST(max(v) OVER w AS BIGINT) AS top, CAST(min(v) OVER w AS BIGINT) AS low FROM a WINDOW w AS (PARTITION BY pos // 1024 ORDER BY pos)")
def cumulative_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir).select(F.floor(F.col("pos") / 1024).cast("long").alias("chunk"), "pos", F.col("v").cast("long").alias("v"))
    parts = [S.cumulative(a, ["chunk"], "pos", how).withColumnRenamed("v", name) for how, name in (("sum", "total"), ("max", "top"), ("min", "low"))]
    return parts[0].join(parts[1], ["chunk", "pos"]).join(parts[2], ["chunk", "pos"])


@query("WITH {A} SELECT pos, CAST(sum(v) OVER (ORDER BY pos) AS BIGINT) AS total FROM a")
def cumulative_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum of the whole array in two levels."""
    a = array(spark, sf_dir)
    return R.running(a, F.col("v").cast("long"), F.floor(F.col("pos") / 8192), F.col("pos"), "total").select("pos", "total")


@query("WITH RECURSIVE {A}, o AS MATERIALIZED (SELECT pos, CASE WHEN v IN (2, 4, 6) THEN v + 1 ELSE v END AS v FROM a), r(pos, prod) AS (SELECT pos, v FROM o WHERE pos % 32 = 0 UNION ALL SELECT o.pos, (r.prod * o.v) % 256 FROM r JOIN o ON o.pos = r.pos + 1 WHERE o.pos % 32 <> 0) SELECT pos, CAST(prod AS BIGINT) AS prod FROM r")
def cumulative_product_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir)
    odd = a.select("pos", F.floor(F.col("pos") / 32).alias("chunk"), F.when(F.col("v").isin(2, 4, 6), F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    return S.cumulative(odd, ["chunk"], "pos", "prod").select("pos", F.col("v").alias("prod"))


@query("WITH {A}, d AS (SELECT pos // 512 AS chunk, pos % 512 AS i, q - lag(q) OVER (PARTITION BY pos // 512 ORDER BY pos) AS x FROM a), e AS (SELECT chunk, i, x - lag(x) OVER (PARTITION BY chunk ORDER BY i) AS x FROM d WHERE x IS NOT NULL) SELECT CAST(chunk AS BIGINT) AS chunk, CAST(i - 2 AS BIGINT) AS pos, CAST(((x % 256) + 256) % 256 AS BIGINT) AS v FROM e WHERE x IS NOT NULL")
def diff_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir, F.col("l_quantity")).select(F.floor(F.col("pos") / 512).cast("long").alias("chunk"), (F.col("pos") % 512).alias("pos"), F.col("v").cast("long").alias("v"))
    return S.diff(a, ["chunk"], "pos", 2, byte=True)


@query("WITH {A} SELECT CAST(min(pos) FILTER (WHERE q = m) AS BIGINT) AS argmax, CAST(min(pos) FILTER (WHERE q = l) AS BIGINT) AS argmin FROM a, (SELECT max(q) AS m, min(q) AS l FROM a)")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir, F.col("l_quantity"))
    return a.agg(S.argmax(F.col("pos"), F.col("v")).alias("argmax"), S.argmin(F.col("pos"), F.col("v")).alias("argmin"))


def _sort_sql(how: str) -> str:
    return f"WITH {{A}} SELECT CAST(pos // 2048 AS BIGINT) AS chunk, CAST(row_number() OVER (PARTITION BY pos // 2048 ORDER BY q {how}, pos) - 1 AS BIGINT) AS rank, q AS v, pos AS source FROM a"


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return array(spark, sf_dir, F.col("l_quantity")).select(F.floor(F.col("pos") / 2048).cast("long").alias("chunk"), "pos", F.col("v").cast("long").alias("v"))


@query(_sort_sql(""))
def argsort_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sort(_chunked(spark, sf_dir), ["chunk"], "pos")


@query(_sort_sql("DESC"))
def sort_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sort(_chunked(spark, sf_dir), ["chunk"], "pos", descending=True)


@query("WITH {A}, k AS (SELECT k, k * 5 - 3.5 + (k % 2) * 0.5 AS x FROM range(15) r(k)) SELECT CAST(k AS BIGINT) AS k, CAST(count(*) FILTER (WHERE q < x) AS BIGINT) AS left, CAST(count(*) FILTER (WHERE q <= x) AS BIGINT) AS right FROM a, k GROUP BY k")
def searchsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    wanted = spark.range(15).select(k.alias("k"), (k * 5 - 3.5 + (k % 2) * 0.5).alias("x"))
    return S.searchsorted(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("v")), wanted)


@query("WITH {A} SELECT pos FROM a WHERE d <> 0")
def nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nonzero(array(spark, sf_dir, F.round(F.col("l_discount") * 100)))


@query("WITH {A} SELECT CAST(sum(CASE WHEN d > 5 THEN q ELSE t END) AS BIGINT) AS chosen, CAST(sum(least(greatest(q, 10), 40)) AS BIGINT) AS clipped FROM a")
def where_and_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = positioned(spark, sf_dir, "l_quantity", "l_discount", "l_tax")
    q, d, t = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100).cast("long")
    return x.agg(F.sum(F.when(d > 5, q).otherwise(t)).alias("chosen"), F.sum(numeric.clip(q, F.lit(10), F.lit(40))).alias("clipped"))


@query("WITH {A} SELECT pos, v FROM a WHERE pos < 700 UNION ALL SELECT pos - 1000 + 700, v FROM a WHERE pos >= 1000 AND pos < 1300")
def concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir).withColumn("v", F.col("v").cast("long"))
    return R.concat([(R.take_slice(a, 0, 700, 1, 1 << 40), 700), (R.take_slice(a, 1000, 1300, 1, 1 << 40), 300)])


RAGGED = "WITH n AS (SELECT o_orderkey AS row, count(l_orderkey) AS n, coalesce(sum(l_linenumber), 0) AS total, count(*) FILTER (WHERE l_linenumber = 2) AS twos FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) "


@query(RAGGED + "SELECT row, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY row) - n AS BIGINT) AS start, CAST(total AS BIGINT) AS total, CAST(twos AS BIGINT) AS twos FROM n")
def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of unequal length, empty ones included: lengths, offsets, sums, counts."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"), F.count_if(F.col("l_linenumber") == 2).alias("twos"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row")).join(lines.withColumnRenamed("l_orderkey", "row"), "row", "left").fillna(0, ["n", "total", "twos"])
    placed = R.running(rows, F.col("n"), F.floor(F.col("row") / 4096), F.col("row"), "end")
    return placed.select("row", "n", (F.col("end") - F.col("n")).alias("start"), "total", "twos")


@query("WITH {A}, o AS (SELECT k, k * k * 3 AS off FROM range(60) r(k)), b AS (SELECT k, off AS lo, lead(off) OVER (ORDER BY k) AS hi FROM o) SELECT CAST(b.k AS BIGINT) AS row, CAST(count(a.pos) AS BIGINT) AS n, CAST(coalesce(sum(a.v), 0) AS BIGINT) AS total FROM b LEFT JOIN a ON a.pos >= b.lo AND a.pos < b.hi WHERE hi IS NOT NULL GROUP BY 1")
def ragged_from_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * F.col("id") * 3).alias("off"))
    rows = R.ragged_from_offsets(array(spark, sf_dir), offsets)
    return rows.select("row", F.size("vals").cast("long").alias("n"), F.aggregate("vals", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"))
