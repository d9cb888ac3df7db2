"""Queries over N-dimensional arrays: axis reductions, views, broadcasting, manipulation, linear algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fourier, linalg
from ..operators import ndarray as D
from ..operators import statistics as S
from ..schema import ArraySpec
from ..sources.tables import array, table
from .catalogue import query

WIDE = "m AS (SELECT pos // 64 AS i0, pos % 64 AS i1, v, q FROM a)"
#: Lines as a cube: order modulo 7, line number, supplier modulo 5; duplicates are summed first.
CUBE = "c AS (SELECT CAST(l_orderkey % 7 AS BIGINT) AS i0, CAST(l_linenumber AS BIGINT) - 1 AS i1, CAST(l_suppkey % 5 AS BIGINT) AS i2, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3)"
SHAPE = (7, 16, 5)


def _matrix(spark: SparkSession, sf_dir: str, value=None) -> DataFrame:
    a = array(spark, sf_dir, value)
    return a.select(F.floor(F.col("pos") / 64).cast("long").alias("i0"), (F.col("pos") % 64).alias("i1"), F.col("v").cast("long").alias("v"))


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy((F.col("l_orderkey") % 7).alias("i0"), (F.col("l_linenumber") - 1).cast("long").alias("i1"), (F.col("l_suppkey") % 5).alias("i2")).agg(F.sum("l_quantity").cast("long").alias("v"))


@query("WITH {A}, " + WIDE + " SELECT CAST(i0 AS BIGINT) AS i0, CAST(sum(v) AS BIGINT) AS v FROM m GROUP BY 1")
def matrix_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reduce_axes(_matrix(spark, sf_dir), ArraySpec((1 << 30, 64)), F.sum("v"), 1)


@query("WITH {A}, " + WIDE + " SELECT CAST(0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, CAST(sum(v) AS BIGINT) AS v FROM m GROUP BY i1")
def matrix_column_sums_keepdims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reduce_axes(_matrix(spark, sf_dir), ArraySpec((1 << 30, 64)), F.sum("v"), 0, keepdims=True)


@query("WITH {A}, " + WIDE + " SELECT CAST(i1 AS BIGINT) AS i0, CAST(i0 AS BIGINT) AS i1, v FROM m")
def matrix_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.transpose(_matrix(spark, sf_dir))


@query("WITH " + CUBE + " SELECT i0, i1, i2, CAST(grouping(i0, i1, i2) AS BIGINT) AS gone, CAST(sum(v) AS BIGINT) AS v FROM c GROUP BY CUBE (i0, i1, i2)")
def axis_sums_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sums_of_all_axes(_cube(spark, sf_dir), 3)


@query("WITH " + CUBE + " SELECT i1 AS i0, CAST(sum(v) AS BIGINT) AS total, CAST(max(v) AS BIGINT) AS top, CAST(min(v) AS BIGINT) AS low, round(avg(v), 6) AS mean, round(var_pop(v), 4) AS var0, round(var_samp(v), 4) AS var1, round(stddev_pop(v), 4) AS std0, bool_and(v > 5) AS every, bool_or(v > 900) AS some, CAST(count(*) FILTER (WHERE v <> 0) AS BIGINT) AS nonzero FROM c GROUP BY i1")
def axis_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _cube(spark, sf_dir).groupBy(F.col("i1").alias("i0")).agg(
        S.sum_(v).alias("total"), S.maximum(v).alias("top"), F.min(v).alias("low"), F.round(F.avg(v), 6).alias("mean"), F.round(S.variance(v), 4).alias("var0"), F.round(S.variance(v, 1), 4).alias("var1"),
        F.round(S.std(v), 4).alias("std0"), S.all_(v > 5).alias("every"), S.any_(v > 900).alias("some"), S.count_nonzero(v).alias("nonzero"),
    )


@query("WITH " + CUBE + ", n AS (SELECT i0, (2 * i1 + 1) % 256 AS v FROM c), g AS (SELECT i0, list(v) AS l FROM n GROUP BY i0) SELECT i0, CAST(list_reduce(list_concat([CAST(1 AS BIGINT)], l), lambda p, q: p * q % 256) AS BIGINT) AS v FROM g")
def axis_product_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = _cube(spark, sf_dir).withColumn("v", 2 * F.col("i1") + 1)
    return odd.groupBy("i0").agg(S.prod_byte(F.col("v")).alias("v"))


@query("WITH {A}, i AS (SELECT x AS i0, y AS i1 FROM range(40) r(x), range(30) s(y)) SELECT CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, v FROM i JOIN a ON a.pos = 5000 - 60 * i0 + 2 * i1")
def view_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view with a negative stride."""
    root = array(spark, sf_dir).withColumn("v", F.col("v").cast("long"))
    return D.affine_view(root, (40, 30), (-60, 2), 5000, 1 << 40)


@query("WITH {A}, " + WIDE + ", b AS (SELECT i1, v FROM m WHERE i0 = 3) SELECT CAST(m.i0 AS BIGINT) AS i0, CAST(m.i1 AS BIGINT) AS i1, CAST((m.q + b.v) % 256 AS BIGINT) AS v FROM m JOIN b USING (i1)")
def broadcast_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row added to every row of a matrix."""
    n = 1 << 30
    row = _matrix(spark, sf_dir).where("i0 = 3").select(F.col("i1").alias("i0"), "v")
    return D.elementwise(_matrix(spark, sf_dir, F.col("l_quantity")), (n, 64), row, (64,), lambda x, y: (x + y) % 256)


@query("WITH " + CUBE + " SELECT i2 AS i0, CAST(0 AS BIGINT) AS i1, i0 AS i2, v FROM c WHERE i1 = 3 AND i0 >= 1")
def basic_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer, a new axis, a slice and an axis move in one expression."""
    view, shape = D.basic_index(_cube(spark, sf_dir), ArraySpec(SHAPE), (slice(1, None), 3, None, Ellipsis))
    moved = D.permute(view, (2, 1, 0))
    return moved.withColumn("i2", F.col("i2") + 1)


@query("WITH " + CUBE + " SELECT CAST(row_number() OVER (ORDER BY i0, i1, i2) - 1 AS BIGINT) AS pos, v FROM c WHERE v % 3 = 0")
def boolean_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cube(spark, sf_dir)
    return D.boolean_mask(c, c.withColumn("v", F.col("v") % 3 == 0), ArraySpec(SHAPE))


@query("WITH " + CUBE + ", k AS (SELECT * FROM (VALUES (0, 4), (1, 0), (2, 4), (3, 2)) t(k, i)) SELECT c.i0, c.i1, CAST(k.k AS BIGINT) AS i2, c.v FROM c JOIN k ON k.i = c.i2")
def take_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.take_axis(_cube(spark, sf_dir), [4, 0, -1, 2], 2, SHAPE)


@query("WITH " + CUBE + ", x AS (SELECT i0, i1, i2, (i0 + i1) % 5 AS j FROM c) SELECT x.i0, x.i1, x.i2, c.v FROM x JOIN c ON c.i0 = x.i0 AND c.i1 = x.i1 AND c.i2 = x.j")
def take_along_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cube(spark, sf_dir)
    return D.take_along_axis(c, c.withColumn("v", (F.col("i0") + F.col("i1")) % 5), 2, SHAPE)


@query("WITH " + CUBE + ", n AS (SELECT i0 * 80 + i1 * 5 + i2 AS p, i0, i1, i2, v FROM c) SELECT 'reshape' AS op, CAST(p // 35 AS BIGINT) AS a, CAST(p % 35 AS BIGINT) AS b, v FROM n UNION ALL SELECT 'flip', i0 * 16 + 15 - i1, i2, v FROM n UNION ALL SELECT 'roll', i0 * 16 + (i1 + 11) % 16, i2, v FROM n UNION ALL SELECT 'rollflat', (p + 557) % 560 // 5, (p + 557) % 560 % 5, v FROM n UNION ALL SELECT 'move', i1 * 5 + i2, i0, v FROM n")
def reshape_flip_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, spec = _cube(spark, sf_dir), ArraySpec(SHAPE)
    show = lambda name, df, a, b: df.select(F.lit(name).alias("op"), a.cast("long").alias("a"), b.cast("long").alias("b"), "v")
    i0, i1, i2 = F.col("i0"), F.col("i1"), F.col("i2")
    parts = [
        show("reshape", D.reshape(c, spec, (16, 35)), i0, i1), show("flip", D.flip(c, SHAPE, 1), i0 * 16 + i1, i2), show("roll", D.roll(c, SHAPE, -5, 1), i0 * 16 + i1, i2),
        show("rollflat", D.roll(c, SHAPE, -3), (i0 * 80 + i1 * 5 + i2 - i2) / 5, i2), show("move", D.move_axis(c, 3, 0, 2), i0 * 5 + i1, i2),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH {A}, s AS (SELECT pos // 64 AS i0, pos % 64 AS i1, v FROM a), n AS (SELECT max(i0) + 1 AS n FROM s)
SELECT 'tile' AS op, CAST(i0 + n * r AS BIGINT) AS i0, CAST(i1 + 64 * c AS BIGINT) AS i1, v FROM s, n, range(2) x(r), range(3) y(c) UNION ALL SELECT 'repeat', i0, i1 * 3 + r, v FROM s, range(3) x(r)
UNION ALL SELECT 'tril', i0, i1, CASE WHEN i1 - i0 <= 1 THEN v ELSE 0 END FROM s UNION ALL SELECT 'triu', i0, i1, CASE WHEN i1 - i0 >= -1 THEN v ELSE 0 END FROM s
UNION ALL SELECT 'stack', i0 + n * k, i1, v * (k + 1) FROM s, n, range(2) x(k) UNION ALL SELECT 'concat', i0, i1 + 64 * c, v FROM s, range(2) y(c)""")
def tile_repeat_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _matrix(spark, sf_dir).repartition("i0")  # numbered once: all parts read this exchange
    rows = -(-table(spark, sf_dir, "lineitem").count() // 64)
    shape = (rows, 64)
    two = D.stack([s, s.withColumn("v", F.col("v") * 2)], 2)
    joined = D.unstack(two, (2, *shape))[0]
    parts = {
        "tile": D.tile(s, shape, (2, 3)), "repeat": D.repeat(s, 3, 1), "tril": D.triangle(s, 1, True), "triu": D.triangle(s, -1, False),
        "stack": two.select((F.col("i0") * rows + F.col("i1")).alias("i0"), F.col("i2").alias("i1"), "v"), "concat": D.concat_axis([(s, shape), (joined, shape)], 1),
    }
    out = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("op"), "i0", "i1", F.col("v").cast("long").alias("v"))
        out = p if out is None else out.unionByName(p)
    return out


@query("SELECT 'eye' AS op, CAST(i AS BIGINT) AS i0, CAST(j AS BIGINT) AS i1, CAST(CASE WHEN j - i = 1 THEN 1 ELSE 0 END AS DOUBLE) AS v FROM range(4) a(i), range(5) b(j) UNION ALL SELECT 'linspace', i, 0, 2 + i * 0.75 FROM range(5) a(i) UNION ALL SELECT 'arange', i, 0, 3 + 4 * i FROM range(5) a(i) UNION ALL SELECT 'full', i, j, 7 FROM range(3) a(i), range(2) b(j) UNION ALL SELECT 'mesh_x', i, j, 3 + 4 * j FROM range(5) a(i), range(5) b(j) UNION ALL SELECT 'mesh_y', i, j, 2 + i * 0.75 FROM range(5) a(i), range(5) b(j) UNION ALL SELECT 'fftfreq', i, 0, (CASE WHEN i < 4 THEN i ELSE i - 8 END) / 4.0 FROM range(8) a(i) UNION ALL SELECT 'rfftfreq', i, 0, i / 4.0 FROM range(5) a(i)")
def creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, steps = D.linspace(spark, 2, 5, 5), D.arange(spark, 3, 21, 4)
    mesh = D.meshgrid(steps, 5, line, 5)
    flat = lambda df: df.withColumn("i1", F.lit(0).cast("long"))
    parts = {"eye": D.eye(spark, 4, 5, 1), "linspace": flat(line), "arange": flat(steps), "full": D.full(spark, (3, 2), 7), "mesh_x": mesh[0], "mesh_y": mesh[1], "fftfreq": flat(fourier.fftfreq(spark, 8, 0.5)), "rfftfreq": flat(fourier.rfftfreq(spark, 8, 0.5))}
    out = None
    for name, p in parts.items():
        p = p.select(F.lit(name).alias("op"), "i0", "i1", F.col("v").cast("double").alias("v"))
        out = p if out is None else out.unionByName(p)
    return out


# ---------------------------------------------------------------- linear algebra

SMALL = "x AS (SELECT l_orderkey % 24 AS i0, l_suppkey % 16 AS i1, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy((F.col("l_orderkey") % 24).alias("i0"), (F.col("l_suppkey") % 16).alias("i1")).agg(F.sum("l_linenumber").alias("v"))


@query("WITH " + SMALL + " SELECT a.i0, b.i0 AS i1, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM x a JOIN x b ON a.i1 = b.i1 GROUP BY 1, 2")
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _small(spark, sf_dir)
    return linalg.matmul(x, linalg.transpose(x))


@query("WITH " + CUBE + " SELECT a.i0, b.i0 AS i1, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM c a JOIN c b ON a.i1 = b.i1 AND a.i2 = b.i2 GROUP BY 1, 2")
def tensordot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cube(spark, sf_dir)
    return linalg.tensordot(c, 3, c, 3, (1, 2), (1, 2))


@query("WITH " + SMALL + ", d AS (SELECT i0, v FROM x WHERE i1 = i0) SELECT (SELECT CAST(sum(v) AS BIGINT) FROM d) AS trace, (SELECT CAST(max(s) AS DOUBLE) FROM (SELECT sum(abs(v)) AS s FROM x GROUP BY i1)) AS one, (SELECT CAST(max(s) AS DOUBLE) FROM (SELECT sum(abs(v)) AS s FROM x GROUP BY i0)) AS inf, (SELECT round(sqrt(sum(v * v)), 6) FROM x) AS fro, (SELECT round(pow(sum(pow(v, 3)), 1.0 / 3), 6) FROM d) AS three, (SELECT CAST(sum(a.v * b.v) AS BIGINT) FROM x a JOIN x b ON a.i1 = b.i1 AND b.i0 = (a.i0 + 1) % 24) AS dot")
def norms_and_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _small(spark, sf_dir)
    inf = float("inf")
    out = linalg.trace(x).withColumnRenamed("v", "trace")
    for name, p in {"one": linalg.matrix_norm(x, 1), "inf": linalg.matrix_norm(x, inf)}.items():
        out = out.join(p.select(F.col("v").cast("double").alias(name)))
    out = out.join(linalg.matrix_norm(x).select(F.round("v", 6).alias("fro")))
    out = out.join(linalg.diagonal(x).agg(F.round(linalg.vector_norm(F.col("v"), 3), 6).alias("three")))
    row, after = x.withColumnRenamed("i0", "key"), x.select(F.pmod(F.col("i0") - 1, F.lit(24)).alias("key"), "i1", "v")
    return out.join(linalg.vecdot(row, after, ["key"], "i1").agg(F.sum("v").alias("dot")))


@query("WITH " + SMALL + ", f AS (SELECT i0, sum(v) AS v FROM x GROUP BY 1), g AS (SELECT i1, sum(v) AS v FROM x GROUP BY 1) SELECT f.i0, g.i1, CAST(f.v * g.v AS BIGINT) AS v FROM f, g")
def outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row sums times column sums."""
    x = _small(spark, sf_dir)
    return linalg.outer(x.groupBy("i0").agg(F.sum("v").alias("v")), x.groupBy(F.col("i1").alias("i0")).agg(F.sum("v").alias("v")))


@query("WITH e AS (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(64)) AS d FROM embeddings), m AS (SELECT label, d, avg(CAST(v AS DOUBLE)) AS v FROM e GROUP BY 1, 2) SELECT CAST(a.label AS BIGINT) AS i0, CAST(b.label AS BIGINT) AS i1, round(sum(a.v * b.v), 6) + 0.0 AS v FROM m a JOIN m b USING (d) GROUP BY 1, 2")
def embedding_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "v"))
    m = e.groupBy(F.col("label").cast("long").alias("i0"), F.col("d").cast("long").alias("i1")).agg(F.avg(F.col("v").cast("double")).alias("v"))
    return linalg.matmul(m, linalg.transpose(m)).select("i0", "i1", (F.round("v", 6) + 0.0).alias("v"))


@query("WITH {A}, b AS (SELECT pos // 8 AS key, pos % 8 AS j, v FROM a) SELECT CAST(key AS BIGINT) AS key, CAST(k AS BIGINT) AS k, round(sum(v * cos(2 * pi() / 8 * (k * j % 8))), 6) + 0.0 AS re, round(-sum(v * sin(2 * pi() / 8 * (k * j % 8))), 6) + 0.0 AS im FROM b, range(8) r(k) GROUP BY 1, 2")
def dft_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir).select(F.floor(F.col("pos") / 8).cast("long").alias("key"), (F.col("pos") % 8).alias("pos"), "v")
    return fourier.dft(a, ["key"], 8).select("key", "k", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))


def _stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix 2 I + u u' of 6 x 6 for each supplier; u has a hundredth of the quantities by part number modulo 6."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("key"), (F.col("l_partkey") % 6).alias("i0")).agg(F.sum("l_quantity").alias("q"))
    cells = t.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("i0"))
    t = cells.join(t, ["key", "i0"], "left").select("key", "i0", F.coalesce("q", F.lit(0.0)).alias("q"))
    other = t.select("key", F.col("i0").alias("i1"), F.col("q").alias("r"))
    return t.join(other, "key").select("key", "i0", "i1", (F.col("q") * F.col("r") / 1e4 + F.when(F.col("i0") == F.col("i1"), 2.0).otherwise(0.0)).alias("v"))


#: u, its squared length s (and that of its front), and the matrix: all decompositions follow from these in closed form.
STACK = """k AS (SELECT DISTINCT l_suppkey AS key FROM lineitem), q AS (SELECT l_suppkey AS key, l_partkey % 6 AS i, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
u AS (SELECT key, i, coalesce(q, 0) / 100 AS u FROM (SELECT key, i FROM k, range(6) r(i)) LEFT JOIN q USING (key, i)),
f AS (SELECT key, i, u, sum(u * u) OVER (PARTITION BY key ORDER BY i) AS s FROM u), t AS (SELECT key, sum(u * u) AS s, sum(u) AS h FROM u GROUP BY 1),
p AS (SELECT x.key, x.i AS i0, y.i AS i1, x.u AS a, y.u AS b, y.s AS s1, 2 * (2 + y.s) / (2 + y.s - y.u * y.u) AS d1, t.s, t.h, CASE WHEN x.i = y.i THEN 1 ELSE 0 END AS one FROM f x JOIN f y USING (key) JOIN t USING (key)),
n AS (SELECT key, s, i FROM t, range(6) r(i))"""
_CELL = "SELECT key, '{part}' AS part, i0, i1, round({v}, {digits}) + 0.0 AS v FROM p"
_ONE = "SELECT key, '{part}' AS part, CAST(0 AS BIGINT) AS i0, CAST(0 AS BIGINT) AS i1, round({v}, {digits}) + 0.0 AS v FROM t"
_LINE = "SELECT key, '{part}' AS part, CAST(0 AS BIGINT) AS i0, i AS i1, round({v}, 4) + 0.0 AS v FROM n"
_MATRIX = _CELL.format(part="product", v="a * b + 2 * one", digits=4)
_UNIT = _CELL.format(part="unit", v="one * 1.0", digits=6)
_FALLING, _RISING = "CASE WHEN i = 0 THEN 2 + s ELSE 2 END", "CASE WHEN i = 5 THEN 2 + s ELSE 2 END"
#: SQL, and the digits that are compared.
CLOSED = {
    "cholesky": (_CELL.format(part="lower", v="CASE WHEN i0 > i1 THEN a * b / (2 + s1) * sqrt(d1) WHEN i0 = i1 THEN sqrt(d1) ELSE 0 END", digits=5), 5),
    "det": (_ONE.format(part="det", v="64 + 32 * s", digits=4), 4),
    "slogdet": (_ONE.format(part="sign", v="1.0", digits=6) + " UNION ALL " + _ONE.format(part="log", v="ln(64 + 32 * s)", digits=6), 6),
    "inv": (_CELL.format(part="inverse", v="one * 0.5 - a * b / (4 + 2 * s)", digits=6), 6),
    "pinv": (_CELL.format(part="inverse", v="one * 0.5 - a * b / (4 + 2 * s)", digits=6), 6),
    "qr": (_MATRIX + " UNION ALL " + _UNIT, 4),
    "svd": (_MATRIX + " UNION ALL " + _LINE.format(part="s", v=_FALLING), 4),
    "svdvals": (_LINE.format(part="s", v=_FALLING), 4),
    "eigh": (_MATRIX + " UNION ALL " + _LINE.format(part="values", v=_RISING), 4),
    "eigvalsh": (_LINE.format(part="values", v=_RISING), 4),
    "matrix_rank": (_ONE.format(part="rank", v="6.0", digits=4), 4),
    "cond": (_ONE.format(part="cond", v="1 + s / 2", digits=5), 5),
    "norm_2": (_ONE.format(part="norm", v="2 + s", digits=4), 4),
    "norm_nuc": (_ONE.format(part="norm", v="12 + s", digits=4), 4),
}


def _times(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
    """Matrix products by key."""
    left, right = x.select("key", "i0", F.col("i1").alias("k"), F.col("v").alias("x")), y.select("key", F.col("i0").alias("k"), "i1", F.col("v").alias("y"))
    return left.join(right, ["key", "k"]).groupBy("key", "i0", "i1").agg(F.sum(F.col("x") * F.col("y")).alias("v")).select("key", F.lit(name).alias("part"), "i0", "i1", "v")


def _rebuilt(parts: DataFrame, name: str) -> DataFrame:
    """Factors whose signs are free are multiplied out again."""
    part = lambda n: parts.where(F.col("part") == n)
    turned = lambda x: x.select("key", F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")
    scaled = lambda x, s: x.join(s.select("key", "i1", F.col("v").alias("w")), ["key", "i1"]).select("key", "i0", "i1", (F.col("v") * F.col("w")).alias("v"))
    if name == "qr":
        return _times(part("q"), part("r"), "product").unionByName(_times(turned(part("q")), part("q"), "unit"))
    if name == "svd":
        return _times(scaled(part("u"), part("s")), part("vh"), "product").unionByName(part("s"))
    if name == "eigh":
        return _times(scaled(part("vectors"), part("values")), turned(part("vectors")), "product").unionByName(part("values"))
    return parts


def _rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumn("v", F.round("v", digits) + 0.0)


for _name, (_sql, _digits) in CLOSED.items():

    def _run(spark: SparkSession, sf_dir: str, name: str = _name, digits: int = _digits) -> DataFrame:
        return _rounded(_rebuilt(linalg.decompose(_stack(spark, sf_dir), name), name), digits)

    query(f"WITH {STACK} {_sql}", f"linalg_{_name}")(_run)


@query(f"WITH {STACK} SELECT key, 'x' AS part, i AS i0, CAST(0 AS BIGINT) AS i1, round(0.5 - u * h / (4 + 2 * t.s), 6) + 0.0 AS v FROM u JOIN t USING (key)")
def linalg_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _stack(spark, sf_dir).withColumn("side", F.lit("a"))
    b = a.where("i1 = 0").withColumn("v", F.lit(1.0)).withColumn("side", F.lit("b"))
    return _rounded(linalg.solve(a.unionByName(b)), 6)


#: Elements of a block that is transformed: a line of 64, or 8 rows of 8.
BLOCK = 64


def fft_sql(name: str) -> str:
    """A transform of real blocks by its definition: sums of cosines and sines."""
    kind = name.rstrip("n2")
    flat = kind == name
    back = kind in ("ifft", "irfft", "ihfft")
    cols = {"rfft": 33 if flat else 5, "ihfft": 33, "irfft": 126 if flat else 14, "hfft": 126}.get(kind, 64 if flat else 8)
    period = {"irfft": cols, "hfft": cols}.get(kind, 64 if flat else 8)
    rows = 1 if flat else 8
    line = f"2 * pi() / {period} * (k2 * j2 % {period})"
    angle = line if flat else f"(2 * pi() / 8 * (k1 * j1 % 8) + {line})"
    last = 63 if flat else 7
    weight = f" * CASE WHEN j2 IN (0, {last}) THEN 1 ELSE 2 END" if kind in ("irfft", "hfft") else ""
    scale = f" / {rows * period}" if back else ""
    im = "0.0" if kind in ("irfft", "hfft") else f"{'' if back else '-'}sum(v * sin({angle})){scale}"
    cells = f"SELECT pos // {BLOCK} AS key, {'0' if flat else f'pos % {BLOCK} // 8'} AS j1, pos % {BLOCK}{'' if flat else ' % 8'} AS j2, v FROM a"
    return f"WITH {{A}}, x AS ({cells}) SELECT CAST(key AS BIGINT) AS key, CAST(k1 * {cols} + k2 AS BIGINT) AS pos, round(sum(v * cos({angle}){weight}){scale}, 6) + 0.0 AS re, round({im}, 6) + 0.0 AS im FROM x, range({rows}) r(k1), range({cols}) c(k2) GROUP BY key, k1, k2"


for _name in fourier.NAMES:

    def _run(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        blocks = array(spark, sf_dir).select(F.floor(F.col("pos") / BLOCK).cast("long").alias("key"), (F.col("pos") % BLOCK).alias("pos"), F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
        out = fourier.transform(blocks, name, (8, 8) if name.rstrip("n2") != name else (BLOCK,))
        return out.select("key", "pos", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))

    query(fft_sql(_name), f"fft_{_name}")(_run)


@query("WITH {A}, " + WIDE + " SELECT CAST(i0 AS BIGINT) AS i0, CAST((i1 + 32) % 64 AS BIGINT) AS i1, v FROM m")
def fftshift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fourier.fftshift(_matrix(spark, sf_dir), 64, "i1")


@query("WITH {A}, f AS (SELECT pos // 3 AS key, pos % 3 AS i0, q AS x, v AS y FROM a), g AS (SELECT key, max(x) FILTER (WHERE i0 = 0) AS x0, max(x) FILTER (WHERE i0 = 1) AS x1, max(x) FILTER (WHERE i0 = 2) AS x2, max(y) FILTER (WHERE i0 = 0) AS y0, max(y) FILTER (WHERE i0 = 1) AS y1, max(y) FILTER (WHERE i0 = 2) AS y2 FROM f GROUP BY key) SELECT CAST(key AS BIGINT) AS key, CAST(i0 AS BIGINT) AS i0, CAST(CASE i0 WHEN 0 THEN x1 * y2 - x2 * y1 WHEN 1 THEN x2 * y0 - x0 * y2 ELSE x0 * y1 - x1 * y0 END AS BIGINT) AS v FROM g, range(3) r(i0)")
def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda value=None: array(spark, sf_dir, value).select(F.floor(F.col("pos") / 3).cast("long").alias("key"), (F.col("pos") % 3).alias("i0"), F.col("v").cast("long").alias("v"))
    return linalg.cross(part(F.col("l_quantity")), part(), ["key"])
