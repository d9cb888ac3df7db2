"""Queries over chunked storage: sizes of all encodings, the choice, round trips and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import storage
from ..schema import ArraySpec
from ..sources.tables import array
from .catalogue import query

SIZE = 512
#: Arrays that bring out different encodings: name, Spark value, SQL value.
KINDS = {
    "lines": (lambda: F.col("v"), "v"),
    "blocks": (lambda: F.floor(F.col("pos") / 37) % 5 * 50, "pos // 37 % 5 * 50"),
    "periodic": (lambda: F.col("pos") % 31 + 128, "pos % 31 + 128"),
    "spikes": (lambda: F.when(F.col("pos") % 501 == 0, F.col("v")).otherwise(0), "CASE WHEN pos % 501 = 0 THEN v ELSE 0 END"),
    "uniform": (lambda: F.floor(F.col("pos") / 512) % 3, "pos // 512 % 3"),
    "sparse": (lambda: F.col("v") * 36 + 3, "v * 36 + 3"),
    "edges": (lambda: F.when((F.col("pos") % 512 > 200) & (F.col("pos") % 512 < 300), F.col("q")).otherwise(9), "CASE WHEN pos % 512 > 200 AND pos % 512 < 300 THEN q ELSE 9 END"),
    "wide": (lambda: F.col("q") * 5, "q * 5"),
}


def _chunks(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    """(kind, chunk_id, vals) for all kinds of arrays."""
    a = array(spark, sf_dir, F.col("l_linenumber") * 64 + F.col("l_quantity")).select("pos", F.floor(F.col("v") / 64).alias("v"), (F.col("v") % 64).alias("q"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c().cast("int").alias("v")) for k, (c, _) in KINDS.items())))
    return storage.chunks(a.select("pos", kinds.alias("x")).select("pos", "x.kind", "x.v"), size, ("kind",))


LONG = "{A}, x AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, pos, CAST({s} AS BIGINT) AS v FROM a" for k, (_, s) in KINDS.items()) + f"), y AS (SELECT kind, pos // {SIZE} AS chunk_id, pos % {SIZE} AS i, v FROM x)"
BITS = "greatest(1, length(bin(CAST({} AS BIGINT))))"
BASIC = ", b AS (SELECT kind, chunk_id, count(*) AS n, max(v) AS top, count(DISTINCT v) AS k FROM y GROUP BY 1, 2), s AS (SELECT *, " + BITS.format("top") + " AS db, " + BITS.format("k - 1") + " AS pb FROM b)"


@query("WITH " + LONG + BASIC + " SELECT kind, CAST(chunk_id AS BIGINT) AS chunk_id, CAST(k AS BIGINT) AS k, CAST(8 * ((n * db + 63) // 64) AS BIGINT) AS direct_bytes, CAST(8 * ((n * pb + 63) // 64) + k AS BIGINT) AS palette_bytes FROM s")
def chunk_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = storage.measured(_chunks(spark, sf_dir))
    return m.select("kind", "chunk_id", F.col("k").cast("long").alias("k"), F.col("direct_bytes").cast("long").alias("direct_bytes"), F.col("palette_bytes").cast("long").alias("palette_bytes"))


RUNS = ", r AS (SELECT kind, chunk_id, i, v, CASE WHEN i = 0 OR v <> lag(v) OVER (PARTITION BY kind, chunk_id ORDER BY i) THEN 1 ELSE 0 END AS starts FROM y), g AS (SELECT *, sum(starts) OVER (PARTITION BY kind, chunk_id ORDER BY i) AS run FROM r), l AS (SELECT kind, chunk_id, run, count(*) AS n FROM g GROUP BY ALL), u AS (SELECT kind, chunk_id, CAST(sum(1 + ceil(" + BITS.format("n - 1") + " / 7.0)) AS BIGINT) AS payload FROM l GROUP BY 1, 2)"


@query("WITH " + LONG + BASIC + RUNS + " SELECT kind, CAST(chunk_id AS BIGINT) AS chunk_id, CAST(payload + CASE WHEN pb < db THEN k ELSE 0 END AS BIGINT) AS rle_bytes FROM u JOIN s USING (kind, chunk_id)")
def chunk_rle_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = storage.measured(_chunks(spark, sf_dir))
    return m.select("kind", "chunk_id", F.col("rle_bytes").cast("long").alias("rle_bytes"))


PERIOD = ", ch AS (SELECT kind, chunk_id, list(v ORDER BY i) AS vals FROM y GROUP BY 1, 2), pd AS (SELECT kind, chunk_id, coalesce(list_filter(range(1, least(256, len(vals) // 2) + 1), lambda p: vals[p + 1:] = vals[:len(vals) - p])[1], 0) AS period FROM ch)"


@query("WITH " + LONG + BASIC + PERIOD + " SELECT kind, CAST(chunk_id AS BIGINT) AS chunk_id, CAST(period AS BIGINT) AS period FROM pd")
def chunk_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("kind", "chunk_id", storage.shortest_period(F.col("vals"), F.size("vals")).cast("long").alias("period"))


TRIM = """, ends AS (SELECT kind, chunk_id, vals, vals[1] AS l, vals[len(vals)] AS r, len(vals) AS n,
  list_filter(range(1, len(vals) + 1), lambda i: vals[i] <> vals[1])[1] - 1 AS lead,
  list_filter(range(1, len(vals) + 1), lambda i: vals[i] <> vals[len(vals)])[-1] AS tail FROM ch),
cand AS (SELECT kind, chunk_id, 0 AS c, l AS value, lead AS f, CASE WHEN l = r THEN tail ELSE n END AS t, vals FROM ends WHERE lead IS NOT NULL
  UNION ALL SELECT kind, chunk_id, 1, r, 0, tail, vals FROM ends WHERE lead IS NOT NULL AND l <> r),
spans AS (SELECT *, len(list_distinct(vals[f + 1:t])) AS sk, list_max(vals[f + 1:t]) AS sm FROM cand),
sized AS (SELECT kind, chunk_id, c, least(8 * (((t - f) * """ + BITS.format("sm") + " + 63) // 64), CASE WHEN sk < 256 THEN 8 * (((t - f) * " + BITS.format("sk - 1") + """ + 63) // 64) + sk END) + 6 AS bytes FROM spans),
tr AS (SELECT kind, chunk_id, min(bytes) AS trim_bytes FROM sized GROUP BY 1, 2)"""
CHOICE = """, m AS (SELECT s.*, period, payload + CASE WHEN pb < db THEN k ELSE 0 END AS rle, 8 * ((n * db + 63) // 64) AS direct, 8 * ((n * pb + 63) // 64) + k AS pal, trim_bytes FROM s JOIN u USING (kind, chunk_id) JOIN pd USING (kind, chunk_id) LEFT JOIN tr USING (kind, chunk_id)),
m2 AS (SELECT *, least(direct, n, CASE WHEN pb < db THEN pal END) AS plain FROM m),
m3 AS (SELECT *, CASE WHEN period > 0 AND plain > 9 THEN least(8 * ((period * db + 63) // 64) + 1, CASE WHEN pb < db THEN 8 * ((period * pb + 63) // 64) + 1 + k END) END AS per FROM m2),
m4 AS (SELECT *, coalesce(per < plain, false) AS by_period, CASE WHEN per < plain THEN per ELSE plain END AS lim FROM m3),
m5 AS (SELECT *, rle < lim AS by_rle, least(rle, lim) AS best FROM m4),
pick AS (SELECT kind, chunk_id, n, k, CASE WHEN k = 1 THEN 'uniform' WHEN NOT by_period AND trim_bytes < best AND best + 2 > 16 THEN 'trim' WHEN by_rle THEN 'rle' WHEN by_period THEN 'period' WHEN pb < db AND pal < least(direct, n) THEN 'palette' WHEN direct <= n THEN 'direct' ELSE 'bytes' END AS encoding,
  CASE WHEN k = 1 THEN 0 WHEN NOT by_period AND trim_bytes < best AND best + 2 > 16 THEN trim_bytes ELSE best END AS stored FROM m5)"""
ALL = "WITH " + LONG + BASIC + RUNS + PERIOD + TRIM + CHOICE


@query(ALL + " SELECT kind, CAST(chunk_id AS BIGINT) AS chunk_id, encoding, CAST(stored AS BIGINT) AS stored_bytes FROM pick")
def chunk_encoding_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.planned(_chunks(spark, sf_dir)).select("kind", "chunk_id", "encoding", "stored_bytes")


@query(ALL + ", kinds AS (SELECT unnest(['uniform', 'rle', 'period', 'trim']) AS e) SELECT CAST(sum(n) AS BIGINT) AS logical_bytes, CAST(sum(stored) AS BIGINT) AS stored_bytes, CAST(count(*) AS BIGINT) AS chunk_count, CAST(count(*) FILTER (WHERE encoding = 'uniform') AS BIGINT) AS uniform_chunks, CAST(count(*) FILTER (WHERE encoding = 'rle') AS BIGINT) AS rle_chunks, CAST(count(*) FILTER (WHERE encoding = 'period') AS BIGINT) AS periodic_chunks, CAST(count(*) FILTER (WHERE encoding = 'trim') AS BIGINT) AS trimmed_chunks FROM pick")
def storage_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.storage_info(storage.planned(_chunks(spark, sf_dir))).drop("palette_chunks", "compressed_chunks")


@query("WITH " + LONG + " SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS mismatches, CAST(sum(v * (i + 1)) AS BIGINT) AS checksum FROM y GROUP BY 1")
def storage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk encoded by its winner and decoded again."""
    named = _chunks(spark, sf_dir).withColumn("chunk_id", F.struct("kind", "chunk_id"))
    records = storage.encoded(named.withColumn("was", F.col("vals")), ("was",))
    back = storage.decoded(records, ("was",)).withColumnsRenamed({"vals": "again", "was": "vals"})
    wrong = F.size(F.filter(F.zip_with("vals", "again", lambda x, y: x.eqNullSafe(y)), lambda same: ~same)) + F.abs(F.size("vals") - F.size("again"))
    check = F.aggregate(F.transform("again", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return back.groupBy(F.col("chunk_id.kind").alias("kind")).agg(F.sum(F.size("again")).cast("long").alias("n"), F.sum(wrong).cast("long").alias("mismatches"), F.sum(check).alias("checksum"))


@query("WITH {A} SELECT pos, CASE WHEN pos % 100 = 7 AND pos < 5000 THEN 0 ELSE v END AS v FROM a WHERE pos >= 1000 AND pos < 9000")
def chunk_range_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = storage.chunks(array(spark, sf_dir), SIZE)
    updates = spark.range(50).select((F.col("id") * 100 + 7).alias("pos"), F.lit(0).alias("v"))
    return storage.read_range(storage.write_range(chunked, updates, SIZE), 1000, 9000, 1 << 40, SIZE).select("pos", F.col("v").cast("long").alias("v"))


@query("SELECT CAST(chunk AS BIGINT) AS chunk, CAST(least(512, 100000 - chunk * 512) AS BIGINT) AS n, CAST(5 * least(512, 100000 - chunk * 512) AS BIGINT) AS total FROM range(196) r(chunk)")
def storage_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of one value, never held as elements."""
    f = storage.full(spark, 100_000, 5, SIZE)
    return f.select(F.col("chunk_id").alias("chunk"), F.size("vals").cast("long").alias("n"), F.aggregate("vals", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("total"))


@query("WITH e AS (SELECT row_number() OVER (ORDER BY event_id) AS step, (user_id * 7) // 64 AS c FROM events), l AS (SELECT step, c, lag(step) OVER (PARTITION BY c ORDER BY step) AS last FROM e), o AS (SELECT a.step, a.last, (SELECT count(DISTINCT b.c) FROM e b WHERE b.step > a.last AND b.step < a.step) AS others FROM l a) SELECT CAST(count(*) FILTER (WHERE last IS NOT NULL AND others < 4) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE last IS NULL OR others >= 4) AS BIGINT) AS misses FROM o")
def cache_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import table

    trace = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("user_id") * 7).alias("pos"))
    return storage.simulated_cache(trace, 64, 4)


@query("SELECT CAST(b AS BIGINT) AS bits, CAST(8 * greatest(1, (1000 * b + 63) // 64) AS BIGINT) AS packed, CAST(8 * ((1000 + 64 // b - 1) // (64 // b)) AS BIGINT) AS aligned FROM range(1, 9) r(b)")
def sizes_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(b, ArraySpec((1000,), b).nbytes, ArraySpec((1000,), b, "word-aligned").nbytes) for b in range(1, 9)]
    return spark.createDataFrame(rows, "bits long, packed long, aligned long")


@query(ALL + " SELECT encoding, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(stored) AS BIGINT) AS record_bytes FROM pick GROUP BY 1")
def storage_record_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the records as they are, against those of the plan."""
    records = storage.encoded(_chunks(spark, sf_dir).drop("kind"))
    return records.groupBy("encoding").agg(F.count("*").alias("chunks"), F.sum(storage.record_bytes(records)).alias("record_bytes"))
