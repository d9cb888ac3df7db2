"""Queries over automata and worked uses: grids, genotypes, replay, patches, edits, state keys, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..operators import automata as C
from ..operators import workloads as W
from ..sources.tables import array, positioned, table
from .catalogue import query

COLS = 200
GRID = "{A}, n AS (SELECT (count(*) + 199) // 200 AS rows FROM a), g AS MATERIALIZED (SELECT c // 200 AS y, c % 200 AS x, coalesce(v, 0) AS s FROM (SELECT unnest(range(rows * 200)) AS c FROM n) LEFT JOIN a ON pos = c)"
NINE = "(SELECT a - 1 AS dy, b - 1 AS dx FROM range(3) p(a), range(3) q(b))"


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The array as a torus of 200 columns; the last row is filled with zeros."""
    n = table(spark, sf_dir, "lineitem").count()
    rows = -(-n // COLS)
    a = array(spark, sf_dir).unionByName(spark.range(n, rows * COLS).select(F.col("id").alias("pos"), F.lit(0).alias("v")))
    return a.select(F.floor(F.col("pos") / COLS).cast("long").alias("y"), (F.col("pos") % COLS).alias("x"), F.col("v").cast("long").alias("s")), rows


def _step_sql(source: str, target: str, cell: str) -> str:
    sent = f"SELECT (y + dy + rows) % rows AS y, (x + dx + 200) % 200 AS x, s, dy = 0 AND dx = 0 AS own, abs(dy) + abs(dx) AS dist FROM {source}, n, {NINE}"
    return f"{target} AS MATERIALIZED (SELECT y, x, CAST({cell} AS BIGINT) AS s FROM ({sent}) GROUP BY y, x)"


TOTAL = "sum(s) % 8"
LIFE = "CASE sum(s) WHEN 3 THEN 1 WHEN 4 THEN max(s) FILTER (WHERE own) ELSE 0 END"
CYCLIC = "CASE WHEN bool_or(false) THEN 0 ELSE CASE WHEN list_contains(list(s) FILTER (WHERE dist = 1), (max(s) FILTER (WHERE own) + 1) % 8) THEN (max(s) FILTER (WHERE own) + 1) % 8 ELSE max(s) FILTER (WHERE own) END END"
LAST = " SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, s FROM "


@query("WITH " + GRID + ", " + _step_sql("g", "h", TOTAL) + LAST + "h")
def ca_totalistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, rows = _grid(spark, sf_dir)
    return C.totalistic(g, rows, COLS, 8)


@query("WITH " + GRID + ", " + ", ".join(_step_sql(s, t, TOTAL) for s, t in (("g", "h"), ("h", "i"), ("i", "j"))) + LAST + "j")
def ca_totalistic_3step(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, rows = _grid(spark, sf_dir)
    return C.evolve(g, lambda c: C.totalistic(c, rows, COLS, 8), 3)


@query("WITH " + GRID + ", " + _step_sql("g", "h", CYCLIC) + LAST + "h")
def ca_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, rows = _grid(spark, sf_dir)
    return C.cyclic(g, rows, COLS, 8)


@query("WITH " + GRID + ", g1 AS MATERIALIZED (SELECT y, x, s % 2 AS s FROM g), " + _step_sql("g1", "h", LIFE) + ", " + _step_sql("h", "i", LIFE) + " SELECT CAST(0 AS BIGINT) AS t, y, x, s FROM g1 UNION ALL SELECT 1, y, x, s FROM h UNION ALL SELECT 2, y, x, s FROM i")
def ca_life_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, rows = _grid(spark, sf_dir)
    return C.evolve(g.withColumn("s", F.col("s") % 2), lambda c: C.life(c, rows, COLS), 2, history=True)


@query("WITH " + GRID + " SELECT CAST(y AS BIGINT) AS y, CAST((x + 1) % 200 AS BIGINT) AS x, s FROM g")
def ca_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transport(_grid(spark, sf_dir)[0], COLS)


@query("WITH " + GRID + ", r AS (SELECT y, sum(s) AS sum, sha256(string_agg(printf('%02X', s), '' ORDER BY x)) AS h FROM g GROUP BY y) , b AS (SELECT y // 1024 AS b, sum(sum) AS sum, sha256(string_agg(h, '' ORDER BY y)) AS h FROM r GROUP BY 1) SELECT CAST(sum(sum) AS BIGINT) AS sum, sha256(string_agg(h, '' ORDER BY b)) AS digest FROM b")
def grid_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.digest(_grid(spark, sf_dir)[0])


CALLS = "c AS (SELECT pos // 64 AS variant, pos % 64 // 2 AS sample, pos % 2 AS ploid, CASE WHEN s % 17 = 0 THEN -1 WHEN v > 3 THEN 1 ELSE 0 END AS call FROM a)"
COUNTS = " SELECT CAST(variant AS BIGINT) AS variant, CAST(count(*) FILTER (WHERE call = -1) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE call = 0) AS BIGINT) AS ref, CAST(count(*) FILTER (WHERE call = 1) AS BIGINT) AS alt FROM c"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positioned(spark, sf_dir)
    call = F.when(F.col("l_suppkey") % 17 == 0, -1).when(F.col("l_linenumber") > 3, 1).otherwise(0)
    return p.select(F.floor(F.col("pos") / 64).cast("long").alias("variant"), F.floor(F.col("pos") % 64 / 2).alias("sample"), (F.col("pos") % 2).alias("ploid"), call.alias("call"))


@query("WITH {A}, " + CALLS + COUNTS + " GROUP BY 1")
def genotype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.genotype_counts(_calls(spark, sf_dir))


@query("WITH {A}, " + CALLS + COUNTS + " WHERE variant BETWEEN 30 AND 93 GROUP BY 1")
def genotype_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.genotype_counts(_calls(spark, sf_dir), 30, 64)


@query("WITH i AS (SELECT k, (k * 7919) % 500 AS i FROM range(200) r(k)) SELECT CAST(k AS BIGINT) AS k, CAST(i AS BIGINT) AS i, label, CAST(len(embedding) AS BIGINT) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM i JOIN embeddings ON vec_id = i")
def replay_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "obs_id")
    ids = spark.range(200).select(F.col("id").alias("k"), ((F.col("id") * 7919) % 500).alias("i"))
    return W.sample(e, ids).select("k", "i", "label", F.size("embedding").cast("long").alias("n"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query("WITH f AS (SELECT event_type || user_id % 10 AS mission, min(event_id) AS first FROM events GROUP BY 1), d AS (SELECT mission, row_number() OVER (ORDER BY first) - 1 AS id FROM f) SELECT event_id, CAST(id AS BIGINT) AS id FROM events JOIN d ON mission = event_type || user_id % 10")
def transition_missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("mission"))
    return e.join(W.dictionary(e, "mission", "event_id"), "mission").select("event_id", "id")


@query("WITH {A}, x AS (SELECT pos // 400 AS z, pos // 20 % 20 AS y, pos % 20 AS x, v FROM a), o AS (SELECT p, p * 7 % 90 AS z, p * 3 % 16 AS y, p * 5 % 16 AS x FROM range(30) r(p)) SELECT CAST(p AS BIGINT) AS p, CAST(x.z - o.z AS BIGINT) AS dz, CAST(x.y - o.y AS BIGINT) AS dy, CAST(x.x - o.x AS BIGINT) AS dx, v AS label FROM o JOIN x ON x.z BETWEEN o.z AND o.z + 3 AND x.y BETWEEN o.y AND o.y + 3 AND x.x BETWEEN o.x AND o.x + 3")
def label_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir)
    voxels = a.select(F.floor(F.col("pos") / 400).alias("z"), (F.floor(F.col("pos") / 20) % 20).alias("y"), (F.col("pos") % 20).alias("x"), F.col("v").cast("long").alias("label"))
    p = F.col("id")
    origins = spark.range(30).select(p.alias("p"), (p * 7 % 90).alias("z"), (p * 3 % 16).alias("y"), (p * 5 % 16).alias("x"))
    return W.patches(voxels, origins, 4).select("p", *(F.col(c).cast("long").alias(c) for c in ("dz", "dy", "dx")), "label")


@query("WITH {A}, e AS (SELECT event_id AS step, user_id * 7 AS pos FROM events), j AS (SELECT step, pos, row_number() OVER (PARTITION BY pos ORDER BY step) - 1 AS j FROM e) SELECT step, j.pos, CAST((v + j) % 8 AS BIGINT) AS before, CAST((v + j + 1) % 8 AS BIGINT) AS after FROM j JOIN a USING (pos)")
def online_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("user_id") * 7).alias("pos"))
    return W.online_edits(array(spark, sf_dir), edits, 8)


@query("WITH {A}, t AS (SELECT pos // 12 AS id, CAST(sum(CAST(v % 4 AS BIGINT) << CAST(pos % 12 * 2 AS INTEGER)) AS BIGINT) AS word FROM a GROUP BY 1) SELECT word, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1")
def state_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of twelve 2-bit cells, told apart by their packed words."""
    a = array(spark, sf_dir).select(F.floor(F.col("pos") / 12).cast("long").alias("id"), (F.col("pos") % 12).alias("pos"), (F.col("v") % 4).alias("v"))
    words = B.pack_rows(a, 2, False, ("id",)).select("id", "word")
    return W.distinct_states(words, "word")


@query("WITH {A}, b AS (SELECT i AS pos, i * 3 % 7 + 1 AS v FROM range(50) r(i)) SELECT CAST(a.pos // 50 AS BIGINT) AS key, CAST(a.pos % 50 AS BIGINT) AS pos, a.v FROM a JOIN b ON b.pos = a.pos % 50 WHERE a.v <> b.v")
def sparse_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir).withColumn("v", F.col("v").cast("long"))
    state = a.select(F.floor(F.col("pos") / 50).cast("long").alias("key"), (F.col("pos") % 50).alias("pos"), "v")
    board = spark.range(50).select(F.col("id").alias("pos"), (F.col("id") * 3 % 7 + 1).alias("v"))
    return W.sparse_difference(state, board).select("key", "pos", "v")


@query("WITH {A} SELECT pos * 2 AS pos, (q * 5) & 15 AS v FROM a UNION ALL SELECT pos * 2 + 1, (q * 5) >> 4 FROM a")
def nibble_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = array(spark, sf_dir, F.col("l_quantity") * 5)
    return W.nibbles(a).select("pos", F.col("v").cast("long").alias("v"))


@query("WITH c AS (SELECT count(DISTINCT p_type || p_brand) AS k, count(*) AS n FROM part) SELECT CAST(k AS BIGINT) AS colors, CAST(length(bin(CAST(k - 1 AS BIGINT))) AS BIGINT) AS bits, CAST(8 * ceil(n * length(bin(CAST(k - 1 AS BIGINT))) / 64.0) + 4 * k AS BIGINT) AS bytes FROM c")
def palette_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.palette_audit(table(spark, sf_dir, "part").select(F.concat("p_type", "p_brand").alias("color")))


@query("WITH {A} SELECT 'type' AS channel, pos, v FROM a UNION ALL SELECT 'colour', pos, d % 8 FROM a UNION ALL SELECT 'state', pos, t % 4 FROM a")
def channel_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = positioned(spark, sf_dir, "l_discount", "l_tax")
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return W.channels(p, {"type": F.col("l_linenumber").cast("long"), "colour": cents("l_discount") % 8, "state": cents("l_tax") % 4})


@query("SELECT CAST(event_type AS VARCHAR) AS event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the events, run to its end, against the same counts in one batch."""
    import uuid

    from ..streaming import arrays as stream

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"counts_{uuid.uuid4().hex[:8]}"
    counts = stream.windowed_counts(events, "event_type")
    run = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select("event_type", F.unix_timestamp("start").alias("start"), "n")
