"""Queries over sequences: k-mers, motif features, Hamming neighbours, batches, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences as Q
from ..sources.tables import table
from .catalogue import query

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SEQS = "s AS (SELECT item_id AS seq_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS seq, item_id % 5 + 1 AS weight FROM benchmark)"


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), seq.alias("seq"), (F.col("item_id") % 5 + 1).alias("weight"))


def _codes(col: str) -> str:
    return f"instr('{LETTERS}', {col}) - 1"


@query("WITH " + SEQS + ", k AS (SELECT substr(seq, CAST(p AS INTEGER), 3) AS kmer FROM s, LATERAL (SELECT unnest(range(1, length(seq) - 1)) AS p)) SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.kmer_counts(_sequences(spark, sf_dir), 3)


@query("WITH " + SEQS + " SELECT seq_id, CAST(p - 1 AS BIGINT) AS place, substr(seq, CAST(p AS INTEGER), 4) AS kmer FROM s, LATERAL (SELECT unnest(range(1, length(seq) - 2)) AS p)")
def kmer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.kmers(_sequences(spark, sf_dir), 4).select("seq_id", "place", "kmer")


ROLLING = "WITH " + SEQS + ", k AS (SELECT seq_id, p - 1 AS pos, seq, CAST(p AS INTEGER) AS p FROM s, LATERAL (SELECT unnest(range(1, length(seq) - 1)) AS p)) SELECT seq_id, CAST(pos AS BIGINT) AS pos, CAST(" + " + ".join(f"({_codes(f'substr(seq, p + {j}, 1)')}) * {26**j}" for j in range(3)) + " AS BIGINT) AS code FROM k"


@query(ROLLING)
def rolling_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _sequences(spark, sf_dir).select("seq_id", Q.codes(F.col("seq"), LETTERS).alias("vals"))
    return coded.select("seq_id", F.posexplode(Q.rolling_codes(F.col("vals"), 3, 26)).alias("pos", "code")).select("seq_id", F.col("pos").cast("long").alias("pos"), "code")


@query(ROLLING)
def window_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from long form by window functions."""
    long = _sequences(spark, sf_dir).select("seq_id", F.posexplode(Q.codes(F.col("seq"), LETTERS)).alias("pos", "v"))
    return Q.window_codes(long, 3, 26).select("seq_id", F.col("pos").cast("long").alias("pos"), "code")


MOTIF = " UNION ALL ".join(f"SELECT {k} AS k, substr(w, CAST(p AS INTEGER), {k}) AS kmer, weight FROM b, LATERAL (SELECT unnest(range(1, length(w) - {k - 2})) AS p)" for k in (3, 4))


@query("WITH " + SEQS + ", b AS (SELECT '@' || seq || '@' AS w, weight FROM s), g AS (" + MOTIF + "), c AS (SELECT k, kmer, sum(weight) AS n FROM g GROUP BY 1, 2) SELECT CAST(k AS BIGINT) AS k, kmer, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY k), 9) AS share FROM c")
def motif_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.motif_features(_sequences(spark, sf_dir), 3, 5).withColumn("share", F.round("share", 9))


@query("WITH " + SEQS + f", l AS (SELECT i, substr('{LETTERS}', CAST(i + 1 AS INTEGER), 1) AS c FROM range(26) r(i)), v AS (SELECT a.i * 26 + b.i AS code, a.c || b.c AS kmer FROM l a, l b), k AS (SELECT substr(seq, CAST(p AS INTEGER), 2) AS kmer, count(*) AS n FROM s, LATERAL (SELECT unnest(range(1, length(seq))) AS p) GROUP BY 1) SELECT CAST(code AS BIGINT) AS code, kmer, CAST(coalesce(n, 0) AS BIGINT) AS n FROM v LEFT JOIN k USING (kmer)")
def kmer_dense_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dense_vocabulary(spark, Q.kmer_counts(_sequences(spark, sf_dir), 2), 2, LETTERS)


WORDS = "w AS (SELECT min(seq_id) AS seq_id, seq FROM (SELECT item_id * 1000 + i AS seq_id, regexp_replace(lower(x), '[^a-z]', '', 'g') AS seq FROM (SELECT item_id, unnest(string_split(text, ' ')) AS x, unnest(range(len(string_split(text, ' ')))) AS i FROM benchmark)) WHERE seq <> '' GROUP BY seq)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "x"))
    words = split.select((F.col("item_id") * 1000 + F.col("i")).alias("seq_id"), F.regexp_replace(F.lower("x"), "[^a-z]", "").alias("seq"))
    return words.where("seq != ''").groupBy("seq").agg(F.min("seq_id").alias("seq_id"))


@query("WITH " + WORDS + ", p AS (SELECT a.seq_id AS i, b.seq_id AS j, hamming(a.seq, b.seq) AS d FROM w a JOIN w b ON length(a.seq) = length(b.seq)) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(d + 1 AS BIGINT) AS v FROM p WHERE d <= 2")
def hamming_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.hamming_neighbours(_words(spark, sf_dir), 2)


@query("WITH " + SEQS + ", k AS (SELECT k, (k * 17) % 37 AS i FROM range(50) r(k)), c AS (SELECT k.k, s.seq FROM k JOIN s ON s.seq_id = k.i), m AS (SELECT max(length(seq)) AS m FROM c), x AS (SELECT k, seq, m, CAST(unnest(range(1, m + 1)) AS INTEGER) AS p FROM c, m) SELECT CAST(k AS BIGINT) AS k, CAST(p - 1 AS BIGINT) AS pos, CAST(CASE WHEN p <= length(seq) THEN " + _codes("substr(seq, p, 1)") + " ELSE -1 END AS BIGINT) AS v, CAST(length(seq) AS BIGINT) AS n FROM x")
def padded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.range(50).select(F.col("id").alias("k"), ((F.col("id") * 17) % 37).alias("i"))
    batch = Q.padded_batch(_sequences(spark, sf_dir), chosen, LETTERS)
    return batch.select("k", F.posexplode("vals").alias("pos", "v"), "n").select("k", F.col("pos").cast("long").alias("pos"), F.col("v").cast("long").alias("v"), "n")


@query("WITH t AS (SELECT conv_id % 10 AS rep, unnest(string_split(lower(text), ' ')) AS seq FROM conversations), c AS (SELECT rep, seq, count(*) AS n FROM t GROUP BY 1, 2) SELECT CAST(a.rep AS BIGINT) AS rep_a, CAST(b.rep AS BIGINT) AS rep_b, CAST(sum(a.n * b.n) AS BIGINT) AS v FROM c a JOIN c b USING (seq) WHERE a.rep <= b.rep GROUP BY 1, 2")
def repertoire_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("rep"), F.explode(F.split(F.lower("text"), " ")).alias("seq"))
    return Q.overlap(t.groupBy("rep", "seq").agg(F.count("*").alias("n")))


@query("WITH " + SEQS + ", g AS (SELECT seq_id, CAST(length(seq) AS BIGINT) AS length FROM s) SELECT seq_id, length, CAST(8 * greatest(1, (length * 5 + 63) // 64) AS BIGINT) AS nbytes FROM g")
def sequence_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.sequence_sizes(_sequences(spark, sf_dir), LETTERS)


@query("WITH " + SEQS + ", k AS (SELECT seq_id, CAST(p - 1 AS BIGINT) AS place, substr(seq, CAST(p AS INTEGER), 3) AS kmer FROM s, LATERAL (SELECT unnest(range(1, length(seq) - 1)) AS p)) SELECT seq_id % 7 AS rep, kmer, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1, 2")
def kmer_matrix_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each k-mer in each group, in long form."""
    rows = Q.encode_continuous(_sequences(spark, sf_dir), LETTERS, 3)
    return rows.groupBy((F.col("seq_id") % 7).alias("rep"), "kmer").agg(F.count("*").alias("n"))
