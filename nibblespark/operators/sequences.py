"""Sequences over an alphabet: codes, k-mers, motif features, Hamming neighbours, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def check_alphabet(alphabet: str) -> str:
    if not 2 <= len(alphabet) <= 256 or len(set(alphabet)) < len(alphabet) or not alphabet.isascii():
        raise ValueError("an alphabet has 2 to 256 distinct ASCII symbols")
    return alphabet


def codes(seq: Column, alphabet: str) -> Column:
    """Places of the symbols in the alphabet; an unknown symbol raises."""
    check_alphabet(alphabet)
    symbols = F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.split(seq, ""))
    at = lambda c: F.call_function("instr", F.lit(alphabet), c) - 1
    return F.transform(symbols, lambda c: F.when(at(c) >= 0, at(c)).otherwise(F.raise_error(F.lit("symbol outside the alphabet")).cast("int")).cast("smallint"))


def encode_continuous(df: DataFrame, alphabet: str = AMINO_ACIDS, k: int = 3, encoding: str = "continuous_kmer", prefix: str = "") -> DataFrame:
    """Windows of k symbols without gaps, the only encoding that there is: (seq_id, place, kmer). Others are refused, as are prefixes."""
    check_alphabet(alphabet)
    if encoding != "continuous_kmer":
        raise ValueError(f"unknown encoding {encoding}")
    if prefix:
        raise ValueError("features have no prefixes")
    if k < 1:
        raise ValueError("k must be positive")
    known = df.where(F.size(codes(F.col("seq"), alphabet)) >= 0)  # an unknown symbol raises
    return kmers(known, k).select("seq_id", "place", "kmer")


def sequence_sizes(df: DataFrame, alphabet: str = AMINO_ACIDS) -> DataFrame:
    """(seq_id, length, nbytes): the length of each sequence, and the bytes of its codes in packed words."""
    n = F.length("seq").cast("long")
    return df.select("seq_id", n.alias("length"), (8 * F.greatest(F.lit(1), F.ceil(n * code_bits(alphabet) / 64))).cast("long").alias("nbytes"))


def code_bits(alphabet: str) -> int:
    return max(1, (len(alphabet) - 1).bit_length())


def kmers(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Each k-mer of each sequence with its place; shorter sequences have none."""
    places = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - (k - 1))).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("__p", F.explode(places))
    return rows.withColumn("kmer", F.substring(F.col(seq), F.col("__p"), F.lit(k))).withColumn("place", (F.col("__p") - 1).cast("long")).drop("__p")


def rolling_codes(vals: Column, k: int, radix: int) -> Column:
    """Codes of all windows, least significant symbol first; none if the array is shorter."""
    if radix**k >= 1 << 63:
        raise ValueError("window exceeds 63 bits")
    n = F.size(vals)
    places = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))

    def code(i: Column) -> Column:
        out = F.lit(0).cast("long")
        for j in range(k):
            out = out + F.get(vals, i + j).cast("long") * F.lit(radix**j)
        return out

    return F.transform(places, code)


def window_codes(df: DataFrame, k: int, radix: int, keys: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """The same for long form (keys, pos, v): windows never cross sequences."""
    w = Window.partitionBy(*keys).orderBy("pos")
    code = F.lit(0).cast("long")
    for j in range(k):
        code = code + F.lead("v", j).over(w).cast("long") * F.lit(radix**j)
    return df.select(*keys, "pos", code.alias("code")).where(F.col("code").isNotNull())


def kmer_counts(df: DataFrame, k: int, by: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    return kmers(df, k, seq).groupBy(*by, "kmer").agg(F.count("*").alias("n"))


def motif_features(df: DataFrame, start: int, stop: int, seq: str = "seq", weight: str = "weight", boundary: str = "@") -> DataFrame:
    """Share of each k-mer among all of its length, for k from start to stop - 1, over '@seq@', by weight."""
    if not 1 <= start < stop <= 64:
        raise ValueError("lengths must satisfy 1 <= start < stop <= 64")
    wrapped = df.select(F.concat(F.lit(boundary), seq, F.lit(boundary)).alias("s"), F.col(weight).cast("long").alias("w"))

    def grams_of(k: int) -> Column:
        places = F.when(F.length("s") >= k, F.sequence(F.lit(1), F.length("s") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.struct(F.lit(k).cast("long").alias("k"), F.substring(F.col("s"), p, F.lit(k)).alias("kmer")))

    grams = F.flatten(F.array(*map(grams_of, range(start, stop))))
    counts = wrapped.select("w", F.explode(grams).alias("g")).groupBy("g.k", "g.kmer").agg(F.sum("w").alias("n"))
    totals = counts.groupBy("k").agg(F.sum("n").alias("total"))  # one row per length
    share = F.when(F.col("total") == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.col("n").cast("double"), F.col("total")))
    return counts.join(F.broadcast(totals), "k").select("k", "kmer", "n", share.alias("share"))


def dense_vocabulary(spark, counts: DataFrame, k: int, alphabet: str) -> DataFrame:
    """Counts for every possible k-mer, zeros included: (code, kmer, n), most significant symbol first."""
    base = len(alphabet)
    symbol = lambda j: F.substring(F.lit(alphabet), (F.floor(F.col("id") / base ** (k - 1 - j)) % base + 1).cast("int"), F.lit(1))
    every = spark.range(base**k).select(F.col("id").alias("code"), F.concat(*map(symbol, range(k))).alias("kmer"))
    return every.join(counts, "kmer", "left").select("code", "kmer", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distance(x: Column, y: Column) -> Column:
    """Hamming distance of strings of equal length."""
    return F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda acc, d: acc + d)


def hamming_neighbours(df: DataFrame, cutoff: int, seq: str = "seq", id_: str = "seq_id") -> DataFrame:
    """(i, j, v) for sequences of equal length within the cutoff, i and j both ways, v = distance + 1.

    A pair within the cutoff agrees in one of cutoff + 1 equal parts, so pairs meet on a part instead of all
    with all. Equal sequences are compared once, as one text.
    """
    texts = df.select(F.col(seq).alias("s")).distinct()
    n = F.length("s")
    cut = lambda k: F.floor(n * k / (cutoff + 1)).cast("int")
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.substring(F.col("s"), cut(k) + 1, cut(k + 1) - cut(k)).alias("part")) for k in range(cutoff + 1)))
    blocks = texts.select("s", n.alias("n"), F.explode(parts).alias("p")).select("s", "n", "p.k", "p.part")
    pairs = blocks.join(blocks.withColumnRenamed("s", "t"), ["n", "k", "part"]).where(F.col("s") <= F.col("t")).select("s", "t").distinct()
    near = pairs.withColumn("d", F.when(F.col("s") == F.col("t"), 0).otherwise(distance(F.col("s"), F.col("t")))).where(F.col("d") <= cutoff)
    both = near.unionByName(near.where("s <> t").select(F.col("t").alias("s"), F.col("s").alias("t"), "d"))
    ids = df.select(F.col(seq).alias("s"), F.col(id_).cast("long").alias("i"))
    found = ids.join(both, "s").join(ids.select(F.col("s").alias("t"), F.col("i").alias("j")), "t")
    return found.select("i", "j", (F.col("d") + 1).cast("long").alias("v"))


def padded_batch(df: DataFrame, selection: DataFrame, alphabet: str, seq: str = "seq", id_: str = "seq_id", pad: int = -1) -> DataFrame:
    """(k, vals, n): codes of the selected sequences in order, padded to the longest of them."""
    chosen = selection.join(df.select(F.col(id_).alias("i"), seq), "i").select("k", codes(F.col(seq), alphabet).alias("c"))
    longest = chosen.agg(F.max(F.size("c")).alias("m"))
    padded = F.concat(F.transform("c", lambda x: x.cast("int")), F.array_repeat(F.lit(pad), F.col("m") - F.size("c")))
    return chosen.join(F.broadcast(longest)).select("k", padded.alias("vals"), F.size("c").cast("long").alias("n"))  # one row


def overlap(a: DataFrame) -> DataFrame:
    """Shared sequences of repertoires: sum of products of counts for each pair (rep, seq, n)."""
    b = a.select("seq", F.col("rep").alias("rep_b"), F.col("n").alias("m"))
    return a.withColumnRenamed("rep", "rep_a").join(b, "seq").where("rep_a <= rep_b").groupBy("rep_a", "rep_b").agg(F.sum(F.col("n") * F.col("m")).alias("v"))
