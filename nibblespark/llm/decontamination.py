"""Benchmark decontamination by spaced seeds; DataFrame functions only.

A seed is a place in a text of which fixed masks keep ``MASKS`` positions and ignore the others, so places match
although words were replaced at the ignored positions. Seeds of the documents are hashed and joined with those
of the benchmark items. Around each hit the document's words are held against the item's words at the same
relative place (on one diagonal). An overlap is a run of such places in which at least ``DENSE`` of the words
are equal, and at least ``MATCHED`` of them, or ``SHARE`` of a shorter item. Every run of this kind holds a seed:
the masks were chosen so, and a test goes through all patterns. Items under ``SHORT`` words are found where they
stand whole, by one hash of all their words.

All masks keep the first two words. A bitmap of the benchmark's word pairs and one of its seeds, of fixed sizes,
leave out what can't match before anything is joined or shuffled. The table of seeds is broadcast while it has at
most ``BROADCAST_ROWS`` rows, and shuffled beyond, with the few places that passed the bitmaps. Words are compared
in stretches of ``STRETCH`` words of an item, so what a hit carries is bounded however long texts are.

Null or empty text, in either table: no words, no overlap. Null ids are kept as null. Rows that repeat a doc_id
are searched apart and share one result per item, the best. Repeated items count once. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise
from .license_scan import words_of

#: Positions that each mask keeps.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 1, 2, 6, 8), (0, 1, 3, 4, 6))
MATCHED, SHARE, SHORT = 12, 0.8, 10
#: Equal words among the words of an overlap: so many of so many.
DENSE = (7, 10)
BROADCAST_ROWS = 1_000_000
#: Words of an item that are compared around a hit, and more of them to both sides.
STRETCH, MARGIN = 128, 32
#: Bits of a bitmap, as a power of two.
BITMAP = 22


def _hashes(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(*keep, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))


def _places(hashed: DataFrame, keep: list[str]) -> DataFrame:
    """Every word of every text: ``keep``, its place ``at``, and the text's word hashes."""
    return hashed.select(*keep, "hashes", F.posexplode("hashes").alias("at", "word"))


def _word(k: int) -> Column:
    return F.get("hashes", F.col("at") + k)


def _pair() -> Column:
    return F.xxhash64(F.lit(-1), _word(0), _word(1))


def _seeds() -> Column:
    """The seed of each mask at a place; null where the text ends before."""
    one = lambda i, m: F.when(F.col("at") + m[-1] < F.size("hashes"), F.xxhash64(F.lit(i), *map(_word, m)))
    return F.array(*(one(i, m) for i, m in enumerate(MASKS)))


def _bitmap(values: DataFrame) -> Column:
    """A bitmap of the one column of ``values``, as an array of 64-bit words in one row, for ``_in_bitmap``."""
    spark, x = values.sparkSession, F.col(values.columns[0])
    bit = F.pmod(x, F.lit(1 << BITMAP))
    words = values.select((F.shiftright(bit, 6)).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    every = spark.range(1 << (BITMAP - 6)).join(words, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda s: s["b"]).alias("bitmap")).scalar()  # as many as the bitmap has


def _in_bitmap(bitmap: Column, x: Column) -> Column:
    bit = F.pmod(x, F.lit(1 << BITMAP))
    word = F.get(bitmap, F.shiftright(bit, 6).cast("int"))
    return F.call_function("shiftright", word, (bit % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def needed(n: Column) -> Column:
    """Equal words that an overlap with an item of n words must have."""
    return F.when(n < SHORT, n).otherwise(F.least(F.lit(MATCHED), F.ceil(n * SHARE)))


def _best_run(same: Column) -> Column:
    """Of the sorted places of equal words: the longest dense run, as (n_matched, first, last); the first is negated."""
    a, b = DENSE
    # of places x at rank r, runs from i to j are dense where b * (rj - ri + 1) >= a * (xj - xi + 1)
    level = F.transform(same, lambda x, r: b * r - a * x)
    start = lambda g: F.array_position(F.transform(level, lambda h: h <= g + (b - a)), True) - 1
    run = lambda x, j, i: F.struct((j - i + 1).alias("n_matched"), (-F.get(same, i.cast("int"))).alias("first"), x.alias("last"))
    return F.array_max(F.transform(same, lambda x, j: run(x, j, start(b * j - a * x))))


def overlaps(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Overlaps: ``keys``, item_id, n_item_words, n_matched, first_word, last_word (places in the document)."""
    keep = list(keys)
    items = _hashes(benchmark, ["item_id"]).distinct().select("*", F.xxhash64("item_id", "hashes").alias("item"), F.size("hashes").alias("n_item_words"))
    items = materialise(items, "items")
    texts = _hashes(docs.select(*keep, "text"), keep).withColumn("__text", F.monotonically_increasing_id())

    own = _places(items.where(F.col("n_item_words") >= SHORT), ["item", "n_item_words"])
    seeds = materialise(own.select("item", F.col("n_item_words").alias("n"), F.col("at").alias("item_at"), _pair().alias("pair"), F.explode(_seeds()).alias("seed")).where("seed IS NOT NULL"), "seeds")
    sized = F.broadcast if seeds.count() <= BROADCAST_ROWS else lambda x: x  # by the count just taken; an item is less than its seeds
    pairs, whole = _bitmap(seeds.select("pair")), _bitmap(seeds.select("seed"))

    # where both words of a pair are in the bitmap, the seeds of all masks are looked up
    likely = _places(texts, [*keep, "__text"]).where(_in_bitmap(pairs, _pair()))
    asked = likely.select(*keep, "__text", "at", "hashes", F.explode(_seeds()).alias("seed")).where(F.col("seed").isNotNull() & _in_bitmap(whole, F.col("seed")))
    # what a hit carries on: the document's words beside one stretch of the item
    cell = F.floor(F.col("item_at") / STRETCH) * STRETCH
    diagonal = F.col("at") - F.col("item_at")
    lowest, highest = F.greatest(cell - MARGIN, F.lit(0)), F.least(cell + STRETCH + MARGIN, F.col("n"))
    if sized is not F.broadcast:  # a bounded part of the text goes through the shuffle
        asked = asked.select(*keep, "__text", "at", "seed", (-F.least("at", F.lit(STRETCH + MARGIN))).alias("back"), F.slice("hashes", F.greatest(F.col("at") - STRETCH - MARGIN, F.lit(0)) + 1, 2 * (STRETCH + MARGIN)).alias("hashes"))
    else:
        asked = asked.withColumn("back", -F.col("at"))
    hits = asked.join(sized(seeds.drop("pair")), "seed")
    start = F.greatest(diagonal + lowest, F.col("at") + F.col("back"))
    end = F.least(diagonal + highest, F.col("at") + F.col("back") + F.size("hashes"))
    part = F.slice("hashes", (start - F.col("at") - F.col("back") + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    lines = hits.select(*keep, "__text", "item", diagonal.cast("long").alias("diagonal"), start.cast("long").alias("start"), part.alias("part")).distinct()
    held = lines.join(sized(items.where(F.col("n_item_words") >= SHORT)), "item")
    same = F.filter(F.transform("part", lambda h, k: F.when(h == F.get("hashes", (F.col("start") - F.col("diagonal") + k).cast("int")), F.col("start") + k)), lambda x: x.isNotNull())
    by = [*keep, "__text", "item", "item_id", "n_item_words", "diagonal"]
    lined = held.select(*by, same.alias("same")).groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("same")))).alias("same"))  # an item's length bounds the places of one diagonal
    need = needed(F.col("n_item_words"))
    runs = lined.where(F.size("same") >= need).withColumn("best", _best_run(F.col("same"))).where(F.col("best.n_matched") >= need)
    found = runs.select(*keep, "item_id", "n_item_words", F.col("best.n_matched").cast("long").alias("n_matched"), (-F.col("best.first")).cast("long").alias("first_word"), F.col("best.last").cast("long").alias("last_word"))

    lengths = sorted(r["n_item_words"] for r in items.where((F.col("n_item_words") < SHORT) & (F.col("n_item_words") > 0)).select("n_item_words").distinct().collect())  # SHORT numbers at most
    if not lengths:
        return found
    few = items.where((F.col("n_item_words") < SHORT) & (F.col("n_item_words") > 0))
    known = few.select("item_id", "n_item_words", F.col("hashes").alias("own"), F.xxhash64("n_item_words", "hashes").alias("whole"))
    fronts = _bitmap(known.select("whole"))
    here = lambda n: F.slice("hashes", F.col("at") + 1, n)
    all_of = F.array(*(F.when(F.col("at") + n <= F.size("hashes"), F.struct(F.xxhash64(F.lit(n), here(n)).alias("whole"), here(n).alias("words"))) for n in lengths))
    stand = _places(texts, keep).select(*keep, "at", F.explode(all_of).alias("x")).where(F.col("x").isNotNull() & _in_bitmap(fronts, F.col("x.whole")))
    sized = F.broadcast if few.count() <= BROADCAST_ROWS else lambda x: x  # by the count just taken
    exact = stand.select(*keep, "at", "x.whole", "x.words").join(sized(known), "whole").where(F.col("words") == F.col("own"))
    n = F.col("n_item_words").cast("long")
    return found.unionByName(exact.select(*keep, "item_id", "n_item_words", n.alias("n_matched"), F.col("at").cast("long").alias("first_word"), (F.col("at") + n - 1).alias("last_word")))


def contaminated(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document (by ``keys``) and item whose passage it holds: the best overlap."""
    best = F.max(F.struct("n_matched", (-F.col("first_word")).alias("first"), "last_word")).alias("best")
    rows = overlaps(docs, benchmark, keys).groupBy(*keys, "item_id").agg(best)
    return rows.select(*keys, "item_id", "best.n_matched", (-F.col("best.first")).alias("first_word"), "best.last_word")


def contaminated_sql() -> str:
    """The same rows in DuckDB SQL, by the definition of an overlap: all equal words of all texts, no seeds."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    a, b = DENSE
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT row_number() OVER () AS j, item_id, v, CASE WHEN len(v) < {SHORT} THEN len(v) ELSE least({MATCHED}, ceil(len(v) * {SHARE})) END AS need FROM (SELECT DISTINCT item_id, {words} AS v FROM benchmark)),
dw AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
bw AS (SELECT j, unnest(v) AS word, unnest(range(len(v))) AS k FROM b),
p AS MATERIALIZED (SELECT r, j, i - k AS diagonal, i AS x FROM dw JOIN bw USING (word)),
c AS (SELECT r, j, diagonal FROM p JOIN b USING (j) GROUP BY r, j, diagonal, need HAVING count(*) >= need),
m AS MATERIALIZED (SELECT r, j, diagonal, x, row_number() OVER (PARTITION BY r, j, diagonal ORDER BY x) AS k FROM p JOIN c USING (r, j, diagonal)),
s AS (SELECT s.r, s.j, e.k - s.k + 1 AS n_matched, s.x AS first_word, e.x AS last_word FROM m s JOIN m e ON s.r = e.r AND s.j = e.j AND s.diagonal = e.diagonal AND s.k <= e.k AND {b} * (e.k - s.k + 1) >= {a} * (e.x - s.x + 1)),
o AS (SELECT doc_id, item_id, n_matched, first_word, last_word, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, first_word, last_word DESC) AS k FROM s JOIN d USING (r) JOIN b USING (j) WHERE n_matched >= need)
SELECT doc_id, item_id, CAST(n_matched AS BIGINT) AS n_matched, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word FROM o WHERE k = 1
"""
