"""Chunked storage: the smallest of several encodings for each chunk, as columns.

A chunk is a row (chunk_id, vals) of at most some thousand values. Sizes of all encodings are computed as
expressions, and the smallest names the winner; ties go in the order uniform, periodic against plain forms
only if smaller, runs if smaller than that, a trimmed span if smaller still, else palette or plain.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits as B

CHUNK, MAX_PERIOD, MAX_TRIM = 4096, 256, 65_535


def bit_length(x: Column) -> Column:
    """Bits of a value, at least one."""
    return F.length(F.bin(x.cast("long")))


def packed_size(n: Column, bits: Column) -> Column:
    return 8 * F.floor((n * bits + 63) / 64)


def chunks(a: DataFrame, size: int = CHUNK, keys: tuple[str, ...] = ()) -> DataFrame:
    """Long form to one row per chunk; a chunk's values meet in one task, never an array's."""
    chunk = F.floor(F.col("pos") / size).cast("long").alias("chunk_id")
    return a.groupBy(*keys, chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"].cast("int")).alias("vals"))


def full(spark, length: int, value: int, size: int = CHUNK) -> DataFrame:
    """An array of one value; each chunk is one small row until it is read."""
    n = F.least(F.lit(size), length - F.col("id") * size).cast("int")
    return spark.range(-(-length // size)).select(F.col("id").alias("chunk_id"), F.array_repeat(F.lit(value), n).alias("vals"))


def run_starts(vals: Column) -> Column:
    n = F.size(vals)
    places = F.sequence(F.lit(0), n - 1)
    return F.filter(places, lambda i: (i == 0) | (F.get(vals, i) != F.get(vals, i - 1)))


def run_lengths(starts: Column, n: Column) -> Column:
    return F.transform(starts, lambda s, i: F.coalesce(F.get(starts, i + 1), n) - s)


def shortest_period(vals: Column, n: Column) -> Column:
    """The smallest period of at most 256 that repeats at least twice, or 0; a part of it may end the chunk."""
    tries = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(MAX_PERIOD), F.floor(n / 2).cast("int"))))
    again = lambda p, i: F.get(vals, i + p) == F.get(vals, i)

    def likely(p: Column) -> Column:
        """A few places, which rule out nearly all that don't fit before whole slices are held together."""
        places = [F.lit(0), n - p - 1, F.lit(1), F.floor((n - p) / 2).cast("int"), F.floor((n - p) / 3).cast("int"), F.floor((n - p) / 5).cast("int"), F.floor((n - p) * 3 / 4).cast("int"), F.floor((n - p) * 6 / 7).cast("int")]
        return reduce(and_, (again(p, i) for i in places))

    fits = F.filter(tries, lambda p: likely(p) & (F.slice(vals, p + 1, n - p) == F.slice(vals, F.lit(1), n - p)))
    return F.when(n < 2, 0).otherwise(F.coalesce(F.get(fits, 0), F.lit(0)))


def measured(chunked: DataFrame) -> DataFrame:
    """Adds the size of every encoding to (.., vals) rows; empty chunks are not stored."""
    vals, n, k = F.col("vals"), F.col("n"), F.col("k")
    out = chunked.where(F.size("vals") > 0).withColumn("n", F.size("vals")).withColumn("colors", F.array_sort(F.array_distinct("vals")))
    out = out.withColumn("k", F.size("colors")).withColumn("starts", run_starts(vals))
    out = out.withColumn("direct_bits", bit_length(F.array_max("colors"))).withColumn("palette_bits", bit_length(k - 1))
    out = out.withColumn("direct_bytes", packed_size(n, F.col("direct_bits"))).withColumn("palette_bytes", packed_size(n, F.col("palette_bits")) + k)
    out = out.withColumn("run_colors", F.when(F.col("palette_bits") < F.col("direct_bits"), k).otherwise(0))
    plain = F.least("direct_bytes", n.cast("long"))
    out = out.withColumn("plain_bytes", F.when(F.col("run_colors") > 0, F.least(plain, F.col("palette_bytes"))).otherwise(plain))
    out = out.withColumn("period", F.when((k > 1) & (F.col("plain_bytes") > 9), shortest_period(vals, n)).otherwise(0))
    direct_period = packed_size(F.col("period"), F.col("direct_bits")) + 1
    palette_period = F.when(F.col("run_colors") > 0, packed_size(F.col("period"), F.col("palette_bits")) + 1 + k)
    out = out.withColumn("period_bytes", F.when(F.col("period") > 0, F.least(direct_period, palette_period)))
    runs = F.transform(run_lengths(F.col("starts"), n), lambda r: 1 + F.ceil(bit_length(r - 1) / 7))
    out = out.withColumn("rle_bytes", F.aggregate(runs, F.lit(0).cast("long"), lambda acc, x: acc + x) + F.col("run_colors"))

    lead, tail = F.get("starts", 1), F.element_at("starts", -1)
    left, right = F.get(vals, 0), F.element_at(vals, -1)

    def span(value: Column, first: Column, last: Column) -> Column:
        inner = F.slice(vals, first + 1, last - first)
        colors = F.array_distinct(inner)
        direct = packed_size(last - first, bit_length(F.array_max(inner)))
        count = F.size(colors)
        indexed = F.when(count < 256, packed_size(last - first, bit_length(count - 1)) + count)
        best = F.least(direct, indexed)
        return F.struct((best + 6).alias("bytes"), value.alias("value"), first.alias("first"), last.alias("last"), F.coalesce(indexed < direct, F.lit(False)).alias("indexed"))

    ends = span(left, lead, F.when(left == right, tail).otherwise(n))
    start = F.when(left != right, span(right, F.lit(0), tail))
    both = F.when(start.isNotNull() & (start["bytes"] < ends["bytes"]), start).otherwise(ends)
    return out.withColumn("trim", F.when((k > 1) & (n <= MAX_TRIM), both))


def planned(chunked: DataFrame) -> DataFrame:
    """Adds ``encoding``, ``stored_bytes`` and ``has_palette``."""
    out = measured(chunked)
    by_period = F.coalesce(F.col("period_bytes") < F.col("plain_bytes"), F.lit(False))
    limit = F.when(by_period, F.col("period_bytes")).otherwise(F.col("plain_bytes"))
    by_runs = F.col("rle_bytes") < limit
    best = F.when(by_runs, F.col("rle_bytes")).otherwise(limit)
    by_trim = F.coalesce(~by_period & (F.col("trim.bytes") < best) & (best + 2 > 16), F.lit(False))
    by_palette = (F.col("run_colors") > 0) & (F.col("palette_bytes") < F.least("direct_bytes", F.col("n").cast("long")))
    name = (
        F.when(F.col("k") == 1, "uniform").when(by_trim, "trim").when(by_runs, "rle").when(by_period, "period").when(by_palette, "palette")
        .when(F.col("direct_bytes") <= F.col("n"), "direct").otherwise("bytes")
    )
    size = F.when(F.col("k") == 1, 0).when(by_trim, F.col("trim.bytes")).otherwise(best)
    indexed_period = F.coalesce((F.col("run_colors") > 0) & (packed_size(F.col("period"), F.col("palette_bits")) + F.col("k") < packed_size(F.col("period"), F.col("direct_bits"))), F.lit(False))
    palette = F.when(F.col("encoding") == "trim", F.col("trim.indexed")).when(F.col("encoding") == "rle", F.col("run_colors") > 0).when(F.col("encoding") == "period", indexed_period).otherwise(F.col("encoding") == "palette")
    return out.withColumn("encoding", name).withColumn("stored_bytes", size.cast("long")).withColumn("has_palette", palette)


WIDTHS = range(1, 9)


def _by_width(width: Column, f) -> Column:
    """f of the one width that a row has: packing is an expression for each width."""
    out = F.when(width == WIDTHS[0], f(WIDTHS[0]))
    for bits in WIDTHS[1:]:
        out = out.when(width == bits, f(bits))
    return out


def _byte(x: Column) -> Column:
    return F.lpad(F.hex(x.cast("long")), 2, "0")


def run_stream(runs: Column) -> Column:
    """Runs (v, n) as bytes: the value or its place in the palette, then n - 1 in groups of seven bits, low ones first."""
    low, rest = F.lit(127).cast("long"), lambda x, k: F.call_function("shiftright", x, F.lit(k))
    more = lambda x: _byte(x.bitwiseAND(low) + 128)

    def count(x: Column) -> Column:
        return F.when(x < 128, _byte(x)).when(x < 1 << 14, F.concat(more(x), _byte(rest(x, 7)))).otherwise(F.concat(more(x), more(rest(x, 7)), _byte(rest(x, 14))))

    return F.unhex(F.array_join(F.transform(runs, lambda r: F.concat(_byte(r["v"]), count(r["n"].cast("long") - 1))), ""))


def runs_of(stream: Column, n: Column) -> Column:
    """Runs (v, n) of a byte stream. One that breaks off, or has other than n values in all, raises."""
    places = F.sequence(F.lit(1), F.length(stream))
    # v, how far the count has got, its bits, whether a count is open, and the runs that are done
    start = F.struct(F.lit(-1).alias("v"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("k"), F.array().cast("array<struct<v:int,n:int>>").alias("done"))

    def step(acc: Column, i: Column) -> Column:
        b = F.conv(F.hex(F.substring(stream, i, 1)), 16, 10).cast("int")
        k = acc["k"] + F.call_function("shiftleft", b.bitwiseAND(F.lit(127)).cast("long"), acc["at"])
        closed = F.struct(F.lit(-1).alias("v"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("k"), F.concat(acc["done"], F.array(F.struct(acc["v"].alias("v"), (k + 1).cast("int").alias("n")))).alias("done"))
        further = F.struct(acc["v"].alias("v"), (acc["at"] + 7).alias("at"), k.alias("k"), acc["done"].alias("done"))
        opened = F.struct(b.alias("v"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("k"), acc["done"].alias("done"))
        return F.when(acc["v"] < 0, opened).when(b >= 128, further).otherwise(closed)

    total = lambda runs: F.aggregate(runs, F.lit(0), lambda s, r: s + r["n"])
    whole = lambda acc: F.when((acc["v"] < 0) & (total(acc["done"]) == n), acc["done"]).otherwise(F.raise_error(F.lit("damaged runs")).cast("array<struct<v:int,n:int>>"))
    return F.aggregate(places, start, step, whole)


def encoded(chunked: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, n, encoding, palette, period, first, value, stream, width, n_body, words, stored_bytes): only the winner's parts are filled.

    ``words`` packs values, or places in the palette, in the ``width`` bits that the winner needs; ``stream`` is
    the bytes of runs.
    """
    p = planned(chunked)
    is_ = lambda x: F.col("encoding") == x
    none = F.array().cast("array<int>")
    inner = F.when(is_("trim"), F.slice("vals", F.col("trim.first") + 1, F.col("trim.last") - F.col("trim.first"))).when(is_("period"), F.slice("vals", 1, F.col("period"))).when(is_("uniform") | is_("rle"), none).otherwise(F.col("vals"))
    p = p.withColumn("inner", inner)
    colors = F.when(is_("rle"), F.col("colors")).otherwise(F.array_sort(F.array_distinct("inner")))
    p = p.withColumn("palette", F.when(F.col("has_palette"), colors).otherwise(none))
    place = lambda x: F.when(F.size("palette") > 0, (F.array_position("palette", x) - 1).cast("int")).otherwise(x)
    p = p.withColumn("body", F.transform("inner", place))
    width = F.when(is_("bytes"), 8).when(F.size("palette") > 0, bit_length(F.size("palette") - 1)).otherwise(bit_length(F.coalesce(F.array_max("body"), F.lit(0))))
    p = p.withColumn("width", F.when(F.size("body") > 0, width))
    runs = F.arrays_zip(F.transform("starts", lambda s: place(F.get("vals", s))).alias("v"), run_lengths(F.col("starts"), F.col("n")).alias("n"))
    names = [c for c in ("chunk_id", *keep) if c in chunked.columns]
    return p.select(
        *names, "n", "encoding", "palette", F.when(is_("period"), F.col("period")).alias("period"), F.when(is_("trim"), F.col("trim.first")).alias("first"),
        F.when(is_("trim"), F.col("trim.value")).when(is_("uniform"), F.get("vals", 0)).alias("value"), F.when(is_("rle"), run_stream(runs)).alias("stream"),
        "width", F.size("body").alias("n_body"), _by_width(F.col("width"), lambda bits: B.pack(F.col("body"), bits)).alias("words"), "stored_bytes",
    )


def record_bytes(records: DataFrame) -> Column:
    """The bytes that an ``encoded`` row really has: words, palette, runs, and what a period or a span needs to be told."""
    words = F.when(F.col("encoding") == "bytes", F.col("n")).otherwise(8 * F.coalesce(F.size("words"), F.lit(0)))
    told = F.when(F.col("encoding") == "trim", 6).when(F.col("encoding") == "period", 1).otherwise(0)
    return (words + F.size("palette") + F.coalesce(F.length("stream"), F.lit(0)) + told).cast("long")


def decoded(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, vals) from ``encoded`` rows."""
    color = lambda x: F.when(F.size("palette") > 0, F.get("palette", x)).otherwise(x)
    body = _by_width(F.col("width"), lambda bits: B.unpack(F.col("words"), F.col("n_body"), bits))
    rows = records.withColumn("__body", F.transform(F.coalesce(body, F.array().cast("array<smallint>")), lambda x: color(x.cast("int"))))
    fill = lambda k: F.array_repeat("value", k)
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("__body", i % F.col("period")))
    vals = (
        F.when(F.col("encoding") == "uniform", fill(F.col("n")))
        .when(F.col("encoding") == "trim", F.concat(fill(F.col("first")), "__body", fill(F.col("n") - F.col("first") - F.col("n_body"))))
        .when(F.col("encoding") == "rle", F.flatten(F.transform(runs_of(F.col("stream"), F.col("n")), lambda r: F.array_repeat(color(r["v"]), r["n"]))))
        .when(F.col("encoding") == "period", every)
        .otherwise(F.col("__body"))
    )
    return rows.select("chunk_id", vals.alias("vals"), *keep)


def storage_info(plan: DataFrame) -> DataFrame:
    """One row of counts over ``planned`` chunks."""
    kind = lambda *x: F.count_if(F.col("encoding").isin(*x)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return plan.agg(
        total("n").alias("logical_bytes"), total("stored_bytes").alias("stored_bytes"), F.count("*").cast("long").alias("chunk_count"),
        kind("uniform").alias("uniform_chunks"), F.count_if("has_palette").cast("long").alias("palette_chunks"), F.lit(0).cast("long").alias("compressed_chunks"),
        kind("rle").alias("rle_chunks"), kind("period").alias("periodic_chunks"), kind("trim").alias("trimmed_chunks"),
    )


def read_range(chunked: DataFrame, start: int, stop: int, length: int, size: int = CHUNK) -> DataFrame:
    """Elements start to stop: whole chunks outside are pruned before anything is unpacked."""
    if not 0 <= start <= stop <= length:
        raise IndexError("range outside the array")
    inside = chunked.where(F.col("chunk_id").between(start // size, max(stop - 1, 0) // size))
    lo = F.greatest(F.lit(0).cast("long"), start - F.col("chunk_id") * size)
    hi = F.least(F.size("vals").cast("long"), stop - F.col("chunk_id") * size)
    part = F.when(hi > lo, F.slice("vals", (lo + 1).cast("int"), (hi - lo).cast("int"))).otherwise(F.array().cast("array<int>"))
    cells = inside.select("chunk_id", lo.alias("lo"), F.posexplode(part).alias("c", "v"))
    return cells.select((F.col("chunk_id") * size + F.col("lo") + F.col("c")).alias("pos"), "v")


def write_range(chunked: DataFrame, updates: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks with (pos, v) written; chunks that no update touches pass as they are."""
    changes = updates.groupBy(F.floor(F.col("pos") / size).cast("long").alias("chunk_id")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("pos") % size).cast("int"), F.col("v").cast("int")))).alias("m"))
    new = F.transform("vals", lambda v, i: F.coalesce(F.element_at("m", i), v))
    return chunked.join(changes, "chunk_id", "left").select("chunk_id", F.when(F.col("m").isNull(), F.col("vals")).otherwise(new).alias("vals"))


#: Steps of a trace that one task runs through.
TRACE_BLOCK = 1 << 16


def simulated_cache(trace: DataFrame, size: int, budget_chunks: int, block: int = TRACE_BLOCK) -> DataFrame:
    """Hits and misses of an LRU cache of chunks over an ordered trace (step, pos).

    A cache holds the chunks that were read last. So of each block of steps its last distinct chunks are enough,
    and what the cache holds before a block comes from the blocks before by doubling: round j joins with the
    block 2**j before. Then every block is run through on its own.
    """
    reads = trace.select("step", F.floor(F.col("pos") / size).cast("long").alias("chunk_id"), F.floor(F.col("step") / block).cast("long").alias("block"))
    last = reads.groupBy("block", "chunk_id").agg(F.max("step").alias("step"))
    newest = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("step")))
    held = last.withColumn("k", newest).where(F.col("k") <= budget_chunks).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "chunk_id"))).alias("x"))
    held = held.select("block", F.col("x.chunk_id").alias("held"))
    ends = held.agg(F.min("block").alias("lo"), F.max("block").alias("hi")).first()
    every = trace.sparkSession.range(ends["lo"] or 0, (ends["hi"] if ends["hi"] is not None else -1) + 2).select(F.col("id").alias("block"))
    held = every.join(held, "block", "left").select("block", F.coalesce("held", F.array().cast("array<bigint>")).alias("held"))
    reach = 1
    while reach <= (ends["hi"] or 0) - (ends["lo"] or 0):
        before = held.select((F.col("block") + reach).alias("block"), F.col("held").alias("before"))
        older = F.array_except(F.coalesce("before", F.array().cast("array<bigint>")), F.col("held"))
        held = held.join(before, "block", "left").select("block", F.slice(F.concat("held", older), 1, budget_chunks).alias("held"))
        reach *= 2
    start = held.select((F.col("block") + 1).alias("block"), F.col("held").alias("start"))
    known = reads.join(start, "block", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import OrderedDict

        pdf = pdf.sort_values("step")
        first = pdf["start"].iloc[0]
        cache = OrderedDict.fromkeys(reversed([] if first is None else list(first)))
        hits = 0
        for c in pdf["chunk_id"].tolist():
            hits += c in cache
            cache[c] = None
            cache.move_to_end(c)
            if len(cache) > budget_chunks:
                cache.popitem(last=False)
        return pd.DataFrame({"hits": [hits], "misses": [len(pdf) - hits]})

    done = known.groupBy("block").applyInPandas(run, "hits long, misses long")
    return done.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"))
