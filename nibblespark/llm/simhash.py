"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint bit is set where more than half of a text's shingle hashes have it. Fingerprints within
``radius`` bits are linked. The tables of the index are bit masks with a structure: each of the 64 bits has
a vector of radius + 1 bits, and mask v keeps the bits whose vector has an odd overlap with v. The at most
``radius`` bits in which two fingerprints differ leave some v orthogonal to all their vectors, so that table
does not see the difference, and the pair collides there: nothing within the radius is lost.

Equal fingerprints are one vertex from the start. In a bucket, a search from vertex to vertex finds the
groups that links join, and gives one link per member, never all pairs. A bucket of over ``MOST`` distinct
fingerprints is dealt again by another family of masks, which covers every pair just as well; each family
fixes half of the bits that were free, so buckets that share ``FAMILIES`` masks differ in few bits, if at all.

``near_duplicates`` links by fingerprints alone. ``near_copies`` and ``without_copies`` link texts of which 0.8
of the five-word shingles are common: the tables give candidates, whole sets of shingles decide, and what
lies too far apart for the tables (a fifth of all shingles may differ) is looked up by rare shingles.

Null or empty text: no words, fingerprint zero, linked like any other. Null ids: the component is the
smallest id that is not null, or null. Repeated rows are one vertex. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import handed_on, materialise, scratch_scope, small_batches, text_bytes
from ._rows import Findings, leave, named, scanned, without
from .components import connected_components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Distinct fingerprints that one bucket may compare in a task, and families of masks that split larger ones.
MOST, FAMILIES = 8192, 8


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, unsigned."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if n > 1 else [b" ".join(words[:shingle])]
    return majority(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint of each row, written once."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                prints = np.array([fingerprint(t, shingle) for t in text_bytes(b.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints)], names=["doc_id", "print"])

    return materialise(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, print long"), "prints")


def masks(radius: int = RADIUS, seed: int = 1) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks of a covering family, signed."""
    size = 1 << (radius + 1)
    # every vector about as often, dealt to the bits in random order
    vectors = np.random.default_rng(seed).permutation(np.arange(BITS) % (size - 1) + 1)
    out = []
    for v in range(1, size):
        m = sum(1 << i for i, a in enumerate(vectors) if bin(int(a) & v).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def groups_within(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint the first member of its group (what links reach), and the member that it was reached from."""
    prints = prints.view(np.uint64)  # of signed numbers, NumPy counts the bits of the absolute value
    n = len(prints)
    first, source = np.arange(n), np.arange(n)
    unseen = np.arange(n)
    while len(unseen):
        start, unseen = unseen[0], unseen[1:]
        front = np.array([start])
        while len(front) and len(unseen):
            part, front = front[:256], front[256:]
            close = np.bitwise_count(prints[part][:, None] ^ prints[unseen][None, :]) <= radius
            near = close.any(axis=0)
            found = unseen[near]
            first[found] = start
            source[found] = part[close[:, near].argmax(axis=0)]
            front = np.append(front, found)
            unseen = unseen[~near]
    return first, source


def _links(rows: DataFrame, radius: int, close_pairs: bool) -> DataFrame:
    """Links inside the buckets of (bucket, print, id); rows of a bucket come together and in order."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(bucket: np.ndarray, prints: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
            edges = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
            starts = np.append(0, edges[:-1])
            u, v = [], []
            several = np.flatnonzero(edges - starts > 1)
            for i, j in zip(starts[several].tolist(), edges[several].tolist()):
                first, source = groups_within(prints[i:j], radius)
                far = np.flatnonzero(first != np.arange(j - i))
                u.append(ids[i + (source if close_pairs else first)[far]])
                v.append(ids[i + far])
            return pa.RecordBatch.from_pydict({"u": np.concatenate(u), "v": np.concatenate(v)}) if u else None

        held: list[np.ndarray] | None = None
        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "print", "id")]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            cut = np.flatnonzero(held[0] != held[0][-1]) if len(held[0]) else []
            if len(cut):  # the last bucket may go on in the next batch
                k = int(cut[-1]) + 1
                if (out := close(*(x[:k] for x in held))) is not None:
                    yield out
                held = [x[k:] for x in held]
        if held is not None and len(held[0]) and (out := close(*held)) is not None:
            yield out

    return dealt.mapInArrow(run, "u long, v long")


def links(vertices: DataFrame, radius: int = RADIUS, most: int = MOST, close_pairs: bool = False) -> DataFrame:
    """Links (u, v) of ids that join all of (print, id) within the radius, through the covering tables.

    ``close_pairs``: each link is itself within the radius; else links may go to the first of a group.
    """

    def dealt(rows: DataFrame, seed: int, *upper: str) -> DataFrame:
        tables = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks(radius, seed))))
        dealt_out = rows.select("print", "id", *upper, F.explode(tables).alias("x"))
        return dealt_out.select("print", "id", F.xxhash64(*upper, "x.t", F.col("print").bitwiseAND(F.col("x.m"))).alias("bucket"))

    out, rows, seed = None, dealt(vertices, 1), 1
    while True:
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most)
        large = materialise(sizes.select("bucket"), "large-buckets") if seed < FAMILIES else None
        if large is None or not large.limit(1).count():
            done = _links(rows, radius, close_pairs)
            return done if out is None else out.unionByName(done)
        done = _links(rows.join(large, "bucket", "left_anti"), radius, close_pairs)
        out = done if out is None else out.unionByName(done)
        seed += 1
        rows = dealt(rows.join(large, "bucket", "left_semi"), seed, "bucket")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, print and component_id of every row."""
    prints = fingerprints(docs, shingle)
    vertices = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("id")), "vertices")
    joined = connected_components(links(vertices.where(F.col("id").isNotNull()), radius))
    classes = vertices.join(joined, "id", "left").select("print", F.coalesce("component", "id").alias("component_id"))
    return prints.join(classes, "print").select("doc_id", "print", "component_id")


# ---------------------------------------------------------------- near copies by whole sets of shingles

COPY_SHINGLE = 5
#: Common shingles come last in the order of shingles: one row of SAMPLED is counted, HOT times make one common.
#: They only set the order in which shingles are looked up; no pair depends on them.
SAMPLED, HOT, MOST_HOT = 8, 6, 100_000
#: Members of a bucket that may meet all others of it, how often larger buckets are dealt again, and how many of them are asked what most have.
ALL_MEET, LEVELS, MAJORITY = 32, 8, 15
#: 64-bit parts of a set's parities: sets differ in as many elements as their parities in bits, or in more.
PARITIES = 16


class _Words(dict):
    """Hashes of words, each made once while it is remembered."""

    MOST = 1 << 16

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxh64_intdigest(word, SEED)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: bytes, memory: _Words, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """64-bit hashes of all shingles, repeats included; a shorter text is one shingle."""
    words = text.lower().split()
    h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(h))
    out = np.full(len(h) - k + 1 if k else 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out) + h[i : len(h) - k + 1 + i]
    return _mixed(out)


def shingle_set(text: bytes, memory: _Words, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(text, memory, shingle)).view(np.int64)


def _signature(own: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    sig = xxh3_64_intdigest(own.tobytes())
    return sig - (1 << 64) if sig >> 63 else sig


def _parities(own: np.ndarray) -> list[int]:
    bits = np.bincount((own.view(np.uint64) % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) % 2
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _prefix(n: int) -> int:
    """Sets that share 0.8 of their union share one of the first so many, in any order common to all sets."""
    return n - -(-4 * n // 5) + 1


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample, sorted, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Words()
        for b in batches:
            sets = [shingle_set(t, memory) for t in text_bytes(b.column("text"))]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["token"])

    some = rows.where(F.pmod(F.xxhash64("__block", "__row"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "token long")
    often = some.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "token").limit(MOST_HOT)
    got = sorted((r["token"], r["n"]) for r in often.collect())
    return np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64)


def _often(tokens: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often the sample has each shingle; zero if it is not common."""
    common, counts = order
    if not len(common):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    return np.where(common[at] == tokens, counts[at], 0)


SKETCH = "block long, row long, doc_id long, sig long, n int, rare int, print long, parities array<long>, firsts array<long>"


def _sketches(rows: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of each row: the signature of its set of shingles, the set's size, how many are not common, fingerprint, parities, rarest shingles."""
    names = [f.split()[0] for f in SKETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Words()
        for b in batches:
            if not b.num_rows:
                continue
            sigs, sizes, rare, prints, parities, firsts = [], [], [], [], [], []
            for t in text_bytes(b.column("text")):
                own = shingle_set(t, memory)
                often = _often(own, order)
                sigs.append(_signature(own))
                sizes.append(len(own))
                rare.append(np.count_nonzero(often == 0))
                prints.append(majority(own.view(np.uint64)))
                parities.append(_parities(own))
                firsts.append(own[np.lexsort((own, often))[: _prefix(len(own))]])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (parities, firsts)]
            numbers = [pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("__block"), b.column("__row"), b.column("doc_id"), *numbers, *lists], names=names)

    return materialise(rows.select("__block", "__row", "doc_id", "text").mapInArrow(run, SKETCH), "sketches")


def _similar(rows: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of signatures whose whole sets have a Jaccard similarity of 0.8 or more.

    ``texts`` has one row for each signature: where a text of it stands, and its parities.
    """
    with scratch_scope(rows.sparkSession):
        return _verified(rows, texts, pairs)


def _verified(rows: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    left, right = (texts.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("parities").alias(f"p{k}")) for k in "ab")
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # at 0.8 the sets differ in a ninth of their sizes at most
    likely = pairs.distinct().join(left, "a").join(right, "b").where(9 * apart <= F.col("na") + F.col("nb"))
    pairs = materialise(likely.select("a", "b"), "pairs")
    sets = _sets(rows, texts, pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("sig").alias("b"), F.col("own").alias("y")), "b")
    # i / (x + y - i) >= 4 / 5
    enough = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    return materialise(both.where(enough).select(F.col("a").alias("u"), F.col("b").alias("v")), "similar", hand_on=True)


def _sets(rows: DataFrame, texts: DataFrame, sigs: DataFrame) -> DataFrame:
    """The whole set of each signature in ``sigs``."""
    path = leave(texts.select("sig", "block", "row").join(sigs, "sig", "left_semi").select("block", "row", "sig"), "needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, memory = Findings(path), _Words()
        for b in batches:
            sigs, sets = [], []
            for k, (block, row) in enumerate(zip(b.column("__block").to_pylist(), b.column("__row").to_pylist())):
                if (mine := found.of(block, row)) is not None:
                    sigs += mine.column("sig").to_pylist()
                    sets.append(shingle_set((b.column("text")[k].as_py() or "").encode(), memory))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "own"])

    return materialise(rows.select("__block", "__row", "text").mapInArrow(run, "sig long, own array<long>"), "sets")


def _sized(n: Column, m: Column) -> Column:
    """Sets of such sizes can share 0.8 of their union."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _paired(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _sized_buckets(members: DataFrame) -> DataFrame:
    """Buckets dealt by size: sets that can share 0.8 of their union are in one class or in neighbours, and meet in the higher."""
    size = F.floor(F.log("n") / math.log(1.26))
    return members.withColumn("bucket", F.explode(F.array(F.xxhash64("bucket", size), F.xxhash64("bucket", size + 1))))


def _differences(rows: DataFrame, texts: DataFrame, members: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Links, and buckets in which all further links meet, from how members differ from what most of them have.

    Buckets that choose the same member are one. Let c be the shingles that over half of a sample have, D(x) what x
    has and c lacks, or lacks and c has, s(x) the size of x less nine times that of D(x). Sets x and y share 0.8 of
    their union if D(x) and D(y) differ in a ninth of both sizes at most, so if s(x) + s(y) >= 0, or if they have
    -(s(x) + s(y)) / 18 elements in common. The former are linked to the member with the highest s. Any others need
    a common element, which is among the first of each in any order; no more than about half of all can have it.
    """
    spark = rows.sparkSession
    with scratch_scope(spark):
        chosen = materialise(members.groupBy("bucket").agg(F.min(F.struct("rare", "sig")).alias("x")).select("bucket", F.col("x.sig").alias("c")), "chosen")
        stars = materialise(members.select("bucket", "sig", "rare").join(chosen, "bucket").select("sig", "rare", "c").distinct(), "stars")
        sets = _sets(rows, texts, stars.select("sig").distinct())
        some = stars.groupBy("c", F.pmod(F.xxhash64("sig"), F.lit(MAJORITY)).alias("k")).agg(F.min("sig").alias("sig"))
        held = some.withColumn("asked", F.count("*").over(Window.partitionBy("c"))).join(sets, "sig").select("c", "asked", F.explode("own").alias("token"))
        most = held.groupBy("c", "token").agg(F.count("*").alias("have"), F.max("asked").alias("asked")).where("2 * have > asked")
        most = materialise(most.groupBy("c").agg(F.collect_list("token").alias("most")), "majorities")
        both = stars.join(sets, "sig").join(most, "c", "left").select("sig", "rare", "c", "own", F.coalesce("most", F.array().cast("array<long>")).alias("most"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes, tokens = [], []
                for own, most in zip(b.column("own"), b.column("most")):
                    own, most = own.values.to_numpy(), most.values.to_numpy()
                    more, less = np.setdiff1d(own, most, assume_unique=True), np.setdiff1d(most, own, assume_unique=True)
                    # rare ones first; a rare one of the majority is what most of the other texts lack
                    tokens.append(np.append(more[np.lexsort((more, _often(more, order)))], less[np.lexsort((less, -_often(less, order)))]))
                    sizes.append(len(own))
                if sizes:
                    made = [pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([b.column("sig"), b.column("rare"), b.column("c"), *made], names=["sig", "rare", "c", "n", "tokens"])

        apart = materialise(both.mapInArrow(run, "sig long, rare int, c long, n int, tokens array<long>"), "differences", hand_on=True)
    apart = apart.withColumn("d", F.size("tokens")).withColumn("slack", F.col("n") - 9 * F.col("d"))
    best = apart.groupBy("c").agg(F.max(F.struct("slack", "sig")).alias("x")).select("c", F.col("x.slack").alias("top"), F.col("x.sig").alias("best"))
    apart = apart.join(best, "c").withColumn("linked", F.expr("slack + top >= 0"))
    links = apart.where("linked AND sig != best").select(F.col("sig").alias("u"), F.col("best").alias("v"))
    # the core is for sets that are not linked; these are looked up by more, for those that are
    core, whole = F.expr("d + floor((slack + least(top, -top - 1)) / 18) + 1"), F.expr("d + floor((slack + top) / 18) + 1")
    apart = apart.withColumn("near", core).withColumn("far", F.greatest(F.when(F.col("linked"), core).otherwise(whole), F.lit(0)).cast("int"))
    dealt = apart.select("sig", "n", "rare", "c", "d", "slack", "near", F.posexplode(F.slice("tokens", F.lit(1), F.col("far"))).alias("at", "token"))
    return links, dealt.select(F.xxhash64("c", "token").alias("bucket"), "sig", "n", "rare", (F.col("d") - F.col("at")).alias("room"), "slack", (F.col("at") < F.col("near")).alias("core"))


def _met(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in a bucket, of which one is of its core; ``room`` and ``slack`` let them reach 0.8."""
    y = members.select("bucket", *(F.col(c).alias(f"{c}_") for c in ("sig", "n", "room", "slack", "core", "part")))
    once = F.expr("part != part_ AND (sig < sig_ OR NOT core_)") & _sized(F.col("n"), F.col("n_"))
    enough = 18 * F.least("room", "room_") + F.col("slack") + F.col("slack_") >= 0
    return members.where("core").join(y, "bucket").where(once & enough).select(*_paired(F.col("sig"), F.col("sig_"))).distinct()


def _remaining(rows: DataFrame, texts: DataFrame, members: DataFrame, joined: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Pairs that may be similar and are not in one component, and the components (sig, component) with all links found here.

    A member meets at most ``ALL_MEET`` others of a bucket. Larger buckets are dealt by size, and then by differences
    from what most have, until all pairs in them are no more than there are texts; what is still large after
    ``LEVELS`` times meets all the same.
    """
    pairs, level, few = None, 0, texts.count()
    while True:
        parts = materialise(members.join(joined, "sig", "left").withColumn("part", F.coalesce("component", "sig")).drop("component"), "parts")
        of = parts.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("members"), F.sum(F.col("core").cast("int")).alias("cores"))
        mixed = materialise(of.where("low != high AND cores > 0").select("bucket", "members", "cores"), "mixed")
        ahead = mixed.where(F.col("cores") > ALL_MEET).agg(F.sum(F.expr("double(cores) * members"))).first()[0] or 0
        again = ahead > few and level <= LEVELS
        met = parts.join(mixed.where(F.col("cores") <= ALL_MEET) if again else mixed, "bucket", "left_semi")
        met = materialise(_met(met), "rest")
        pairs = met if pairs is None else pairs.unionByName(met)
        if not again:
            return pairs, joined
        large = parts.join(mixed.where(F.col("cores") > ALL_MEET), "bucket", "left_semi").drop("part")
        if level:
            links, members = _differences(rows, texts, large, order)
            known = joined.select(F.col("sig").alias("u"), F.col("component").alias("v"))
            joined = connected_components(known.unionByName(links)).withColumnRenamed("id", "sig")
        else:
            members = _sized_buckets(large)
        level += 1


def _copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (sig, part, block, row, doc_id): the component of each signature and its first row.

    Texts are sets of shingles (64-bit hashes). Fingerprints over these sets go through the covering tables; their
    close pairs are candidates. For the others: in an order of all shingles, rare ones first, two sets that share
    0.8 of their union share one of their first fifth, so these are buckets from which no pair is lost. A bucket
    first holds its members against one of them; then only members that are not in one component yet meet, and
    where they are many, only those with a common difference from most others (see ``_differences``).
    Sizes, places in the order and parities leave out pairs that can't reach 0.8; whole sets decide each link.
    """
    spark = rows.sparkSession
    small_batches(spark)
    with scratch_scope(spark):
        order = _common(rows)
        wide = _sketches(rows, order)
        first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "block", "row", "n", "rare", "print", "parities", "firsts")).alias("x")
        texts = materialise(wide.groupBy("sig").agg(first).select("sig", "x.doc_id", "x.block", "x.row", "x.n", "x.rare", "x.print", "x.parities", "x.firsts"), "texts-once", hand_on=True)
        sketches = materialise(wide.select("block", "row", "doc_id", "sig"), "signatures", hand_on=True)

    # the covering tables
    prints = materialise(texts.groupBy("print").agg(F.min("sig").alias("id")), "vertices")
    with scratch_scope(spark):
        tables = materialise(links(prints, RADIUS, close_pairs=True).select(*_paired(F.col("u"), F.col("v"))).distinct(), "table-pairs", hand_on=True)
    equal = texts.select("sig", "print").join(prints, "print").where("sig != id").select(*_paired(F.col("sig"), F.col("id")))

    # the rarest shingles
    dealt = texts.select("sig", "n", "rare", F.posexplode("firsts").alias("at", "token"))
    centre = F.min(F.struct(F.xxhash64(F.pmod("token", F.lit(2)), "sig"), F.col("sig").alias("a"), F.col("n").alias("m"))).alias("c")  # few different centres for one text
    buckets = dealt.groupBy("token").agg(F.count("*").alias("members"), centre).where("members > 1").select("token", F.col("c.a").alias("a"), F.col("c.m").alias("m"))
    shared = materialise(dealt.join(buckets, "token"), "shared")
    stars = shared.where((F.col("sig") != F.col("a")) & _sized(F.col("n"), F.col("m"))).select(*_paired(F.col("sig"), F.col("a")))
    near = _similar(rows, texts, materialise(tables.unionByName(equal).unionByName(stars).distinct(), "candidates"))

    joined = connected_components(near).withColumnRenamed("id", "sig")
    # a difference from the empty set is the set itself
    members = shared.select(F.col("token").alias("bucket"), "sig", "n", "rare", (F.col("n") - F.col("at")).alias("room"), (-8 * F.col("n")).alias("slack"), F.lit(True).alias("core"))
    rest, joined = _remaining(rows, texts, members, joined, order)
    rest = materialise(rest.distinct(), "rest")
    if rest.limit(1).count():
        more = _similar(rows, texts, rest)
        if more.limit(1).count():
            known = joined.select(F.col("sig").alias("u"), F.col("component").alias("v"))
            joined = connected_components(known.unionByName(more)).withColumnRenamed("id", "sig")
    classes = texts.select("sig", "doc_id", "block", "row").join(joined, "sig", "left")
    return sketches, classes.select("sig", F.coalesce("component", "sig").alias("part"), "doc_id", "block", "row")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of each row; links are all pairs that share 0.8 of their five-word shingles.

    Texts without words are copies of each other. Rows of equal texts are one vertex, whatever their ids.
    """
    rows = named(scanned(docs))
    with scratch_scope(docs.sparkSession):
        sketches, classes = _copies(rows)
        least = classes.groupBy("part").agg(F.min("doc_id").alias("component_id"))
        of = classes.join(least, "part").select("sig", "component_id")
        return materialise(sketches.select("doc_id", "sig").join(of, "sig").select("doc_id", "component_id"), "copies", hand_on=True)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, one row of each group of near copies: that of the smallest id.

    Rows are told apart by their place in the input, not by id: of repeated rows one stays, rows without an id
    count after all others, and a row never goes for sharing its id with a copy. Texts without words are one group.
    """
    rows = named(scanned(docs))
    with scratch_scope(docs.sparkSession):
        sketches, classes = _copies(rows)
        kept = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "block", "row")).alias("x")
        stays = classes.groupBy("part").agg(kept).select("x.block", "x.row")
        gone = sketches.select("block", "row").join(stays, ["block", "row"], "left_anti")
        path = handed_on(leave(gone, "copies"))
    return without(docs, rows, path)
