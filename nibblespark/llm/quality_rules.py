"""Quality rules with an isolation forest over their statistics.

Every whole text gives a row of rule statistics. Fixed rules reject a document outright; the others are
judged by an isolation forest: trees of random splits, in which an odd row ends after few splits. The
forest grows on labelled good rows. Its threshold is calibrated on rows that a forest hasn't seen: labelled bad
rows, and good rows by two forests that grew on the other half of them. It lies where the share of good rows
beyond it and of bad rows below add up to the least; without bad rows it keeps ``KEEP_GOOD`` of the good ones.
Both use all labels outside the held-out fold, however many: the reach of the features is taken, and the threshold
laid, over all of these rows. Each tree grows on ``SUBSAMPLE`` rows drawn from all good ones, as the method
has it; these rows are all that the driver gets.

Null text: no words, so the fixed rules reject it. Empty text: the same. Null ids stay null. Repeated rows
are judged alike. Without any labelled rows (or an empty labels table) only the fixed rules decide. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import held_out, materialise, small_batches, text_bytes

#: Good rows below which there is no forest.
LEAST_GOOD = 32
TREES, SUBSAMPLE, SEED = 128, 512, 11
#: Share of the labelled good rows that the threshold keeps where no bad rows are known.
KEEP_GOOD = 0.999
#: Reach of the random splits, where 0 to 1 is the usual range of a feature.
CELL = (-1.0, 4.0)
#: Shares of the good rows below the usual range of a feature, and below its end.
REACH = (0.005, 0.995)
#: Ranges of scores, and of hashed ids, that tasks order by themselves.
SCORE_CELLS, HASH_BITS = 1 << 14, 12

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = ("mean_chars", "symbols", "dup_lines", "repeats", "upper", "bangs", "stutters")
SCHEMA = f"doc_id long, {BASE}, " + ", ".join(f"f_{x} double" for x in FEATURES)

_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def statistics(text: bytes) -> tuple:
    """Counts of one text: the base columns, then the features of the forest."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 5 - max(end, i)
                    end = i + 5
    size, w, m = max(len(joined), 1), max(n, 1), max(lines, 1)
    rate = lambda chars: (len(joined) - len(joined.translate(None, chars))) / size
    stutters = sum(map(bytes.__eq__, words, words[1:])) / w
    return (n, chars, symbols, dup, repeated, chars / w, rate(_SYMBOLS), dup / m, repeated / w, rate(_UPPER), rate(b"!?"), stutters)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """One row of statistics per document, in one narrow pass over the whole texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", ")[1:])]
        for b in batches:
            rows = [statistics(t) for t in text_bytes(b.column("text"))]
            columns = [b.column("doc_id"), *(pa.array(c, pa.int64() if i < 5 else pa.float64()) for i, c in enumerate(zip(*rows)))]
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


class IsolationForest:
    """Trees of random splits, kept as flat arrays of feature, split value and children."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        self._grow_all(*np.quantile(rows, REACH, axis=0), [rows[x] for x in picks(len(rows), trees, subsample, seed)], seed)

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray, parts: list[np.ndarray], seed: int = SEED) -> IsolationForest:
        """A forest by the usual range of each feature and the rows of each tree."""
        forest = cls.__new__(cls)
        forest._grow_all(low, high, parts, seed)
        return forest

    def _grow_all(self, low: np.ndarray, high: np.ndarray, parts: list[np.ndarray], seed: int) -> None:
        self.low, self.high = low, np.where(high > low, high, low + 1e-3)
        self.size = len(parts[0])
        self.depth = int(np.ceil(np.log2(max(self.size, 2)))) + 2
        self.trees = [self._grow(self._scale(rows), np.random.default_rng([seed, 1, t])) for t, rows in enumerate(parts)]

    def _scale(self, rows: np.ndarray) -> np.ndarray:
        """The usual range of a feature becomes 0..1; what lies far outside is drawn in to the edge of the cell."""
        return np.clip((rows - self.low) / (self.high - self.low), *CELL)

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, value, left, right, length = [], [], [], [], []

        def node(part: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
            me = len(feature)
            for column, x in ((feature, -1), (value, 0.0), (left, 0), (right, 0), (length, 0.0)):
                column.append(x)
            if depth >= self.depth or len(part) <= 1:
                length[me] = depth + usual_path(len(part))
                return me
            # splits are drawn from the cell, which reaches past the rows: far values part from them early
            f = int(rng.integers(part.shape[1]))
            v = float(rng.uniform(lo[f], hi[f]))
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = v
            feature[me], value[me] = f, v
            left[me] = node(part[part[:, f] < v], lo, below, depth + 1)
            right[me] = node(part[part[:, f] >= v], above, hi, depth + 1)
            return me

        k = rows.shape[1]
        node(rows, np.full(k, CELL[0]), np.full(k, CELL[1]), 0)
        return np.array(feature), np.array(value), np.array(left), np.array(right), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the minus mean path over the usual path."""
        rows = self._scale(rows)
        total, at_row = np.zeros(len(rows)), np.arange(len(rows))
        for feature, value, left, right, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, np.where(rows[at_row, f] < value[at], left[at], right[at]), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(usual_path(self.size), 1e-9))


def picks(n: int, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> list[np.ndarray]:
    """Of n rows, the numbers of those that each tree grows on."""
    return [np.random.default_rng([seed, 0, t]).choice(n, min(subsample, n), replace=False) for t in range(trees)]


def usual_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def fit_forest(sample: np.ndarray, quality: np.ndarray) -> tuple[IsolationForest, float] | None:
    """A forest of the good rows, and the score above which a row is odd; of arrays, what ``fit_table`` does to a table."""
    good, bad = sample[quality == 1], sample[quality == 0]
    if len(good) < LEAST_GOOD:
        return None
    forest = IsolationForest(good)
    unseen = np.concatenate([IsolationForest(good[1::2]).score(good[::2]), IsolationForest(good[::2]).score(good[1::2])])
    if not len(bad):
        return forest, float(np.quantile(unseen, KEEP_GOOD)) + 1e-9
    return forest, calibrated(unseen, forest.score(bad))


def calibrated(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the widest gap between scores in which the shares of good rows above and bad rows below add up to the least."""
    scores = np.unique(np.concatenate([good, bad, [0.0, 1.0]]))
    edges = (scores[:-1] + scores[1:]) / 2
    wrong = (len(good) - np.searchsorted(np.sort(good), edges)) / len(good) + np.searchsorted(np.sort(bad), edges) / len(bad)
    least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(edges[least[np.argmax(np.diff(scores)[least])]])


def _ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with their ranks from 0 by a hash of doc_id, in two levels, and how many they are."""
    hashed = rows.withColumn("__hash", F.xxhash64("doc_id")).withColumn("__cell", F.shiftright("__hash", 64 - HASH_BITS))
    cells = hashed.groupBy("__cell").agg(F.count("*").alias("n")).orderBy("__cell").toArrow()  # 2**HASH_BITS at most
    counts = cells.column("n").to_numpy()
    before = pa.table({"__cell": cells.column("__cell"), "__before": np.cumsum(counts) - counts})
    place = F.row_number().over(Window.partitionBy("__cell").orderBy("__hash", "doc_id"))
    ranked = hashed.withColumn("__place", place).join(F.broadcast(rows.sparkSession.createDataFrame(before)), "__cell")
    return ranked.withColumn("rank", F.col("__before") + F.col("__place") - 1).drop("__hash", "__cell", "__before", "__place"), int(counts.sum())


def _reaches(good: DataFrame, names: list[str], sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The exact quantiles ``REACH`` of each feature over the rows of even rank, of odd rank, and all.

    Approximate ones bound a narrow range around each; what lies below it is counted, and only what is inside is
    ordered. Should a bound be too narrow after all, everything is ordered.
    """
    spark = good.sparkSession
    places = [[q * (n - 1) for q in REACH] for n in sizes]
    wanted = {(part, f, k, min(int(v) + up, sizes[part] - 1)) for part, vs in enumerate(places) for k, v in enumerate(vs) for f in range(len(names)) for up in (0, 1)}
    asked = spark.createDataFrame(pa.table(dict(zip(("part", "feature", "k", "at"), map(list, zip(*sorted(wanted)))))))
    every = good.select(F.explode(F.array((F.col("rank") % 2).cast("long"), F.lit(2).cast("long"))).alias("part"), F.array(*names).alias("xs"))
    every = every.select("part", F.posexplode("xs").alias("feature", "x")).withColumn("feature", F.col("feature").cast("long"))
    near = [min(max(q + way * 3e-4, 0.0), 1.0) for q in REACH for way in (-1, 1)]
    for bounds in (F.percentile_approx("x", near, 10_000), F.array(*[F.min("x"), F.max("x")] * len(REACH))):
        marks = every.groupBy("part", "feature").agg(bounds.alias("m"))
        marked = every.join(F.broadcast(marks), ["part", "feature"])  # a row for each part and feature
        ranges = marked.select("part", "feature", "x", F.posexplode(F.array(*(F.struct(F.get("m", F.lit(2 * k)).alias("lo"), F.get("m", F.lit(2 * k + 1)).alias("hi")) for k in range(len(REACH))))).alias("k", "r"))
        ranges = ranges.where("x <= r.hi").withColumn("x", F.when(F.col("x") >= F.col("r.lo"), F.col("x")))  # what lies below is a null, and first
        counted = ranges.groupBy("part", "feature", F.col("k").cast("long").alias("k"), "x").agg(F.count("*").alias("n"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("part", "feature", "k").orderBy(F.asc_nulls_first("x"))))
        hit = upto.join(F.broadcast(asked), ["part", "feature", "k"]).where("x IS NOT NULL AND at < upto AND at >= upto - n")
        found = {(r["part"], r["feature"], r["k"], r["at"]): r["x"] for r in hit.select("part", "feature", "k", "at", "x").collect()}  # as many as were asked for
        if found.keys() == wanted:
            break
    out = []
    for part, vs in enumerate(places):
        pair = lambda f, k: [found[part, f, k, min(int(vs[k]) + up, sizes[part] - 1)] for up in (0, 1)]  # noqa: B023, E731
        out.append(tuple(np.array([np.quantile(pair(f, k), v - int(v)) for f in range(len(names))]) for k, v in enumerate(vs)))
    return out


def fit_table(known: DataFrame, names: list[str]) -> tuple[IsolationForest, float] | None:
    """Forest and threshold of all rows of ``known`` (doc_id, quality, features); the driver gets the rows of the trees only."""
    spark = known.sparkSession
    good, n = _ranked(known.where("quality = 1").select("doc_id", *names))
    if n < LEAST_GOOD:
        return None
    good = materialise(good.select("rank", *names), "good")
    sizes = [n - n // 2, n // 2, n]
    chosen = [[2 * x for x in picks(sizes[0])], [2 * x + 1 for x in picks(sizes[1])], picks(n)]
    ranks = np.unique(np.concatenate([np.concatenate(c) for c in chosen]))  # 3 * TREES * SUBSAMPLE at most
    rows = good.join(F.broadcast(spark.createDataFrame(pa.table({"rank": ranks}))), "rank").toArrow().sort_by("rank")
    values = np.column_stack([rows.column(x).to_numpy() for x in names])
    even, odd, forest = (IsolationForest.of(*reach, [values[np.searchsorted(ranks, x)] for x in c]) for reach, c in zip(_reaches(good, names, sizes), chosen))
    judges = [odd, even, forest]  # for good rows of even and odd rank, and for bad rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, part = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names]), b.column("part").to_numpy()
            score = np.zeros(len(x))
            for k in np.unique(part):
                score[part == k] = judges[k].score(x[part == k])
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array((part < 2).astype(np.int64)), pa.array((part == 2).astype(np.int64))], names=["score", "good", "bad"])

    parts = good.select((F.col("rank") % 2).cast("int").alias("part"), *names).unionByName(known.where("quality = 0").select(F.lit(2).alias("part"), *names))
    return forest, threshold(materialise(parts.mapInArrow(run, "score double, good long, bad long"), "scores"))


def threshold(scores: DataFrame) -> float:
    """``calibrated``, or the quantile ``KEEP_GOOD`` without bad rows, of a table (score, good, bad) of ones and zeros."""
    spark = scores.sparkSession
    celled = scores.groupBy((F.col("score") * SCORE_CELLS).cast("long").alias("cell"), "score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    cells = celled.groupBy("cell").agg(F.min("score").alias("low"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).orderBy("cell").toArrow()  # SCORE_CELLS at most
    good, bad, low = (cells.column(c).to_numpy() for c in ("good", "bad", "low"))
    n_good, n_bad = int(good.sum()), int(bad.sum())
    starts = pa.table({"cell": cells.column("cell"), "good_before": np.cumsum(good) - good, "bad_before": np.cumsum(bad) - bad, "after": np.append(low[1:], 1.0)})
    inside = Window.partitionBy("cell").orderBy("score")
    upto = lambda c: F.col(f"{c}_before") + F.sum(c).over(inside)
    placed = celled.join(F.broadcast(spark.createDataFrame(starts)), "cell")
    steps = materialise(placed.select("score", F.coalesce(F.lead("score").over(inside), "after").alias("next"), "good", upto("good").alias("n_good"), upto("bad").alias("n_bad")), "steps")
    if not n_bad:
        v = KEEP_GOOD * (n_good - 1)
        ranks = [int(v), min(int(v) + 1, n_good - 1)]
        pair = [steps.where(F.col("n_good") > k).agg(F.min("score")).first()[0] for k in ranks]
        return float(np.quantile(pair, v - int(v))) + 1e-9
    # the edge below all scores has all good rows beyond
    first = spark.createDataFrame(pa.table({"score": [0.0], "next": [float(low[0])], "n_good": [0], "n_bad": [0]}))
    wrong = ((F.lit(n_good) - F.col("n_good")) / F.lit(n_good) + F.col("n_bad") / F.lit(n_bad)).alias("wrong")
    edges = steps.select("score", "next", "n_good", "n_bad").unionByName(first).select("score", "next", wrong)
    least = edges.agg(F.min("wrong")).first()[0]
    best = edges.where(F.col("wrong") <= least + 1e-12).orderBy(F.desc(F.col("next") - F.col("score")), "score").first()
    return (best["score"] + best["next"]) / 2


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly (null without labels) and kept."""
    stats = materialise(rule_statistics(docs), "rules")
    names = [f"f_{x}" for x in FEATURES]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = F.min(F.struct("n_words", *names)).alias("x")  # of rows that share an id, one
    known = stats.where(~failed).join(known, "doc_id").groupBy("doc_id", "quality").agg(one)
    fitted = fit_table(materialise(known.select("doc_id", "quality", "x.*"), "known"), names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.column_stack([b.column(x).to_numpy(zero_copy_only=False) for x in names])
            odd = fitted[0].score(rows) if fitted else np.zeros(len(rows))
            n, rep = (b.column(x).to_numpy(zero_copy_only=False) for x in ("n_words", "n_repeat_words"))
            bad = (n < 10) | (100 * rep > 20 * n)
            kept = ~bad & (odd <= (fitted[1] if fitted else 1.0))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(bad), pa.array(kept), pa.array(odd)], names=[*b.schema.names[:6], "base_failed", "kept", "anomaly"])

    return stats.mapInArrow(judge, f"doc_id long, {BASE}, base_failed boolean, kept boolean, anomaly double")
