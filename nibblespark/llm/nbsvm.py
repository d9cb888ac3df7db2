"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios.

Each text becomes the set of its hashed byte n-grams, and the share of its repeated word pairs. A feature's scale is the log ratio of
its share among good and among bad labelled texts; the weights are fitted by dual coordinate descent, and
a logistic curve turns the margin into a score. The fit uses a bounded sample of labelled rows
(``SAMPLE_ROWS``) outside the held-out fold; every row is scored over its whole text.

Null and empty texts have no n-grams and get the score of the bias. Null ids stay null and count as not
held out. Repeated rows score alike. Without labels of both classes every score is 0.5. Extra columns are
ignored; only the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import give_back, held_out, small_batches, text_bytes

#: Labelled rows that the fit may use, in the order of a hash of their ids.
SAMPLE_ROWS = 4_000
BITS = 18
EPOCHS, COST, SEED = 12, 1.0, 5
THRESHOLD = 0.7

GRAMS = 1 << BITS
SIZE = GRAMS + 121
_SEEN = np.zeros(GRAMS, bool)


def features(text: bytes) -> np.ndarray:
    """Distinct hashes of the byte 2-, 3- and 4-grams, then one id for the share of repeated word pairs."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    parts = []
    code = b
    for n in (2, 3, 4):
        if len(b) >= n:
            code = code[:-1] * np.uint32(257) + b[n - 1 :]
            parts.append(code * np.uint32(2654435761) + np.uint32(n * 97))
    words = text.split()
    pairs = max(len(words) - 1, 0)
    share = (pairs - len(set(zip(words, words[1:])))) / max(pairs, 1)
    shape = GRAMS + int(10 * share) + 11 * int(10 * sum(map(bytes.__eq__, words, words[1:])) / max(pairs, 1))
    if not parts:
        return np.array([shape])
    ids = np.concatenate(parts) >> np.uint32(32 - BITS)
    _SEEN[ids] = True  # a table of flags is quicker than a sort
    ids = np.flatnonzero(_SEEN)
    _SEEN[ids] = False
    return np.append(ids, shape)


def lengths(ids: np.ndarray) -> np.ndarray:
    """The n-grams share one unit of length; the pair share has its own."""
    out = np.full(len(ids), 1 / np.sqrt(max(len(ids) - 1, 1)))
    out[-1] = 1.0
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, ids: np.ndarray) -> float:
        return float((self.weights[ids[:-1]].sum() / np.sqrt(max(len(ids) - 1, 1))) + self.weights[ids[-1]] + self.bias)

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.shift, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> Model:
    """Log-count ratios, dual coordinate descent of the L2-loss hinge model, then a logistic curve."""
    size = SIZE
    y = np.where(labels == 1, 1.0, -1.0)
    if not len(y) or (y == y[0]).all():
        return Model(np.zeros(size), 0.0)
    counts = {s: np.ones(size) for s in (1.0, -1.0)}
    for ids, s in zip(rows, y):
        counts[s][ids] += 1
    ratio = np.log((counts[1.0] / ((y > 0).sum() + 2)) / (counts[-1.0] / ((y < 0).sum() + 2)))
    part = {s: len(y) / 2 / max((y == s).sum(), 1) for s in (1.0, -1.0)}  # both classes weigh the same
    x = [ratio[ids] * lengths(ids) for ids in rows]
    diag = np.array([1 / (2 * cost * part[s]) for s in y])
    curve = np.array([v @ v + 1 for v in x]) + diag
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ x[i] + bias) - 1 + diag[i] * alpha[i]
            step = max(alpha[i] - g / curve[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * x[i]
                bias += step * y[i]
    model = Model(w * ratio, bias)
    m = np.array([model.margin(ids) for ids in rows])
    a, c = 1.0, 0.0
    t = np.where(y > 0, 1 - 1 / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    for _ in range(100):  # Newton steps of a two-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
        q = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(m * (p - t)).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, c = a - np.clip(move[0], -1, 1), c - np.clip(move[1], -1, 1)
    model.slope, model.shift = float(max(a, 1e-3)), float(c)
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows; the driver receives their hashed n-grams only."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", "quality").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # sample_rows rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sets = [features(t).astype(np.int32) for t in text_bytes(b.column("text"))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int32()), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "quality", "ids"])

    small_batches(docs.sparkSession)
    got = chosen.mapInArrow(run, "doc_id long, quality int, ids array<int>").toArrow().sort_by("doc_id")
    lists = got.column("ids").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    model = fit(np.split(flat, ends[:-1]) if len(ends) else [], got.column("quality").to_numpy())
    del got, lists, flat
    give_back()
    return model


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every document, with its score, which takes the place of a column of that name."""
    small_batches(docs.sparkSession)
    keep = [c for c in keep if c.lower() != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = [shared.value.score(features(t)) for t in text_bytes(b.column("text"))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s, pa.float64())], names=[*keep, "score"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*fields, "score double"]))
