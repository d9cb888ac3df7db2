"""Connected components of a table of links.

First each task joins the links that it holds, some hundred thousand at once, and gives a star around the
smallest id for each group: long chains and dense groups become short and thin without a shuffle more. Then
rounds of labels: each vertex starts with the smallest of its neighbours; a round hands the smaller label over
each link to both ends and to the ends' labels, and follows labels one step. Chains halve, so rounds grow with
the logarithm of the longest chain. Smallest labels are taken by partial aggregation, so a vertex or a label
that a third of all links name is one row a task. A round is written to the shared folder once; the driver gets
one count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: Links that a task joins at once.
LINKS = 1 << 19


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id that the links join with a smaller one, and the smallest id of its group."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]


def _thinned(links: DataFrame) -> DataFrame:
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def close() -> pa.RecordBatch:
            u, v = stars(*map(np.concatenate, zip(*held)))
            return pa.RecordBatch.from_pydict({"u": u, "v": v})

        for b in batches:
            held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
            n += b.num_rows
            if n >= LINKS:
                yield close()
                held, n = [], 0
        if n:
            yield close()

    return links.select("u", "v").repartition(parts, "u").mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for each vertex of ``links`` (u, v); component is the smallest id that it reaches.

    Links from an id to itself are ignored. No links: no rows.
    """
    edges = materialise(_thinned(links.where("u IS NOT NULL AND v IS NOT NULL AND u != v")), "links")
    ends = lambda *names: F.explode(F.array(*(F.struct(F.col(x).alias("id"), F.least("u", "v").alias("label")) for x in names)))
    labels = materialise(edges.select(ends("u", "v").alias("x")).groupBy("x.id").agg(F.min("x.label").alias("label")), "labels")
    while True:
        of = lambda end, name: labels.select(F.col("id").alias(end), F.col("label").alias(name))  # noqa: E731, B023
        seen = edges.join(of("u", "lu"), "u").join(of("v", "lv"), "v").where("lu != lv")
        low = F.least("lu", "lv")
        told = F.explode(F.array(*(F.struct(F.col(x).alias("id"), low.alias("label")) for x in ("u", "v", "lu", "lv"))))
        moved = seen.select(told.alias("x")).select("x.id", "x.label", F.lit(None).cast("long").alias("old"))
        step = labels.join(of("label", "next"), "label").select("id", F.col("next").alias("label"), F.col("label").alias("old"))
        labels = materialise(step.unionByName(moved).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        if not labels.where(F.col("label") != F.col("old")).limit(1).count():
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.drop("old")
