"""Streams of array updates: windowed counts, edits and caches with state, replay buffers, chunks encoded as they come."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .._ship import ship_package
from ..operators import storage, workloads


def windowed_counts(events: DataFrame, value: str, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of each value per tumbling window; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), value).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), value, "n")


def online_edits(edits: DataFrame, states: int, mode: str = "append") -> DataFrame:
    """Edits (step, pos, v0): each reads its cell, writes (v + 1) modulo the states. The state is the cell's value."""

    ship_package(edits.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values("step")
            rows = []
            for s, v0 in zip(pdf["step"], pdf["v0"]):
                before = int(v0) if value is None else value
                value = (before + 1) % states
                rows.append((int(s), int(key[0]), before, value))
            state.update((value,))
            yield pd.DataFrame(rows, columns=["step", "pos", "before", "after"])

    return edits.groupBy("pos").applyInPandasWithState(step, "step long, pos long, before long, after long", "v long", mode, GroupStateTimeout.NoTimeout)


def encode_chunks(values: DataFrame, path: str, checkpoint: str, size: int = storage.CHUNK) -> DataStreamWriter:
    """Write each micro-batch of (pos, v) as encoded chunks; batches must hold whole chunks.

    A batch that runs again overwrites its own folder, so chunks are written once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        storage.encoded(storage.chunks(batch, size)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return values.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def append_observations(observations: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append (obs_id, ...) of each micro-batch to a replay buffer; a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return observations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def sample_appended(spark, path: str, ids: DataFrame) -> DataFrame:
    """Rows (k, i) of what a replay buffer holds by now, in order and with repeats."""
    return workloads.sample(spark.read.parquet(path).drop("epoch"), ids)


def lru_reads(reads: DataFrame, size: int, budget_chunks: int, mode: str = "append") -> DataFrame:
    """Reads (cache, step, pos) of many caches: (cache, step, chunk, hit). The state is each cache's chunks, oldest first."""
    ship_package(reads.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = OrderedDict.fromkeys(state.get[0] if state.exists else [])
        rows = []
        # a trigger's reads of a cache come in any order
        for s, pos in sorted((int(s), int(p)) for pdf in batches for s, p in zip(pdf["step"], pdf["pos"])):
            chunk = pos // size
            rows.append((int(key[0]), s, chunk, chunk in held))
            held[chunk] = None
            held.move_to_end(chunk)
            if len(held) > budget_chunks:
                held.popitem(last=False)
        state.update((list(held),))
        yield pd.DataFrame(rows, columns=["cache", "step", "chunk", "hit"])

    return reads.groupBy("cache").applyInPandasWithState(step, "cache long, step long, chunk long, hit boolean", "held array<long>", mode, GroupStateTimeout.NoTimeout)
