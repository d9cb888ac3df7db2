"""Token ids in files of fixed-width packed bits.

Documents are dealt by ranges of doc_id and sorted, so file k holds smaller ids than file k + 1. Each task
encodes its texts and streams one file: blocks of ``BLOCK`` ids, each id in the fewest bits that hold the
vocabulary, then a footer with the documents' ids and token counts and the offset of every block. A reader
opens the footer, and unpacks just the blocks that a range of tokens touches.

File: magic, blocks, footer (JSON header, document table, block offsets), footer length, magic.

A file is closed after ``FILE_TOKENS`` ids or ``FILE_DOCS`` documents, and the task goes on with another; the
manifest keeps their order. Ids that need more bits than the vocabulary raise.

Null text: only the end id. Null ids come first and stay null. Repeated rows are written once each. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _tokens
from ._common import materialise, scratch_path, ship_package, small_batches

MAGIC, BLOCK = b"NSBITS01", 1 << 16
#: What one file holds at most, but for a last document that goes beyond.
FILE_TOKENS, FILE_DOCS = 1 << 28, 1 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as little-endian 64-bit words; id i starts at bit i * bits. 64 ids fill ``bits`` words."""
    n = len(ids)
    if n and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    rows = np.zeros((-(-n // 64), 64), np.uint64)
    rows.ravel()[:n] = ids
    words = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        words[:, w] |= rows[:, j] << np.uint64(s)
        if s + bits > 64:
            words[:, w + 1] |= rows[:, j] >> np.uint64(64 - s)
    return words.ravel()[: -(-n * bits // 64)].astype("<u8").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    words = np.zeros((-(-n // 64), bits), np.uint64)
    got = np.frombuffer(raw, "<u8")
    words.ravel()[: len(got)] = got
    rows = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        x = words[:, w] >> np.uint64(s)
        if s + bits > 64:
            x = x | words[:, w + 1] << np.uint64(64 - s)
        rows[:, j] = x & mask
    return rows.ravel()[:n].astype(np.uint32)


class TokenWriter:
    """Streams documents of ids to one file."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.docs: list[tuple[int | None, int]] = []
        self.tokens = 0
        self.offsets = [len(MAGIC)]
        self.held: list[np.ndarray] = []
        self.n_held = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 8 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        full = len(ids) if last else len(ids) // self.block * self.block
        for k in range(0, full, self.block):
            raw = pack(ids[k : min(k + self.block, full)], self.bits)
            self.out.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.held, self.n_held = [ids[full:]], len(ids) - full

    def close(self) -> int:
        self._flush(True)
        tokens = self.tokens
        head = json.dumps({"bits": self.bits, "block": self.block, "docs": len(self.docs), "tokens": tokens, "blocks": len(self.offsets) - 1}).encode()
        ids = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + np.array([d is not None for d, _ in self.docs], "u1").tobytes()
        foot = struct.pack("<I", len(head)) + head + ids + np.array([n for _, n in self.docs], "<i8").tobytes() + np.array(self.offsets, "<i8").tobytes()
        self.out.write(foot + struct.pack("<Q", len(foot)) + MAGIC)
        return tokens


class TokenReader:
    """Random access to one file; reads the footer, then only the blocks it is asked for."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - 16)
        n, magic = struct.unpack("<Q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(size - 16 - n)
        foot = source.read(n)
        (h,) = struct.unpack_from("<I", foot)
        self.head = json.loads(foot[4 : 4 + h])
        at, docs = 4 + h, self.head["docs"]
        self.ids = np.frombuffer(foot, "<i8", docs, at)
        self.known = np.frombuffer(foot, "u1", docs, at + 8 * docs).astype(bool)
        self.counts = np.frombuffer(foot, "<i8", docs, at + 9 * docs)
        self.offsets = np.frombuffer(foot, "<i8", self.head["blocks"] + 1, at + 17 * docs)
        self.starts = np.cumsum(self.counts) - self.counts

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop`` of the file."""
        block, bits = self.head["block"], self.head["bits"]
        parts, stop = [], min(stop, self.head["tokens"])
        first, last = start // block, -(-stop // block)
        if start >= stop:
            return np.zeros(0, np.uint32)
        self.source.seek(int(self.offsets[first]))
        raw = self.source.read(int(self.offsets[last] - self.offsets[first]))
        for b in range(first, last):
            lo, hi = (int(self.offsets[x] - self.offsets[first]) for x in (b, b + 1))
            parts.append(unpack(raw[lo:hi], min(block, self.head["tokens"] - b * block), bits))
        return np.concatenate(parts)[start - first * block : stop - first * block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i] + self.counts[i]))

    def documents(self, chunk: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """Every document in order, reading about ``chunk`` tokens at once."""
        i = 0
        while i < len(self.counts):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + chunk)))
            base = int(self.starts[i])
            ids = self.tokens(base, int(self.starts[j - 1] + self.counts[j - 1]))
            for k in range(i, j):
                at = int(self.starts[k]) - base
                yield (int(self.ids[k]) if self.known[k] else None), ids[at : at + int(self.counts[k])]
            i = j


def write_tokens(docs: DataFrame, path: str, vocabulary: int, tokenizer: str, leading: bool = True, end_id: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode all texts into files under the shared folder ``path``; one row per file: part, roll, path, docs, tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    bits = bits_for(max(vocabulary, end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, roll = TaskContext.get().partitionId(), 0
        system, folder = fs.FileSystem.from_uri(path)
        encode = _tokens.encoder(tokenizer, leading).encode
        writer = out = temp = None
        end = np.array([end_id], "<u4").tobytes()

        def close() -> pa.RecordBatch:
            tokens = writer.close()
            out.close()
            final = f"{folder}/part-{part:06d}-{roll:04d}.bits"
            system.move(temp, final)  # whole or absent; a repeated task writes the same file
            row = {"part": pa.array([part], pa.int32()), "roll": pa.array([roll], pa.int32()), "path": [final], "docs": [len(writer.docs)], "tokens": [tokens]}
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), encode([t or "" for t in b.column("text").to_pylist()])):
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    temp = f"{folder}/.{part:06d}-{roll:04d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(temp)
                    writer = TokenWriter(out, bits)
                writer.add(doc_id, np.frombuffer(raw + end, "<u4"))
                if writer.tokens >= file_tokens or len(writer.docs) >= FILE_DOCS:
                    yield close()
                    writer, roll = None, roll + 1
        if writer is not None:
            yield close()

    return materialise(ordered.mapInArrow(run, "part int, roll int, path string, docs long, tokens long"), "token-files")


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, in parallel over files."""
    spark = manifest.sparkSession
    ship_package(spark)
    files = sorted(manifest.select("part", "roll", "path", "tokens").collect())  # one row per file
    starts = [0, *accumulate(f["tokens"] for f in files)]
    rows = [(f["path"], s) for f, s in zip(files, starts)]
    table = spark.createDataFrame(rows, "path string, start long").repartition(max(len(rows), 1), "path") if rows else spark.createDataFrame([], "path string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(path)
        for b in batches:
            for file, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with system.open_input_file(file) as source:
                    reader = TokenReader(source)
                    sums = [zlib.crc32(np.ascontiguousarray(ids, "<u4")) for _, ids in reader.documents()]
                    ids = pa.array(reader.ids, pa.int64(), mask=~reader.known)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(reader.starts + start), pa.array(reader.counts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the files to the session's shared folder and read every document back; the file says how large the vocabulary is."""
    path = scratch_path(docs.sparkSession, "tokens")
    vocabulary = _tokens.vocabulary_size(tokenizer)
    return read_tokens(write_tokens(docs, path, vocabulary, tokenizer, end_id=end_id, file_tokens=file_tokens), path)
