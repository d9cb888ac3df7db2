"""WARC records in ZIP packages, written and read in place.

A package is a ZIP file of stored members: ``archive/data.warc.gz`` with one gzip member per record, and
``indexes/index.cdxj`` with a line for each record. The reader parses the end record, its ZIP64 form, the
central directory and the local header of a member itself, and then reads byte ranges of the package: a part of
the index first, then just the records asked for. Nothing is extracted, and only stored members are read.

Each task packs the pages that it scans; which of them are revisits was found by their digests alone, so pages
are never shuffled. A package is closed after ``PACKAGE`` bytes, and the manifest has a row for each ``RECORDS``
records with their part of the index, so a reader's work and memory don't grow with the package.

Among equal payloads of at least ``LEAST`` bytes the row with the largest page_id is a response; the others
are revisit records without a payload that refer to it. Smaller payloads are always responses.

Null html: an empty payload. Null page_id: never chosen while another row has an id; kept null. Rows that
repeat the largest page_id are all responses. An empty table gives no packages and no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, scratch_path, ship_package, small_batches
from ._rows import Findings, leave, named, scanned

LEAST = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records that one row of the manifest stands for, bytes of one range read, and of a package's records at most.
RECORDS, RANGE, PACKAGE = 4096, 4 << 20, 1 << 30


# ---------------------------------------------------------------- ZIP directories


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header: int


def _read(source, at: int, n: int) -> bytes:
    source.seek(at)
    return source.read(n)


def directory(source) -> dict[str, Member]:
    """The members of a ZIP file from its central directory, ZIP64 fields included."""
    size = source.seek(0, io.SEEK_END)
    tail_at = max(0, size - 65_557)
    tail = _read(source, tail_at, size - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    if k < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = _read(source, tail_at + k - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (end64,) = struct.unpack_from("<Q", locator, 8)
        record = _read(source, end64, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = _read(source, start, length), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        stored, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
        (header,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, i = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:  # only the fields that overflowed are there, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            i += 4 + n
        out[name] = Member(name, method, plain, stored, header)
        at += 46 + n_name + n_extra + n_note
    return out


def data_start(source, member: Member) -> int:
    """Where a stored member's bytes start."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read in place")
    local = _read(source, member.header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    n_name, n_extra = struct.unpack_from("<HH", local, 26)
    return member.header + 30 + n_name + n_extra


# ---------------------------------------------------------------- WARC records


def record_id(page_id: int | None, salt: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, salt)}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, salt: str = "") -> bytes:
    """One record; with ``refers_to`` a revisit, which keeps the HTTP header and drops the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, salt)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, '')}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record. The digest of a response is taken from its payload and held against the header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda s: int(s[len("<urn:page:") : -1]) if s.startswith("<urn:page:") else None
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != named:
            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": named, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def gzip_member(raw: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


# ---------------------------------------------------------------- Spark


MANIFEST = "path string, records long, index_at long, index_bytes long"


class PackageWriter:
    """Streams records to one package; keeps the index, and where each ``RECORDS`` entries of it start."""

    def __init__(self, out):
        self.out = out
        self.package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        self.data = self.package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index = io.BytesIO()
        self.offset = self.n = 0
        self.parts: list[list[int]] = []  # records, first byte and bytes of the index

    def add(self, page_id: int | None, url: str, raw: bytes) -> None:
        if self.n % RECORDS == 0:
            self.parts.append([0, self.index.tell(), 0])
        self.data.write(raw)
        line = json.dumps({"url": url, "page_id": page_id, "offset": self.offset, "length": len(raw)}).encode() + b"\n"
        self.index.write(line)
        self.offset += len(raw)
        self.n += 1
        self.parts[-1][0] += 1
        self.parts[-1][2] += len(line)

    def close(self) -> None:
        self.data.close()
        self.package.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue())
        self.package.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.package.close()
        self.out.close()


def revisits(rows: DataFrame) -> DataFrame:
    """(block, row, refers_to) of the named pages that repeat a payload; only digests are shuffled."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    large = rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= LEAST)
    narrow = materialise(large.select(F.col("__block").alias("block"), F.col("__row").alias("row"), "page_id", F.sha1(body).alias("digest")), "digests")
    chosen = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    return narrow.join(chosen, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("block", "row", "refers_to")


def write_packages(pages: DataFrame, path: str, package_bytes: int = PACKAGE) -> DataFrame:
    """Write all pages to packages in the shared folder ``path``; the manifest: parts of the packages' indexes."""
    small_batches(pages.sparkSession)
    rows = named(scanned(pages))
    marks = leave(revisits(rows), "revisits")
    names = [f.split()[0] for f in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, roll = TaskContext.get().partitionId(), 0
        system, folder = fs.FileSystem.from_uri(path)
        found = Findings(marks)
        writer = temp = None

        def close() -> pa.RecordBatch:
            writer.close()
            final = f"{folder}/pages-{part:06d}-{roll:04d}.wacz"
            system.move(temp, final)  # whole or absent; a repeated task writes the same file
            return pa.RecordBatch.from_arrays([pa.array([final] * len(writer.parts)), *(pa.array(c, pa.int64()) for c in zip(*writer.parts))], names=names)

        for b in batches:
            for block, row, page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("__block", "__row", "page_id", "url", "html"))):
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    temp = f"{folder}/.{part:06d}-{roll:04d}-{uuid.uuid4().hex}"
                    writer = PackageWriter(system.open_output_stream(temp, buffer_size=1 << 20))
                mine = found.of(block, row)
                refers_to = None if mine is None else mine.column("refers_to")[0].as_py()
                url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                writer.add(page_id, url, gzip_member(record(page_id, url, (html or "").encode(), refers_to, f"{part}/{roll}/{writer.n}")))
                if writer.offset >= package_bytes:
                    yield close()
                    writer, roll = None, roll + 1
        if writer is not None:
            yield close()

    return materialise(rows.select("__block", "__row", "page_id", "url", "html").mapInArrow(run, MANIFEST), "packages")


def records(source, index_at: int = 0, index_bytes: int | None = None) -> Iterator[dict]:
    """Records of an open package, all or those of a part of its index, by range reads."""
    members = directory(source)
    at = data_start(source, members[INDEX]) + index_at
    lines = _read(source, at, members[INDEX].size if index_bytes is None else index_bytes).split(b"\n")
    entries = [json.loads(x) for x in lines if x]
    base, i = data_start(source, members[DATA]), 0
    while i < len(entries):
        j, start = i, entries[i]["offset"]
        while j < len(entries) and (j == i or entries[j]["offset"] + entries[j]["length"] - start <= RANGE):
            j += 1
        raw = _read(source, base + start, entries[j - 1]["offset"] + entries[j - 1]["length"] - start)
        for e in entries[i:j]:
            k = e["offset"] - start
            yield parse(zlib.decompress(raw[k : k + e["length"]], 31)) | {"url": e["url"]}
        i = j


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(manifest: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the packages, a task for some thousand records; with ``payloads`` the bytes too."""
    spark = manifest.sparkSession
    ship_package(spark)
    schema = SCHEMA + (", url string, payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(path)
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        for b in batches:
            for file, at, n in zip(b.column("path").to_pylist(), b.column("index_at").to_pylist(), b.column("index_bytes").to_pylist()):
                with system.open_input_file(file) as source:
                    found = records(source, at, n)
                    while rows := [tuple(r[k] for k in names) for r in islice(found, 64 if payloads else 1024)]:  # the rest of a record isn't kept
                        yield pa.RecordBatch.from_arrays([pa.array(c, types.get(k, pa.string())) for k, c in zip(names, zip(*rows))], names=names)

    return manifest.repartition(parts, "path", "index_at").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write packages to the session's shared folder and read all records back."""
    path = scratch_path(pages.sparkSession, "wacz")
    return read_packages(write_packages(pages, path), path)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
c AS (SELECT digest, max(page_id) AS chosen FROM d WHERE n >= {LEAST} GROUP BY digest HAVING count(*) > 1)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN c.chosen IS NOT NULL AND d.page_id IS DISTINCT FROM c.chosen THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id IS DISTINCT FROM c.chosen THEN c.chosen END AS refers_to
FROM d LEFT JOIN c USING (digest)
"""
