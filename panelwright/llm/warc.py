"""WARC records in ZIP-packaged archives, read by range.

An archive is a ZIP file with two stored (uncompressed) members: a WARC file of
one gzip stream per record, and an index with a line per record (identity,
offset and length within the WARC member). The reader parses the end record,
the ZIP64 locator and directory, the central directory and the local headers,
reads the index, and then reads each record's range; nothing is extracted.

Payloads that occur more than once are written once, as the response of the
least page_id; the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_path, stage, table

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: An archive is closed once its records take this many bytes.
ARCHIVE_BYTES = 64 << 20
_EPOCH = (0 << 11, 1 << 5 | 1)  # DOS time and date of every member: 1980-01-01


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def bare_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records -----------------------------------------------------------------


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip stream with a WARC/1.1 response record or, if refers_to is
    given, a revisit record without the payload."""
    digest = bare_digest(payload)
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{bare_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head.insert(3, f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level, mtime=0)


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes | None

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def payload_bytes(self) -> int:
        """Of the full payload: a revisit states it in its HTTP headers."""
        if self.payload is not None:
            return len(self.payload)
        for line in self.http.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                return int(line.split(b":", 1)[1])
        raise ValueError("a revisit record without Content-Length")

    def page(self, name: str = "warc-record-id") -> int | None:
        value = self.headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None


def read_record(stream: bytes) -> Record:
    """Parses one gzip stream; lengths and digests must hold."""
    data = gzip.decompress(stream)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n" or headers["warc-block-digest"] != f"sha1:{bare_digest(block)}":
        raise ValueError("damaged WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "revisit":
        return Record(headers, http, None)
    if headers["warc-payload-digest"] != f"sha1:{bare_digest(payload)}":
        raise ValueError("damaged WARC payload")
    return Record(headers, http, payload)


# --- ZIP ---------------------------------------------------------------------

_LOCAL, _CENTRAL, _END, _END64, _AT64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


class ZipWriter:
    """Stored members, written in order; sizes follow in a data descriptor, so
    nothing is held back. force64 writes ZIP64 fields whatever the size."""

    def __init__(self, out, force64: bool = False) -> None:  # noqa: ANN001
        self.out, self.at, self.members, self.force64 = out, 0, [], force64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.name, self.start, self.crc = raw, self.at, 0
        # ZIP64 extra present: the descriptor has 8-byte sizes
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4sHHHHHIIIHH", _LOCAL, 45, 0x808, 0, *_EPOCH, 0, _FULL32, _FULL32, len(raw), len(extra)) + raw + extra)
        self.data = self.at

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)

    def end(self) -> None:
        size = self.at - self.data
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", self.crc, size, size))
        self.members.append((self.name, self.start, size, self.crc))

    def close(self) -> None:
        begin = self.at
        for name, start, size, crc in self.members:
            big = self.force64 or max(size, start) >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if big else b""
            s, o = (_FULL32, _FULL32) if big else (size, start)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x808, 0, *_EPOCH, crc, s, s, len(name), len(extra), 0, 0, 0, 0, o) + name + extra)
        n, size = len(self.members), self.at - begin
        if self.force64 or n >= _FULL16 or begin >= _FULL32:
            here = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(struct.pack("<4sIQI", _AT64, 0, here, 1))
            n, size, begin = _FULL16, _FULL32, _FULL32
        self._put(struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, size, begin, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    crc: int
    header: int


class ZipReader:
    """The directory of a seekable file; members are read by range."""

    def __init__(self, source) -> None:  # noqa: ANN001
        self.source, self.size = source, source.size()
        tail_at = max(0, self.size - (22 + 65535 + 20))
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(_END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, size, begin = struct.unpack_from("<HII", tail, at + 10)
        if _FULL16 == count or _FULL32 in (size, begin):
            if at < 20 or tail[at - 20 : at - 16] != _AT64:
                raise ValueError("no ZIP64 locator")
            at64 = struct.unpack_from("<Q", tail, at - 12)[0]
            end = self.read(at64, 56)
            if end[:4] != _END64:
                raise ValueError("no ZIP64 end record")
            count, size, begin = struct.unpack_from("<QQQ", end, 32)
        self.members = {m.name: m for m in self._directory(self.read(begin, size), count)}

    def read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("the archive is cut off")
        return data

    @staticmethod
    def _directory(data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != _CENTRAL:
                raise ValueError("damaged central directory")
            method, crc, packed, size = struct.unpack_from("<H4xIII", data, at + 10)
            n, m, k = struct.unpack_from("<HHH", data, at + 28)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n].decode()
            extra, x = data[at + 46 + n : at + 46 + n + m], 0
            while x + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, x)
                if tag == 1:
                    y = x + 4
                    for field in ("size", "packed", "header"):
                        if {"size": size, "packed": packed, "header": header}[field] == _FULL32:
                            value = struct.unpack_from("<Q", extra, y)[0]
                            y += 8
                            size, packed, header = (value if f == field else v for f, v in (("size", size), ("packed", packed), ("header", header)))
                x += 4 + length
            yield Member(name, method, size, crc, header)
            at += 46 + n + m + k

    def data_at(self, name: str) -> int:
        """Where the bytes of a stored member begin."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} isn't stored; ranges of it can't be read")
        local = self.read(member.header, 30)
        if local[:4] != _LOCAL:
            raise ValueError(f"damaged local header of {name}")
        n, m = struct.unpack_from("<HH", local, 26)
        return member.header + 30 + n + m

    def member(self, name: str) -> bytes:
        data = self.read(self.data_at(name), self.members[name].size)
        if binascii.crc32(data) != self.members[name].crc:
            raise ValueError(f"checksum of {name}")
        return data


# --- Spark -------------------------------------------------------------------


def _payload(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def with_references(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload (binary) and refers_to of every row of pages
    (page_id, url, html). Of rows with equal payloads of `least` bytes or more,
    that with the smallest page_id is referred to by the others.

    The first id of each digest is aggregated before the shuffle; a digest that
    a third of all rows share is a join key whose rows adaptive execution splits.
    Null ids sort last; a repeated row (equal id) refers to its own id's response.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), _payload("html").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    first = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(first, "digest", "left")
    again = (F.length("payload") >= least) & (F.col("n") > 1) & ~F.coalesce(F.col("first") == F.col("page_id"), F.col("first").isNull())
    return joined.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Writes rows (page_id, url, payload, refers_to) to ZIP archives in folder,
    and returns a row for each: name, records, bytes. Names hold the task's attempt:
    a task that runs again writes archives of its own, and only those that the
    returned rows name count."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        number = 0
        packer = None
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            nonlocal packer
            packer[1].end()
            packer[1].begin(INDEX_MEMBER)
            packer[1].write(b"".join(packer[2]))
            packer[1].end()
            packer[1].close()
            packer[0].close()
            done.append((packer[3], len(packer[2]), packer[1].at))
            packer = None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packer is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:05d}.wacz"
                    number += 1
                    out = store.open_output_stream(f"{base}/{name}")
                    packer = (out, ZipWriter(out), [], name)
                    packer[1].begin(WARC_MEMBER)
                stream = write_record(page_id, url, payload, refers_to, level)
                packer[2].append(json.dumps({"id": page_id, "offset": packer[1].at - packer[1].data, "length": len(stream)}).encode() + b"\n")
                packer[1].write(stream)
                if packer[1].at >= archive_bytes:
                    finish()
        if packer is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "records", "bytes"])

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(of, "name string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of archives (name): page_id, payload_bytes,
    payload_digest, record_type, refers_to, and the payload if asked for.
    Each archive's index is read, then its records by range, in offset order."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def rows_of(name: str) -> Iterator[tuple]:
        store, base = open_store(folder)
        with store.open_input_file(f"{base}/{name}") as source:
            reader = ZipReader(source)
            begin = reader.data_at(WARC_MEMBER)
            for line in reader.member(INDEX_MEMBER).splitlines():
                entry = json.loads(line)
                record = read_record(reader.read(begin + entry["offset"], entry["length"]))
                if record.page() != entry["id"]:
                    raise ValueError(f"{name}: the index points to another record")
                digest = record.headers["warc-payload-digest"].removeprefix("sha1:")
                url = json.loads(f'"{record.headers["warc-target-uri"]}"')
                yield (record.page(), url, record.payload_bytes, digest, record.kind, record.page("warc-refers-to"), *([record.payload] * payloads))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] * payloads)]
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held: list[tuple] = []
                for row in rows_of(name):
                    held.append(row)
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names)
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds)], names)

    return archives.select("name").mapInArrow(of, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to archives in the shared folder, then reads all back."""
    folder = new_path(spark, "warc")
    written = stage(write_archives(with_references(table(spark, sf_dir, "pages")), folder), "archives")
    # one archive a task: a written list of names is small
    names = written.select("name").repartitionByRange(max(1, written.count()), "name")
    return read_archives(names, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the archives must give back, without archives.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, CAST(unhex(h) AS BIT)::VARCHAR AS bits FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST(('000' || substring(bits, CAST(i * 5 + 1 AS BIGINT), 5))::BIT::UTINYINT AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
