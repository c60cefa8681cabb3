r"""WARC archives as a Python data source, and the archive of a table of pages with revisit records.

Reading plans a partition a file. A record's WARC and HTTP headers are parsed first; predicates on the record type and
other header columns are pushed into the source and decide, before the payload is decompressed, whether a record is
wanted. Gzip members written here carry their compressed length in an `sl` extra field, so that what is not wanted is
skipped by a seek; other members are inflated to find their end. Plain `.warc` files are skipped by Content-Length.

Writing gives every attempt's files new names; the commit lists the files of successful tasks in a `_files-*` entry,
and a folder with such entries is read by them alone.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from cairn.llm import files
from cairn.llm.common import bounded_batches, cut, join_sized, new_dir, tidy

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
_ARROW = pa.schema([*((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "payload_digest")), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
#: A file is ended beyond so many bytes; a batch of read records beyond so many bytes of payload.
MAX_FILE, _BATCH = 256 << 20, 8 << 20
_MEMBER = struct.Struct("<4BI2B")
_CHUNK = 1 << 16


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose `sl` extra field holds its whole length and that of data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, 10 + 2 + 12 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return _MEMBER.pack(0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _line(name: str, value: str | None) -> str:
    return "" if value is None else f"{name}: {value.replace('\r', '%0D').replace('\n', '%0A')}\r\n"


def record(row: dict) -> bytes:
    """A response or revisit record of a row of SCHEMA."""
    revisit = row["record_type"] == "revisit"
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    head = "WARC/1.1\r\n" + _line("WARC-Type", row["record_type"]) + _line("WARC-Record-ID", f"<{row['record_id']}>") + _line("WARC-Date", row["date"]) + _line("WARC-Target-URI", row["target_uri"])
    head += _line("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")
    if revisit:
        head += _line("WARC-Profile", _REVISIT) + _line("WARC-Refers-To", f"<{row['refers_to']}>")
    body = http if revisit else http + payload
    head += "Content-Type: application/http; msgtype=response\r\n" + _line("Content-Length", str(len(body))) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


class _Plain:
    """The bytes of one record of a plain file, from its start; the end comes from Content-Length."""

    def __init__(self, f, at: int):
        self.f, self.start, self.at = f, at, at

    def read(self, n: int) -> bytes:
        self.f.seek(self.at)
        out = self.f.read(n)
        self.at += len(out)
        return out

    def end(self, length: int) -> int:
        return self.start + length


class _Member:
    """The inflated bytes of one gzip member; end() is where the next begins."""

    def __init__(self, f, at: int):
        self.f, self.start, self.at = f, at, at
        f.seek(at)
        first = f.read(24)
        self.length = None
        if len(first) == 24 and first[3] & 4 and first[12:16] == b"sl\x08\x00":
            self.length = struct.unpack("<I", first[16:20])[0]
        self.inflater, self.left = zlib.decompressobj(31), b""

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n and not self.inflater.eof:
            if not self.left:
                self.f.seek(self.at)
                self.left = self.f.read(_CHUNK if self.length is None else min(_CHUNK, self.start + self.length - self.at))
                self.at += len(self.left)
                if not self.left:
                    raise ValueError(f"a gzip member at {self.start} is cut off")
            out += self.inflater.decompress(self.left, n - len(out))
            self.left = self.inflater.unconsumed_tail
        return out

    def end(self, _: int) -> int:
        if self.length is not None:
            return self.start + self.length
        while not self.inflater.eof:
            self.read(_CHUNK)
        return self.at - len(self.inflater.unused_data)


class _Record:
    """Headers and block of one record, read forward and no further than asked for."""

    def __init__(self, source):
        self.source, self.held, self.used = source, b"", 0

    def headers(self, most: int | None = None) -> tuple[str, dict[str, str]] | None:
        """First line and fields by lower-case name; None, and nothing consumed, if they don't end within `most` bytes."""
        while (at := self.held.find(b"\r\n\r\n", 0, most)) < 0:
            more = self.source.read(2048) if most is None or len(self.held) < most else b""
            if not more:
                if most is None:
                    raise ValueError("headers are cut off")
                return None
            self.held += more
        lines = self.held[:at].decode("utf-8", "replace").split("\r\n")
        self.held, self.used = self.held[at + 4 :], self.used + at + 4
        return lines[0], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def take(self, n: int) -> bytes:
        parts, have = [self.held[:n]], min(n, len(self.held))
        self.held, self.used = self.held[n:], self.used + n
        while have < n:
            more = self.source.read(n - have)
            if not more:
                raise ValueError("a record is cut off")
            parts.append(more)
            have += len(more)
        return b"".join(parts)


def _bare(value: str | None) -> str | None:
    return value[1:-1] if value and value[:1] == "<" else value


def records(f, size: int, plain: bool, wanted, payload: bool, verify: bool) -> Iterator[dict]:
    """Rows of SCHEMA for the wanted records of an open file; payloads are null unless asked for."""
    at = 0
    while at < size:
        source = (_Plain if plain else _Member)(f, at)
        r = _Record(source)
        version, fields = r.headers()
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        length, before = int(fields["content-length"]), r.used
        row = {
            "record_id": _bare(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "payload_bytes": None, "refers_to": _bare(fields.get("warc-refers-to")), "payload": None,
        }
        if wanted(row):
            http = r.headers(length) if fields.get("content-type", "").startswith("application/http") else None
            left = length - (r.used - before)
            revisit = row["record_type"] == "revisit"
            said = http[1].get("content-length", "") if http else ""
            row["payload_bytes"] = int(said) if revisit and said.isdigit() else left
            if (payload or verify) and not revisit:
                body = r.take(left)
                if verify and row["payload_digest"] not in (None, digest(body)):
                    raise ValueError(f"payload of {row['record_id']} differs from its digest")
                row["payload"] = body if payload else None
            yield row
        at = source.end(before + length + 4)


@dataclass
class _File(InputPartition):
    path: str
    size: int


#: Columns whose predicates are decided from the headers alone.
_HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "date", "payload_digest", "refers_to")
_TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    In: lambda v, f: v is not None and v in f.value,
    IsNull: lambda v, f: v is None,
    IsNotNull: lambda v, f: v is not None,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    StringContains: lambda v, f: v is not None and f.value in v,
}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _HEADER_COLUMNS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self):
        listed = [x for x, _ in files.listing(self.path, (".files",))]
        found = files.listing(self.path, (".warc", ".warc.gz"))
        if listed:
            names = set()
            for x in listed:
                with files.open_input(x) as f:
                    names |= set(f.read().decode().split("\n"))
            found = [x for x in found if posixpath.basename(x[0]) in names]
        return [_File(*x) for x in found]

    def read(self, partition):
        if partition is None:  # no file
            return
        wanted = lambda row: all(_TESTS[type(f)](row[f.attribute[0]], f) for f in self.tests)
        held, n = [], 0
        with files.open_input(partition.path) as f:
            for row in records(f, partition.size, not partition.path.endswith(".gz"), wanted, self.payload, self.verify):
                held.append(row)
                n += len(row["payload"] or b"") + 200
                if n > _BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows with the columns of SCHEMA as gzip members, several files a task if they grow large."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        stream, size, names = None, 0, []
        for batch in iterator:
            for row in batch.to_pylist():
                if stream is None:
                    stream, path = files.create(self.path, "part", ".warc.gz")
                    names.append(posixpath.basename(path))
                    info = b"software: cairn\r\nformat: WARC File Format 1.1\r\n"
                    head = "WARC/1.1\r\nWARC-Type: warcinfo\r\n" + _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>") + _line("WARC-Date", _DATE) + f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    size = stream.write(member(head.encode() + info + b"\r\n\r\n")) or 0
                data = member(record(row))
                stream.write(data)
                size += len(data)
                if size > MAX_FILE:
                    stream.close()
                    stream, size = None, 0
        if stream is not None:
            stream.close()
        return _Written(names)

    def commit(self, messages):
        stream, _ = files.create(self.path, "_files", ".files")
        with stream:
            stream.write("\n".join(n for m in messages if m for n in m.names).encode())

    def abort(self, messages):
        """Files of failed runs are not in any list and are never read."""


class WarcDataSource(DataSource):
    """`warc`: reads and appends WARC/1.1 archives in a folder. Options: path; on reading payload and verify."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def _register(spark: SparkSession) -> None:
    bounded_batches(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of the archives at path; verify checks response payloads against their digests."""
    _register(spark)
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(path)


def write(rows: DataFrame, path: str) -> None:
    """Appends rows of SCHEMA to the archives at path."""
    _register(rows.sparkSession)
    rows.write.format("warc").mode("append").save(path)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows of SCHEMA for pages, with copies as revisits.

    Takes page_id, url and html; other columns are not read. The payload is html in UTF-8 (null: empty). Of pages with
    equal payloads of at least min_bytes bytes, the one with the largest page_id is a response and the others revisit it;
    smaller payloads are all responses, and so are pages with a null page_id and all rows that share the largest one.
    An empty table gives no rows.
    """
    p = tidy(pages, "page_id", "url", "html").withColumn("payload", F.coalesce("html", F.lit("")).cast("binary"))
    p = p.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    by = p.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("keep"), F.count("page_id").alias("n"))
    copies = cut(by.where((F.col("n") > 1) & (F.col("payload_bytes") >= min_bytes)).select("sha1", "keep"))
    p = join_sized(p, copies, "sha1", salt="page_id")
    revisit = F.coalesce(F.col("page_id") < F.col("keep"), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return p.select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(_DATE).alias("date"),
        _base32(F.col("sha1")).alias("payload_digest"), "payload_bytes", F.when(revisit, urn(F.col("keep"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _base32(hexed):
    """Base32 of 40 hexadecimal digits: 32 letters of five bits."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 2), 40, "0") for k in range(4)))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(letters, F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))))


def page_id(record_id):
    """The page_id in a record id of page_records(); null if it holds none."""
    return F.expr(f"try_cast(substring({record_id}, 10) AS bigint)")


def archive(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives and reads them back, response payloads verified: the rows of read() without payloads."""
    spark = pages.sparkSession
    path = path or new_dir(spark, "warc")
    write(page_records(pages, min_bytes), path)
    return read(spark, path, payload=False, verify=True).where(F.col("record_type").isin("response", "revisit"))


#: DuckDB has no SHA-1 in base32; bits are spelled out from the hexadecimal digits.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT *, list_reduce(list_transform(range(40), lambda i: right(bin(strpos('0123456789abcdef', x[i + 1]) - 1 + 16), 4)), lambda a, c: a || c) AS bits,
             max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0b' || bits[i * 5 + 1:i * 5 + 5])::INTEGER + 1)]), lambda a, c: a || c) AS payload_digest,
  CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keep THEN keep END AS refers_to
FROM b
"""
