"""WARC archives: a Python data source (format ``warc``) that writes and reads them.

``write_warc`` makes one record of each page with DataFrame functions. Pages with equal payloads of ``REVISIT_BYTES`` or more are
written once, as the response of the smallest page_id; the others are revisits of it. Groups are found on digests and page_ids
alone, and a page meets its mark by both, so copies of one payload spread over all tasks. Each task writes one file with a gzip
member for each record, which has the member's length in its header; the driver then lists the files of the tasks that were
committed, so what a lost task left behind is never read.

The reader plans whole files into partitions of about ``partition_bytes``, as a payload may hold what looks like the start of a
record. Equality and IN filters on ``record_type`` and equality on other header columns are pushed down: a record's headers are
parsed first, and if a filter fails or the payload is not asked for, the reader goes on to the next member without inflating the
rest. Archives of others, without lengths or with many records in a member, are read through.

Defined results: a null html is an empty payload; a null url gives no target URI, and control characters and spaces in one are
percent-encoded; a null page_id is written as an empty id and read as null, and such a page is never the response that others
revisit; repeated pages are repeated records, with one id; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import files_of, filesystem, written

REVISIT_BYTES = 100
#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID = "urn:page:"
#: Columns of the source and the headers they hold.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "payload_length": "x-payload-length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload binary"
#: What a gzip header says of a member of known length: flags with an extra field, of one part ``sl`` with the member's length and its content's.
MEMBER = struct.Struct("<4sIBBHccHII")
GZIP = b"\x1f\x8b\x08\x04"
#: Lists the files of an archive.
LISTED = "_files.txt"
CHUNK = 1 << 14


def _encoded(url: Column) -> Column:
    """``url`` with control characters and spaces percent-encoded."""
    coded = lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), F.array_join(F.transform(F.split(url, ""), coded), "")).otherwise(url)


def _revisits(rows: DataFrame) -> DataFrame:
    """``digest, page_id, first`` of the pages that revisit another, from narrow ``rows`` (page_id, digest, bytes)."""
    rows = written(rows.where(F.col("bytes") >= REVISIT_BYTES).select("digest", "page_id"), "digests")
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and first is not null").select("digest", "first"), "groups")  # written: a join of two exchanges can split a hot key
    return written(rows.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).dropDuplicates(), "revisits")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write ``page_id, url, html`` as WARC files below ``path``; ``compression`` is gzip or none."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), _encoded(F.col("url")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html")})
    again = _revisits(rows.select("page_id", "digest", "bytes")).select(F.col("digest").alias("of"), F.col("page_id").alias("id"), "first")
    rows = rows.join(again, (F.col("digest") == F.col("of")) & F.col("page_id").eqNullSafe(F.col("id")), "left")
    again = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    block = F.when(again, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), "html"))
    record = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("page_id")),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Refers-To", urn("first")), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit(END),
    )
    pages.sparkSession.dataSource.register(WarcSource)
    rows.select(record.alias("record")).write.format("warc").option("compression", compression).mode("append").save(path)


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that has its length in its header, if 32 bits can hold it."""
    if len(data) >= 1 << 31:
        return gzip.compress(data, 6)
    deflate = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    size = MEMBER.size + len(body) + 8
    return MEMBER.pack(GZIP, 0, 0, 255, 12, b"s", b"l", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    """Writes records, one a row, to a file of their task; ``commit`` lists the files."""

    def __init__(self, options: dict):
        self.path, self.compression = options["path"], options.get("compression", "gzip")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = filesystem(self.path)
        system.create_dir(root)
        name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.compression == "gzip" else "")
        pack = member if self.compression == "gzip" else bytes
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for record in batch.column(0):
                    out.write(pack(record.as_py().encode()))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = filesystem(self.path)
        system.create_dir(root)
        _, found = files_of(self.path, hidden=True)
        names = [f"{m.name}\n" for m in messages if m]
        for f in found:
            if f.rpartition("/")[2] == LISTED:
                with system.open_input_stream(f) as held:
                    names.insert(0, held.read().decode())
        with system.open_output_stream(f"{root}/{LISTED}", compression=None) as out:
            out.write("".join(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that are not listed are not read."""


@dataclass
class Files(InputPartition):
    names: list[str]


class Member(io.RawIOBase):
    """The content of a gzip member that starts at ``at``, inflated as far as it is read."""

    def __init__(self, raw, at: int):
        self.raw, self.inflate, self.held = raw, zlib.decompressobj(zlib.MAX_WBITS | 16), b""
        raw.seek(at)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held and not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.raw.read(CHUNK)
            if not data:
                raise EOFError("a member ends early")
            self.held = self.inflate.decompress(data, len(buffer))
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, names = files_of(self.path, hidden=True)
        listed: set[str] | None = None
        for n in names:
            if n.rpartition("/")[2] == LISTED:
                with system.open_input_stream(n) as held:
                    listed = set(held.read().decode().split())
        held, out = 0, []
        for n in names:
            base = n.rpartition("/")[2]
            if base.startswith(("_", ".")) or listed is not None and base not in listed:
                continue
            size = system.get_file_info(n).size
            if not out or held + size > self.partition_bytes:
                out.append(Files([]))
                held = 0
            out[-1].names.append(n)
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        rows: list[tuple] = []
        held = 0
        for name in partition.names:
            with system.open_input_file(name) as raw:
                for row in self.file(raw, name.endswith(".gz")):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def file(self, raw, zipped: bool) -> Iterator[tuple]:
        """Records of a file: members of known length one by one, anything else as one stream."""
        at = 0
        while zipped:
            raw.seek(at)
            head = raw.read(MEMBER.size)
            if not head:
                return
            if len(head) < MEMBER.size or not head.startswith(GZIP) or head[12:16] != b"sl\x08\x00":
                raw.seek(at)
                yield from self.records(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20))
                return
            yield from self.records(io.BufferedReader(Member(raw, at), CHUNK), single=True)
            at += MEMBER.unpack(head)[8]
        yield from self.records(io.BufferedReader(raw, 1 << 20))

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*HEADERS, "content_length", "payload"])

    def records(self, file: io.BufferedReader, single: bool = False) -> Iterator[tuple]:
        """Records that pass the pushed filters; blocks that nobody asked for are skipped, and not even inflated if ``file`` is a ``single`` record."""
        while version := file.readline():
            if version in (b"\r\n", b"\n"):
                continue
            if not version.startswith(b"WARC/"):
                raise ValueError(f"a record starts with {version[:40]!r}")
            headers: dict[str, str] = {}
            while (line := file.readline().strip()) != b"":
                key, _, value = line.partition(b":")
                headers[key.decode().strip().lower()] = value.decode().strip()
            length = int(headers["content-length"])
            row = [headers.get(h) for h in HEADERS.values()]
            keep = all(headers.get(HEADERS[c]) in values for c, values in self.wanted.items())
            if not keep or not self.payload or headers.get("warc-type") == "revisit":
                if not single:
                    self.skip(file, length)
                payload = None
            else:
                block = file.read(length)
                head = block.find(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else -4
                payload = block[head + 4 :]
            if keep:
                yield *row, length, payload
            if single:
                return

    @staticmethod
    def skip(file: io.BufferedReader, length: int) -> None:
        if file.seekable():
            file.seek(length, io.SEEK_CUR)
        else:
            while length > 0 and (data := file.read(min(length, 1 << 20))):
                length -= len(data)


class WarcSource(DataSource):
    """Options: ``path``; ``payload`` (false: leave payloads null and unread); ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path``. Registers the source and lets Spark push filters into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write the archives below ``path``, read them back: one row for each page. Responses and revisits are two reads, whose filters on
    the record type reach the source: one inflates no revisit's block, the other no block at all."""
    write_warc(pages, path)
    page = lambda c: F.nullif(F.regexp_extract(c, f"^<{ID}(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    of = lambda kind, payload: read_warc(pages.sparkSession, path, payload).where(F.col("record_type") == kind)
    responses = of("response", True).select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("payload_bytes"),
        F.sha2(F.coalesce("payload", F.lit(b"")), 256).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = of("revisit", False).select(
        page("record_id").alias("page_id"),
        F.col("payload_length").cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)
