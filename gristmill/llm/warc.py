"""WARC archives as a Spark data source, and archiving of pages with revisit records.

``spark.read.format("warc")`` plans one partition for each group of archive files, pushes
predicates on record type, ids, target and digest into the scan, parses a record's headers first
and passes over the payloads of records that the predicates or the option ``payload = none``
don't want. Each record is a gzip member of its own whose extra field gives the member's length,
so an unwanted payload is not even inflated; plain gzip members are inflated and thrown away, and
uncompressed archives are passed over by their content length.

``df.write.format("warc")`` writes files of bounded size under names of one attempt each; a
commit lists the files of the finished tasks, and readers go by these lists where there are any.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from gristmill.llm import shared_files
from gristmill.scratch import Scratch

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
# A file is closed once it has this many bytes; files are the unit of reading.
FILE_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
# Payloads shorter than this are never replaced by revisit records.
LEAST_REVISIT = 1000
COMMITTED = "_committed-"

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_COLUMNS = {
    "record_id": "WARC-Record-ID",
    "type": "WARC-Type",
    "date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}

RECORD = T.StructType(
    [
        *[T.StructField(name, T.StringType()) for name in HEADER_COLUMNS],
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content_length", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def header_block(fields: list[tuple[str, str]], length: int) -> bytes:
    """Header lines of one record; line ends within values become spaces."""
    lines = [VERSION]
    lines += [f"{k}: {' '.join(v.split())}".encode() for k, v in [*fields, ("Content-Length", str(length))]]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """``data`` as a gzip member with its own length in the extra subfield ``SL``."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"SL" + struct.pack("<HI", 4, 12 + 8 + len(body) + 8)
    head = struct.pack("<4BI2BH", 0x1F, 0x8B, 8, 4, 0, 0, 255, len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    """Header names (as written) and values; continuation lines are joined."""
    out: dict[str, str] = {}
    last = None
    for line in block.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            last, _, value = text.partition(":")
            out[last] = value.strip()
    return out


class _Inflated:
    """Bytes of one gzip member, inflated as far as they are asked for."""

    def __init__(self, file, wbits: int):
        self.file, self.inflate, self.held = file, zlib.decompressobj(wbits), b""

    def upto(self, mark: bytes) -> bytes | None:
        """Everything up to and with ``mark``; None if the member ends before."""
        while mark not in self.held and self._more():
            pass
        at = self.held.find(mark)
        if at < 0:
            return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        self.held = b""
        while have < n and self._more():
            parts.append(self.held)
            have += len(self.held)
            self.held = b""
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]

    def next_block(self) -> bytes | None:
        """The next headers; None if the member holds no further record."""
        while True:
            block = self.upto(b"\r\n\r\n")
            if block is None or block.strip(b"\r\n"):
                return block and block.lstrip(b"\r\n")

    def skip(self, n: int) -> None:
        while n > 0 and (passed := len(self.take(min(n, 1 << 16)))):
            n -= passed

    def pass_over(self) -> bytes:
        """Throws the rest of the member away; what follows it in the file."""
        while self._more():
            self.held = b""
        return self.inflate.unused_data

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        source = self.inflate.unconsumed_tail or self.file.read(1 << 14)
        if not source:
            return False
        self.held += self.inflate.decompress(source, 1 << 16)
        return True


def records(file, size: int, wanted, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records for which ``wanted(headers)`` holds.

    ``file`` can seek. A compressed member may hold one record or several. A truncated last record
    ends the file.
    """
    at = 0
    while at < size:
        file.seek(at)
        start = file.read(20)
        if start[:2] == b"\x1f\x8b":
            known = start[3] & 4 and start[12:16] == b"SL" + struct.pack("<H", 4)
            file.seek(at)
            member = _Inflated(file, 31)
            while (block := member.next_block()) is not None:
                headers = parse_headers(block)
                length = int(headers.get("Content-Length", 0))
                if wanted(headers):
                    yield headers, member.take(length) if payload else None
                    length = 0 if payload else length
                if known:
                    # Our own members hold one record and name their length.
                    break
                member.skip(length)
            if known:
                at += struct.unpack("<I", start[16:20])[0]
            else:
                rest = member.pass_over()
                at = file.tell() - len(rest)
        else:
            file.seek(at)
            held = b""
            while b"\r\n\r\n" not in held.lstrip(b"\r\n"):
                more = file.read(1 << 12)
                if not more:
                    return
                held += more
            lead = len(held) - len(held.lstrip(b"\r\n"))
            end = held.index(b"\r\n\r\n", lead) + 4
            headers = parse_headers(held[lead:end])
            length = int(headers.get("Content-Length", 0))
            if wanted(headers):
                file.seek(at + end)
                yield headers, file.read(length) if payload else None
            at += end + length + 4


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(None)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) else None
            if column in HEADER_COLUMNS and len(f.attribute) == 1:
                self.tests.append((type(f).__name__, HEADER_COLUMNS[column], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, inner = shared_files.locate(self.path)
        found = {
            f.path: f.size
            for f in system.get_file_info(fs.FileSelector(inner, recursive=True))
            if f.type == fs.FileType.File
        }
        lists = [p for p in found if p.rpartition("/")[2].startswith(COMMITTED)]
        if lists:
            names = {n for p in lists for n in json.loads(system.open_input_file(p).read())}
            chosen = [p for p in found if p.rpartition("/")[2] in names]
        else:
            chosen = [p for p in found if p.endswith((".warc", ".warc.gz"))]
        groups: list[list[str]] = []
        room = 0
        for p in sorted(chosen):
            if room < found[p] or not groups:
                groups.append([])
                room = PARTITION_BYTES
            groups[-1].append(p)
            room -= found[p]
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(RECORD)
        system, _ = shared_files.locate(self.path)
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for path in partition.paths if partition else ():
            size = system.get_file_info(path).size
            with system.open_input_file(path) as file:
                for headers, payload in records(file, size, self._wanted, self.payload):
                    named = [headers.get(h) for h in HEADER_COLUMNS.values()]
                    rows.append((*named, list(headers.items()), int(headers.get("Content-Length", 0)), payload))
                    held += len(payload or b"") + 500
                    if held >= BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    def _wanted(self, headers: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            own = headers.get(name)
            if own is None or not (
                kind == "IsNotNull"
                or (kind == "EqualTo" and own == value)
                or (kind == "In" and own in value)
                or (kind == "StringStartsWith" and own.startswith(value))
            ):
                return False
        return True


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows with the columns of the header fields, ``headers`` (more fields) and ``payload``."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names: list[str] = []
        out = None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        system, inner = shared_files.locate(shared_files.fresh(self.path, ".warc.gz"))
                        system.create_dir(inner.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(inner, compression=None)
                        names.append(inner.rpartition("/")[2])
                    fields = [(h, row[c]) for c, h in HEADER_COLUMNS.items() if row.get(c) is not None]
                    more = row.get("headers") or {}
                    fields += [(k, v) for k, v in dict(more).items() if v is not None]
                    payload = row.get("payload") or b""
                    out.write(gzip_member(header_block(fields, len(payload)) + payload + b"\r\n\r\n"))
                    if out.tell() >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        names = [n for m in messages if m is not None for n in m.names]
        shared_files.write(f"{self.path}/{COMMITTED}{uuid.uuid4().hex}.json", json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files of a failed write are in no list, so no reader takes them."""


class WarcDataSource(DataSource):
    """Options: ``path``; ``payload`` = ``bytes`` (default) or ``none``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return RECORD

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "bytes") != "none")

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Python sources take predicates."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(WarcDataSource)


def _record_id(kind: Column, page_id: Column) -> Column:
    """A name in the form of a UUID, the same for the same record of a page."""
    h = F.md5(F.concat_ws("/", kind, page_id.cast("string")))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


# Archives of this module name the page and the payload's size and digest in fields of their own.
PAGE, REFERS, LENGTH, SHA1 = "X-Page-ID", "X-Refers-To-Page-ID", "X-Payload-Length", "X-Payload-SHA1"


def write_pages(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes one record per page below ``folder``.

    Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest id
    is written whole, and the others as revisit records without payload. A null payload is
    empty, a null target is left out, rows with equal ids are records of their own.
    """
    register(pages.sparkSession)
    scratch = Scratch(pages.sparkSession, "warc-groups")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("_page"), F.col(url).alias("_url"), payload.alias("payload"))
    rows = rows.withColumn("_sha1", F.sha1("payload")).withColumn("_length", F.octet_length("payload").cast("bigint"))
    groups = (
        rows.where(F.col("_length") >= LEAST_REVISIT)
        .groupBy(F.col("_sha1").alias("_group"), F.col("_length").alias("_size"))
        .agg(F.max("_page").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    groups = scratch.keep(groups, "groups")
    same = (F.col("_sha1") == F.col("_group")) & (F.col("_length") == F.col("_size"))
    revisit = F.col("_group").isNotNull() & ~F.col("_page").eqNullSafe(F.col("_first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    fields = {
        PAGE: F.col("_page"),
        LENGTH: F.col("_length"),
        SHA1: F.col("_sha1"),
        REFERS: F.when(revisit, F.col("_first")),
        "WARC-Profile": F.when(revisit, REVISIT_PROFILE),
    }
    headers = F.map_from_arrays(
        F.array(*[F.lit(k) for k in fields]), F.array(*[v.cast("string") for v in fields.values()])
    )
    digest = F.concat(F.lit("sha1:"), F.col("_sha1"))
    made = rows.join(groups, same, "left").select(
        _record_id(kind, F.col("_page")).alias("record_id"),
        kind.alias("type"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.col("_url").alias("target_uri"),
        F.when(revisit, _record_id(F.lit("response"), F.col("_first"))).alias("refers_to"),
        digest.alias("payload_digest"),
        headers.alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    made.write.format("warc").mode("append").option("path", folder).save()


def read_pages(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of written pages.

    Size and digest of a response are taken from its payload as read; of a revisit, whose
    payload is never decoded, from its headers.
    """
    register(spark)
    source = spark.read.format("warc")
    response = source.load(folder).where("type = 'response'")
    revisit = source.option("payload", "none").load(folder).where("type = 'revisit'")
    header = lambda name: F.col("headers")[name]
    common = (F.col("type").alias("record_type"), header(REFERS).cast(id_type).alias("refers_to"), "target_uri")
    return response.select(
        header(PAGE).cast(id_type).alias("page_id"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        *common,
    ).union(
        revisit.select(
            header(PAGE).cast(id_type).alias("page_id"),
            header(LENGTH).cast("bigint").alias("payload_bytes"),
            header(SHA1).alias("payload_digest"),
            *common,
        )
    )
