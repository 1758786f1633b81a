"""Conversion of ARC archives (versions 1 and 2) to WARC.

An ARC file opens with a ``filedesc`` record that states its version; the
version says which fields a record's header line has, the last of them the
declared length of the content that follows.  Each ARC record becomes a WARC
record: its identifier is derived from the place it has in the ARC archives
(so no two share one, whatever they hold), the date is rewritten, the type
follows from the content (HTTP responses, other resources, the ``filedesc``
record as ``warcinfo``), and block and payload digests are taken.  A payload of
at least ``REVISIT_BYTES`` that an earlier record has as well becomes a
``revisit`` that names that record and stores no payload.

Archives are files of bounded size that Spark writes and reads.  Each record
is a gzip member of its own, so that it can be read by its place alone; a
record larger than an archive's bound has an archive of its own.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the records of an archive, before they are compressed.
ARCHIVE_BYTES = 16 << 20
#: Compressed bytes of the archives that a task converts.
TASK_BYTES = 32 << 20
REVISIT_BYTES = 100
#: Header fields of ARC records by version, and WARC's profile of revisits.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: HTTP header that carries a record's number in the source table.
ID_HEADER = b"X-Source-Record"
DATE = "19970101000000"


class ArcRecord(NamedTuple):
    version: int
    fields: dict[str, str]
    content: bytes
    #: Number of the byte where its header line starts.
    offset: int = 0


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file by their declared lengths, the ``filedesc`` record first."""
    at, version = 0, 0
    while at < len(raw):
        if raw[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = raw.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"header line without end at byte {at}")
        line = raw[at:stop].rstrip(b"\r").decode("utf-8", "surrogateescape")
        if not version:
            if not line.startswith("filedesc:"):
                raise ValueError("no filedesc record")
            length = int(line.rsplit(" ", 1)[1])
            content = raw[stop + 1 : stop + 1 + length]
            version = int(content.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
        names = FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) < len(names):
            # a filedesc line may keep the five fields of version 1
            names = FIELDS[1]
            values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"malformed header line at byte {at}")
        length = int(values[-1])
        if stop + 1 + length > len(raw):
            raise ValueError(f"truncated record at byte {at}")
        yield ArcRecord(version, dict(zip(names, values, strict=True)), raw[stop + 1 : stop + 1 + length], at)
        at = stop + 1 + length


def arc_line(version: int, url: str, date: str, length: int, offset: int = 0, name: str = "-") -> bytes:
    url = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url) or "unknown:"
    middle = f"text/html 200 - - {offset} {name}" if version == 2 else "text/html"
    return f"{url} 0.0.0.0 {date} {middle} {length}\n".encode("utf-8", "surrogatepass")


def iso_date(date: str) -> str:
    """WARC-Date of an ARC date of up to 14 digits; what is missing is the earliest."""
    digits = "".join(c for c in date if c.isdigit())[:14]
    digits += "19700101000000"[len(digits) :]
    y, mo, d, h, mi, s = digits[:4], *(digits[n : n + 2] for n in range(4, 14, 2))
    mo, d = (v if v != "00" else "01" for v in (mo, d))
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z"


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and payload."""
    stop = content.find(b"\r\n\r\n")
    return (content, b"") if stop < 0 else (content[: stop + 4], content[stop + 4 :])


def header_value(header: bytes, name: bytes) -> bytes | None:
    for line in header.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.lower() == name.lower():
            return value.strip()
    return None


def record_id(archive: str, offset: int) -> str:
    """Identifier of the record that starts at a byte of an archive, whose name must be its own."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{archive}|{offset}'.encode()).digest()[:16], version=5)}>"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the two line ends that close a record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block


class Original(NamedTuple):
    """The record that a revisit repeats: its number in the source table, archive and offset."""

    source: int
    archive: str
    offset: int


def convert(record: ArcRecord, archive: str = "-", refers_to: Original | None = None) -> bytes:
    """The WARC record of a record of ARC archive ``archive``."""
    url, date = record.fields["url"], iso_date(record.fields["date"])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    own = ("WARC-Record-ID", record_id(archive, record.offset))
    if url.startswith("filedesc:"):
        info = f"software: epochal\r\nformat: WARC file version 1.1\r\nsource-format: ARC {record.version}\r\n".encode()
        return warc_record("warcinfo", [own, ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info)
    http = record.content.startswith(b"HTTP/")
    header, payload = http_parts(record.content) if http else (b"", record.content)
    digest = sha(payload)
    block = record.content if refers_to is None else header
    headers = [
        own,
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("WARC-IP-Address", record.fields["ip"]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{sha(block)}"),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(refers_to.archive, refers_to.offset)),
            ("X-Refers-To-Record", str(refers_to.source)),
            ("X-Payload-Length", str(len(payload))),
        ]
    headers.append(("Content-Type", "application/http; msgtype=response" if http else record.fields["content_type"]))
    return warc_record("revisit" if refers_to is not None else "response" if http else "resource", headers, block)


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by its declared length."""
    at = 0
    while at < len(raw):
        stop = raw.find(b"\r\n\r\n", at)
        lines = raw[at:stop].decode("utf-8", "surrogateescape").split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = stop + 4
        stop = start + int(headers["Content-Length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where it says")
        yield headers, raw[start:stop]
        at = stop + 4


# -- jobs ------------------------------------------------------------------
FILES = T.StructType([T.StructField("value", T.BinaryType())])


def member(record: bytes) -> bytes:
    """A record as a gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def unpacked(archive: bytes) -> bytes:
    """All members of an archive, one after another."""
    with gzip.GzipFile(fileobj=io.BytesIO(archive)) as file:
        return file.read()


def _files(parts: Iterator, open_with, make) -> Iterator[pa.RecordBatch]:
    """Rows of one archive each: records are made and packed until ``ARCHIVE_BYTES``.

    ``make`` gets the record's archive (counted in the task) and offset.
    """
    held: list[bytes] = []
    size = count = 0

    def close() -> pa.RecordBatch:
        # a member ends with its size, whose highest byte is 0 below 16 MB; else an empty member follows
        data = b"".join(held) if held[-1].endswith(b"\0") else b"".join([*held, member(b"")])
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], ["value"])

    for part in parts:
        if size >= ARCHIVE_BYTES:
            yield close()
            held, size, count = [], 0, count + 1
        if not held:
            first = open_with(count)
            held.append(member(first))
            size += len(first)
        record = make(part, count, size)
        held.append(member(record))
        size += len(record)
    if held:
        yield close()


def _save(files: DataFrame, path: str) -> None:
    """One file a row; the writer's line end is the last byte of the last member (see ``_files``)."""
    files.select(F.col("value").cast("string")).write.options(maxRecordsPerFile=1, lineSep="\0").text(path)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", version: int | None = None) -> None:
    """ARC archives of a table of pages; ``version`` None: both versions in turns.

    Null bodies are empty payloads, null URLs and numbers are left out.  Rows
    with repeated numbers are records of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        now = [1]

        def open_with(count: int) -> bytes:
            now[0] = v = version or 1 + (task + count) % 2
            content = f"{v} 0 epochal\n{TITLES[v]}\n".encode()
            return f"filedesc://{task}-{count}.arc 0.0.0.0 {DATE} text/plain {len(content)}\n".encode() + content + b"\n"

        def parts() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for number, address, text in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                    own = b"" if number is None else ID_HEADER + b": %d\r\n" % number
                    yield address or "", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + own + b"\r\n" + (text or b"")

        def line(part: tuple[str, bytes], count: int, offset: int) -> bytes:
            address, content = part
            return arc_line(now[0], address, DATE, len(content), offset, f"{task}-{count}.arc") + content + b"\n"

        return _files(parts(), open_with, line)

    rows = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(body).cast("string").cast("binary"))
    _save(rows.mapInArrow(run, FILES), path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length`` and ``content`` of the archives of a folder; lengths alone are read without contents."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length")


PAYLOADS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("source", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)


def arc_payloads(arcs: DataFrame) -> DataFrame:
    """Place, number, size and digest of every record's payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for record in read_arc(unpacked(raw.as_py())):
                    if record.fields["url"].startswith("filedesc:"):
                        continue
                    header, payload = http_parts(record.content) if record.content.startswith(b"HTTP/") else (b"", record.content)
                    number = header_value(header, ID_HEADER)
                    rows.append((path, record.offset, int(number) if number else None, len(payload), hashlib.sha256(payload).hexdigest()))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], PAYLOADS.names)

    return arcs.mapInArrow(run, PAYLOADS)


def revisits(payloads: DataFrame) -> DataFrame:
    """Of each archive (``path``): which of its records repeat which record.

    Of numbered records with a payload that of the smallest number is the
    original; others that bear this number too (a table with repeated numbers)
    are no revisits, and revisits name the first of them by path and offset.
    Records without a number are never originals.

    Payloads are grouped by digest and size but joined by digest, so that both
    sides of the join are plain exchanges, whose hot digests Spark can split.
    """
    long = payloads.where(F.col("payload_bytes") >= REVISIT_BYTES)
    place = F.when(F.col("source").isNotNull(), F.struct("source", "path", "offset"))
    first = long.groupBy("payload_digest", "payload_bytes").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("payload_digest", "first")
    again = long.join(first, "payload_digest").where("NOT source <=> first.source")
    return again.groupBy("path").agg(F.collect_list(F.struct("offset", "first")).alias("again"))


def to_warc(arcs: DataFrame, again: DataFrame, path: str) -> None:
    """Convert each archive into WARC archives under ``path``.

    Archives are dealt by name to as many tasks as keep each at ``TASK_BYTES``
    or so (at least to the session's shuffle partitions), with their revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def open_with(count: int) -> bytes:
            headers = [("WARC-Record-ID", record_id(f"{path}/{task}-{count}", 0)), ("WARC-Date", iso_date(DATE)), ("Content-Type", "application/warc-fields")]
            return warc_record("metadata", headers, b"") + END

        def parts() -> Iterator[bytes]:
            for batch in batches:
                for name, raw, pairs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    known = {p["offset"]: Original(p["first"]["source"], p["first"]["path"], p["first"]["offset"]) for p in pairs.as_py() or []}
                    for record in read_arc(unpacked(raw.as_py())):
                        yield convert(record, name, known.get(record.offset)) + END

        return _files(parts(), open_with, lambda record, count, offset: record)

    spark = arcs.sparkSession
    total = arcs.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    joined = arcs.select("path", "content").repartition(tasks, "path").join(again.repartition(tasks, "path"), "path", "left").select("path", "content", "again")
    _save(joined.mapInArrow(run, FILES), path)


RECORDS = T.StructType(
    [T.StructField("source", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType())]
)


def warc_records(warcs: DataFrame) -> DataFrame:
    """What the archives hold: digests of stored payloads are taken anew and held against the headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1):
                rows = []
                for headers, block in read_warc(unpacked(raw.as_py())):
                    kind = headers["WARC-Type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    header, payload = http_parts(block) if kind != "resource" else (b"", block)
                    number = header_value(header, ID_HEADER)
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {headers['WARC-Record-ID']} differs")
                    size = int(headers["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    refers = headers.get("X-Refers-To-Record")
                    rows.append((int(number) if number else None, size, digest, kind, int(refers) if refers else None, headers["WARC-Target-URI"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], RECORDS.names)

    return warcs.mapInArrow(run, RECORDS)
