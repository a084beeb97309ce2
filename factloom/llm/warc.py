r"""WARC archives as a PySpark Python data source ("warc"), and the archive of a table of pages.

Writing: every task writes gzip members, one per record, whose extra field `sl` holds the member's length, so a reader can
pass over a record without inflating its payload. A file gets its name only when it is whole; the driver's commit lists the
files of the tasks that count, with the record offsets at which each may be split, in a manifest. Files of tasks that
failed or ran twice aren't listed.

Reading: the driver plans one partition per piece of a file (at the manifest's offsets; a file without manifest is one
piece). Equality, membership, prefix, order and null tests on header columns are pushed down: a task inflates and parses a
record's headers first and passes over records that can't match; payloads are decoded for the rest, unless the option
payload is false.

Defined results: a null html is the empty payload; null urls have no WARC-Target-URI; control characters and spaces of a
url are percent-encoded; of equal payloads of MIN_REVISIT bytes or more, all rows with the largest id (nulls are least)
are responses and the others revisit that id; an empty table makes an archive without records; only the named columns are
read. Files go through pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from .support import bounded, file_system, fresh_dir, kept, prepare, table

MIN_REVISIT = 1000
SPLIT_BYTES = 32 << 20
BROADCAST_ROWS = 500_000
MANIFEST = "_manifest.json"

READ_SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, content_length long, payload binary"
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("content_length", pa.int64()),
        ("payload", pa.binary()),
    ]
)
#: Header columns that predicates may be pushed to, and their headers.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_length": "content-length"}


# writing


def record(row: dict) -> bytes:
    """One WARC record: a response holds an HTTP response with the payload, a revisit its HTTP headers only."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {row['target_uri']}")
    lines.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its length and the data's in the extra field `sl`."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return struct.pack("<4BIBBH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    size: int
    splits: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        name, own = f"{uuid.uuid4().hex}.warc.gz", f"{base}/.{uuid.uuid4().hex}"
        size, splits, any_record = 0, [0], False
        with fs.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    data = member(record(row))
                    if size - splits[-1] >= self.split_bytes:
                        splits.append(size)
                    out.write(data)
                    size, any_record = size + len(data), True
        if not any_record:
            fs.delete_file(own)
            return Written(None, 0, [])
        fs.move(own, f"{base}/{name}")
        return Written(name, size, splits)

    def commit(self, messages: list) -> None:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        files = []
        if any(x.path.endswith(MANIFEST) for x in fs.get_file_info(_selector(base))):
            with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
                files = json.loads(f.read())
        files += [{"file": m.file, "size": m.size, "splits": m.splits} for m in messages if m is not None and m.file]
        own = f"{base}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(json.dumps(files).encode())
        fs.move(own, f"{base}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        fs, base = file_system(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{base}/{m.file}")


def _selector(base: str):
    from pyarrow import fs

    return fs.FileSelector(base, recursive=True, allow_not_found=True)


# reading


@dataclass
class Piece(InputPartition):
    file: str
    start: int
    end: int | None


def _test(f: Filter):
    """A function of parsed headers for a filter that can be pushed down, else None."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in HEADERS:
        return None
    column = f.attribute[0]

    def value(headers: dict):
        return _header(headers, column)

    if isinstance(f, EqualTo):
        return lambda h: value(h) == f.value
    if isinstance(f, EqualNullSafe):
        return lambda h: value(h) == f.value
    if isinstance(f, In):
        wanted = set(f.value)
        return lambda h: value(h) in wanted
    if isinstance(f, IsNull):
        return lambda h: value(h) is None
    if isinstance(f, IsNotNull):
        return lambda h: value(h) is not None
    if isinstance(f, StringStartsWith):
        return lambda h: (value(h) or "").startswith(f.value) and value(h) is not None
    order = {GreaterThan: lambda a: a > f.value, GreaterThanOrEqual: lambda a: a >= f.value, LessThan: lambda a: a < f.value, LessThanOrEqual: lambda a: a <= f.value}.get(type(f))
    # text compares by its UTF-8 bytes, as Spark's does
    if order and isinstance(f.value, int):
        return lambda h: value(h) is not None and order(value(h))
    if order and isinstance(f.value, str):
        whole = f.value.encode()
        compare = {GreaterThan: lambda a: a > whole, GreaterThanOrEqual: lambda a: a >= whole, LessThan: lambda a: a < whole, LessThanOrEqual: lambda a: a <= whole}[type(f)]
        return lambda h: value(h) is not None and compare(value(h).encode())
    return None


def _header(headers: dict, column: str):
    text = headers.get(HEADERS[column])
    if text is None:
        return None
    if column in ("record_id", "refers_to"):
        return text.removeprefix("<").removesuffix(">")
    if column == "payload_digest":
        return text.removeprefix("sha1:")
    return int(text) if column == "content_length" else text


def parse_headers(data: bytes) -> dict[str, str]:
    """Headers by lower-case name; the first line is left out, a line that begins with white space continues the last."""
    found: dict[str, str] = {}
    last = None
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, _, text = line.partition(":")
            last = last.strip().lower()
            found[last] = text.strip()
    return found


class _Source:
    """Bytes of a file from start on, read ahead in chunks, that can be passed over."""

    def __init__(self, stream, start: int):
        self.stream, self.at, self.buffer = stream, start, b""
        stream.seek(start)

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n:
            more = self.stream.read(max(n - len(self.buffer), 1 << 16))
            if not more:
                break
            self.buffer += more
        return self.buffer[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.buffer = self.buffer[len(out) :]
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.buffer = b""
            self.stream.seek(self.at + n)
        self.at += n


def _records(source: _Source, end: int | None, wanted) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of the records that begin before end and whose headers are wanted."""
    while (end is None or source.at < end) and source.peek(1):
        if source.peek(2) == b"\x1f\x8b":
            head = source.peek(24)
            size = struct.unpack_from("<I", head, 16)[0] if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl" else None
            if size:
                start = zlib.decompressobj(31).decompress(source.peek(min(size, 2048)), 1 << 16)
                cut = start.find(b"\r\n\r\n")
                if cut >= 0 and not wanted(parse_headers(start[:cut])):
                    source.skip(size)
                    continue
                data = zlib.decompress(source.take(size), 31)
            else:
                inflate, parts = zlib.decompressobj(31), []
                while not inflate.eof:
                    chunk = source.take(1 << 16)
                    if not chunk:
                        raise ValueError("a gzip member is cut short")
                    parts.append(inflate.decompress(chunk))
                source.buffer = inflate.unused_data + source.buffer
                source.at -= len(inflate.unused_data)
                data = b"".join(parts)
            at = 0  # a member may hold several records
            while at < len(data):
                cut = data.index(b"\r\n\r\n", at)
                headers = parse_headers(data[at:cut])
                n = int(headers.get("content-length", 0))
                if wanted(headers):
                    yield headers, data[cut + 4 : cut + 4 + n]
                at = cut + 4 + n + 4
        else:
            size = 4096
            while (cut := (head := source.peek(size)).find(b"\r\n\r\n")) < 0:
                if len(head) < size:
                    return  # nothing but line ends is left
                size *= 4
            headers = parse_headers(source.take(cut + 4)[:cut])
            n = int(headers.get("content-length", 0))
            if wanted(headers):
                yield headers, source.take(n)
            else:
                source.skip(n)
            source.skip(4)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters: list) -> Iterator[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[Piece]:
        fs, base = file_system(self.path)
        found = {x.path: x.size for x in fs.get_file_info(_selector(base)) if x.is_file}
        manifest = next((p for p in found if p.endswith(f"/{MANIFEST}")), None)
        if manifest:
            with fs.open_input_stream(manifest) as f:
                listed = json.loads(f.read())
            return [Piece(x["file"], a, b) for x in listed for a, b in zip(x["splits"], [*x["splits"][1:], x["size"]], strict=True)] or [Piece("", 0, 0)]
        files = sorted(p for p in found if p.endswith((".warc", ".warc.gz")))
        return [Piece(p.removeprefix(base).lstrip("/"), 0, None) for p in files] or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.file:
            return
        fs, base = file_system(self.path)
        tests = [_test(f) for f in self.filters]

        def wanted(headers: dict) -> bool:
            return all(t(headers) for t in tests)

        rows, size = [], 0
        with fs.open_input_file(f"{base}/{piece.file}") as stream:
            for headers, block in _records(_Source(stream, piece.start), piece.end, wanted):
                row = {c: _header(headers, c) for c in HEADERS} | {"payload": None, "payload_bytes": None}
                if headers.get("content-type", "").startswith("application/http"):
                    http, _, body = block.partition(b"\r\n\r\n")
                    declared = parse_headers(http).get("content-length")
                    if row["record_type"] == "revisit":
                        row["payload_bytes"] = int(declared) if declared else None
                    else:
                        row["payload_bytes"] = len(body)
                        row["payload"] = body if self.payload else None
                elif row["record_type"] != "revisit":
                    row["payload_bytes"] = len(block)
                    row["payload"] = block if self.payload else None
                rows.append(row)
                size += len(block)
                if size > 4 << 20 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); df.write.format("warc").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("an archive is only appended to")
        return WarcWriter(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# an archive of pages

DATE = "2024-01-01T00:00:00Z"


def _uri(url):
    """url with control characters and spaces percent-encoded."""
    out = url
    for code in [*range(0x21), 0x7F]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), out).otherwise(url)


def records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """What to write for each page: a response, or a revisit of the response with an equal payload."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    groups = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest", "payload_bytes").agg(F.max("id").alias("keep"), F.count("*").alias("c")).where("c > 1")
    groups = kept(groups.select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "keep"))
    rows = rows.join(bounded(groups, BROADCAST_ROWS), (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    revisit = F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))

    def name(c: str):
        """Nothing after the colon for null, % for an empty text, else the id with what a header can't hold encoded."""
        text = F.col(c).cast("string")
        return F.concat(F.lit("urn:page:"), F.when(text == "", "%").otherwise(F.coalesce(F.url_encode(text), F.lit(""))))

    return rows.select(
        name("id").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        _uri(F.col("url")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(revisit, name("keep")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archived(pages: DataFrame, folder: str, id_type) -> DataFrame:
    """pages written to a folder as WARC files and read back from them."""
    spark, kind = pages.sparkSession, id_type
    register(spark)
    records(pages).write.format("warc").mode("append").save(folder)
    back = spark.read.format("warc").load(folder).where(F.col("record_type").isin("response", "revisit"))

    def page(c: str):
        text = F.substring(c, len("urn:page:") + 1, 1 << 30)
        return F.when(text == "%", "").when(text != "", F.url_decode(F.nullif(text, F.lit("%")))).cast(kind)

    return back.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return archived(pages, fresh_dir(spark, "warc"), pages.schema["page_id"].dataType)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, strlen(h) AS b, max(page_id) OVER (PARTITION BY h) AS k FROM p)
SELECT page_id, b::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN b >= 1000 AND page_id <> k THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN b >= 1000 AND page_id <> k THEN k END AS refers_to FROM g
"""
