"""WARC archives as a PySpark Python data source.

Reading plans one partition for each run of records of about ``split`` bytes (from the manifest that the writer leaves; other
archives are one partition a file), takes record-type and header predicates from Catalyst, reads a record's header
first and, where the predicates reject it, skips its payload without inflating it: the gzip member of each record
carries its own length (the ``sl`` extra field). Payloads are not decoded at all under ``payload=none``.

Writing puts each task's records in files of its own and lists the files of successful tasks in a manifest when the job
commits, so that lost executors and repeated tasks leave no record twice. Archives are reached through
pyarrow.fs by URI, so the folder can lie in any shared store that it knows.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "date": "WARC-Date"}
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, date string, payload_length long, payload binary"
MANIFEST = "manifest.json"
#: Length of the payload that a revisit stands for.
LENGTH = "X-Payload-Length"
MIN_REVISIT = 100
SALTS = 16
_BUFFER = 1 << 16
_ROWS, _BYTES = 512, 8 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member that knows its own length. Control characters in header values become blanks."""
    head = "".join(f"{k}: {re.sub(r'[\x00-\x1f\x7f]', ' ', v)}\r\n" for k, v in headers.items() if v is not None)
    raw = f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


class _Window:
    """A file read forwards through a buffer, with skips."""

    def __init__(self, file: Any, start: int) -> None:
        self.file, self.at, self.held = file, start, b""
        file.seek(start)

    def fill(self, n: int = 1) -> bool:
        while len(self.held) < n:
            more = self.file.read(max(_BUFFER, n - len(self.held)))
            if not more:
                return False
            self.held += more
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError(f"archive ends at byte {self.at + len(self.held)}, inside a record")
        out, self.held = self.held[:n], self.held[n:]
        self.at += n
        return out

    def skip_to(self, at: int) -> None:
        if at - self.at <= len(self.held):
            self.held = self.held[at - self.at :]
        else:
            self.file.seek(at)
            self.held = b""
        self.at = at


class _Member:
    """One gzip member, inflated as far as it is asked for."""

    def __init__(self, window: _Window) -> None:
        self.window, self.begin, self.end = window, window.at, None
        head = window.take(10)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {self.begin}")
        if head[3] & 4:
            extra = window.take(struct.unpack("<H", window.take(2))[0])
            if extra[:2] == b"sl" and len(extra) >= 12:
                self.end = self.begin + struct.unpack_from("<I", extra, 4)[0]
        for flag in (8, 16):
            while head[3] & flag and window.take(1) != b"\0":
                pass
        if head[3] & 2:
            window.take(2)
        self.inflate, self.out = zlib.decompressobj(-15), b""

    def more(self) -> bool:
        if self.inflate.eof or not self.window.fill():
            return False
        raw = self.window.held
        got = self.inflate.decompress(raw, _BUFFER)
        rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.window.at += len(raw) - len(rest)
        self.window.held = rest
        self.out += got
        return True

    def until(self, mark: bytes) -> int:
        while (at := self.out.find(mark)) < 0:
            if not self.more():
                raise ValueError(f"no whole record in the gzip member at byte {self.begin}")
        return at

    def block(self, start: int, length: int) -> bytes:
        parts, size, self.out = [self.out[start:]], len(self.out) - start, b""
        while size < length and self.more():
            parts.append(self.out)
            size += len(self.out)
            self.out = b""
        data = b"".join(parts)
        if len(data) < length:
            raise ValueError(f"no whole record in the gzip member at byte {self.begin}")
        return data[:length]

    def close(self) -> None:
        if self.end is not None:
            self.window.skip_to(self.end)
            return
        while self.more():
            self.out = b""
        self.window.take(8)


class _Plain:
    """The same of a record that is not compressed."""

    def __init__(self, window: _Window) -> None:
        self.window, self.begin, self.length = window, window.at, 0

    def until(self, mark: bytes) -> int:
        size = _BUFFER
        while (at := self.window.held.find(mark)) < 0:
            if not self.window.fill(size):
                raise ValueError(f"no whole record at byte {self.begin}")
            size += _BUFFER
        self.out = self.window.held[: at + len(mark)]
        return at

    def block(self, start: int, length: int) -> bytes:
        self.window.take(start)
        return self.window.take(length)

    def close(self) -> None:
        self.window.skip_to(self.begin + len(self.out) + self.length + 4)


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def scan(file: Any, start: int, end: int | None, wanted: list[tuple[str, Any]], payload: bool) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """(headers, payload length, payload) of the records that begin in the range and pass the predicates."""
    window = _Window(file, start)
    while (end is None or window.at < end) and window.fill():
        if window.held[:1] in b"\r\n":
            window.take(1)
            continue
        member = _Member(window) if window.held[:1] == b"\x1f" else _Plain(window)
        at = member.until(b"\r\n\r\n")
        head = parse_head(member.out[:at])
        length = int(head.get("content-length", 0))
        if isinstance(member, _Plain):
            member.length = length
        if all(test(head.get(FIELDS[name].lower())) for name, test in wanted):
            body, size = None, int(head.get(LENGTH.lower(), -1))
            if payload or size < 0:
                body = member.block(at + 4, length)
                if head.get("content-type", "").startswith("application/http"):
                    body = body.partition(b"\r\n\r\n")[2]
                size = len(body) if size < 0 else size
                body = body if payload and head.get("warc-type") != "revisit" else None
            yield head, size, body
        member.close()


def predicate(f: Filter) -> tuple[str, Any] | None:
    """A column of the header and a test of its value, for the filters that can be judged by it; None for the others."""
    if len(f.attribute) != 1 or f.attribute[0] not in FIELDS:
        return None
    name = f.attribute[0]
    if isinstance(f, IsNotNull):
        return name, lambda x: x is not None
    tests = {EqualTo: lambda v: lambda x: x == v, In: lambda v: lambda x: x in v, StringStartsWith: lambda v: lambda x: x is not None and x.startswith(v), StringEndsWith: lambda v: lambda x: x is not None and x.endswith(v), StringContains: lambda v: lambda x: x is not None and v in x}
    return (name, tests[type(f)](f.value)) if type(f) in tests else None


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int | None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.payload = options["path"], options.get("payload", "bytes") != "none"
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if predicate(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self) -> list[Span]:
        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{root}/{MANIFEST}") as file:
                spans = [Span(name, a, b) for name, cuts in sorted(json.loads(file.read()).items()) for a, b in zip(cuts, cuts[1:])]
        else:
            info = store.get_file_info(root)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
            spans = [Span("" if x.path == root else x.path[len(root) + 1 :], 0, None) for x in sorted(found, key=lambda x: x.path) if re.search(r"\.warc(\.gz)?$", x.path)]
        return spans or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * len(FIELDS) + [pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        wanted = [p for f in self.pushed if (p := predicate(f))]
        store, root = filesystem(self.path)
        rows: list[tuple] = []
        if partition.end == 0:
            return
        held = 0
        with store.open_input_file(f"{root}/{partition.path}" if partition.path else root) as file:
            for head, size, body in scan(file, partition.start, partition.end, wanted, self.payload):
                rows.append((*(head.get(FIELDS[name].lower()) for name in FIELDS), size, body))
                held += len(body or b"")
                if len(rows) >= _ROWS or held >= _BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, list[int]]


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_id, record_type, target_uri, refers_to, payload_digest (sha256 in hex), payload_length, payload."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.split, self.date = options["path"], int(options.get("split", 8 << 20)), options.get("date", "1970-01-01T00:00:00Z")
        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound and not overwrite:
            raise ValueError(f"{self.path} has archives; write with mode overwrite")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        cuts, at, file = [0], 0, None
        for batch in iterator:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                row = {k: v[i].as_py() for k, v in column.items()}
                revisit = row["record_type"] == "revisit"
                headers = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": self.date, "WARC-Target-URI": row["target_uri"], "WARC-Refers-To": row["refers_to"], "WARC-Payload-Digest": f"sha256:{row['payload_digest']}", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None, LENGTH: str(row["payload_length"]) if revisit else None, "Content-Type": "application/http; msgtype=response"}
                raw = record(headers, http_block(b"" if revisit else row["payload"] or b""))
                if file is None:
                    store.create_dir(root, recursive=True)
                    file = store.open_output_stream(f"{root}/{name}", compression=None)
                file.write(raw)
                at += len(raw)
                if at - cuts[-1] >= self.split:
                    cuts.append(at)
        if file is None:
            return Written({})
        file.close()
        return Written({name: cuts if cuts[-1] == at else [*cuts, at]})

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        files = {k: v for m in messages if m is not None for k, v in m.files.items()}
        for info in store.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("part-") and info.base_name not in files:
                store.delete_file(info.path)
        with store.open_output_stream(f"{root}/{MANIFEST}") as file:
            file.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        for m in messages:
            for name in m.files if m is not None else ():
                store.delete_file(f"{root}/{name}")


class Warc(DataSource):
    """``format("warc")``: options path, payload (bytes or none), and for writing split (bytes) and date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for each row; of equal payloads of at least 100 bytes all but that with the smallest id are revisits of it.

    A null payload is empty. Rows with a null id are never referred to, and are revisits where another row has their
    payload and an id. Rows that share the smallest id and the payload are all responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long"), "salt": F.pmod(F.xxhash64("id", "target_uri"), F.lit(SALTS)).cast("int")})
    # only payloads that several rows have; each for every salt, so that a payload of a third of all rows meets its first in many tasks
    first = rows.filter(F.col("payload_length") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    first = first.select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.join(first, ["payload_digest", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    out = joined.select(name(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(again, name(F.col("first"))).alias("refers_to"), "payload_digest", "payload_length", F.when(~again, F.col("payload")).alias("payload"))
    pages.sparkSession.dataSource.register(Warc)
    out.write.format("warc").mode("overwrite").save(folder)


def read(spark: Any, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(folder)


def archived_pages(spark: Any, folder: str) -> DataFrame:
    """``page_records`` of an archive in two reads with the record type pushed down: revisits without inflating a payload, responses with theirs."""
    revisits = read(spark, folder, payload="none").filter(F.col("record_type") == "revisit")
    return page_records(read(spark, folder).filter(F.col("record_type") == "response").unionByName(revisits))


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages; digests of responses are taken from the payload read."""
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1), '') as bigint)")
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )

