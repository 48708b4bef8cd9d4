"""A WARC data source, and archives of pages with revisit records.

``spark.read.format("pathloom-warc").load(folder)`` plans the folder's files into partitions of about ``partitionBytes``;
equality and IN filters on record_type and on header columns are taken over (with spark.sql.python.filterPushdown.enabled)
and tested on the headers, which are parsed first: the block of a record that fails is skipped undecoded, and so is every
payload unless option ``payload`` is true. Files are ``.warc`` or ``.warc.gz`` (a gzip member for each record). Gzip members
written here tell their length in an extra field "sl" (compressed and plain length, 4 bytes each), so that a reader inflates
no more than the headers and seeks to the next member; a foreign member without that field is inflated to find its end, and
in plain files the block is sought past. Writing goes
through the same source: a file or more for each task, taken into the folder's manifest when the job commits, so that tasks
that are run again or fail leave nothing that is read. Files are rolled at the size of a reading task.

Edge cases: a null payload is the empty one; rows with a null key are written without a key and read back with null;
repeated rows are written each; other columns are ignored; an empty table or folder gives no rows; a very long payload is a
record like any other, and without option ``payload`` it is not held; a record cut off by the end of
its file raises; an HTTP block without Content-Length has what follows its headers as its payload, one without a blank line
is all headers.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import storage
from .common import fresh_path, table
from .storage import filesystem

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to string, payload binary"
#: Columns that come from headers, by name.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "page_id": "x-page-id", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PARTITION_BYTES, ROLL_BYTES = 64 << 20, 64 << 20
#: Bytes that are inflated, and that are read to be inflated, at a time.
INFLATED, DEFLATED = 4096, 2048
MANIFEST = "_manifest"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, date: str, payload: bytes, payload_digest: str, first) -> bytes:
    """A response, or if first is another page's id a revisit of it: HTTP headers only, with the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first is not None and first != page_id
    block = http if revisit else http + payload
    uri = "".join((url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id if page_id is not None else uuid.uuid4())}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    head += [f"X-Page-Id: {page_id}"] * (page_id is not None)
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page-Id: {first}"] * revisit
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """data as a gzip member that tells its length, where four bytes hold it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(body) + 32
    told = max(size, len(data)) < 2**32
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) if told else b""
    return struct.pack("<4BIBB", 0x1F, 0x8B, 8, 4 * told, 0, 0, 255) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) % 2**32)


def told_length(start: bytes) -> int | None:
    """The compressed length that a gzip member's first bytes tell, if they do."""
    if len(start) < 12 or not start[3] & 4:
        return None
    at, end = 12, 12 + int.from_bytes(start[10:12], "little")
    while at + 4 <= min(end, len(start)):
        name, size = start[at : at + 2], int.from_bytes(start[at + 2 : at + 4], "little")
        if name == b"sl" and size >= 4 and at + 8 <= len(start):
            return int.from_bytes(start[at + 4 : at + 8], "little")
        at += 4 + size
    return None


class Plain:
    """A plain archive file. ``inflated`` counts nothing; see Members."""

    inflated = 0

    def __init__(self, raw):
        self.source, self.end = io.BufferedReader(raw, 1 << 20), raw.size()
        self.readline, self.read = self.source.readline, self.source.read

    def skip(self, size: int) -> None:
        if self.source.tell() + size > self.end:
            raise ValueError("a record is cut off by the end of its file")
        self.source.seek(size, 1)


class Members:
    """A file of gzip members, inflated as far as it is read. ``inflated`` counts the bytes made."""

    def __init__(self, raw):
        self.source, self.end = io.BufferedReader(raw, 1 << 20), raw.size()
        self.start = self.inflated = 0
        self.packer, self.length, self.held, self.at = None, None, b"", 0

    def _more(self) -> bool:
        """Inflate some more, of the next member after the end of one; False at the end of the file."""
        while True:
            if self.packer is None or self.packer.eof:
                if self.packer is not None:
                    self.start = self.source.tell() - len(self.packer.unused_data)
                if self.start >= self.end:
                    return False
                self.source.seek(self.start)
                first = self.source.read(DEFLATED)
                self.packer, self.length = zlib.decompressobj(31), told_length(first)
                piece = self.packer.decompress(first, INFLATED)
            else:
                data = self.packer.unconsumed_tail or self.source.read(DEFLATED)
                piece = self.packer.decompress(data, INFLATED)
                if not data and not piece and not self.packer.eof:
                    raise ValueError("a record is cut off by the end of its file")
            if piece:
                self.inflated += len(piece)
                self.held, self.at = self.held[self.at :] + piece, 0
                return True

    def readline(self, most: int = -1) -> bytes:
        seen = self.at
        while (end := self.held.find(b"\n", seen)) < 0 and (most < 0 or len(self.held) - self.at < most):
            seen = len(self.held) - self.at
            if not self._more():
                break
        end = end + 1 if end >= 0 else len(self.held)
        end = min(end, self.at + most) if most >= 0 else end
        out, self.at = self.held[self.at : end], end
        return out

    def read(self, size: int) -> bytes:
        parts = []
        while size > 0 and (self.at < len(self.held) or self._more()):
            parts.append(self.held[self.at : self.at + size])
            self.at += len(parts[-1])
            size -= len(parts[-1])
        return b"".join(parts)

    def skip(self, size: int) -> None:
        """Pass over the rest of a record: to the next member, if this one tells its length, as it holds one record."""
        if self.length is not None and size > len(self.held) - self.at:
            self.start += self.length
            if self.start > self.end:
                raise ValueError("a record is cut off by the end of its file")
            self.packer, self.held, self.at = None, b"", 0
            return
        while size > 0:
            got = len(self.read(min(size, 1 << 20)))
            if not got:
                raise ValueError("a record is cut off by the end of its file")
            size -= got


def headers_of(stream) -> dict[str, str] | None:
    """The next record's headers with lower-case names, or None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a record's headers end with the file")
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcSource(DataSource):
    """Options: path; partitionBytes; payload (true to read payloads)."""

    @classmethod
    def name(cls) -> str:
        return "pathloom-warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns = dict(options), schema.names
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterator:
        """Takes over equality and IN on header columns; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else set()
            if name in HEADERS and values and None not in values:
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = filesystem(self.options["path"])
        from pyarrow import fs

        found = {f.base_name: f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))}
        manifests = [f for f in system.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}", allow_not_found=True)) if f.is_file]
        if manifests:  # written here: only what a job has committed
            listed: set[str] = set()
            for f in manifests:
                with system.open_input_file(f.path) as source:
                    listed |= set(json.loads(source.read()))
            found = {k: v for k, v in found.items() if k in listed}
        most, groups, size = int(self.options.get("partitionbytes", PARTITION_BYTES)), [[]], 0
        for f in sorted(found.values(), key=lambda f: f.base_name):
            if groups[-1] and size + f.size > most:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [Files(tuple(g)) for g in groups if g]

    def read(self, partition: Files | None) -> Iterator[tuple]:
        system, _ = filesystem(self.options["path"])
        with_payload = str(self.options.get("payload", "false")).lower() == "true" and "payload" in self.columns
        for path in partition.paths if partition else ():
            with system.open_input_file(path) as raw:
                source = Members(raw) if path.endswith(".gz") else Plain(raw)
                while (head := headers_of(source)) is not None:
                    row = {c: head.get(h) for c, h in HEADERS.items()}
                    row["page_id"] = int(row["page_id"]) if row["page_id"] else None
                    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
                    row["refers_to"] = head.get("x-refers-to-page-id", row["refers_to"])
                    left = int(head["content-length"])
                    if any(row[c] not in v for c, v in self.wanted.items()):
                        source.skip(left)
                        continue
                    if head.get("content-type", "").startswith("application/http"):
                        while left > 0 and (line := source.readline(left)):
                            left -= len(line)
                            name, _, value = line.partition(b":")
                            if line in (b"\r\n", b"\n"):
                                break
                            if name.lower() == b"content-length":
                                row["payload_bytes"] = int(value)
                        row.setdefault("payload_bytes", left)
                    else:
                        row["payload_bytes"] = left
                    if with_payload and row["record_type"] != "revisit":
                        row["payload"] = source.read(left)
                        if len(row["payload"]) < left:
                            raise ValueError(f"{path}: a record is cut off")
                    else:
                        source.skip(left)
                    yield tuple(row.get(c) for c in self.columns)


class WarcWriter(DataSourceWriter):
    """Rows of (page_id, url, payload string or binary, digest, first): see ``record``."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def write(self, iterator) -> Written:
        system, root = filesystem(self.options["path"])
        system.create_dir(root, recursive=True)
        date, files, out, size = self.options.get("date", "1970-01-01T00:00:00Z"), [], None, 0
        for row in iterator:
            if out is None or size > int(self.options.get("rollbytes", ROLL_BYTES)):
                if out is not None:
                    out.close()
                files.append(f"pages-{uuid.uuid4().hex}.warc.gz")
                out, size = system.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
            payload = row.payload.encode() if isinstance(row.payload, str) else bytes(row.payload or b"")
            packed = member(record(row.page_id, row.url, date, payload, digest(payload), row.first))
            out.write(packed)
            size += len(packed)
        if out is not None:
            out.close()
        return Written(tuple(files))

    def commit(self, messages) -> None:
        system, root = filesystem(self.options["path"])
        system.create_dir(f"{root}/{MANIFEST}", recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}/{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages) -> None:
        system, root = filesystem(self.options["path"])
        for name in (f for m in messages if m for f in m.files):
            system.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    # The processes that plan a source need not find this package, so that its classes travel whole.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(storage)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """A record for each row. Of equal payloads of least_bytes or more, the one with the smallest id is the response."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("key"))
    firsts = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"))
    # Few payloads come again: the join may be skewed on one that does often, which Spark splits.
    rows.join(firsts, "key", "left").select("page_id", "url", "payload", "first").write.format("pathloom-warc").mode("append").option("path", folder).save()


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    back = spark.read.format("pathloom-warc").option("partitionBytes", str(8 << 20)).load(folder)
    return back.filter(F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
