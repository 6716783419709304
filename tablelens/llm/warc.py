"""WARC archives as a PySpark data source.

Writing: a gzip member per record, whose extra field holds its length, in one file per task; a file gets its final name
only when the job commits, so lost or repeated tasks leave nothing behind. Reading: files are planned into partitions,
predicates on the record type and other headers are pushed down, headers are parsed first, and the payload of a record
that is not wanted is skipped unread where the archive allows a seek, else unpacked and dropped piece by piece.

Archives of other writers: plain ones, a gzip member for each record, or several records to a member. The record's and the
original's WARC ids stand for ids; the HTTP headers of a captured message are no payload; their digests are given as they stand.

Edge cases: a null payload is empty; a null url or id leaves out the header; ids come back as strings, extra columns are
refused by the writer; an empty table writes no file and reads back as no rows; rows that repeat the smallest id of a
payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import materialize, text_of, work_dir

SCHEMA = "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Column and header of what a record says of itself; X- headers are this writer's own.
HEADERS = {"record_id": "X-Record-Key", "record_type": "WARC-Type", "url": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "refers_to": "X-Refers-To-Key"}
#: Where other writers' archives say it.
FOREIGN = {"record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To"}
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 8 << 20
#: Archives are read and unpacked by pieces of this size; headers are at most so long.
CHUNK, HEADER_BYTES = 64 << 10, 1 << 20
#: Files are packed into partitions of about this size.
PARTITION_BYTES = 64 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow opens; a path without scheme is local."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _quoted(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unquoted(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(row: dict, payload: bytes) -> bytes:
    """One WARC record as a gzip member that tells its own length."""
    kind, body = row["record_type"], payload if row["record_type"] == "response" else b""
    said = {"payload_digest": "sha1:" + digest(payload), "payload_bytes": str(len(payload))} | {k: _quoted(str(row[k])) for k in ("record_id", "record_type", "url", "refers_to") if row.get(k) is not None}
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{said.get('record_id')} {said.get('url')} {said['payload_digest']} {kind}")
    lines = ["WARC/1.1", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}", *(f"{HEADERS[k]}: {v}" for k, v in said.items()), *([f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []), "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    plain = "\r\n".join([*lines, "", ""]).encode() + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(plain) + packer.flush()
    # the gzip header with the extra field "sl": the member's packed and plain lengths
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, len(packed), len(plain) & 0xFFFFFFFF) + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class Plain:
    """Bytes of a file from a position on. What is skipped is not read."""

    def __init__(self, source, at: int):
        self.source, self.at = source, at

    def more(self) -> bytes:
        self.source.seek(self.at)
        got = self.source.read(CHUNK)
        self.at += len(got)
        return got

    def skip(self, n: int) -> int:
        self.at += n
        return n


class Packed:
    """The plain bytes of the gzip member at a position, unpacked a piece at a time. At its end ``at`` is where the next one begins."""

    def __init__(self, source, at: int):
        self.source, self.at, self.unpack, self.rest = source, at, zlib.decompressobj(31), b""

    def more(self) -> bytes:
        while not self.unpack.eof:
            if not self.rest:
                self.source.seek(self.at)
                self.rest = self.source.read(CHUNK)
                self.at += len(self.rest)
                if not self.rest:
                    raise ValueError("the archive ends within a gzip member")
            out = self.unpack.decompress(self.rest, CHUNK)
            self.rest = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.at -= len(self.unpack.unused_data)
            if out:
                return out
        return b""

    def skip(self, n: int) -> int:
        return 0


class Cursor:
    """Reads over pieces, of which it holds one and what is asked for."""

    def __init__(self, pieces: Plain | Packed):
        self.pieces, self.held = pieces, b""

    def _more(self) -> bool:
        got = self.pieces.more()
        self.held += got
        return bool(got)

    def until(self, mark: bytes, most: int) -> bytes | None:
        """What comes before the mark, which is passed; None if the bytes end first."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > most:
                raise ValueError(f"no end of headers in {most} bytes")
            if not self._more():
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        parts, size = [], 0
        while size < n:
            if not self.held and not self._more():
                raise ValueError("a record ends within its payload")
            parts.append(self.held[: n - size])
            self.held = self.held[len(parts[-1]) :]
            size += len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.held:
                n -= self.pieces.skip(n)
                if n <= 0:
                    return
                if not self._more():
                    raise ValueError("a record ends within its payload")
            gone = min(n, len(self.held))
            self.held, n = self.held[gone:], n - gone

    def past_breaks(self) -> bool:
        """Passes line breaks between records; False at the end."""
        while not self.held.lstrip(b"\r\n"):
            self.held = b""
            if not self._more():
                return False
        self.held = self.held.lstrip(b"\r\n")
        return True


class Record:
    """A record whose headers are read and whose payload is read if asked for, else skipped."""

    def __init__(self, cursor: Cursor):
        head = cursor.until(b"\r\n\r\n", HEADER_BYTES)
        if head is None:
            raise ValueError("a record ends within its headers")
        self.cursor, self.headers = cursor, parse_headers(head)
        self.length = self.left = int(self.headers.get("content-length", 0))
        self._http = "application/http" in self.headers.get("content-type", "") and self.headers.get("warc-type") in ("response", "revisit", "request")

    def _past_http(self) -> None:
        """A captured HTTP message has headers of its own, which are no payload."""
        if self._http:
            self._http = False
            inner = Cursor(_Part(self))
            inner.until(b"\r\n\r\n", self.length)
            self.cursor.held, self.left = inner.held + self.cursor.held, self.left + len(inner.held)
            self.length = self.left

    @property
    def payload_bytes(self) -> int:
        self._past_http()
        return self.length

    def payload(self) -> bytes:
        self._past_http()
        got, self.left = self.cursor.take(self.left), 0
        return got

    def close(self) -> None:
        self.cursor.skip(self.left)
        self.left = 0


class _Part:
    """The pieces of one record's block."""

    def __init__(self, one: Record):
        self.one = one

    def more(self) -> bytes:
        one = self.one
        if one.left and not one.cursor.held:
            one.cursor._more()
        got = one.cursor.take(min(one.left, len(one.cursor.held)))
        one.left -= len(got)
        return got


def records(source, size: int) -> Iterator[Record]:
    """The records of an archive, packed or plain, one or many to a gzip member.

    A member that tells its packed length and holds one record, as this writer's do, is left by a seek; any other is unpacked
    piece by piece, and what is not wanted of it is dropped on the way.
    """
    at = 0
    while at < size:
        source.seek(at)
        head = source.read(24)
        packed = head.startswith(b"\x1f\x8b")
        end = None
        if packed and len(head) == 24 and head[3] == 4 and head[12:14] == b"sl":
            packed_len, plain_len = struct.unpack("<II", head[16:24])
            end = at + 12 + struct.unpack("<H", head[10:12])[0] + packed_len + 8
        pieces = Packed(source, at) if packed else Plain(source, at)
        cursor = Cursor(pieces)
        first = True
        while cursor.past_breaks():
            one = Record(cursor)
            yield one
            # the headers' length is not kept: a lone record's member ends with its payload and two line breaks
            if end is not None and first and one.headers.get(HEADERS["payload_bytes"].lower()) is not None:
                break
            first = False
            one.close()
        if not packed:
            return
        at = end if end is not None and first else pieces.at


@dataclass
class Files(InputPartition):
    paths: tuple[tuple[str, int], ...]


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    rows: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.want = options["path"], options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality on headers is tested before a payload is read; all else stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.attribute[0] != "payload_bytes":
                self.tests.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            elif not (isinstance(f, IsNotNull) and any(f.attribute == (k,) for k, _ in self.tests)):
                yield f

    def partitions(self):
        fs, path = filesystem(self.path)
        found = sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz")))
        packs: list[list[tuple[str, int]]] = []
        room = 0
        for name, size in found:
            if not packs or size > room:
                packs.append([])
                room = PARTITION_BYTES
            packs[-1].append((name, size))
            room -= size
        return [Files(tuple(p)) for p in packs] or [Files(())]

    def read(self, partition: Files):
        fs, _ = filesystem(self.path)
        rows: list[dict] = []
        held = 0
        for name, size in partition.paths:
            with fs.open_input_file(name) as source:
                for one in records(source, size):
                    own = HEADERS["payload_bytes"].lower() in one.headers
                    row = {k: one.headers.get(h.lower()) for k, h in HEADERS.items()}
                    row = {k: None if v is None else _unquoted(v) if own else v for k, v in row.items()}
                    for k, h in FOREIGN.items():
                        row[k] = one.headers.get(h.lower()) if row[k] is None and not own else row[k]
                    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
                    if any(row[k] not in some for k, some in self.tests):
                        continue
                    row["payload_bytes"] = int(row["payload_bytes"]) if own else one.payload_bytes
                    row["payload"] = None
                    if self.want and row["record_type"] != "revisit":
                        row["payload"] = one.payload()
                        if own and row["payload_digest"] and digest(row["payload"]) != row["payload_digest"]:
                            raise ValueError(f"{name}: the payload of {row['record_id']} does not fit its digest")
                    rows.append(row)
                    held += len(row["payload"] or b"") + 300
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        fs, path = filesystem(self.path)
        name, rows, out = f"{path}/.{uuid.uuid4().hex}.tmp", 0, None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(name)
                out.write(record(row, row["payload"] or b""))
                rows += 1
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages):
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(path)):
                if x.is_file and x.base_name.endswith(".warc.gz"):
                    fs.delete_file(x.path)
        for m in messages:
            if m is not None and m.path:
                fs.move(m.path, f"{path}/{m.path.rpartition('/')[2][1:-4]}.warc.gz")

    def abort(self, messages):
        fs, _ = filesystem(self.path)
        for m in messages:
            if m is not None and m.path:
                fs.delete_file(m.path)


class WarcDataSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(folder); df.write.format("warc").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        if missing := {"record_id", "record_type", "url", "refers_to", "payload"} ^ set(schema.fieldNames()):
            raise ValueError(f"columns missing or not known: {sorted(missing)}")
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: Repeated payloads are broadcast to the pages up to this many; beyond, Spark joins by a shuffle.
REPEATS = 200_000


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Rows for the writer: of pages with equal payloads of at least min_bytes, that with the smallest id is a response and the others revisit it.

    Only digests and ids are shuffled to find repeats, summed before the shuffle, so that no payload's copies meet in one task.
    """
    payload = F.encode(text_of(text_col), "UTF-8")
    key = [F.sha2(payload, 256).alias("_sha"), F.octet_length(payload).alias("_n")]
    ids = pages.select(F.col(id_col).alias("_id"), *key).filter(F.col("_n") >= min_bytes)
    repeats = ids.groupBy("_sha", "_n").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("_sha", "_n", "_first")
    repeats = materialize(repeats, f"{folder or work_dir(pages.sparkSession)}/repeats")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), *key)
    joined = rows.join(F.broadcast(repeats) if repeats.count() <= REPEATS else repeats, ["_sha", "_n"], "left")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    return joined.select(F.col("_id").cast("string").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "url", F.when(again, F.col("_first")).cast("string").alias("refers_to"), "payload")


def archive(pages: DataFrame, path: str, **options) -> None:
    """Writes all pages as WARC files into the folder."""
    register(pages.sparkSession)
    with_revisits(pages, **options).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
