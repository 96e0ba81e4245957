"""WARC records packaged in ZIP archives: a writer, and a reader that never extracts.

The reader takes the end-of-central-directory record from the tail of a file (and, where that says so,
the ZIP64 locator and record), parses the central directory, finds stored members and their index, and
fetches each record by one range read. An archive holds ``archive/data.warc.gz`` (one gzip member a
record), ``indexes/index.cdxj`` (a JSON line a record: offset, length, id) and ``datapackage.json``.

Defined results: a null page counts as an empty payload; payloads under 1000 bytes are always
responses; of equal larger ones the largest page_id is the response (rows that repeat it are responses
too) and a page without an id revisits it, or is a response where no equal page has an id; an empty
table gives no archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare_python, scratch_path

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Bytes of records after which a task closes an archive and opens the next.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Fixed values of the ZIP format: signatures, and the marks of fields kept in ZIP64 records.
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MARK16, MARK32 = 0xFFFF, 0xFFFFFFFF


# --- records ---------------------------------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; ``payload`` is None for a revisit, whose HTTP header still gives the full size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, payload and its full size and digest, from the bytes of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(dict(x.split(b": ", 1) for x in http.lower().split(b"\r\n")[1:])[b"content-length"])

    def number(value: str | None) -> int | None:
        tail = (value or "").strip("<>").rpartition(":")[2]
        return None if tail in ("", "none") else int(tail)

    kind = headers["warc-type"]
    stated = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
    if kind == "response":
        if len(payload) != declared or hashlib.sha1(payload).hexdigest() != stated:
            raise ValueError(f"record {headers['warc-record-id']}: payload and digest differ")
    return {
        "page_id": number(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": declared,
        "payload_digest": stated,
        "refers_to": number(headers.get("warc-refers-to")),
    }


# --- archives --------------------------------------------------------------------------------------


class ArchiveWriter:
    """Builds one archive in memory, bounded by ``ARCHIVE_BYTES`` and the last record."""

    def __init__(self):
        self.data, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, record: bytes) -> None:
        member = gzip.compress(record, 5, mtime=0)
        self.index.append({"offset": self.data.tell(), "length": len(member), "page_id": page_id})
        self.data.write(member)

    def bytes(self, zip64: bool = False) -> bytes:
        out = io.BytesIO()
        lines = "".join(json.dumps(x) + "\n" for x in self.index).encode()
        package = json.dumps({"profile": "data-package", "resources": [{"path": DATA, "bytes": self.data.tell()}, {"path": INDEX, "bytes": len(lines)}]}).encode()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for name, body in ((DATA, self.data.getvalue()), (INDEX, lines), (PACKAGE, package)):
                with archive.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as member:
                    member.write(body)
        return out.getvalue()


class ZipDirectory:
    """The stored members of a ZIP file behind a ``read(offset, length)`` function, found without extraction."""

    def __init__(self, read, size: int):
        self.read, self.members = read, {}
        tail_from = max(0, size - (1 << 16) - 22)
        tail = read(tail_from, size - tail_from)
        at = tail.rfind(EOCD)
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail):
            at = tail.rfind(EOCD, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        ends = tail_from + at
        if MARK16 == count or MARK32 in (length, offset):
            locator = read(ends - 20, 20)
            if locator[:4] != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            ends = struct.unpack_from("<Q", locator, 8)[0]
            record = read(ends, 56)
            if record[:4] != EOCD64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, offset = struct.unpack_from("<QQQ", record, 32)
        self._central(read(offset, length), count)

    def _central(self, data: bytes, count: int) -> None:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, full, name_length, extra_length, comment_length = struct.unpack_from("<IIHHH", data, at + 20)
            offset = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + name_length].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + name_length : at + 46 + name_length + extra_length]
            full, packed, offset = self._zip64(extra, full, packed, offset)
            self.members[name] = (method, packed, full, offset)
            at += 46 + name_length + extra_length + comment_length

    @staticmethod
    def _zip64(extra: bytes, *fields: int) -> tuple[int, ...]:
        """Fields marked full in the entry stand in its ZIP64 extra field, in this order."""
        at, out = 0, list(fields)
        while at + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                place = at + 4
                for i, value in enumerate(out):
                    if value == MARK32:
                        out[i] = struct.unpack_from("<Q", extra, place)[0]
                        place += 8
            at += 4 + length
        return tuple(out)

    def stored(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many they are."""
        method, packed, _, offset = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; range reads need stored members")
        local = self.read(offset, 30)
        if local[:4] != LOCAL:
            raise ValueError("broken local header")
        name_length, extra_length = struct.unpack_from("<HH", local, 26)
        return offset + 30 + name_length + extra_length, packed


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


# --- Spark -----------------------------------------------------------------------------------------


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, size, digest, and what each refers to (null: a response).

    Only digests of groups move in the aggregate; a group's rows are combined where they lie.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", body.alias("body")).withColumns({"size": F.octet_length("body").cast("long"), "digest": F.sha1("body")})
    large = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1 and kept is not null").select("digest", "kept")
    refers = F.when((F.col("size") >= REVISIT_BYTES) & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return rows.join(large, "digest", "left").select("page_id", "url", "size", "digest", refers.alias("refers_to"), "body")


def write_archives(records: DataFrame, folder: str, zip64: bool = False) -> DataFrame:
    """Write archives under a shared ``folder``; returns the manifest (path, bytes, records).

    Names are unique to an attempt, and only files in the manifest count, so a retried task leaves
    nothing that is read twice.
    """
    prepare_python(records.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)

        def close(writer: ArchiveWriter) -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.wacz", writer.bytes(zip64)
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([len(data)], pa.int64()), pa.array([len(writer.index)], pa.int64())], names=["path", "bytes", "records"])

        writer = ArchiveWriter()
        for batch in batches:
            for row in batch.to_pylist():
                payload = None if row["refers_to"] is not None else row["body"]
                writer.add(row["page_id"], make_record(row["page_id"], row["url"], payload, row["size"], row["digest"], row["refers_to"]))
                if writer.data.tell() >= ARCHIVE_BYTES:
                    yield close(writer)
                    writer = ArchiveWriter()
        if writer.index:
            yield close(writer)

    return materialise(records.mapInArrow(run, "path string, bytes long, records long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives named by column ``path``, each fetched by one range read."""
    prepare_python(manifest.sparkSession)
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def flush(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in columns], names=columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = _open(path)
                with fs.open_input_file(name) as handle:
                    directory = ZipDirectory(lambda offset, length, h=handle: h.read_at(length, offset), handle.size())
                    start, length = directory.stored(INDEX)
                    base, _ = directory.stored(DATA)
                    rows, held = [], 0
                    for line in directory.read(start, length).splitlines():
                        entry = json.loads(line)
                        rows.append(parse_record(directory.read(base + entry["offset"], entry["length"])))
                        held += rows[-1]["payload_bytes"] if payloads else 0
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                    if rows:
                        yield flush(rows)

    return manifest.select("path").repartition(_tasks(manifest)).mapInArrow(run, schema)


def _tasks(manifest: DataFrame) -> int:
    return max(1, min(manifest.count(), 10_000))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back; the columns of the contract."""
    spark = pages.sparkSession
    manifest = write_archives(plan_records(pages), scratch_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
