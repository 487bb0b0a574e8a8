"""WARC records in ZIP packages: a writer, and a reader that works by ranges.

An archive is a ZIP file whose members are stored, not deflated: `archive/data.warc` and `indexes/index.cdxj`, a line for
each record with its offset and length. The reader finds the end record (and the ZIP64 records where they
are), parses the central directory, locates the data of a member behind its local header, and reads the index: a row for each
record, its archive, offset and length. These rows are dealt to tasks by archive and SPAN, so that a large archive is read by many, and each
record is then read from its file by its range; nothing is extracted, and no archive is held whole. Every access
goes through `read(offset, length)`, of a file in any store that Arrow's file systems know, or of bytes in memory.

Archives are written to a folder that all machines share. A task that is run again writes files of other names, and only those of
the run that counts are in the result.

Of records with equal payloads of MIN_REVISIT bytes or more, the one with the smallest page id is the response and
the others are revisits, which keep the payload's digest and length in their headers.

Defined cases: a null html is an empty payload; a null url is empty; rows that repeat the smallest page id of their
payload are responses, each; a page without an id is a revisit if a page with an id has its payload, else a
response; an empty table makes no archive; columns other than the three named are ignored; a package with records but without an
index that can be read is an error.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import base

MIN_REVISIT = 100
#: An archive is closed when its records reach so many bytes; records of so many bytes of an archive are read by one task.
ARCHIVE_BYTES, SPAN = 8 << 20, 64 << 20
DATA, INDEX = "archive/data.warc", "indexes/index.cdxj"
PLACE = "archive string, offset long, length long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
Reader = Callable[[int, int], bytes]


# ---- records ------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """first: the page whose response has this payload, if this is to be a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8").split("\r\n")[1:])}


def parse(raw: bytes) -> tuple:
    """A record's bytes (plain or a gzip member) to a row of RECORD."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record at this range")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda x: int(x[len("<urn:page:") : -1]) if x else None
    said, length = warc["warc-payload-digest"].removeprefix("sha256:"), int(_headers(http)["content-length"])
    kind = warc["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != said):
        raise ValueError("a payload differs from its digest")
    return page(warc.get("warc-record-id")), warc["warc-target-uri"], payload if kind == "response" else None, length, said, kind, page(warc.get("warc-refers-to"))


# ---- packages -----------------------------------------------------------------------------------------------


def package(records: list[tuple[bytes, dict]]) -> bytes:
    """A ZIP of stored members from (record, index entry)s."""
    out, at, lines = io.BytesIO(), 0, []
    for raw, entry in records:
        lines.append(json.dumps(entry | {"offset": at, "length": len(raw), "filename": DATA.rpartition("/")[2]}))
        at += len(raw)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open(zipfile.ZipInfo(DATA, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
            for raw, _ in records:
                f.write(raw)
        z.writestr(zipfile.ZipInfo(INDEX, (1980, 1, 1, 0, 0, 0)), "\n".join(lines) + "\n")
    return out.getvalue()


def ranges(source: bytes | pa.NativeFile) -> tuple[Reader, int]:
    """(read, size) over bytes or a file of Arrow's."""
    if isinstance(source, pa.NativeFile):
        return lambda at, n: source.read_at(n, at), source.size()
    return lambda at, n: bytes(source[at : at + n]), len(source)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path within it."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class Package:
    """The members of a ZIP, by name: (offset of the local header, size, method)."""

    def __init__(self, read: Reader, size: int) -> None:
        self.read = read
        tail_at = max(0, size - 22 - 65535)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the mark can also stand in a comment
        if end < 0:
            raise ValueError("no end of central directory")
        entries, length, at = struct.unpack_from("<HII", tail, end + 10)
        end_at = tail_at + end
        directory_end = end_at
        if end_at >= 20 and (locator := read(end_at - 20, 20))[:4] == b"PK\x06\x07":
            at64 = struct.unpack_from("<Q", locator, 8)[0]
            record64 = read(at64, 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory where its locator says")
            entries, length, at = struct.unpack_from("<QQQ", record64, 32)
            directory_end = at64
        shift = directory_end - length - at  # bytes that stand before the first member, in a self-extracting archive
        if shift < 0:
            raise ValueError("the central directory does not fit")
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, p = read(at + shift, length), 0
        for _ in range(entries):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            flags, method = struct.unpack_from("<HH", directory, p + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
            local = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
            e = 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # ZIP64: the fields that did not fit, in this order
                    q = e + 4
                    if plain == 0xFFFFFFFF:
                        plain, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                    if packed == 0xFFFFFFFF:
                        packed, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                    if local == 0xFFFFFFFF:
                        local = struct.unpack_from("<Q", extra, q)[0]
                e += 4 + n
            self.members[name] = (local + shift, packed, method)
            p += 46 + n_name + n_extra + n_comment

    def place(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's data in the archive."""
        at, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed: its records have no ranges")
        local = self.read(at, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return at + 30 + n_name + n_extra, size

    def places(self) -> Iterator[tuple[int, int]]:
        """(offset in the archive, length) of every record that an index names."""
        found = False
        for index in sorted(x for x in self.members if x.startswith("indexes/") and x.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz"))):
            found, lines = True, self.read(*self.place(index))
            for line in (gzip.decompress(lines) if lines[:2] == b"\x1f\x8b" else lines).splitlines():
                if b"{" not in line:  # a header
                    continue
                entry = json.loads(line[line.index(b"{") :])
                at, size = self.place("archive/" + entry["filename"])
                offset, length = int(entry["offset"]), int(entry["length"])
                if not 0 <= offset <= offset + length <= size:
                    raise ValueError("a range beyond its member")
                yield at + offset, length
        if not found and any(x.startswith("archive/") for x in self.members):
            raise ValueError("records without an index")

    def records(self) -> Iterator[bytes]:
        """Every record that an index names, read by its range."""
        for at, length in self.places():
            yield self.read(at, length)


# ---- DataFrames ---------------------------------------------------------------------------------------------


def write(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, n_records): the files written from pages (page_id, url, html), a ZIP package for about every ARCHIVE_BYTES of a task's rows."""
    spark = base.ready(pages.sparkSession)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # Only digests that several records have are looked up; where these take few bytes, payloads stay where they are, else they
    # move by digest, but for the digests that many records have.
    many = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    many = base.materialise(many.filter("n > 1 and first is not null").select(F.col("digest").alias("twin"), "first", "n"))
    if base.size_of(many) <= base.BROADCAST_BYTES:
        rows = rows.join(F.broadcast(many.drop("n")), F.col("digest") == F.col("twin"), "left")
    else:
        rows = base.looked_up(rows, "digest", many, "twin", "n")
    rows = rows.select("page_id", "url", "payload", "digest", F.when((F.octet_length("payload") >= MIN_REVISIT) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))
    folder = f"{base.scratch(spark)}/quarry-warc-{uuid.uuid4().hex}"
    base.made("folder", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size = TaskContext.get().partitionId(), [], 0
        where, path = store(folder)
        where.create_dir(path)

        def close() -> pa.RecordBatch:
            name = f"part-{task:06d}-{uuid.uuid4().hex}.zip"
            with where.open_output_stream(f"{path}/{name}") as f:
                f.write(package(held))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], names=["archive", "n_records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, body, digest, first = (c[i].as_py() for c in batch.columns)
                raw = record(page_id, url, body, digest, first, date)
                held.append((raw, {"url": url, "digest": f"sha256:{digest}", "type": "response" if first is None else "revisit"}))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return base.materialise(rows.mapInArrow(run, "archive string, n_records long"))


def indexed(archives: DataFrame) -> DataFrame:
    """Rows of PLACE, one for each record, from the indexes of archives (archive: a path or URI)."""
    base.ready(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, path = store(name)
                with where.open_input_file(path) as f:
                    places = list(Package(*ranges(f)).places())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(places), pa.string()), *[pa.array([x[i] for x in places], pa.int64()) for i in (0, 1)]], names=["archive", "offset", "length"])

    return archives.filter("archive is not null").select("archive").mapInArrow(run, PLACE)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Rows of RECORD from archives (archive: a path or URI)."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, at, rows = None, "", []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != at:
                    if opened:
                        opened.close()
                    where, path = store(name)
                    opened, at = where.open_input_file(path), name
                row = parse(ranges(opened)[0](offset, length))
                rows.append(row if payloads else (*row[:2], None, *row[3:]))
                if len(rows) == 256:
                    yield table()
                    rows = []
        if opened:
            opened.close()
        yield table()

    places = indexed(archives).repartition("archive", (F.col("offset") / SPAN).cast("long")).sortWithinPartitions("archive", "offset")
    return places.mapInArrow(run, RECORD)


def op7_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(base.read(spark, sf_dir, "pages")), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
