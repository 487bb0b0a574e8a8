"""Writers of folders and ZIP archives from rows (file_entry, content), or (file_entry, path, entry, digest): then a task reads the
content from its place and copies it, and no row carries it.

Folder: each file is written beside its place under a temporary name and then renamed, so a reader sees whole files only;
nothing is overwritten; paths must stay within the root and lead through no link. ZIP: tasks stage parts, deflated; the commit
puts them behind each other in order of entry, exclusively, without inflating them, and removes the parts; a failure removes the archive.

Rows may carry a part number: the rows of such an entry are pieces of one file, which the commit puts together in order of part, a
piece at a time. So a report may have any number of lines, made by any number of tasks.

Both are Python data source writers: Spark runs `write` on executors and `commit` or `abort` once. The target must be a
folder that all machines see.
"""

from __future__ import annotations

import filecmp
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby
from operator import itemgetter
from typing import BinaryIO, NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.session import ready
from quarry.sources.contents import Contents

SCHEMA = "file_entry string, content binary, part long, path string, entry string, digest string"
COPY = 1 << 20


class ExportWriteError(OSError):
    """The target cannot be written: fatal for the whole export, unlike a failed unit."""


def safe(entry: str) -> bool:
    return bool(entry) and not any(c in entry for c in "\\:") and all(p not in ("", ".", "..") for p in entry.split("/"))


class Target:
    """A folder that is written to. Folders that were made or found sound are looked at once."""

    def __init__(self, root: str) -> None:
        self.root, self.sound = root, {root}

    def path(self, entry: str) -> str:
        """Where an entry goes; its folder is there then."""
        if not safe(entry):
            raise ExportWriteError(f"unsafe entry {entry!r}")
        path, at = os.path.normpath(os.path.join(self.root, entry)), self.root
        if not path.startswith(self.root + "/"):
            raise ExportWriteError(f"{entry!r} leaves the target")
        folder = os.path.dirname(path)
        if folder not in self.sound:
            for part in os.path.relpath(folder, self.root).split("/"):
                at = os.path.join(at, part)
                if os.path.islink(at):
                    raise ExportWriteError(f"{at} is a link")
            os.makedirs(folder, exist_ok=True)
            self.sound.add(folder)
        return path

    def put(self, entry: str, content: bytes | str) -> None:
        """content: bytes, or the path of a file to copy, of whatever size."""
        path = self.path(entry)
        part = f"{path}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "xb") as f:
                if isinstance(content, str):
                    with open(content, "rb") as source:
                        shutil.copyfileobj(source, f, COPY)
                else:
                    f.write(content)
            try:
                os.link(part, path)  # unlike a rename it refuses what is there
            except FileExistsError as e:
                # equal: another attempt of this very task wrote it, or it was there before
                if os.path.islink(path) or not os.path.isfile(path) or not filecmp.cmp(part, path, shallow=False):
                    raise ExportWriteError(f"{path} exists") from e
        finally:
            os.unlink(part)


def put(root: str, entry: str, content: bytes | str) -> None:
    Target(root).put(entry, content)


@dataclass
class Staged(WriterCommitMessage):
    place: str
    count: int


class Piece(NamedTuple):
    """A staged piece of an entry: where its deflated bytes are, and the checksum and size of what they hold."""

    entry: str
    part: int
    place: str
    offset: int
    length: int
    crc: int
    size: int


class Stage:
    """Staged bytes: a file for each task of (name length, part, deflated length, checksum, size), name and raw deflated content."""

    HEAD = struct.Struct("<IqQIQ")

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, rows: Iterator[Row]) -> Staged:
        place, n = f"{self.folder}/{uuid.uuid4().hex}", 0
        os.makedirs(self.folder, exist_ok=True)
        with open(place, "xb") as f, Contents() as contents:
            for row in rows:
                if not safe(row["file_entry"]):
                    raise ExportWriteError(f"unsafe entry {row['file_entry']!r}")
                name, part, at = row["file_entry"].encode(), -1 if row["part"] is None else row["part"], f.tell()
                f.write(self.HEAD.pack(len(name), part, 0, 0, 0) + name)
                length, crc, size, deflate = 0, 0, 0, zlib.compressobj(1, zlib.DEFLATED, -15)
                for data in self.pieces(row, contents):
                    out = deflate.compress(data)
                    f.write(out)
                    length, crc, size = length + len(out), zlib.crc32(data, crc), size + len(data)
                out = deflate.flush()
                f.write(out)
                f.seek(at)
                f.write(self.HEAD.pack(len(name), part, length + len(out), crc, size))
                f.seek(0, 2)
                n += 1
        return Staged(place, n)

    @staticmethod
    def pieces(row: Row, contents: Contents) -> Iterator[bytes]:
        if row["path"] is None:
            yield bytes(row["content"])
        elif row["entry"] is None and row["digest"] is None:
            with open(row["path"], "rb") as f:
                while data := f.read(COPY):
                    yield data
        else:
            yield contents.read(row["path"], row["entry"], row["digest"])

    def entries(self, messages: list[WriterCommitMessage | None]) -> Iterator[tuple[str, list[Piece]]]:
        """Entries in order, each with its pieces. Only the index is held; an entry of one row may not come twice."""
        index: list[Piece] = []
        for m in messages:
            if m is not None:
                with open(m.place, "rb") as f:
                    while head := f.read(self.HEAD.size):
                        n_name, part, n_body, crc, size = self.HEAD.unpack(head)
                        name = f.read(n_name).decode()
                        index.append(Piece(name, part, m.place, f.tell(), n_body, crc, size))
                        f.seek(n_body, 1)
        for name, pieces in groupby(sorted(index), key=itemgetter(0)):
            pieces = list(pieces)
            if len(pieces) > 1 and (pieces[0].part < 0 or len({p.part for p in pieces}) < len(pieces)):
                raise ExportWriteError(f"{name} twice")
            yield name, pieces

    @staticmethod
    def content(pieces: list[Piece]) -> Iterator[bytes]:
        """What the pieces hold, one behind the other, some at a time."""
        for p in pieces:
            inflate, left = zlib.decompressobj(-15), p.length
            with open(p.place, "rb") as f:
                f.seek(p.offset)
                while left:
                    data = f.read(min(COPY, left))
                    left -= len(data)
                    yield inflate.decompress(data)
            yield inflate.flush()

    def drop(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class FolderWriter(DataSourceWriter):
    def __init__(self, root: str, keep: bool, overwrite: bool, merge: bool = False) -> None:
        """merge: what is in the folder already stays, and equal files are left as they are."""
        self.root, self.keep, self.merge = os.path.normpath(os.path.abspath(root)), keep or merge, merge
        if overwrite and os.path.lexists(self.root):
            shutil.rmtree(self.root)
        if os.path.lexists(self.root) and (not merge or os.path.islink(self.root) or not os.path.isdir(self.root)):
            raise ExportWriteError(f"{self.root} exists")
        os.makedirs(self.root, exist_ok=True)
        self.stage = Stage(f"{self.root}.{uuid.uuid4().hex}.parts")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        target = Target(self.root)

        def pieces(contents: Contents) -> Iterator[Row]:
            for row in iterator:
                if row["part"] is not None:
                    yield row
                elif row["path"] is None:
                    target.put(row["file_entry"], bytes(row["content"]))
                elif row["entry"] is None and row["digest"] is None:
                    target.put(row["file_entry"], row["path"])
                else:
                    target.put(row["file_entry"], contents.read(row["path"], row["entry"], row["digest"]))

        with Contents() as contents:
            return self.stage.write(pieces(contents))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        try:
            target = Target(self.root)
            for name, pieces in self.stage.entries(messages):
                with open(target.path(name), "wb" if self.merge else "xb") as f:  # only reports come in pieces
                    f.writelines(self.stage.content(pieces))
        finally:
            self.stage.drop()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.stage.drop()
        if not self.keep:
            shutil.rmtree(self.root, ignore_errors=True)


class Archive:
    """A ZIP from deflated entries: headers, bytes as they are, and a central directory, in ZIP64 where sizes or places need it."""

    LOCAL, CENTRAL = struct.Struct("<4sHHHHHIIIHH"), struct.Struct("<4sHHHHHHIIIHHHHHII")
    FULL, MANY = 0xFFFFFFFF, 0xFFFF

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.directory = out, []

    def add(self, entry: str, pieces: list[Piece], stage: Stage) -> None:
        name, at = entry.encode(), self.out.tell()
        self.out.write(b"\0" * (self.LOCAL.size + len(name) + 20))
        if len(pieces) == 1:
            crc, size, length = pieces[0].crc, pieces[0].size, pieces[0].length
            with open(pieces[0].place, "rb") as f:
                f.seek(pieces[0].offset)
                left = length
                while left:
                    data = f.read(min(COPY, left))
                    self.out.write(data)
                    left -= len(data)
        else:  # a report: pieces become one stream
            crc, size, length, deflate = 0, 0, 0, zlib.compressobj(1, zlib.DEFLATED, -15)
            for data in chain(stage.content(pieces), (None,)):
                out = deflate.flush() if data is None else deflate.compress(data)
                crc, size, length = zlib.crc32(data or b"", crc), size + len(data or b""), length + len(out)
                self.out.write(out)
        end = self.out.tell()
        self.out.seek(at)
        extra = struct.pack("<HHQQ", 1, 16, size, length)
        self.out.write(self.LOCAL.pack(b"PK\3\4", 45, 0x800, 8, 0, 33, crc, self.FULL, self.FULL, len(name), len(extra)) + name + extra)
        self.out.seek(end)
        self.directory.append((name, crc, length, size, at))

    def close(self) -> None:
        begin = self.out.tell()
        for name, crc, length, size, at in self.directory:
            wide = [x for x in (size, length, at) if x >= self.FULL]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            size, length, at = (min(x, self.FULL) for x in (size, length, at))
            self.out.write(self.CENTRAL.pack(b"PK\1\2", 45, 45, 0x800, 8, 0, 33, crc, length, size, len(name), len(extra), 0, 0, 0, 0, at) + name + extra)
        end, n = self.out.tell(), len(self.directory)
        if n >= self.MANY or end >= self.FULL:
            self.out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, end - begin, begin) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self.out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, min(n, self.MANY), min(n, self.MANY), min(end - begin, self.FULL), min(begin, self.FULL), 0))


class ZipWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = os.path.abspath(path)
        if os.path.lexists(self.path):
            raise ExportWriteError(f"{self.path} exists")
        self.stage = Stage(f"{self.path}.{uuid.uuid4().hex}.parts")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return self.stage.write(iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        made = False
        try:
            with open(self.path, "xb") as out:
                made = True
                archive = Archive(out)
                for name, pieces in self.stage.entries(messages):
                    archive.add(name, pieces, self.stage)
                archive.close()
        except FileExistsError as e:
            raise ExportWriteError(f"{self.path} exists") from e
        except BaseException:
            if made:
                os.unlink(self.path)
            raise
        finally:
            self.stage.drop()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.stage.drop()


class ExportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_export"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if self.options.get("format", "directory") == "zip":
            return ZipWriter(self.options["target"])
        yes = lambda k: self.options.get(k, "false").lower() == "true"
        return FolderWriter(self.options["target"], yes("keep_completed"), yes("recreate"), yes("merge"))


def export(rows: DataFrame, target: str, format: str = "directory", keep_completed: bool = False, recreate: bool = False, merge: bool = False) -> None:
    """Write rows of SCHEMA; but for file_entry, columns may be missing. keep_completed: files that are whole stay when the job fails.
    recreate: an existing folder is deleted first, which must be asked for. merge: an existing folder is added to."""
    spark: SparkSession = rows.sparkSession
    ready(spark).dataSource.register(ExportSink)
    o = {"target": target, "format": format, "keep_completed": str(keep_completed), "recreate": str(recreate), "merge": str(merge)}
    columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMA).fields]
    rows.select(*columns).write.format("artifact_export").mode("append").options(**o).save()


def next_free(parent: str, name: str, extension: str = "") -> str:
    """name, name-2, name-3, …: the first that nothing stands at."""
    path, n = os.path.join(parent, name + extension), 2
    while os.path.lexists(path):
        path, n = os.path.join(parent, f"{name}-{n}{extension}"), n + 1
    return path
