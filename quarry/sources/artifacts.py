"""The `artifacts` data source: class files in folders, archives and archives within archives.

A row for each class entry that is found, also for those that are filtered or broken, so that every count can be taken from the
rows: status is ok, filtered, error or warning. The header of a class is parsed first, rules that are given as
options are applied to its true name, and only what they accept is read to its end and digested.

Spark's binaryFile source would drop names that start with . or _ and follow links, so folders are walked here: links are
never followed, each path is read once, and folders are left out by mode:

    registered  libraries as listed: .git .hg .svn and the output folder are left out
    loose       all class files of a project: .git .hg .svn and earlier collections are left out
    jars        all archives of a project: hidden folders, node_modules, target, build and earlier collections are left out

An input partition is a batch of loose files, or of archives that have BATCH_BYTES together; a larger archive is one of its own.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from collections.abc import Iterator
from concurrent.futures import Executor, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quarry.functions.classfile import ClassFormatError, Header, Truncated, enclosing_class
from quarry.functions.rules import Rule, accepts_name, tokenize
from quarry.session import ready

SCHEMA = "path string, entry string, depth int, origin string, grp string, name string, parent string, digest string, size long, status string, error string, content binary"
# Limits and folder names.
MAX_CLASS, MAX_NESTED, MAX_DEPTH, BATCH = 64 << 20, 512 << 20, 8, 40
BATCH_BYTES, LISTERS = 4 << 20, 16
COLLECTED = "all-in-one"
VERSION_CONTROL = frozenset((".git", ".hg", ".svn"))
BUILD = frozenset(("node_modules", "target", "build", COLLECTED))


@dataclass
class Files(InputPartition):
    paths: list[str]


def skipped(mode: str, name: str) -> bool:
    if mode == "jars":
        return name.startswith(".") or name in BUILD
    return name in VERSION_CONTROL or (mode == "loose" and name == COLLECTED)


def listed(folder: str) -> tuple[list[tuple[str, str]], list[str], str | None]:
    """(folders (path, name), regular files, why it cannot be listed). Links are neither."""
    folders, files = [], []
    try:
        with os.scandir(folder) as it:
            for e in it:
                if e.is_dir(follow_symlinks=False):
                    folders.append((e.path, e.name))
                elif e.is_file(follow_symlinks=False):
                    files.append(e.path)
    except OSError as e:
        return [], [], f"{type(e).__name__}: {e}"
    return folders, files, None


def walk(root: str, mode: str, output: str | None, seen: set[str], problems: list[tuple[str, str]], threads: Executor) -> Iterator[str]:
    """Regular files below root, without links, a level of folders at a time. seen: folders that another root has led to."""
    level = [root]
    while level:
        fresh = []
        for folder in level:
            real = os.path.normpath(folder)
            if real not in seen and not (output and (real == output or real.startswith(output + "/"))):
                seen.add(real)
                fresh.append(folder)
        level = []
        for folder, (folders, files, problem) in zip(fresh, threads.map(listed, fresh), strict=True):
            if problem:
                problems.append((folder, problem))
            level += [path for path, name in folders if not skipped(mode, name)]
            yield from files


def kind_of(path: str) -> str:
    low = path.lower()
    return "class" if low.endswith(".class") else "jar" if low.endswith(".jar") else ""


def discover(roots: list[str], mode: str, output: str | None) -> tuple[list[str], list[tuple[str, str]]]:
    """(files, problems): each file once, by path."""
    seen: set[str] = set()
    found: set[str] = set()
    problems: list[tuple[str, str]] = []
    wanted = {"registered": ("class", "jar"), "loose": ("class",), "jars": ("jar",)}[mode]
    with ThreadPoolExecutor(LISTERS) as threads:
        for root in sorted({os.path.normpath(r) for r in roots}):
            if os.path.islink(root):
                continue
            if os.path.isdir(root):
                found.update(f for f in walk(root, mode, output, seen, problems, threads) if kind_of(f) in wanted)
            elif os.path.isfile(root):
                found.update((root,) if kind_of(root) in wanted else ())
            else:
                problems.append((root, "FileNotFoundError: no such library"))
    return sorted(found), problems


def label(path: str, project: str) -> str:
    if path == project:
        return ""
    if path.startswith(project + "/"):
        return path[len(project) + 1 :]
    return "external/" + "/".join([p for p in path.split("/") if p][-4:])


class Counted:
    """A stream that knows how much has been read from it."""

    def __init__(self, stream: io.BufferedIOBase) -> None:
        self.stream, self.total = stream, 0

    def read(self, n: int) -> bytes:
        out = self.stream.read(n)
        self.total += len(out)
        return out


def read_class(stream: Counted, allow: list[Rule], deny: list[Rule], with_content: bool = True) -> tuple[str, str | None, str | None, int | None, str, bytes | None]:
    """(name, parent, digest, size, status, content). Raises ClassFormatError, or ValueError beyond MAX_CLASS."""
    data, step = b"", 8192
    while True:
        more = stream.read(step)
        data += more
        try:
            header = Header(data)
            break
        except Truncated:
            if not more:
                raise
        if len(data) > MAX_CLASS:
            raise ValueError("class larger than 64 MiB")
        step *= 2
    if not accepts_name(header.name, allow, deny):
        return header.name, None, None, None, "filtered", None
    parts, size = [data], len(data)
    while more := stream.read(1 << 20):
        parts.append(more)
        size += len(more)
        if size > MAX_CLASS:
            raise ValueError("class larger than 64 MiB")
    data = b"".join(parts)
    if len(data) > MAX_CLASS:
        raise ValueError("class larger than 64 MiB")
    try:
        parent = enclosing_class(data)
    except ClassFormatError:
        parent = None  # left to the engine
    return header.name, parent, hashlib.sha256(data).hexdigest(), size, "ok", data if with_content else None


class ArtifactReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = json.loads(options["roots"])
        self.mode = options.get("mode", "registered")
        self.project = os.path.normpath(options.get("project", "/"))
        self.output = os.path.normpath(options["output"]) if options.get("output") else None
        self.allow, self.deny = ([Rule(x) for x in tokenize(options.get(k, ""))] for k in ("allow", "deny"))
        self.content = options.get("content", "true").lower() == "true"
        if self.mode not in ("registered", "loose", "jars"):
            raise ValueError(f"mode {self.mode}")

    def partitions(self) -> list[InputPartition]:
        files, problems = discover(self.roots, self.mode, self.output)
        loose = [f for f in files if kind_of(f) == "class"]
        out: list[InputPartition] = [Files(loose[i : i + BATCH]) for i in range(0, len(loose), BATCH)]
        held, size = [], 0
        for f in files:
            if kind_of(f) == "jar":
                own = os.path.getsize(f) if os.path.exists(f) else 0
                if held and (size + own > BATCH_BYTES or len(held) >= BATCH):
                    out.append(Files(held))
                    held, size = [], 0
                held, size = [*held, f], size + own
        if held:
            out.append(Files(held))
        if problems:
            out.append(Files([f"\0{p}\0{why}" for p, why in problems]))
        return out or [Files([])]

    def row(self, path: str, entry: str | None, depth: int, origin: str, grp: str, stream: io.BufferedIOBase) -> tuple:
        try:
            name, parent, digest, size, status, content = read_class(Counted(stream), self.allow, self.deny, self.content)
            return path, entry, depth, origin, grp, name, parent, digest, size, status, None, content
        except Exception as e:  # one broken class is a row, not a failed scan
            return path, entry, depth, origin, grp, None, None, None, None, "error", f"{type(e).__name__}: {e}", None

    def problem(self, path: str, entry: str | None, depth: int, origin: str, why: str) -> tuple:
        return path, entry, depth, origin, None, None, None, None, None, "warning", why, None

    def archive(self, path: str, source: str | io.BytesIO, name: str, depth: int, chain: str | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(source) as z:
                for info in z.infolist():
                    kind, origin = kind_of(info.filename), f"{name}!/{info.filename}"
                    inner = f"{chain}!/{info.filename}" if chain else info.filename
                    if info.is_dir() or not kind:
                        continue
                    if kind == "class":
                        try:
                            with z.open(info) as f:
                                yield self.row(path, inner, depth, origin, name, f)
                        except Exception as e:
                            yield path, inner, depth, origin, name, None, None, None, None, "error", f"{type(e).__name__}: {e}", None
                    elif depth >= MAX_DEPTH:
                        yield self.problem(path, inner, depth, origin, f"archives are nested more than {MAX_DEPTH} deep")
                    else:
                        try:
                            with z.open(info) as f:
                                data = f.read(MAX_NESTED + 1)
                            if len(data) > MAX_NESTED:
                                raise ValueError("nested archive larger than 512 MiB")
                            nested = io.BytesIO(data)
                        except Exception as e:
                            yield self.problem(path, inner, depth, origin, f"{type(e).__name__}: {e}")
                            continue
                        yield from self.archive(path, nested, origin, depth + 1, inner)
        except Exception as e:
            yield self.problem(path, chain, depth, name, f"{type(e).__name__}: {e}")

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            if path.startswith("\0"):
                _, p, why = path.split("\0", 2)
                yield self.problem(p, None, 0, label(p, self.project), why)
            elif kind_of(path) == "class":
                where = label(path, self.project)
                try:
                    with open(path, "rb") as f:
                        yield self.row(path, None, 0, where, label(os.path.dirname(path), self.project), f)
                except OSError as e:
                    yield self.problem(path, None, 0, where, f"{type(e).__name__}: {e}")
            elif self.mode == "jars":
                yield path, None, 0, label(path, self.project), None, os.path.basename(path), None, None, os.path.getsize(path), "ok", None, None
            else:
                yield from self.archive(path, path, label(path, self.project), 0, None)


class ArtifactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArtifactReader({k: v for k, v in self.options.items()})


def scan(spark: SparkSession, roots: list[str], **options: str) -> DataFrame:
    """Rows of SCHEMA. options: mode, project, output, allow, deny, content."""
    if not roots:
        raise ValueError("no libraries are registered: nothing is scanned, and no target is touched")
    ready(spark).dataSource.register(ArtifactSource)
    return spark.read.format("artifacts").options(roots=json.dumps(list(roots)), **options).load()
