"""Transforms of whole families: the contract, failure capture, and a stand-in engine.

Native decompilers live in closed runtimes and are not part of this repository; any callable with the contract of
Engine can take their place. The built-in engine prints a summary of the parsed headers, which is enough to exercise
every path: one output per family, warnings, partial sources, failures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import CancelledError
from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.sources.contents import Contents

UNIT_RESULT = "unit string, source string, warnings array<string>, issues array<struct<internal_name:string,error_type:string,reason:string>>, error_type string, error string"
PARTIAL = "NativePartialSource"
#: What a partial source's end-of-line comment starts with and says.
MARK, FAILED, LIMITS, EXCEEDED = "// $FF:", "couldn't be decompiled", "Limits for ", " are exceeded."


@dataclass
class Member:
    name: str
    origin: str
    digest: str
    content: bytes


@dataclass
class Output:
    source: str
    warnings: list[str] = field(default_factory=list)
    issues: list[tuple[str | None, str, str]] = field(default_factory=list)


@dataclass
class Engine:
    """transform: one call for a whole family, its root first. merges: whether it takes more than one class at a time.
    parallelism_hint: how many calls it can bear, None or not positive: no opinion. needs_siblings: it reads what is nested in a class
    from the files beside it, so a family fails if one of these was not selected. opened and closed: called around a task's units."""

    transform: Callable[[list[Member]], Output]
    merges: bool = True
    parallelism_hint: int | None = None
    requires: Callable[[], None] | None = None  # raises if the engine cannot run here
    needs_siblings: bool = False
    opened: Callable[[], None] | None = None
    closed: Callable[[], None] | None = None

    @property
    def hint(self) -> int | None:
        return self.parallelism_hint if self.parallelism_hint and self.parallelism_hint > 0 else None


def describe(error: BaseException, separator: str = "\ncaused by: ") -> str:
    """The chain of causes, each once even if the chain is a ring."""
    seen, out = set(), []
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        out.append(f"{type(error).__name__}: {str(error) or '(no message)'}")
        error = error.__cause__ or error.__context__
    return separator.join(out)


def stopped(error: BaseException) -> None:
    """Raise what says that the work was interrupted, also where it is the cause of something else: it is no failure of an item."""
    seen = set()
    while error is not None and id(error) not in seen:
        if isinstance(error, (InterruptedError, KeyboardInterrupt, CancelledError)):
            raise error
        seen.add(id(error))
        error = error.__cause__ or error.__context__


def comments(source: str) -> Iterator[tuple[int, str]]:
    """(line, text) of each end-of-line comment of a Java source: not those within strings, characters, text blocks, block comments."""
    i, line, n = 0, 1, len(source)
    while i < n:
        c = source[i]
        if c == "\n":
            line, i = line + 1, i + 1
        elif source.startswith("//", i):
            end = min((x for x in (source.find("\n", i), source.find("\r", i)) if x >= 0), default=n)
            yield line, source[i:end]
            i = end
        elif source.startswith("/*", i):
            end = source.find("*/", i + 2)
            end = n if end < 0 else end + 2
            line += source.count("\n", i, end)
            i = end
        elif source.startswith('"""', i):
            end = i + 3
            while end < n and not source.startswith('"""', end):
                end += 2 if source[end] == "\\" else 1
            end = min(n, end + 3)
            line += source.count("\n", i, end)
            i = end
        elif c in "\"'":
            end = i + 1
            while end < n and source[end] not in (c, "\n"):
                end += 2 if source[end] == "\\" else 1
            i = min(n, end + (end < n and source[end] == c))
        else:
            i += 1


def partial_issues(source: str, name: str | None) -> list[tuple[str | None, str, str]]:
    """Issues for the comments that say a method is missing."""
    out = []
    for line, said in comments(source):
        if said.startswith(MARK) and (FAILED in said.lower() or (LIMITS in said and EXCEEDED in said)):
            out.append((name, PARTIAL, f"line {line}: {said}"))
    return out


def summary(members: list[Member]) -> Output:
    """The built-in engine: what the headers say, as a Java-like text."""
    from quarry.functions.classfile import internal_name

    lines = [f"// {m.name} sha256={m.digest}" for m in members]
    for m in members:
        internal_name(m.content)  # a broken class fails its family
    return Output("\n".join(lines) + f"\nclass {members[0].name.rpartition('/')[2]} {{}}\n")


SUMMARY = Engine(summary)


def run_unit(engine: Engine, members: list[Member]) -> tuple:
    """(source, warnings, issues, error type, error) of one family; any failure of the engine is the family's own."""
    try:
        if not engine.merges and len(members) != 1:
            raise ValueError("this engine takes one class at a time")
        out = engine.transform(members)
        if not out.source.strip():
            raise ValueError(f"no source came back for {members[0].name}")
        issues = [*out.issues, *partial_issues(out.source, members[0].name)]
        return out.source, out.warnings, [{"internal_name": a, "error_type": b, "reason": c} for a, b, c in issues], None, None
    except Exception as e:
        stopped(e)
        return None, [], [], type(e).__name__, describe(e)


def transformed(units: DataFrame, engine: Engine = SUMMARY, admission: Callable[[int | None], AbstractContextManager] = nullcontext) -> DataFrame:
    """units (unit, members array<struct<name, origin, digest, path, entry>>, or content in place of path and entry) to UNIT_RESULT. A
    family's contents are read where it is transformed. Lazy: write or checkpoint the result before it is split, or the engine runs once per branch.
    admission: called with the engine's hint, a context that lets a transform run when the machine bears it."""
    if engine.requires:
        engine.requires()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            if engine.opened:
                engine.opened()
            with Contents() as contents:
                yield from results(batches, contents)
        finally:
            if engine.closed:
                engine.closed()

    def results(batches: Iterator[pa.RecordBatch], contents: Contents) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a family at a time: contents may be large
                unit, members = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                got = [Member(m["name"], m["origin"], m["digest"], contents.read(m["path"], m["entry"], m["digest"]) if m.get("path") else m["content"]) for m in members]
                with admission(engine.hint):
                    row = (unit, *run_unit(engine, got))
                del got
                issue = pa.list_(pa.struct([("internal_name", pa.string()), ("error_type", pa.string()), ("reason", pa.string())]))
                kinds = [pa.string(), pa.string(), pa.list_(pa.string()), issue, pa.string(), pa.string()]
                names = ["unit", "source", "warnings", "issues", "error_type", "error"]
                yield pa.RecordBatch.from_arrays([pa.array([x], type=k) for x, k in zip(row, kinds, strict=True)], names=names)

    return units.select("unit", "members").mapInArrow(run, UNIT_RESULT)
