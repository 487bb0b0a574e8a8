"""Allow and deny rules over class names, compiled to Spark Columns.

A rule reads the package of a slash-separated class name, by shape:

    *            any class, of the default package too
    a.b.*  a.?.c  (with a dot)   the whole package as a glob; a trailing .* also takes the package itself
    word         a package segment, or the simple class name, contains it
    *word*       a package segment contains it          (named packages only)
    *word        a package segment starts with it       (named packages only)
    word*        a package segment ends with it         (named packages only)
    other mixes  a package segment matches the glob     (named packages only)

Deny always wins; an empty allow list allows everything. Everything stays in Catalyst: no Python runs per row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts rules in a text: ASCII and full-width commas, and line ends.
_SEPARATORS = re.compile("[,，\r\n]+")


def tokenize(text: str | None) -> list[str]:
    return [t for t in (x.strip() for x in _SEPARATORS.split(text or "")) if t]


def glob(pattern: str) -> str:
    """A regular expression (Java's and Python's) that matches a glob as a whole; only * and ? are special."""
    body = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in pattern)
    return f"^(?s:{body})$"


def package(name: Column) -> Column:
    return F.when(F.instr(name, "/") > 0, F.regexp_replace(name, r"/[^/]*$", "")).otherwise(F.lit(""))


def simple_name(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def segments(name: Column) -> Column:
    return F.split(package(name), "/")


@dataclass(frozen=True)
class Rule:
    """One compiled rule: a test on Columns, and the same test on Python strings for readers that filter while they parse."""

    text: str

    def parts(self) -> tuple[str, str]:
        """(kind, operand)"""
        t = self.text
        if t == "*":
            return "all", ""
        if "." in t:
            return "package", t
        if "*" not in t and "?" not in t:
            return "literal", t
        core = t.strip("*")
        if core == "" or not re.search(r"[*?]", core):
            front, back = t.startswith("*"), t.endswith("*")
            if t in (f"*{core}*", "**") and len(t) >= 2:
                return "contains", core
            if front and t == f"*{core}":
                return "starts", core
            if back and t == f"{core}*":
                return "ends", core
        return "segment", t

    def packages(self, name: Column) -> Column:
        kind, x = self.parts()
        segs, pkg = segments(name), package(name)
        named = pkg != ""
        if kind == "all":
            return F.lit(True)
        if kind == "package":
            hit = F.regexp_replace(pkg, "/", ".").rlike(glob(x))
            return hit | (F.regexp_replace(pkg, "/", ".") == x[:-2]) if x.endswith(".*") else hit
        if kind == "literal":
            return F.exists(segs, lambda s: F.contains(s, F.lit(x)))
        test = {"contains": lambda s: F.contains(s, F.lit(x)), "starts": lambda s: F.startswith(s, F.lit(x)), "ends": lambda s: F.endswith(s, F.lit(x)), "segment": lambda s: s.rlike(glob(x))}[kind]
        return named & F.exists(segs, test)

    def class_keyword(self) -> str | None:
        kind, x = self.parts()
        return x if kind == "literal" else None

    def matches_package(self, pkg: str) -> bool:
        kind, x = self.parts()
        segs, dotted = pkg.split("/"), pkg.replace("/", ".")
        if kind == "all":
            return True
        if kind == "package":
            return bool(re.search(glob(x), dotted)) or (x.endswith(".*") and dotted == x[:-2])
        if kind == "literal":
            return any(x in s for s in segs)
        test = {"contains": lambda s: x in s, "starts": lambda s: s.startswith(x), "ends": lambda s: s.endswith(x), "segment": lambda s: bool(re.search(glob(x), s))}[kind]
        return bool(pkg) and any(map(test, segs))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def accepts(name: Column, allow: str = "", deny: str = "") -> Column:
    """The filter as a Column. A null name is not accepted."""
    allowed, denied = [Rule(x) for x in tokenize(allow)], [Rule(x) for x in tokenize(deny)]
    said = simple_name(name)
    words = lambda rules: [F.contains(said, F.lit(k)) for r in rules if (k := r.class_keyword()) is not None]
    ok = F.lit(True) if not allowed else _any([r.packages(name) for r in allowed]) | _any(words(allowed))
    return F.coalesce(~_any([r.packages(name) for r in denied]) & ok & ~_any(words(denied)) & name.isNotNull(), F.lit(False))


def accepts_name(name: str, allow: list[Rule], deny: list[Rule]) -> bool:
    """The same decision for one name, for readers."""
    pkg, _, said = name.rpartition("/")
    if any(r.matches_package(pkg) for r in deny):
        return False
    word = lambda rules: any(k in said for r in rules if (k := r.class_keyword()) is not None)
    return (not allow or any(r.matches_package(pkg) for r in allow) or word(allow)) and not word(deny)


def unsafe_name(name: Column) -> Column:
    """Names that must not become paths: empty, . or .. segments, and any of \\ : ; [ NUL."""
    return F.exists(F.split(name, "/"), lambda s: s.isin("", ".", "..")) | name.rlike("[\\\\:;\\[\\x00]")


def is_unsafe(name: str) -> bool:
    return any(s in ("", ".", "..") for s in name.split("/")) or any(c in name for c in "\\:;[\0")


def has_extension(path: Column, extension: str) -> Column:
    return F.endswith(F.lower(path), F.lit(extension.lower()))
