"""Paths, labels and report cells as Spark Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSAFE = r"[^\p{L}\p{N}._-]"


def relative_path(name: Column, extension: str = "class") -> Column:
    return F.concat(name, F.lit("." + extension))


def parent(path: Column) -> Column:
    """Before the last /, empty if there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def last_components(path: Column, n: int = 4) -> Column:
    p = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_join(F.slice(p, F.greatest(F.size(p) - (n - 1), F.lit(1)), n), "/")


def source_root(path: Column, relative: Column, project: Column | str) -> Column:
    """The folder that a class's package path hangs from: path without relative where it ends in it by whole components and
    the rest stays in the project, else the file's folder."""
    project = F.lit(project) if isinstance(project, str) else project
    tail = F.concat(F.lit("/"), relative)
    cut = F.left(path, F.length(path) - F.length(tail))
    inside = (cut == project) | F.startswith(cut, F.concat(project, F.lit("/")))
    return F.when(F.endswith(path, tail) & inside, cut).otherwise(parent(path))


def source_label(path: Column, project: Column | str) -> Column:
    """Relative to the project inside it; outside, external/ and the last four components."""
    project = F.lit(project) if isinstance(project, str) else project
    head = F.concat(project, F.lit("/"))
    return F.when(path == project, F.lit("")).when(F.startswith(path, head), F.substr(path, F.length(head) + 1)).otherwise(F.concat(F.lit("external/"), last_components(path)))


def scope(origin: Column) -> Column:
    """What keeps families of different copies apart: the origin before its last /."""
    return parent(origin)


def entry_origin(label: Column, entry: Column) -> Column:
    return F.concat(label, F.lit("!/"), entry)


def conflict_label(value: Column) -> Column:
    """For exports: unsafe characters to _, the first 50, `project` if nothing is left."""
    cut = F.substring(F.regexp_replace(value, UNSAFE, "_"), 1, 50)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("project"))


def safe_name(value: Column) -> Column:
    """For collections: unsafe characters to _, dots and _ trimmed, `project` if nothing is left."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, UNSAFE, "_"), r"^[._]+", ""), r"[._]+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("project"))


def byte_bounded(value: Column, most: int = 120) -> Column:
    """The longest prefix of at most so many UTF-8 bytes."""
    fits = F.filter(F.sequence(F.lit(0), F.least(F.length(value), F.lit(most))), lambda n: F.octet_length(F.left(value, n)) <= most)
    return F.when(F.octet_length(value) <= most, value).otherwise(F.left(value, F.array_max(fits)))


def folder_name(relative_root: Column, project_name: Column, nth: Column, file: Column) -> Column:
    """The name of a conflict folder before it is made safe."""
    base = F.when(relative_root == "", project_name).otherwise(F.replace(relative_root, F.lit("/"), F.lit("__")))
    return F.concat(base, F.when(nth > 1, F.concat(F.lit("__from-"), file)).otherwise(F.lit("")))


def dotted(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("."))


def tsv_cell(value: Column) -> Column:
    for raw, out in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(raw), F.lit(out))
    return value


def csv_cell(value: Column) -> Column:
    """Quoted always; what a spreadsheet would take for a formula gets an apostrophe first."""
    risky = F.regexp_replace(value, r"^[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", "").rlike("^[=+@-]") | value.rlike("^[\t\r]")
    return F.concat(F.lit('"'), F.when(risky, F.lit("'")).otherwise(F.lit("")), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def safe_entry(path: Column) -> Column:
    """Whether an archive may hold this path: relative, no \\ or :, no empty, . or .. part."""
    return (path != "") & ~path.rlike(r"[\\:]") & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
