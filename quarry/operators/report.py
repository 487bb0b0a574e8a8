"""Provenance, failures and the summary of an export, as rows and as text."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import resolve

# File names and headers of the reports.
SOURCES, FAILURES, REPORT = "export-sources.tsv", "decompilation-failures.csv", "export-report.txt"
SOURCES_HEADER = "file_entry\tsource"
FAILURES_HEADER = ("完整类名", "来源文件或JAR条目", "字节码SHA-256", "计划导出路径", "异常类型", "失败原因")
PREVIEW = 20
LOG = logging.getLogger("quarry")


def provenance(units: DataFrame) -> DataFrame:
    """(file_entry, source): one row per written entry and member."""
    return units.select("file_entry", F.explode("members").alias("m")).select("file_entry", F.col("m.origin").alias("source"))


def provenance_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(text.tsv_cell(F.col("file_entry")), F.lit("\t"), text.tsv_cell(F.col("source"))).alias("line"))


def failures(units: DataFrame, results: DataFrame) -> DataFrame:
    """(class_name, origin, digest, planned_path, error_type, reason): a row for every member of a failed unit, and for every
    member that an issue of a partial source goes to. units: unit, file_entry, members; results: UNIT_RESULT."""
    r = results.select(F.col("unit").alias("_u"), "issues", F.col("error_type").alias("_t"), F.col("error").alias("_e"))
    both = units.select("unit", "file_entry", "members").join(r, F.col("unit") == F.col("_u"))
    lost = both.filter("_e is not null").select("file_entry", "_t", "_e", F.explode("members").alias("m"))
    lost = lost.select(F.col("m.name").alias("name"), F.col("m.origin").alias("origin"), F.col("m.digest").alias("digest"), "file_entry", F.col("_t").alias("error_type"), F.col("_e").alias("reason"))
    part = resolve.joined_issues(resolve.attributed(both.filter("_e is null"))).select(F.col("unit").alias("_v"), "name", "origin", "digest", "error_type", "reason")
    part = part.join(units.select("unit", "file_entry"), F.col("_v") == F.col("unit")).select("name", "origin", "digest", "file_entry", "error_type", "reason")
    return lost.unionByName(part).select(text.dotted(F.col("name")).alias("class_name"), "origin", "digest", F.col("file_entry").alias("planned_path"), "error_type", "reason")


def failure_lines(rows: DataFrame) -> DataFrame:
    cells = [text.csv_cell(F.col(c)) for c in ("class_name", "origin", "digest", "planned_path", "error_type", "reason")]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


def preview(warnings: DataFrame, order: list[str], n: int = PREVIEW) -> DataFrame:
    """The first n for a dialog; the report holds all."""
    return warnings.orderBy(*order).limit(n)


def logged(failed: DataFrame, limit: int = PREVIEW) -> int:
    """Log failures (origin, reason): the first of them as warnings, all others only where debugging asks for them. Returns how many were warnings."""
    told = 0
    rows = failed.select("origin", "reason").orderBy("origin", "reason")
    for row in rows.toLocalIterator() if LOG.isEnabledFor(logging.DEBUG) else rows.limit(limit).collect():
        LOG.log(logging.WARNING if told < limit else logging.DEBUG, "export item failed: origin=%s: %s", row["origin"], row["reason"])
        told += 1
    return min(told, limit)


def summary(counts: dict[str, int], complete: bool, reason: str = "") -> str:
    """The last lines of the text report."""
    head = "status: complete" if complete else "status: incomplete (failed or cancelled)"
    names = ("discovered", "filtered", "duplicates", "exported", "complete_files", "partial_files", "failed_rows", "warnings", "written_files")
    return "\n".join([head, *[f"{k}: {counts[k]}" for k in names if k in counts], *([f"reason: {reason}"] if reason else [])]) + "\n"


def one_row(*rows: DataFrame) -> DataFrame:
    """Frames of one row and different columns as one row."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def run_counts(items: DataFrame, results: DataFrame | None, failed: DataFrame | None) -> DataFrame:
    """One row: the counters of a run. Families dropped as equal are not duplicates; a failed unit is one warning and a row for each member."""
    zero = F.lit(0).cast("long")
    seen = items.agg(
        F.count(F.when(F.col("status") != "warning", 1)).alias("discovered"), F.count(F.when(F.col("status") == "filtered", 1)).alias("filtered"),
        (F.count(F.when(F.col("status") == "ok", 1)) - F.count_distinct(F.when(F.col("status") == "ok", F.struct("name", "digest")))).alias("duplicates"),
        F.count(F.when(F.col("status").isin("error", "warning"), 1)).alias("warnings"),
    )
    none = zero.alias
    parts = [seen.select("discovered", "filtered", "duplicates", "warnings", none("exported"), none("partial_files"), none("failed_rows"))]
    if results is not None:
        parts.append(results.agg(F.count(F.when(F.col("error").isNull(), 1)).alias("exported"), F.count(F.when(F.col("error").isNull() & (F.size("issues") > 0), 1)).alias("partial_files"), F.count("error").alias("warnings")).select(none("discovered"), none("filtered"), none("duplicates"), "warnings", "exported", "partial_files", none("failed_rows")))
    if failed is not None:
        parts.append(failed.agg(F.count(F.lit(1)).alias("failed_rows")).select(none("discovered"), none("filtered"), none("duplicates"), none("warnings"), none("exported"), none("partial_files"), "failed_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = out.agg(*[F.sum(c).alias(c) for c in out.columns])
    return total.withColumn("complete_files", F.col("exported") - F.col("partial_files"))
