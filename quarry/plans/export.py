"""The three flows: export classes, transform and export families, collect dependencies."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text
from quarry.operators import catalog, collect, dedup, engine, family, report, resolve
from quarry.plans import control, resources
from quarry.session import drop, materialise
from quarry.sources import artifacts, sinks

#: So many files are written by one task.
WRITES = 2000


@dataclass
class Result:
    discovered: int
    filtered: int
    duplicates: int
    exported: int
    partially_exported: int = 0
    failed_rows: int = 0
    warnings: int = 0
    preview: list[str] = field(default_factory=list)

    @property
    def successfully_exported(self) -> int:
        return self.exported - self.partially_exported


def _files(rows: DataFrame) -> DataFrame:
    """Rows of the sink's schema from rows with some of its columns."""
    columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(sinks.SCHEMA).fields]
    return rows.select(*columns)


def _placed(rows: DataFrame, n: int) -> DataFrame:
    """rows (path, entry) in order of place, a range of places for each task: each opens few archives, and a large one is read by many."""
    spark = rows.sparkSession
    parts = max(1, min(-(-n // resources.PER_BATCH), max(spark.sparkContext.defaultParallelism, -(-n // WRITES))))
    return rows.repartitionByRange(parts, "path", "entry").sortWithinPartitions("path", "entry")


def _lines(rows: DataFrame, name: str, end: str = "\n", head: str = "", tail: str = "") -> DataFrame:
    """The pieces of one file from rows (line), in order. Each task joins its own range of lines; none sees them all."""
    spark = rows.sparkSession

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (TaskContext.get().partitionId() + 1) << 32
        for n, batch in enumerate(batches):
            if batch.num_rows:
                body = "".join(x + end for x in batch.column(0).to_pylist()).encode()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([body], pa.binary()), pa.array([at + n], pa.int64())], names=["file_entry", "content", "part"])

    schema = "file_entry string, content binary, part long"
    body = rows.select("line").sort("line").mapInArrow(join, schema)
    ends = [(name, bytearray(head.encode()), 0), (name, bytearray(tail.encode()), 1 << 62)]
    return _files(body.unionByName(spark.createDataFrame(ends, schema)))


def _warnings(items: DataFrame) -> DataFrame:
    return items.filter(F.col("status").isin("error", "warning")).select("origin", F.concat_ws(": ", "origin", "error").alias("line"))


def _count(df: DataFrame) -> dict[str, int]:
    return {k: int(v or 0) for k, v in df.first().asDict().items()}


def _unselected(items: DataFrame, members: DataFrame) -> DataFrame:
    """(unit, missing): units beside whose root lie files of nested classes that are not among its members. members: unit, nth, m."""
    at = (F.when(F.col("entry").isNotNull(), F.col("path")).otherwise(F.lit("")).alias("container"), F.coalesce("entry", "path").alias("place"))
    entries = items.filter("status in ('ok', 'filtered')").select("name", "origin", "digest", *at)
    named = entries.select(F.col("name").alias("_n"), F.col("origin").alias("_o"), "container", "place")
    placed = members.join(named, (F.col("m.name") == F.col("_n")) & (F.col("m.origin") == F.col("_o"))).select("unit", "nth", "container", "place")
    return resolve.incomplete(resolve.siblings(placed.filter("nth = 0").drop("nth"), entries.select("container", "place")), placed)


def export_classes(spark: SparkSession, roots: list[str], target: str, allow: str = "", deny: str = "", project: str = "/", format: str = "directory", keep_completed: bool = False, cancel: control.Cancellation | None = None, progress: Callable[[str], None] | None = None) -> Result:
    """Scan, filter, drop copies, keep versions apart, write with provenance. The scan is written once, without contents; these are read
    again, and held against their digests, by the tasks that write them."""
    made: list[DataFrame] = []
    with control.Flow(spark, cancel, progress).running(target, keep_completed and format == "directory") as flow:
        try:
            flow.phase("scan")
            items = materialise(artifacts.scan(spark, roots, allow=allow, deny=deny, project=project, output=target, content="false"))
            made.append(items)
            flow.phase("plan")
            planned = materialise(dedup.planned_paths(dedup.distinct_versions(items.filter("status = 'ok'").drop("content"))))
            made.append(planned)
            if not dedup.repeated_entries(planned).isEmpty():
                raise ValueError("two units would be written to one entry")
            counts = _count(report.run_counts(items, None, None)) | {"exported": planned.count()}
            counts["complete_files"] = counts["exported"]
            lines = report.provenance_lines(planned.select("file_entry", F.col("origin").alias("source")))
            preview = [r[0] for r in report.preview(_warnings(items), ["origin", "line"]).select("line").collect()]
            report.logged(_warnings(items).select("origin", F.col("line").alias("reason")))
            flow.phase("write")
            files = _files(_placed(planned.select("file_entry", "path", "entry", "digest"), counts["exported"]))
            files = files.unionByName(_lines(lines, report.SOURCES, head=report.SOURCES_HEADER + "\n"))
            files = files.unionByName(_lines(_warnings(items), report.REPORT, tail=report.summary(counts, True)))
            sinks.export(files, target, format, keep_completed)
            return Result(counts["discovered"], counts["filtered"], counts["duplicates"], counts["exported"], warnings=counts["warnings"], preview=preview)
        finally:
            for df in made:
                drop(df)


def export_families(spark: SparkSession, roots: list[str], target: str, using: engine.Engine = engine.SUMMARY, allow: str = "", deny: str = "", project: str = "/", format: str = "directory", keep_completed: bool = False, cancel: control.Cancellation | None = None, progress: Callable[[str], None] | None = None) -> Result:
    """Scan, filter, group into families, drop equal families, transform each once, write what came back with provenance and failures.
    How many transforms run at once follows the engine's hint and the machine, sampled before each."""
    made: list[DataFrame] = []

    def held(df: DataFrame) -> DataFrame:
        made.append(materialise(df))
        return made[-1]

    with control.Flow(spark, cancel, progress).running(target, keep_completed and format == "directory") as flow:
        try:
            flow.phase("scan")
            items = held(artifacts.scan(spark, roots, allow=allow, deny=deny, project=project, output=target, content="false"))
            flow.phase("plan")
            ok = items.filter("status = 'ok'")
            units = family.distinct_families(family.families(ok.select("name", "origin", "grp", "digest", "parent")))
            units = held(dedup.planned_paths(units, "java").withColumn("unit", F.col("file_entry")))
            if not dedup.repeated_entries(units).isEmpty():
                raise ValueError("two units would be written to one entry")
            place = ok.select(F.col("name").alias("_n"), F.col("origin").alias("_o"), F.col("digest").alias("_d"), "path", "entry")
            members = units.select("unit", F.posexplode("members").alias("nth", "m"))
            joined = members.join(place, (F.col("m.name") == F.col("_n")) & (F.col("m.origin") == F.col("_o")) & (F.col("m.digest") == F.col("_d")))
            filled = joined.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("nth", F.struct("m.name", "m.origin", "m.digest", "path", "entry").alias("m")))).alias("s")).select("unit", F.transform("s", lambda x: x["m"]).alias("members"))
            n = resources.partitions_for(units.count(), spark.sparkContext.defaultParallelism)
            lost = None
            if using.needs_siblings:
                bad = _unselected(items, members)
                filled = filled.join(bad.select("unit"), "unit", "left_anti")
                why = F.concat(F.col("missing").cast("string"), F.lit(" nested classes beside this one are not selected"))
                issues = T.StructType.fromDDL(engine.UNIT_RESULT)["issues"].dataType
                lost = bad.select("unit", F.lit("IncompleteFamily").alias("error_type"), why.alias("error")).select("unit", F.lit(None).cast("string").alias("source"), F.array().cast("array<string>").alias("warnings"), F.array().cast(issues).alias("issues"), "error_type", "error")
            flow.phase("transform")
            filled = filled.withColumn("first", F.get("members", F.lit(0))).repartitionByRange(n, "first.path", "first.entry").sortWithinPartitions("first.path", "first.entry").drop("first")
            done = engine.transformed(filled, using, resources.Admission)
            done = held(done.unionByName(lost) if lost is not None else done)  # the engine runs once for each unit
            failed = held(report.failures(units, done))
            counts = _count(report.run_counts(items, done, failed))
            written = units.join(done.filter("error is null").select("unit", "source", F.size("issues").alias("n_issues")), "unit")
            notes = _warnings(items).select("line").unionByName(done.select(F.explode(F.concat("warnings", F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>")))).alias("line")))
            preview = [r[0] for r in report.preview(notes, ["line"]).collect()]
            report.logged(failed.select("origin", "reason"))
            flow.phase("write")
            files = _files(written.select("file_entry", F.col("source").cast("binary").alias("content")))
            files = files.unionByName(_lines(report.provenance_lines(report.provenance(written)), report.SOURCES, head=report.SOURCES_HEADER + "\n"))
            files = files.unionByName(_lines(notes, report.REPORT, tail=report.summary(counts, True)))
            if counts["failed_rows"]:
                header = ",".join(f'"{x}"' for x in report.FAILURES_HEADER)
                files = files.unionByName(_lines(report.failure_lines(failed), report.FAILURES, "\r\n", "\ufeff" + header + "\r\n"))
            sinks.export(files, target, format, keep_completed)
            return Result(counts["discovered"], counts["filtered"], counts["duplicates"], counts["exported"], counts["partial_files"], counts["failed_rows"], counts["warnings"], preview)
        finally:
            for df in made:
                drop(df)


def collect_dependencies(spark: SparkSession, project: str, library_root: DataFrame, module_library: DataFrame, modules: DataFrame, confirm: Callable[[str], bool] = lambda path: False, merge: bool = False, tables: str | None = None, succeeded: Callable[[], None] | None = None, cancel: control.Cancellation | None = None, progress: Callable[[str], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Copy a project's archives and loose classes to its collection folder, and return the catalog (library_root,
    module_library) with the collection in place. An existing collection is deleted only if confirm(path) says so; merge: it is added to,
    equal files are used as they are, others kept beside the new ones. tables: a folder in which both tables are replaced once all files are
    there; succeeded is called after that."""
    out = os.path.join(project, artifacts.COLLECTED)
    recreate = os.path.lexists(out) and not merge
    if recreate and not confirm(out):
        raise FileExistsError(out)
    made: list[DataFrame] = []

    def held(df: DataFrame) -> DataFrame:
        made.append(materialise(df))
        return made[-1]

    with control.Flow(spark, cancel, progress).running(out, False) as flow:
        try:
            flow.phase("scan")
            jars = artifacts.scan(spark, [project], mode="jars", project=project).select("path", F.col("name").alias("file_name"))
            loose = held(artifacts.scan(spark, [project], mode="loose", project=project, content="false").filter("status = 'ok'").drop("content"))
            named = held(dedup.suffixed(jars, "file_name", "path"))
            if named.isEmpty() and loose.isEmpty():
                raise ValueError("nothing to collect")
            flow.phase("plan")
            rel = F.concat("name", F.lit(".class"))
            files = loose.select("path", F.substr("path", F.lit(len(project) + 2)).alias("src"), rel.alias("rel"), text.source_root(F.col("path"), rel, project).alias("abs"), "digest")
            files = files.withColumn("sroot", F.when(F.col("abs") == project, F.lit("")).otherwise(F.substr("abs", F.lit(len(project) + 2))))
            there = held(collect.existing(spark, out)) if merge and os.path.isdir(os.path.join(out, collect.MAIN)) else None
            if there is not None and (odd := collect.irregular(files, there).first()):
                raise FileExistsError(os.path.join(out, collect.MAIN, odd[0]))
            plan = held(collect.planned(files, os.path.basename(project), there))
            places = files.select(F.col("src").alias("_s"), "path")
            body = plan.filter("not reused").join(places, F.col("src") == F.col("_s"))
            body = body.select(F.concat("root", F.lit("/"), "rel").alias("file_entry"), "path", F.lit(None).cast("string").alias("entry"), "digest")
            flow.phase("copy")
            copies = _files(_placed(body, plan.count())).unionByName(_files(named.select(F.col("copy_name").alias("file_entry"), "path")))
            index = collect.conflict_index(plan)
            if not index.isEmpty():
                copies = copies.unionByName(_lines(index.select(F.concat_ws("\t", "library_root", "class_path", "source_file").alias("line")), f"{collect.CONFLICTS}/{collect.INDEX}", head="library_root\tclass_path\tsource_file\n"))
            sinks.export(copies, out, recreate=recreate, merge=merge)
            flow.phase("register")
            roots = collect.root_list(plan).select(F.concat(F.lit(out + "/"), "root").alias("path"), "ordinal")
            library = catalog.replaced(library_root, named.select(F.concat(F.lit(out + "/"), "copy_name").alias("path")), roots)
            attached = catalog.attached(module_library, modules)
            if tables:
                library, attached = catalog.committed(library, f"{tables}/library_root"), catalog.committed(attached, f"{tables}/module_library")
            else:
                library, attached = materialise(library), materialise(attached)
            if succeeded:
                succeeded()
            return library, attached
        finally:
            for df in made:
                drop(df)
