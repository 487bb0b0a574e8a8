"""Collecting loose classes under one root, with conflict roots for other versions of a class.

Files are rows (src, rel, sroot, digest): src and sroot are relative to the project. The allocation of conflict roots is
what a sequential walk in source order gives, expressed as windows; see place().
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import dedup

MAIN, CONFLICTS, INDEX = "classes", "classes-conflicts", "sources.tsv"


def planned(files: DataFrame, project_name: str = "project", existing: DataFrame | None = None) -> DataFrame:
    """(src, rel, sroot, digest, root, ordinal, reused): the root folder of each distinct version. Root `classes` for classes
    of one version; else the first conflict root of the same source folder that does not hold the class yet.

    existing (rel, digest): what stands in the main root already. Equal content is reused; where it differs, what is
    there is kept and the new version goes to a conflict root."""
    v = dedup.distinct_versions(files.select("src", "rel", "sroot", "digest"), "rel", "digest", "src")
    by_rel = Window.partitionBy("rel")
    v = v.withColumns({"gkey": F.min("src").over(by_rel), "nv": F.count(F.lit(1)).over(by_rel)})
    if existing is not None:
        there = existing.select(F.col("rel").alias("_r"), F.col("digest").alias("_d")).dropDuplicates(["_r"])
        v = v.join(there, F.col("rel") == F.col("_r"), "left")
        v = v.withColumns({"reused": (F.col("nv") == 1) & F.col("_d").eqNullSafe(F.col("digest")), "diverted": (F.col("nv") == 1) & F.col("_d").isNotNull() & (F.col("_d") != F.col("digest"))}).drop("_r", "_d")
    else:
        v = v.withColumns({"reused": F.lit(False), "diverted": F.lit(False)})
    main = v.filter((F.col("nv") == 1) & ~F.col("diverted")).select("src", "rel", "sroot", "digest", F.lit(MAIN).alias("root"), F.lit(0).cast("long").alias("ordinal"), "reused")
    other = v.filter((F.col("nv") > 1) | F.col("diverted"))
    return main.unionByName(allocated(other, project_name))


def existing(spark: SparkSession, target: str) -> DataFrame:
    """(rel, digest) of the files in a collection's main root. A link or anything else that is no file has no digest."""
    root, rows = os.path.join(target, MAIN), []
    for folder, folders, files in os.walk(root):
        for name in files + [x for x in folders if os.path.islink(os.path.join(folder, x))]:
            path = os.path.join(folder, name)
            rows.append((os.path.relpath(path, root), path if os.path.isfile(path) and not os.path.islink(path) else None))

    @F.udf("string")
    def digest(path: str | None) -> str | None:  # a file per row: nothing to vectorise
        if path is None:
            return None
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    return spark.createDataFrame(rows, "rel string, path string").select("rel", digest("path").alias("digest"))


def irregular(plan_files: DataFrame, there: DataFrame) -> DataFrame:
    """(rel) of files that would go where a link or something else that is no file stands: an error of the whole collection."""
    return there.filter("digest is null").select("rel").join(plan_files.select("rel").distinct(), "rel", "left_semi")


def allocated(versions: DataFrame, project_name: str) -> DataFrame:
    """versions (src, rel, sroot, digest, gkey) with conflict root names.

    ord: the version's place among those of its class in its folder; the (sroot, ord) pairs are the roots. A root is
    made by its first version in walk order (gkey, src), which also names it."""
    v = versions.withColumn("ord", F.row_number().over(Window.partitionBy("sroot", "rel").orderBy("src")).cast("long"))
    first = v.groupBy("sroot", "ord").agg(F.min(F.struct("gkey", "src")).alias("m")).select("sroot", "ord", F.col("m.gkey").alias("gkey"), F.col("m.src").alias("src"))
    label = text.safe_name(text.folder_name(F.col("sroot"), F.lit(project_name), F.col("ord"), text.file_name(F.col("src"))))
    named = first.withColumn("label", label).withColumn("short", text.byte_bounded(F.col("label")))
    digest = F.sha2(F.col("src").cast("binary"), 256)
    nth = F.row_number().over(Window.partitionBy(F.lower("short")).orderBy("gkey", "src"))
    plain = (F.col("short") == F.col("label")) & (F.lower("short") != INDEX) & (nth == 1)
    named = named.withColumn("name", F.when(plain, F.col("short")).otherwise(F.concat("short", F.lit("--"), F.left(digest, F.lit(12)))))
    # a name that is still taken (an accident of 12 digits, or a folder that is called so) gets the whole digest
    again = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("gkey", "src"))
    named = named.withColumn("name", F.when(again == 1, F.col("name")).otherwise(F.concat("short", F.lit("--"), digest)))
    roots = named.select(F.col("sroot").alias("_s"), F.col("ord").alias("_o"), "name", F.struct("gkey", "src").alias("made"))
    out = v.join(roots, (F.col("sroot") == F.col("_s")) & (F.col("ord") == F.col("_o")))
    return out.select("src", "rel", "sroot", "digest", F.concat(F.lit(CONFLICTS + "/"), "name").alias("root"), F.col("ord").alias("ordinal"), F.lit(False).alias("reused"))


def conflict_index(plan: DataFrame) -> DataFrame:
    """(library_root, class_path, source_file), cells escaped: the rows of sources.tsv."""
    rows = plan.filter(F.col("root") != MAIN)
    return rows.select(text.tsv_cell(text.file_name(F.col("root"))).alias("library_root"), text.tsv_cell(F.col("rel")).alias("class_path"), text.tsv_cell(F.col("src")).alias("source_file"))


def root_list(plan: DataFrame) -> DataFrame:
    """(root, ordinal): the main root first, if anything is in it, then conflict roots as they were made."""
    got = plan.groupBy("root").agg(F.min("src").alias("first")).withColumn("other", F.col("root") != MAIN)
    return dedup.positions(got, ["other", "first", "root"]).select("root", F.col("position").alias("ordinal"))
