"""The library catalog as two tables: library_root(library, ordinal, root, kind) and module_library(module, library)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLLECTION = "all-in-one"


def registered(library_root: DataFrame, module_library: DataFrame, project_libraries: DataFrame | None = None) -> DataFrame:
    """(path): roots of kind CLASSES of the project's libraries and of every module's libraries, each once. An archive's
    root (jar://x.jar!/) is the archive; what is neither a file nor an archive is left out."""
    classes = library_root.filter("kind = 'CLASSES'")
    used = classes.join(module_library.select("library").distinct(), "library", "left_semi")
    if project_libraries is not None:
        used = used.unionByName(classes.join(project_libraries.select("library").distinct(), "library", "left_semi"))
    root = F.col("root")
    path = F.when(F.startswith(root, F.lit("jar://")), F.regexp_replace(F.regexp_replace(root, "^jar://", ""), "!/.*$", ""))
    path = path.when(F.startswith(root, F.lit("file://")), F.regexp_replace(root, "^file://", "")).when(~root.contains("://"), root)
    return used.select(path.alias("path")).filter("path is not null").distinct()


def replaced(library_root: DataFrame, jars: DataFrame, class_roots: DataFrame, library: str = COLLECTION) -> DataFrame:
    """library_root with the library made anew from archives (path) and class folders (path, ordinal)."""
    made = jars.select(F.lit(library).alias("library"), F.lit(0).cast("long").alias("ordinal"), F.concat(F.lit("jar://"), "path", F.lit("!/")).alias("root"), F.lit("CLASSES").alias("kind"))
    folders = class_roots.select(F.lit(library).alias("library"), F.col("ordinal").cast("long").alias("ordinal"), F.concat(F.lit("file://"), "path").alias("root"), F.lit("CLASSES").alias("kind"))
    return removed(library_root, library).unionByName(made).unionByName(folders)


def removed(library_root: DataFrame, library: str = COLLECTION) -> DataFrame:
    return library_root.filter(F.col("library") != library)


def attached(module_library: DataFrame, modules: DataFrame, library: str = COLLECTION) -> DataFrame:
    """module_library with the library for every module that has not got it. modules: module."""
    has = module_library.filter(F.col("library") == library).select("module")
    new = modules.select("module").distinct().join(has, "module", "left_anti").withColumn("library", F.lit(library))
    return module_library.unionByName(new.select("module", "library"))


def committed(table: DataFrame, path: str) -> DataFrame:
    """table written to path in place of what is there: whole beside it first, then put in its place, so a reader never sees a part, and a
    failure leaves the old table."""
    spark = table.sparkSession
    new, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    table.write.parquet(new)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    replaces = store.exists(at(path))
    if replaces and not store.rename(at(path), at(old)):
        raise OSError(f"{path} cannot be replaced")
    if not store.rename(at(new), at(path)):
        if replaces:
            store.rename(at(old), at(path))
        raise OSError(f"{path} cannot be written")
    if replaces:
        store.delete(at(old), True)
    return spark.read.schema(table.schema).parquet(path)
