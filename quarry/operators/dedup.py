"""Versions, copies, collisions and counters of class items.

Items are rows (name, origin, grp, digest, ...). Content equality is equality of the SHA-256 digest: plans are made of items without
their contents, which are read again where they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.session import bounded, materialise


def rank_versions(items: DataFrame, name: str = "name", digest: str = "digest", order: str = "origin") -> DataFrame:
    """items with is_first: the first of each distinct content of a name, by origin."""
    w = Window.partitionBy(name, digest).orderBy(order)
    return items.withColumn("is_first", F.row_number().over(w) == 1)


def distinct_versions(items: DataFrame, name: str = "name", digest: str = "digest", order: str = "origin") -> DataFrame:
    """One row for each distinct content of each name: a partial aggregate before the shuffle, no window over copies."""
    rest = [c for c in items.columns if c not in (name, digest, order)]
    first = F.min_by(F.struct(F.col(order), *[F.col(c) for c in rest]), F.col(order)).alias("_first")
    return items.groupBy(name, digest).agg(first).select(name, digest, *[F.col("_first")[c].alias(c) for c in (order, *rest)]).select(*items.columns)


def nth_seen(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """rows with nth: 1 for the first of each key, in order, and so on. What a walk that remembers keys keeps are those with 1."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))


def collisions(units: DataFrame, name: str = "name") -> DataFrame:
    """units with n_same: how many units share the name without regard to case (paths must differ on any file system). Names are
    counted by an aggregate, and only those that several units have are joined back: units of a common name stay where they are."""
    shared = units.groupBy(F.lower(name).alias("_low")).agg(F.count(F.lit(1)).alias("n_same")).filter("n_same > 1")
    out = units.join(bounded(shared), F.lower(name) == F.col("_low"), "left")
    return out.withColumn("n_same", F.coalesce("n_same", F.lit(1))).drop("_low")


def entry_path(name: Column, grp: Column, digest: Column, n_same: Column, extension: str = "class") -> Column:
    """Where a unit is written: under its name, or under a conflict folder if others share it."""
    plain = text.relative_path(name, extension)
    folder = F.concat(F.lit("classes-conflicts/"), text.conflict_label(grp), F.lit("--"), F.left(digest, F.lit(16)), F.lit("/"))
    return F.when(n_same > 1, F.concat(folder, plain)).otherwise(plain)


def planned_paths(units: DataFrame, extension: str = "class") -> DataFrame:
    """units with file_entry."""
    return collisions(units).withColumn("file_entry", entry_path(F.col("name"), F.col("grp"), F.col("digest"), F.col("n_same"), extension))


def repeated_entries(planned: DataFrame, entry: str = "file_entry") -> DataFrame:
    """Entries that more than one unit would be written to: must be empty before anything is written."""
    return planned.groupBy(entry).count().filter("count > 1")


def conflicts(units: DataFrame, name: str = "name") -> DataFrame:
    """One row (in_conflict, conflict_groups): units that share their name with others, and how many such names there are."""
    groups = units.groupBy(F.lower(name).alias("low")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_conflict"), F.count(F.lit(1)).alias("conflict_groups"))


def representatives(files: DataFrame, path: str = "path", relative: str = "relative", digest: str = "digest") -> DataFrame:
    """For each relative path, one file of each distinct content: the one with the smallest source path."""
    return distinct_versions(files, relative, digest, path)


def suffixed(files: DataFrame, file_name: str, order: str) -> DataFrame:
    """files with copy_name: x.jar, x_2.jar, x_3.jar for files of one name, in order. A made name that some file has by
    itself gets a piece of the digest of its order column too, so that no copy overwrites another."""
    name = F.col(file_name)
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    n = F.row_number().over(Window.partitionBy(file_name).orderBy(order))
    made = files.withColumn("_n", n).withColumn("_made", F.when(F.col("_n") == 1, name).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext)))
    taken = files.select(F.lower(name).alias("_taken")).distinct()
    out = made.join(taken, (F.lower("_made") == F.col("_taken")) & (F.col("_n") > 1), "left")
    safe = F.concat(stem, F.lit("_"), F.col("_n").cast("string"), F.lit("-"), F.left(F.sha2(F.col(order).cast("string").cast("binary"), 256), F.lit(8)), ext)
    return out.withColumn("copy_name", F.when(F.col("_taken").isNotNull(), safe).otherwise(F.col("_made"))).drop("_n", "_made", "_taken")


def batches(units: DataFrame, order: list[str], size: int = 40) -> DataFrame:
    """(batch, n): batch numbers over a total order, from range-partitioned positions: each partition counts its own rows and
    adds what stands before it, so no single task sees all rows."""
    placed = positions(units.select(*order), order)
    return placed.groupBy((F.col("position") / size).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"))


def positions(units: DataFrame, order: list[str]) -> DataFrame:
    """units with position, from 0, in a total order. Which partition a row is in holds for one evaluation only, so the ordered rows are
    written once, with their partition and their number in it, and both the counts and the result read them from there."""
    spread = units.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    spread = spread.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33))
    spread = materialise(spread)
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    out = spread.join(F.broadcast(before.select(F.col("_p").alias("_q"), "_before")), F.col("_p") == F.col("_q"), "left")
    known = F.when(F.col("_before").isNull(), F.raise_error(F.lit("a partition was not counted"))).otherwise(F.col("_before"))
    return out.withColumn("position", F.col("_i") + known).drop("_p", "_q", "_i", "_before")
