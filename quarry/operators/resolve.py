"""Lookups between units, sources, siblings and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text


def resolved(sources: DataFrame, contents: DataFrame) -> DataFrame:
    """sources (path, entry) with the content of that place; what is not there has found = false."""
    c = contents.select(F.col("path").alias("_p"), F.col("entry").alias("_e"), "content", F.lit(True).alias("_f"))
    out = sources.join(c, (F.col("path") == F.col("_p")) & F.col("entry").eqNullSafe(F.col("_e")), "left")
    return out.withColumn("found", F.coalesce("_f", F.lit(False))).drop("_p", "_e", "_f")


def siblings(units: DataFrame, entries: DataFrame) -> DataFrame:
    """(unit, sibling): entries beside a unit's own file, in the same container and folder, named <base>$... — the files that
    hold what is nested in it. units: unit, container, place; entries: container, place. Equi-join on the folder."""
    u = units.select("unit", F.col("container").alias("_c"), text.parent(F.col("place")).alias("_d"), F.regexp_replace(text.file_name(F.col("place")), r"(?i)\.class$", "").alias("_b"))
    e = entries.select("container", "place", text.parent(F.col("place")).alias("_dir"), text.file_name(F.col("place")).alias("_f"))
    hit = (F.col("container") == F.col("_c")) & (F.col("_dir") == F.col("_d"))
    return u.join(e, hit & F.startswith("_f", F.concat("_b", F.lit("$"))) & F.endswith(F.lower("_f"), F.lit(".class"))).select("unit", F.col("container"), F.col("place").alias("sibling"))


def incomplete(found: DataFrame, selected: DataFrame) -> DataFrame:
    """Units with a sibling that is not selected (unit, missing): these must fail as a whole. selected: unit, container, place."""
    s = selected.select(F.col("unit").alias("_u"), F.col("container").alias("_c"), F.col("place").alias("_p"))
    gone = found.join(s, (F.col("unit") == F.col("_u")) & (F.col("container") == F.col("_c")) & (F.col("sibling") == F.col("_p")), "left_anti")
    return gone.groupBy("unit").agg(F.count(F.lit(1)).alias("missing"))


def stale(snapshots: DataFrame, current: DataFrame) -> DataFrame:
    """(unit, path, entry) whose content is no longer what was scanned, or gone. Digests are compared, not contents."""
    c = current.select(F.col("path").alias("_p"), F.col("entry").alias("_e"), F.col("digest").alias("_d"))
    out = snapshots.join(c, (F.col("path") == F.col("_p")) & F.col("entry").eqNullSafe(F.col("_e")), "left")
    return out.filter(~F.col("digest").eqNullSafe(F.col("_d"))).select("unit", "path", "entry")


def attributed(results: DataFrame) -> DataFrame:
    """(unit, name, origin, digest, issue): an issue goes to the member it names; one that names none goes to every member.
    results: unit, members array<struct>, issues array<struct<internal_name, error_type, reason>>."""
    issue = results.select("unit", "members", F.posexplode("issues").alias("nth", "issue"))
    names = F.transform("members", lambda m: m["name"])
    every = F.col("issue.internal_name").isNull() | ~F.coalesce(F.array_contains(names, F.col("issue.internal_name")), F.lit(False))
    to = F.when(every, F.col("members")).otherwise(F.filter("members", lambda m: m["name"] == F.col("issue.internal_name")))
    return issue.select("unit", F.explode(to).alias("m"), "nth", "issue").select("unit", F.col("m.name").alias("name"), F.col("m.origin").alias("origin"), F.col("m.digest").alias("digest"), "nth", "issue")


def joined_issues(rows: DataFrame) -> DataFrame:
    """One row per unit and member: distinct error types by `; `, reasons by line, in the order of the issues."""
    got = rows.groupBy("unit", "name", "origin", "digest").agg(F.sort_array(F.collect_list(F.struct("nth", "issue"))).alias("i"))
    types = F.array_join(F.array_distinct(F.transform("i", lambda x: x["issue"]["error_type"])), "; ")
    return got.select("unit", "name", "origin", "digest", types.alias("error_type"), F.array_join(F.transform("i", lambda x: x["issue"]["reason"]), "\n").alias("reason"))
