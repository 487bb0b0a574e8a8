"""Families: a top class and everything nested in it, found by following parents, and their digests.

Items are rows (name, origin, grp, digest, parent). A family stays within its scope, the place that its origin has
in common, so copies in different archives never mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.session import materialise


def roots(items: DataFrame, scope: str = "scope", name: str = "name", parent: str = "parent") -> DataFrame:
    """(scope, name, root, depth) for every distinct name: parents are followed while exactly one item of that name is in the
    scope; a name that is missing, held twice, or already on the way ends the walk, and the last one reached is the root.

    Pointer doubling: after k rounds a name knows the ancestor 2^k parents ahead, so the rounds are the logarithm of the depth, without
    a limit, and a row holds one ancestor whatever the depth. Names that then still have not come to an end lead into a ring; only for these the
    whole way is kept, as it says where they must stop. Each round is written to the shared folder, which cuts the lineage (it would
    double with every round) and survives lost executors."""
    names = items.groupBy(scope, name).agg(F.count(F.lit(1)).alias("n"), F.min(parent).alias("parent"))
    single = names.filter("n = 1").select(F.col(scope).alias("s"), F.col(name).alias("unique_name"))
    step = names.join(single, (F.col(scope) == F.col("s")) & (F.col("parent") == F.col("unique_name")), "left")
    step = materialise(step.select(scope, name, F.when(F.col("unique_name") != F.col(name), F.col("unique_name")).alias("up")))
    largest = step.groupBy(scope).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    now = step.select(scope, name, F.coalesce("up", name).alias("root"), F.col("up").isNotNull().cast("int").alias("depth"), F.col("up").isNotNull().alias("open"))
    reach = 1
    while reach < 2 * largest and (reach == 1 or not now.filter("open").isEmpty()):
        ahead = now.select(F.col(scope).alias("s"), F.col(name).alias("at"), F.col("root").alias("far"), F.col("depth").alias("more"), F.col("open").alias("on"))
        grown = now.filter("open").join(ahead, (F.col(scope) == F.col("s")) & (F.col("root") == F.col("at")))
        grown = grown.select(scope, name, F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("on").alias("open"))
        now, reach = materialise(now.filter("not open").unionByName(grown)), 2 * reach
    done, rest = now.filter("not open").drop("open"), now.filter("open")
    if rest.isEmpty():
        return done
    return done.unionByName(_rings(step.join(rest.select(scope, name), [scope, name], "left_semi"), scope, name))


def _rings(step: DataFrame, scope: str, name: str) -> DataFrame:
    """(scope, name, root, depth) for names (with `up`) that lead into a ring: the walk ends before it would come to a name again."""
    # path: the ancestors in order, nearest first; it stops before what would repeat.
    now = step.select(scope, name, F.array("up").alias("path"))
    while True:
        ahead = now.select(F.col(scope).alias("s"), F.col(name).alias("at"), F.col("path").alias("more"))
        tip = F.get("path", F.size("path") - 1)
        grown = now.join(ahead, (F.col(scope) == F.col("s")) & (tip == F.col("at")))
        seen = F.concat(F.array(name), F.col("path"))
        stop = F.array_min(F.filter(F.transform(F.col("more"), lambda x, i: F.when(F.array_contains(seen, x), i)), lambda i: i.isNotNull()))
        fresh = F.when(stop.isNull(), F.col("more")).otherwise(F.slice("more", 1, stop))
        nxt = materialise(grown.withColumn("fresh", fresh).select(scope, name, F.concat("path", "fresh").alias("path"), F.size("fresh").alias("moved")))
        if nxt.filter("moved > 0").isEmpty():
            return nxt.select(scope, name, F.get("path", F.size("path") - 1).alias("root"), F.size("path").alias("depth"))
        now = nxt.drop("moved")


def assigned(items: DataFrame) -> DataFrame:
    """items with scope and root."""
    scoped = items.withColumn("scope", text.scope(F.col("origin")))
    found = roots(scoped).select(F.col("scope").alias("_s"), F.col("name").alias("_n"), "root")
    return scoped.join(found, (F.col("scope") == F.col("_s")) & (F.col("name") == F.col("_n"))).drop("_s", "_n")


def families(items: DataFrame) -> DataFrame:
    """(scope, name, origin, grp, digest, members): one row per item that is its own root, with members array<struct<name, origin,
    digest>>, root first, then by name. Two roots that name each other each have the other as a member."""
    rows = materialise(assigned(items).select("scope", "name", "origin", "grp", "digest", "root"))
    is_root = F.col("name") == F.col("root")
    heads = rows.filter(is_root).select("scope", "name", "origin", "grp", "digest")
    # A name held twice in a scope gives one family for each of its items; nested items follow a root that is held once.
    nested = rows.filter(~is_root).groupBy("scope", "root").agg(F.collect_list(F.struct(F.lit(1).alias("k"), "name", "origin", "digest")).alias("nested"))
    # the roots of a two-cycle resolve to each other: each is still the head of a family
    cyclic = rows.filter(~is_root).select(F.col("scope").alias("cs"), F.col("name").alias("cn"), F.col("root").alias("cr"))
    loops = cyclic.join(cyclic.select(F.col("cs").alias("ds"), F.col("cn").alias("dn"), F.col("cr").alias("dr")), (F.col("cs") == F.col("ds")) & (F.col("cr") == F.col("dn"))).select(F.col("cs").alias("ls"), F.col("cr").alias("ln")).distinct()
    heads = heads.unionByName(rows.join(loops, (F.col("scope") == F.col("ls")) & (F.col("name") == F.col("ln")), "left_semi").filter(~is_root).select("scope", "name", "origin", "grp", "digest"))
    nested = nested.select(F.col("scope").alias("_s"), F.col("root").alias("_r"), "nested")
    out = heads.join(nested, (F.col("scope") == F.col("_s")) & (F.col("name") == F.col("_r")), "left")
    own = F.array(F.struct(F.lit(0).alias("k"), "name", "origin", "digest"))
    members = F.array_sort(F.concat(own, F.coalesce("nested", F.array().cast("array<struct<k:int,name:string,origin:string,digest:string>>"))))
    out = out.withColumn("members", F.transform(members, lambda m: F.struct(m["name"].alias("name"), m["origin"].alias("origin"), m["digest"].alias("digest"))))
    return out.select("scope", "name", "origin", "grp", family_digest().alias("digest"), "members")


def family_digest(members: str = "members", digest: str = "digest"):
    """SHA-256 over name:digest lines, root first then by name; a family of one keeps its own digest."""
    lines = F.array_join(F.transform(members, lambda m: F.concat(m["name"], F.lit(":"), m["digest"], F.lit("\n"))), "")
    return F.when(F.size(members) == 1, F.get(members, F.lit(0))["digest"]).otherwise(F.sha2(lines.cast("binary"), 256))


def distinct_families(units: DataFrame) -> DataFrame:
    """Of families with equal names and contents throughout, the first by origin."""
    w = Window.partitionBy("name", "digest", F.size("members")).orderBy("origin")
    return units.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
