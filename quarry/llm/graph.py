"""Connected components of a link table, by alternating large-star and small-star rounds.

Links stay in tables throughout: no node or link reaches the driver, which sees one count per round. Each round
is written to the shared folder, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import base

MAX_ROUNDS = 60


#: What a node and its least neighbour take in a broadcast, at most.
NODE_BYTES = 64


def _star(pairs: DataFrame, larger_only: bool, small: bool) -> DataFrame:
    """pairs (u, v): every neighbour v of u (those above u only, or all not above) linked to the least of u and its neighbours. small: the
    nodes' table may be broadcast, so that the links of a node that has most of them stay where they are."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    least = F.broadcast(least) if small else least
    joined = pairs.join(least, "u")
    out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if larger_only else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b), a > b. Returns (node, root): each node that has a link, and the least node it can reach."""
    now, seen = links.select("a", "b"), None
    n = now.count()
    for _ in range(MAX_ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        small_enough = 2 * n * NODE_BYTES <= base.BROADCAST_BYTES  # n links have 2 n nodes at most
        large = _star(both, True, small_enough)
        # small star: a > b holds for every link, so the neighbours below a are the b of its links
        small = base.materialise(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False, small_enough))
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen is not None:
            base.drop(now)
        now = small
        if not state[0] or seen == tuple(state):
            break
        seen, n = tuple(state), state[0]
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
