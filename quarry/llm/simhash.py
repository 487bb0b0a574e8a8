"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has a bit set where over half of its 3-word shingles' XXH64 have it set. Two fingerprints
that differ in at most 2r bits have a common variant within r bits of each, so every distinct fingerprint emits its
ball of radius r (r = 1: itself and its 64 one-bit neighbours), the shuffle brings equal variants together, and
colliding fingerprints are verified. A bucket cannot hold more than one ball (65 distinct fingerprints), and
any two of its members are within 2r bits, so linking each to the least loses no connection: the number of
links is linear in the number of fingerprints, whatever the size of a group of copies, and ways through a group are short.

Defined cases: a text without words, or null, has fingerprint zero and is linked like any other; fewer than three
words make one shingle; null document ids take no part in the choice of a component's id (null if it has no
other); repeated rows and equal texts share a fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import base, graph

SHINGLE, SEED = 3, 42
#: Fingerprints link at twice this many differing bits or fewer.
RADIUS = 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes | None) -> int:
    """Unsigned."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype="int64", count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - SHINGLE] + 1])
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(64, dtype="int64")
    for k in range(0, len(hashes), 1 << 16):  # a long text takes no more memory than a short one
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


@F.arrow_udf(T.LongType())
def fingerprints(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield pa.array(np.array([fingerprint(x.as_py()) for x in texts], dtype="uint64").view("int64"))
    base.relieve()


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct longs in column fp. Rows (a, b), a > b, that connect all that are within 2 * RADIUS bits."""
    if RADIUS != 1:
        raise ValueError("balls are enumerated for radius 1")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    ball = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    met = ball.select(F.col("fp").alias("a"), least.alias("b")).filter("a > b")
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * RADIUS).distinct()


def components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, _d_fp, _d_root, _d_first): every row's fingerprint, its component's least fingerprint and smallest key."""
    base.ready(docs.sparkSession)
    rows = base.materialise(docs.select(F.col(key), fingerprints(F.col(text).cast("binary")).alias("_d_fp")))
    fps = base.materialise(rows.groupBy("_d_fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")))
    edges = base.materialise(links(fps.select(F.col("_d_fp").alias("fp"))))
    # Nodes are the fingerprints that have a link; all others are components of their own.
    member = graph.components(edges)
    named = member.join(fps, member["node"] == fps["_d_fp"]).select("node", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    final = named.join(least, "root").select(F.col("node").alias("fp2"), F.col("root").alias("root2"), "least")
    whole = fps.join(final, F.col("_d_fp") == F.col("fp2"), "left")
    whole = base.materialise(whole.select(F.col("_d_fp").alias("fp3"), F.coalesce("root2", "_d_fp").alias("_d_root"), F.coalesce("least", "first").alias("_d_first"), "n"))
    return base.looked_up(rows, "_d_fp", whole, "fp3", "n").select(key, "_d_fp", "_d_root", "_d_first")


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The document with the smallest key of each component: one row of each, also where keys repeat. Rows without a
    key stay, as there is nothing to choose them by.

    What is looked up are the keys that go (and the few that repeat), not those that stay: where they are few enough to be
    broadcast, texts do not move at all."""
    p = base.prefix(docs, "_d_")
    known = base.materialise(components(docs, text, key).filter(F.col(key).isNotNull()))
    keys = known.groupBy(F.col(key).alias(p + "key")).agg(F.max(F.col(key) == F.col("_d_first")).alias("stays"), F.count(F.lit(1)).alias("n"))
    keys = base.materialise(keys.filter("not stays or n > 1"))
    out = docs.join(base.bounded(keys.select(p + "key")), F.col(key) == F.col(p + "key"), "left_anti")
    repeated = keys.filter("stays and n > 1").select(p + "key")
    if repeated.isEmpty():
        return out
    # A key that repeats is judged by row: its fingerprint says to which component it belongs.
    chosen = known.filter(F.col(key) == F.col("_d_first")).join(base.bounded(repeated), F.col(key) == F.col(p + "key"), "left_semi")
    chosen = chosen.select(F.col(key).alias(p + "key"), F.col("_d_fp").alias(p + "fp"), F.col("_d_root").alias(p + "root")).distinct()
    again = docs.join(base.bounded(repeated), F.col(key) == F.col(p + "key"), "left_semi").withColumn(p + "own", fingerprints(F.col(text).cast("binary")))
    again = again.join(chosen, (F.col(key) == F.col(p + "key")) & (F.col(p + "own") == F.col(p + "fp"))).dropDuplicates([key, p + "root"])
    return out.unionByName(again.select(*docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(base.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("_d_fp")), 16, "0").alias("fingerprint"), F.col("_d_first").alias("component_id"))
