"""Near copies by the Jaccard similarity of their word shingles: MinHash bands find candidates, exact sets verify them.

Two texts are near copies if the sets of their SHINGLE-word shingles have a Jaccard similarity of MIN_SIMILARITY or more.
A text has BANDS hashes of ROWS minima each; texts that share one are candidates. At the limit a pair is a candidate with
a chance of 1 - (1 - 0.8 ** 5) ** 20 = 0.9996, above it with more. Of a bucket's members each is first verified against the least.
Then buckets whose members are not all connected are looked at again, by prefixes: shingles are put in one order, the rare ones
first, and two texts of n and m shingles that are near copies have o = 0.8 / 1.8 * (n + m) or more in common, so that one of the
first n - o + 1 of the one is among the first m - o + 1 of the other. Only pairs that have such a shingle in common, and are not
connected yet, are compared; every other pair of a bucket is connected, or cannot be alike. Copies that differ from a common source in
shingles of their own have those in front, and meet nobody by them, however many they are (see the README for what still
costs).

Defined cases: texts without words, and rows without a key, are no copies of anything; fewer than SHINGLE words make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import base, graph
from quarry.llm.simhash import _LOWER
from quarry.llm.substring import runs

SHINGLE, MIN_SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
_FACTORS = np.random.default_rng(42).integers(1, 1 << 63, size=BANDS * ROWS, dtype="uint64") | np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype="uint64")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype="uint64", count=len(words))
    return np.unique(runs(h, min(SHINGLE, len(h))))


def bands(own: np.ndarray) -> list[int]:
    if not len(own):
        return []
    least = np.array([(own * f).min() for f in _FACTORS], dtype="<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least)]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bands(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield pa.array([bands(shingles(x.as_py())) for x in texts], pa.list_(pa.int64()))
    base.relieve()


@F.arrow_udf(T.BinaryType())
def _sets(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield pa.array([shingles(x.as_py()).tobytes() for x in texts], pa.binary())
    base.relieve()


@F.arrow_udf(T.ArrayType(T.LongType()))
def _hashes(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        yield pa.array([shingles(x.as_py()).view("int64") for x in texts], pa.list_(pa.int64()))
    base.relieve()


@F.arrow_udf(T.BooleanType())
def _similar(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in it:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = np.frombuffer(x.as_py(), dtype="uint64"), np.frombuffer(y.as_py(), dtype="uint64")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both >= MIN_SIMILARITY * (len(a) + len(b) - both) - 1e-9)
        yield pa.array(out, pa.bool_())
    base.relieve()


def _verified(pairs: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """The pairs (a, b) that are near copies. Sets are made of the texts that are in a pair only."""
    keys = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    some = docs.join(base.bounded(keys), F.col(key) == F.col("k"), "left_semi")
    sets = base.materialise(some.select(F.col(key).alias("k"), _sets(F.col(text).cast("binary")).alias("own")))
    left, right = sets.select(F.col("k").alias("a"), F.col("own").alias("x")), sets.select(F.col("k").alias("b"), F.col("own").alias("y"))
    out = pairs.join(left, "a").join(right, "b").filter(_alike(F.octet_length("x"), F.octet_length("y")))
    return base.materialise(out.filter(_similar("x", "y")).select("a", "b"))


def _shared(n: Column, m: Column) -> Column:
    """How many shingles texts of n and m of them share at least, if they are near copies."""
    return F.ceil(MIN_SIMILARITY / (1 + MIN_SIMILARITY) * (n + m) - 1e-6)


def _alike(n: Column, m: Column) -> Column:
    """Whether sizes do not rule a near copy out."""
    return F.least(n, m) >= MIN_SIMILARITY * F.greatest(n, m) - 1e-6


def _prefixes(labelled: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """(a, root, n, s, at): the shingles s that stand first in members of buckets (bucket, a, root), with their places, from 0. As many as
    a near copy from one of a's buckets may need: it has as many shingles as the bucket's smallest member, or more."""
    some = docs.join(base.bounded(labelled.select(F.col("a").alias("k")).distinct()), F.col(key) == F.col("k"), "left_semi")
    sets = base.materialise(some.select(F.col(key).alias("a"), _hashes(F.col(text).cast("binary")).alias("own")).withColumn("n", F.size("own")))
    sized = labelled.join(sets.select("a", "n"), "a")
    least = sized.groupBy("bucket").agg(F.min("n").alias("m"))
    least = sized.join(least, "bucket").groupBy("a", "root", "n").agg(F.min("m").alias("m"))
    rows = sets.select("a", F.explode("own").alias("s"))
    # A shingle that one member has connects nothing: such ones stand before all others, and are not listed.
    known = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    back = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("df"), F.desc("s")))
    placed = rows.join(known, "s").withColumn("back", back).join(least, "a").withColumn("at", F.col("n") - F.col("back"))
    most = F.col("n") - _shared(F.col("n"), F.greatest(F.col("m"), MIN_SIMILARITY * F.col("n")))
    return base.materialise(placed.filter(F.col("at") <= most).select("a", "root", "n", "s", "at"))


def _open(labelled: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """Pairs (a, b), a > b, of different roots, that may be near copies: among them all that share a bucket and are."""
    own = _prefixes(labelled, docs, text, key)
    held = own.groupBy("s", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("s")
    held = held.agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("s", "main")
    own = base.materialise(own.join(base.bounded(base.materialise(held)), "s"))
    # A pair has a member outside the root that most who have the shingle belong to.
    x = own.filter("root != main").select("s", F.col("a").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    y = own.select("s", F.col("a").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    n, m = F.col("nx"), F.col("ny")
    near = (F.col("rx") != F.col("ry")) & _alike(n, m) & (F.col("ax") <= n - _shared(n, m)) & (F.col("ay") <= m - _shared(n, m))
    met = y.join(base.bounded(x), [y["s"] == x["s"], near])
    return met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def links(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (a, b), a > b, that connect all near copies. Keys must not repeat."""
    base.ready(docs.sparkSession)
    docs = docs.filter(F.col(key).isNotNull()).select(key, text)
    members = base.materialise(docs.select(F.col(key).alias("a"), F.explode(_bands(F.col(text).cast("binary"))).alias("bucket")))
    shared = members.groupBy("bucket").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "b")
    members = base.materialise(members.join(shared, "bucket"))
    first = base.materialise(members.filter("a > b").select("a", "b").distinct())
    found = _verified(first, docs, text, key)
    named = graph.components(found)
    labelled = members.join(named.select(F.col("node").alias("a"), "root"), "a", "left").select("bucket", "a", F.coalesce("root", "a").alias("root"))
    labelled = base.materialise(labelled)
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    labelled = base.materialise(labelled.join(mixed, "bucket", "left_semi"))
    rest = base.materialise(_open(labelled, docs, text, key).join(first, ["a", "b"], "left_anti"))
    return found if rest.isEmpty() else found.unionByName(_verified(rest, docs, text, key))


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those that are connected to one with a smaller key. Keys must not repeat."""
    p = base.prefix(docs, "_j_")
    gone = graph.components(base.materialise(links(docs, text, key))).filter("node != root").select(F.col("node").alias(p + "key"))
    return docs.join(base.bounded(base.materialise(gone)), F.col(key) == F.col(p + "key"), "left_anti")
