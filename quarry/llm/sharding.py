"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 2^32 positions. A key belongs to the arc that ends in the next
point clockwise; a shard that is full passes the keys it cannot hold on to the next distinct shard clockwise.

Keys of one arc walk the same sequence of shards, so who goes where is settled on counts per arc: a table of
`shards * vnodes` entries, whatever the number of rows. Rows then only need their rank within their arc, and
arcs are ranked in PIECES independent pieces each, so that no key, however frequent, meets in one task. Rank and piece follow a hash of
the row's whole content, so how files and partitions are laid out decides nothing. Rows that are equal in all columns would share a piece:
where they are more than their share, they are dealt by row number to pieces of their own that rank behind all others
(which of two equal rows is which can't be told).

Laws: "rows" (a shard holds the row count over the shards, rounded up or down: counts differ by one at most, so shards
have no slack and a further shard also moves some rows between the old ones);
"key" (no capacity, the plain ring: key and number of shards decide, a further shard takes keys only into itself).

Defined cases: null keys are dealt by the rest of their row; a null text has size 1 and CRC 0; repeated rows are
rows of their own; an empty table gives an empty result; the columns of the input come back unchanged, and where one is called
shard, slot or grown_shard, the result's own has _s_ before its name.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import base

RING = 1 << 32
PIECES = 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard), ascending. A shard's points do not depend on the number of shards."""
    return sorted((xxhash.xxh64_intdigest(struct.pack("<qq", s, v), 7) % RING, s) for s in range(shards) for v in range(vnodes))


def walk(points: list[tuple[int, int]], arc: int) -> list[int]:
    """The shards that keys of an arc try, in order."""
    return list(dict.fromkeys(points[(arc + i) % len(points)][1] for i in range(len(points))))


def settle(points: list[tuple[int, int]], load: list[int], room: list[int] | None) -> list[list[tuple[int, int]]]:
    """For each arc the (shard, rows) parts in clockwise order. load: rows by arc; room: rows by shard, None: no bound.

    In step k the rows of an arc that have no place yet ask the arc's k-th shard clockwise. Rows once
    placed stay, so only the overflow moves on; as every shard is asked within len(room) steps, all rows find a place
    if there is room for all."""
    if room is None:
        return [[(points[a][1], n)] if n else [] for a, n in enumerate(load)]
    left, free, parts = list(load), list(room), [[] for _ in load]
    ways = [walk(points, a) for a in range(len(load))]
    for step in range(len(room)):
        for a, way in enumerate(ways):
            if left[a] and step < len(way) and (take := min(left[a], free[way[step]])):
                parts[a].append((way[step], take))
                free[way[step]] -= take
                left[a] -= take
    return parts


def place(rows: DataFrame, key: str, shards: int, law: str = "rows", vnodes: int = 64) -> DataFrame:
    """rows with shard, slot (gapless from 0 within the shard) and grown_shard (law "key": with one shard more; else
    null). rows should be narrow, without texts: they are written once before they are ranked."""
    if law not in ("rows", "key"):
        raise ValueError(law)
    points, grown = ring(shards, vnodes), ring(shards + 1, vnodes)
    (ends, owner), (ends2, owner2) = (tuple(np.array(x, dtype="int64") for x in zip(*p, strict=True)) for p in (points, grown))

    @F.arrow_udf("arc int, grown int")
    def spot(h: pa.Array) -> pa.Array:
        at = h.to_numpy(zero_copy_only=False).astype("int64") % RING
        arc, other = (np.searchsorted(ends, at) % len(ends)).astype("int32"), owner2[np.searchsorted(ends2, at) % len(ends2)].astype("int32")
        return pa.StructArray.from_arrays([pa.array(arc), pa.array(other)], names=["arc", "grown"])

    own, p = rows.columns, base.prefix(rows, "_s_")
    content = [F.col(c).isNull() for c in own] + [F.col(c) for c in own]  # xxhash64 passes over nulls
    hashed = rows.withColumn(p + "row", F.xxhash64(*content))
    # xxhash64 of a null is its seed: rows without a key would all share one arc
    hashed = hashed.withColumn(p + "at", spot(F.when(F.col(key).isNull(), F.col(p + "row")).otherwise(F.xxhash64(F.col(key)))))
    hashed = base.materialise(hashed.withColumn(p + "id", F.monotonically_increasing_id()))
    # At most 4 * partitions rows can have more copies than that.
    copies = hashed.groupBy(F.col(p + "row").alias(p + "same")).agg(F.count(F.lit(1)).alias("n"))
    share = max(1000, hashed.count() // (4 * base.partitions(rows.sparkSession)))
    many = F.broadcast(base.materialise(copies.filter(F.col("n") > share).select(p + "same")))
    rows = hashed.join(many, F.col(p + "row") == F.col(p + "same"), "left")
    nth_piece = F.when(F.col(p + "same").isNull(), F.pmod(F.col(p + "row"), F.lit(PIECES))).otherwise(PIECES + F.pmod(F.xxhash64(p + "id"), F.lit(PIECES)))
    rows = rows.select(*own, p + "row", p + "id", F.col(p + "at")["grown"].alias(p + "grown"), (F.col(p + "at")["arc"] * (2 * PIECES) + nth_piece.cast("int")).alias(p + "piece"))

    # At most 2 * shards * vnodes * PIECES counts, whatever the number of rows.
    counts = np.zeros(len(points) * 2 * PIECES, dtype="int64")
    for piece, n in rows.groupBy(p + "piece").count().collect():
        counts[piece] = n
    load, total = counts.reshape(-1, 2 * PIECES).sum(axis=1), int(counts.sum())
    room = [total // shards + (s < total % shards) for s in range(shards)] if law == "rows" else None
    base_of = np.concatenate([[0], np.cumsum(counts)[:-1]])  # rank of a piece's first row among all rows
    starts, shard_of, slot_of, at, filled = [], [], [], 0, [0] * shards
    for parts in settle(points, load.tolist(), room):
        for s, n in parts:
            starts.append(at)
            shard_of.append(s)
            slot_of.append(filled[s])
            at += n
            filled[s] += n
    starts, shard_of, slot_of = (np.array(x or [0], dtype="int64") for x in (starts, shard_of, slot_of))

    @F.arrow_udf("shard int, slot long")
    def seat(piece: pa.Array, nth: pa.Array) -> pa.Array:
        rank = base_of[piece.to_numpy(zero_copy_only=False)] + nth.to_numpy(zero_copy_only=False) - 1
        part = np.searchsorted(starts, rank, side="right") - 1
        return pa.StructArray.from_arrays([pc.cast(pa.array(shard_of[part]), pa.int32()), pa.array(slot_of[part] + rank - starts[part])], names=["shard", "slot"])

    ranked = rows.withColumn(p + "nth", F.row_number().over(Window.partitionBy(p + "piece").orderBy(p + "row", p + "id")).cast("long"))
    out = ranked.withColumn(p + "seat", seat(p + "piece", p + "nth"))
    other = F.col(p + "grown") if law == "key" else F.lit(None).cast("int")
    taken = {c.lower() for c in own}
    name = lambda c: p + c if c in taken else c
    return out.select(*own, F.col(p + "seat")["shard"].alias(name("shard")), F.col(p + "seat")["slot"].alias(name("slot")), other.alias(name("grown_shard")))


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), base.crc32(F.col("text")).alias("text_crc32"), F.lit("rows").alias("law"))
    return place(sized, "doc_id", 8, "rows")
