"""Exact substring deduplication with fixed-block anchors.

A window is WINDOW consecutive words. Every window holds, whole, one of the non-overlapping blocks of BLOCK words that
start at multiples of BLOCK, so where a window's words occur a second time, a block of the one lies in the other. The blocks of all
documents are the index; every rolling run of BLOCK words of every document probes it; where a probe hits, the windows around
the hit are verified, and verified windows that overlap make the maximal exact repeats.

How it scales: documents are dealt once into chunks, a bucketed table. A chunk sends the distinct hashes of its runs, sorted,
delta coded and compressed (about 4 bytes a word), to the owners of hash ranges; each hash goes once from a chunk, however often
it occurs there, so a passage that stands in a third of all documents costs its owner one entry per chunk. Owners answer each
chunk with the hashes that are hit. The same exchange then settles the windows near hits. Texts move once. A chunk has about CHUNK_BYTES of
text and an owner's range the hashes of about OWNER_BYTES, whatever the input's size, so that a task's memory does not grow with it;
messages are as many as chunks times owners, as blocks of an ordinary shuffle are.

Words are `[^\\x20\\x09-\\x0D]+`. Runs are compared by 48 bits for candidates, and windows, when verified, by two hashes of independent
halves of the words' 128-bit hashes, 95 bits in all: by chance, two different windows of 10^13 are equal once in some 700 corpora.

Defined cases: null texts have no words; texts shorter than a window keep all; repeated rows are documents of their own and
so lose what they repeat; an empty table gives an empty result; other columns pass through; the columns that are added begin with
`_x_`, and with one more _ where the input has columns that begin so.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import base

WINDOW = 35
BLOCK = (WINDOW + 1) // 2
#: A chunk is what one Python call is given: so many for each shuffle partition, or more if they would have more than CHUNK_BYTES each. There is an
#: owner for each shuffle partition, or more by OWNER_BYTES of text.
CHUNKS, CHUNK_BYTES, OWNER_BYTES = 2, 16 << 20, 32 << 20
#: Texts of a chunk are hashed in slices of about so many bytes, and hashes settled in ranges of about so many.
SLICE, RANGE = 2 << 20, 1 << 18
_ODD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


# ---- hashes -------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from the words' hashes, by doubling."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, dtype="uint64")
    out, at, k, p = None, 0, 1, h
    while True:
        if n & k:
            piece = p[at : at + m]
            out = piece if out is None else _mix(out * _ODD + piece)
            at += k
        if 2 * k > n:
            return out
        p = _mix(p[:-k] * _ODD + p[k:])
        k *= 2


class Words:
    """The words of a chunk's texts: one row of hashes, another of independent ones, and where each text begins."""

    def __init__(self, texts: pa.ChunkedArray, keep: bool = False) -> None:
        h = xxhash.xxh3_128_digest
        self.words, parts, sizes = [], [], []
        for text in texts:
            words = (text.as_py() or b"").split()
            sizes.append(len(words))
            parts.append(b"".join(map(h, words)))
            if keep:
                self.words.append(words)
        self.sizes = np.array(sizes, dtype="int64")
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        both = np.frombuffer(b"".join(parts), dtype="<u8").reshape(-1, 2)
        self.hashes, self.second = np.ascontiguousarray(both[:, 0]), both[:, 1]

    @staticmethod
    def slices(texts: pa.ChunkedArray, keep: bool = False) -> Iterator["Words"]:
        """The texts in order, SLICE bytes at a time: memory follows the slice, but for what callers gather."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype("int64"))
        at = 0
        while at < len(sizes):
            end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, side="right"))
            end = max(end, at + 1)
            yield Words(texts.slice(at, end - at), keep)
            at = end

    def whole(self, n: int) -> np.ndarray:
        """Starts of the runs of n words that stay within a text."""
        last = np.repeat(self.ends - n, self.sizes)
        at = np.arange(len(self.hashes))
        return at[at <= last]


# ---- the exchange -------------------------------------------------------------------------------------------

# seconds: empty, or the second hash of each value, 4 bytes each
REQUEST = "owner int, chunk int, n long, hashes binary, seconds binary"
ANSWER = "_x_chunk int, n long, hashes binary, seconds binary"


def encode(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers: differences, byte plane by byte plane, compressed."""
    planes = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def decode(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype="uint64")


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    names = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({name: pa.array([r[i] for r in rows], type=kinds[kind]) for i, (name, kind) in enumerate(names)})


def request(chunk: int, values: np.ndarray, bits: int, low: int, owners: int, seconds: np.ndarray | None = None) -> pa.Table:
    """values: ascending, of bits + low bits, of which the low ones are flags. Owners hold equal ranges of the high ones."""
    starts = [(o << bits) // owners for o in range(owners)]
    cuts = np.searchsorted(values, np.array([s << low for s in starts], dtype="uint64"))
    cuts = [*cuts.tolist(), len(values)]
    extra = lambda a, b: b"" if seconds is None else seconds[a:b].astype("<u4").tobytes()
    return _rows(REQUEST, [(o, chunk, b - a, encode(values[a:b]), extra(a, b)) for o, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a])


def _decoded(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray | None]]:
    seconds = [np.frombuffer(b.as_py(), dtype="<u4") for b in table["seconds"]]
    hashes = [decode(b.as_py(), n.as_py()) for b, n in zip(table["hashes"], table["n"], strict=True)]
    return [(h, x if len(x) else None) for h, x in zip(hashes, seconds, strict=True)]


def _firsts(keys: np.ndarray, seconds: np.ndarray | None) -> np.ndarray:
    """Where, in a sorted row of keys (and second keys), others begin."""
    other = keys[1:] != keys[:-1]
    if seconds is not None:
        other |= seconds[1:] != seconds[:-1]
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), other]))


def answers(requests: DataFrame, low: int, need_block: bool) -> DataFrame:
    """What is met from two places, by chunk. Flags: bit 0 met twice in the chunk, bit 1 (if low is 2) a block has it."""

    @base.relieved
    def settle(table: pa.Table) -> pa.Table:
        parts = _decoded(table)
        paired = parts[0][1] is not None
        answered: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in parts]
        least, most = min(int(p[0]) for p, _ in parts) >> low, max(int(p[-1]) for p, _ in parts) >> low
        steps = max(1, sum(len(p) for p, _ in parts) // RANGE)
        edges = [(least + (most + 1 - least) * k // steps) << low for k in range(1, steps)]
        cuts = [[0, *np.searchsorted(p, np.array(edges, dtype="uint64")).tolist(), len(p)] for p, _ in parts]
        for k in range(steps):
            values = np.concatenate([p[c[k] : c[k + 1]] for (p, _), c in zip(parts, cuts, strict=True)])
            if not len(values):
                continue
            seconds = np.concatenate([x[c[k] : c[k + 1]] for (_, x), c in zip(parts, cuts, strict=True)]) if paired else None
            source = np.repeat(np.arange(len(parts), dtype="int32"), [c[k + 1] - c[k] for c in cuts])
            order = np.lexsort((seconds, values >> np.uint64(low))) if paired else np.argsort(values, kind="stable")
            values, source, seconds = values[order], source[order], seconds[order] if paired else None
            keys = values >> np.uint64(low)
            first = _firsts(keys, seconds)
            met = np.add.reduceat(1 + (values & np.uint64(1)).astype("int64"), first) >= 2
            if need_block:
                met &= np.maximum.reduceat((values >> np.uint64(1)) & np.uint64(1), first) > 0
            hit = np.flatnonzero(np.repeat(met, np.diff([*first, len(values)])))
            hit = hit[np.argsort(source[hit], kind="stable")]  # keys stay ascending within a source
            ends = np.searchsorted(source[hit], np.arange(len(parts) + 1)).tolist()
            for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                if b > a:
                    answered[i].append((keys[hit[a:b]], seconds[hit[a:b]] if paired else np.empty(0, dtype="<u4")))
        chunks = table["chunk"].to_pylist()
        return _rows(ANSWER, [(chunks[i], sum(len(h) for h, _ in x), encode(np.concatenate([h for h, _ in x])), np.concatenate([y for _, y in x]).astype("<u4").tobytes()) for i, x in enumerate(answered) if x])

    return requests.groupBy("owner").applyInArrow(settle, ANSWER)


def _flagged(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct values, ascending, with flag bits: a block has it, met twice. Bit 0 of what comes in says that it is a block. parts is emptied."""
    both = np.concatenate(parts) if parts else np.empty(0, dtype="uint64")
    parts.clear()
    both.sort()
    one, out, at = np.uint64(1), [], 0
    while at < len(both):  # a range at a time, which ends where a value does
        end = len(both) if at + RANGE >= len(both) else int(np.searchsorted(both, ((both[at + RANGE] >> one) + one) << one))
        part = both[at:end]
        keys = part >> one
        first = _firsts(keys, None)
        size = np.diff([*first, len(keys)])
        out.append((keys[first] << np.uint64(2)) | ((part[first + size - 1] & one) << one) | (size > 1).astype("uint64"))
        at = end
    return np.concatenate(out) if out else both


def _pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of hashes, ascending by the first, which gets a flag bit: met twice."""
    if not parts:
        return np.empty(0, dtype="uint64"), np.empty(0, dtype="uint64")
    hashes, seconds = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((seconds, hashes))
    hashes, seconds = hashes[order], seconds[order]
    first = _firsts(hashes, seconds)
    return (hashes[first] << np.uint64(1)) | (np.diff([*first, len(hashes)]) > 1).astype("uint64"), seconds[first]


def _union(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, second hashes or none) of a chunk's answers, ascending by the first."""
    parts = _decoded(table)
    if not parts:
        return np.empty(0, dtype="uint64"), np.empty(0, dtype="uint64")
    hashes = np.concatenate([h for h, _ in parts])
    order = np.argsort(hashes, kind="stable")
    return hashes[order], np.concatenate([x for _, x in parts])[order] if parts[0][1] is not None else np.empty(0, dtype="uint64")


def _among(values: np.ndarray, known: np.ndarray, seconds: np.ndarray | None = None, known_seconds: np.ndarray | None = None) -> np.ndarray:
    """Which values are among those known, both ascending; with second hashes, these must be equal as well."""
    out = np.zeros(len(values), dtype=bool)
    if not len(known):
        return out
    at = np.searchsorted(known, values)
    alike = int(np.diff([*_firsts(known, None), len(known)]).max()) if seconds is not None else 1  # one, but for collisions
    for k in range(alike):
        here = np.minimum(at + k, len(known) - 1)
        same = known[here] == values
        out |= same if seconds is None else same & (known_seconds[here] == seconds)
    return out


def _covered(starts: np.ndarray, total: int, n: int) -> np.ndarray:
    """Which of total places lie in [s, s + n) for some start s."""
    steps = np.zeros(total + n + 1, dtype="int64")
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps)[:total] > 0


# ---- the operator -------------------------------------------------------------------------------------------


def dealt(docs: DataFrame, text: str, chunk: str) -> tuple[DataFrame, int]:
    """docs in chunks by row number (column chunk), as a table bucketed by chunk; and the number of owners."""
    spark = base.ready(docs.sparkSession)
    n, size = base.partitions(spark), docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    rows = docs.withColumn(chunk, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(n * CHUNKS, -(-size // CHUNK_BYTES)))).cast("int"))
    name = f"quarry_{uuid.uuid4().hex}"
    base.made("folder", f"{base.scratch(spark)}/{name}")
    base.made("table", name)
    rows.repartition(n, chunk).write.bucketBy(n, chunk).option("path", f"{base.scratch(spark)}/{name}").saveAsTable(name)
    return spark.table(name), max(n, -(-size // OWNER_BYTES))


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without their texts, with (behind base.prefix(docs, "_x_")) n_words, n_removed and kept: the words that no repeated window
    covers, joined by one space (the text as it was if nothing is removed)."""
    block, p = (window + 1) // 2, base.prefix(docs, "_x_")
    table, owners = dealt(docs, text, p + "chunk")
    texts = table.select(F.col(p + "chunk").alias("_x_chunk"), F.col(text).cast("binary").alias("text"))

    @base.relieved
    def probes(t: pa.Table) -> pa.Table:
        parts = []
        for words in Words.slices(t["text"]):
            at = words.whole(block)
            blocks = (at - np.repeat(words.begins, words.sizes)[at]) % block == 0
            parts.append(((runs(words.hashes, block)[at] >> np.uint64(16)) << np.uint64(1)) | blocks.astype("uint64"))
        return request(t["_x_chunk"][0].as_py(), _flagged(parts), 48, 2, owners)

    hits = base.materialise(answers(texts.groupBy("_x_chunk").applyInArrow(probes, REQUEST), 2, True))

    def both(words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return runs(words.hashes, window)[starts] >> np.uint64(1), (runs(words.second, window)[starts] >> np.uint64(32)).astype("<u4")

    @base.relieved
    def windows(t: pa.Table, answer: pa.Table) -> pa.Table:
        if not t.num_rows or not answer.num_rows:
            return _rows(REQUEST, [])
        known, parts = _union(answer)[0], []
        for words in Words.slices(t["text"]):
            at = words.whole(block)
            hit = at[_among(runs(words.hashes, block)[at] >> np.uint64(16), known)]
            near = np.zeros(len(words.hashes) + 1, dtype="int64")
            np.add.at(near, hit + 1, 1)
            near = np.cumsum(near)  # hits before a place
            starts = words.whole(window)
            starts = starts[near[starts + window - block + 1] > near[starts]]
            if len(starts):
                parts.append(both(words, starts))
        values, seconds = _pairs(parts)
        return request(t["_x_chunk"][0].as_py(), values, 63, 1, owners, seconds)

    asked = texts.groupBy("_x_chunk").cogroup(hits.groupBy("_x_chunk")).applyInArrow(windows, REQUEST)
    repeats = base.materialise(answers(asked, 1, False))
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != text], T.StructField(p + "n_words", T.LongType()), T.StructField(p + "n_removed", T.LongType()), T.StructField(p + "kept", T.StringType())])

    @base.relieved
    def cut(t: pa.Table, answer: pa.Table) -> pa.Table:
        whole = t.select(rest)
        plain = t[text]
        (known, second), sizes, kept, removed = _union(answer), [], [], []
        for words in Words.slices(pc.cast(plain, pa.binary()), keep=True):
            starts = words.whole(window)
            if len(known) and len(starts):
                hashes, seconds = both(words, starts)
                starts = starts[_among(hashes, known, seconds, second)]
            else:
                starts = starts[:0]
            gone = _covered(starts, len(words.hashes), window)
            for own, a, b in zip(words.words, words.begins.tolist(), words.ends.tolist(), strict=True):
                lost = gone[a:b]
                n = int(lost.sum())
                sizes.append(b - a)
                removed.append(n)
                kept.append(b" ".join([w for w, x in zip(own, lost.tolist(), strict=True) if not x]).decode() if n else plain[len(kept)].as_py())
        out = whole
        for name, values, kind in (("n_words", sizes, pa.int64()), ("n_removed", removed, pa.int64()), ("kept", kept, pa.string())):
            out = out.append_column(p + name, pa.array(values, kind))
        return out

    return table.groupBy(p + "chunk").cogroup(repeats.groupBy("_x_chunk")).applyInArrow(cut, schema)


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the repeats cut from their texts, and n_chars (where there is such a column) to match."""
    p = base.prefix(docs, "_x_")
    out = without_repeats(docs, text).withColumnRenamed(p + "kept", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(p + "n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = base.mark()
    out = without_repeats(base.read(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.filter(F.split("_x_kept", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.when(F.col("_x_n_removed") > 0, F.col("_x_kept")).otherwise(F.array_join(words, " "))
    # The rows are short: they are written, so that the dealt texts and the messages can go.
    out = base.materialise(out.select("doc_id", F.col("_x_n_words").alias("n_words"), F.col("_x_n_removed").alias("n_removed"), F.sha2(F.coalesce(kept, F.lit("")).cast("binary"), 256).alias("kept_sha256")))
    base.released(since, out)
    return out
