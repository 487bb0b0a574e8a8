"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK random walk writes a sequence of characters to a longer embedding: at each step it outputs the character it stands at and
moves on, or stays, by a random bit of (step, character). Sequences a few edits apart fall into step again after each edit,
so their embeddings differ in few places, and sampling SAMPLES places of the embedding is a hash that near sequences share.

Windows have the size of an item, and one starts at every word of every document. Walked one by one, windows of all sizes would read each
character thousands of times. So the walk of a window starts anew at each of its words, and STEPS steps long: what it writes there, a
part, is the same in every window, of whatever size, that holds the word. Each part is walked once, by WALKS walks with random bits and places
of their own, and its samples are one draw of the LSH for all these windows. A window thus has WALKS draws for each of its words, and
meets an item if one draw agrees. No text is passed over: every word of every document is walked, whatever stands there.

A draw says which item a window meets and where in it. Then its edit distance is verified: first a lower bound for many windows at a
time, which loses none (an item is cut into pieces, and a passage within the limit has the pieces within it, each near its place, at
a total distance not above its own), then the exact distance of the characters over the whole window.

Items are the small side. They are taken in blocks of ITEMS_PER_BLOCK: a block is what is sent to the executors, however
many items there are, documents are read once for each block, and never shuffled.

A text is read as its runs of letters and digits, lower-cased, with one space between, so punctuation and case don't hide a passage.
Similarity is one less the edit distance over the item's length; a passage is a leak from MIN_SIMILARITY on. Items of
fewer than SHORT characters, in which an edit or two make another text, are leaks where they stand verbatim, as whole words.

Defined cases: null and empty texts leak nothing; an item without letters or digits is never found; repeated rows are reported each;
of equal matches of an item in a document the first counts; an empty table on either side gives an
empty result; other columns, whatever their names, pass through where documents are returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import base

MIN_SIMILARITY = 0.8
SHORT = 32
ITEMS_PER_BLOCK = 20_000
#: A walk moves every second step on average, so a part is about half as many characters. Measured on the 200 items of sf0.1, of passages within
#: the limit of similarity 95 in 100 are met where a letter of every word is changed, and 99 in 100 where any fifth of the words or of the
#: characters is.
STEPS, SAMPLES, WALKS = 32, 12, 4
#: A part of an item must have so many characters of it before its end.
LEAST_PART = 16
#: Texts are searched in slices of about so many characters, walks taken so many at a time, and pieces compared so many at a time.
CHARS, AT_ONCE, COMPARED = 1 << 21, 1 << 14, 1 << 14
#: Items are compared in pieces of so many characters; windows that begin within NEXT of each other are compared once.
PIECE_CHARS, NEXT = 32, 8
#: From here on scripts do not part words by spaces: every character begins a word.
UNSPACED = 0x2E80

_GAP = re.compile(r"\W+")
_ODD, _M1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def plain(text: str | None) -> str:
    """The words of a text, lower-cased, with one space between."""
    return _GAP.sub(" ", text.lower()).strip(" ") if text else ""


def limit_of(length: int) -> int:
    return int((1 - MIN_SIMILARITY) * length + 1e-9)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


# ---- the embedding ------------------------------------------------------------------------------------------------


def _bits() -> tuple[np.ndarray, np.ndarray]:
    """For each walk: a word for each of 256 classes of characters, whose bit number s is the walk's random bit at step s; and the
    steps at which it is sampled."""
    rng = np.random.default_rng(7)
    places = np.array([np.sort(rng.choice(STEPS, SAMPLES, replace=False)) for _ in range(WALKS)])
    return rng.integers(0, 1 << 63, size=(WALKS, 256), dtype="uint64") * np.uint64(2) + rng.integers(0, 2, size=(WALKS, 256), dtype="uint64"), places


_BITS, _PLACES = _bits()


def word_starts(codes: np.ndarray) -> np.ndarray:
    gap = (codes == 32) | (codes == 10)
    return np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | (codes >= UNSPACED)))


def signatures(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """WALKS rows: the sampled places of each part's embedding, hashed. All parts take a step at a time. Beyond the end stands 0."""
    kinds = np.concatenate([codes.astype(np.uint8), np.zeros(STEPS + 1, dtype=np.uint8)])
    out = np.empty((WALKS, len(starts)), dtype="uint64")
    for walk in range(WALKS):
        sampled, bits = set(_PLACES[walk].tolist()), _BITS[walk][kinds]
        for k in range(0, len(starts), AT_ONCE):
            at = starts[k : k + AT_ONCE].copy()
            sig = np.full(len(at), walk + 1, dtype="uint64")
            here, bit = np.empty(len(at), dtype="uint64"), np.empty(len(at), dtype="uint64")
            for step in range(max(sampled) + 1):
                np.take(bits, at, out=here, mode="clip")
                if step in sampled:
                    sig *= _ODD
                    sig += here
                np.right_shift(here, np.uint64(step), out=bit)
                bit &= np.uint64(1)
                at += bit.view("int64")
            out[walk, k : k + AT_ONCE] = (sig ^ (sig >> np.uint64(29))) * _M1
    return out


# ---- edit distance ------------------------------------------------------------------------------------------------


def edit_match(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of pattern to any substring of text, where the first such substring ends). Bit-parallel, a column at a time."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Pieces:
    """The items' pieces for comparison, those of an item one behind the other."""

    letters: np.ndarray  # code to a number, 0 for what no item has
    masks: np.ndarray  # for each piece and letter, where the letter stands
    begins: np.ndarray  # in the item
    lengths: np.ndarray
    first: np.ndarray  # for each item its first piece, and one more
    limits: np.ndarray  # for each item


def pieces_of(texts: list[str]) -> Pieces:
    coded = [codes_of(t) for t in texts]
    alphabet = np.unique(np.concatenate(coded)) if coded else np.empty(0, dtype="uint32")
    letters = np.zeros(int(alphabet[-1]) + 2 if len(alphabet) else 1, dtype="int64")
    letters[alphabet] = np.arange(1, len(alphabet) + 1)
    masks, begins, lengths, first = [], [], [], [0]
    for c in coded:
        parts = -(-len(c) // PIECE_CHARS)
        edges = (np.arange(parts + 1) * len(c) // parts).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            own = np.zeros(len(alphabet) + 1, dtype="uint32")
            np.bitwise_or.at(own, letters[c[a:b]], np.uint32(1) << np.arange(b - a, dtype="uint32"))
            masks.append(own)
            begins.append(a)
            lengths.append(b - a)
        first.append(len(begins))
    return Pieces(letters, np.array(masks, dtype="uint32").reshape(-1, len(alphabet) + 1), np.array(begins, dtype="int64"), np.array(lengths, dtype="int64"), np.array(first, dtype="int64"), np.array([limit_of(len(t)) for t in texts], dtype="int64"))


def least_distances(pieces: Pieces, coded: np.ndarray, at: np.ndarray, piece: np.ndarray, margin: int) -> np.ndarray:
    """For each pair of a piece and the place in coded (letters' numbers) where it is expected, the least edit distance of the piece to
    a part of the text from margin before to margin behind, all within coded. As edit_match, for many pieces at a time."""
    one, length = np.uint32(1), pieces.lengths[piece].astype("int32")
    width = pieces.masks.shape[1]
    masks, row, top = pieces.masks.ravel(), piece * width, (length - 1).astype("uint32")
    pv, mv, score, best = np.full(len(at), ~np.uint32(0)), np.zeros(len(at), dtype="uint32"), length.copy(), length.copy()
    at = at - margin
    for _ in range(PIECE_CHARS + 2 * margin):
        eq = masks[row + coded[at]]
        at += 1
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> top) & one).view("int32") - ((mh >> top) & one).view("int32")
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best


def possible(pieces: Pieces, coded: np.ndarray, item: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Which windows can hold their item within its limit: pieces' least distances, each looked for as far around its place as the
    limit lets it move, sum to the limit at most. Windows of items of like size are compared together."""
    out = np.zeros(len(item), dtype=bool)
    edge = PIECE_CHARS + 2 * (int(pieces.limits.max()) + NEXT)  # an item is five times its limit: what begins further out can't hold it
    coded = np.concatenate([np.zeros(edge, dtype=coded.dtype), coded, np.zeros(edge + 6 * int(pieces.limits.max()) + PIECE_CHARS, dtype=coded.dtype)])
    begin = np.maximum(begin, -int(pieces.limits.max()) - NEXT) + edge
    order = np.argsort(pieces.limits[item], kind="stable")
    for k in range(0, len(order), COMPARED):
        live = order[k : k + COMPARED]
        spent, nth = np.zeros(len(live), dtype="int64"), 0
        count = (pieces.first[1:] - pieces.first[:-1])[item[live]]
        while len(live):
            done = count <= nth
            out[live[done]] = True
            live, spent, count = live[~done], spent[~done], count[~done]
            if not len(live):
                break
            # from both ends inwards: what meets an item by one draw differs most away from it
            p = pieces.first[item[live]] + np.where(nth % 2, count - 1 - nth // 2, nth // 2)
            margin = int(pieces.limits[item[live]].max()) + NEXT
            spent = spent + least_distances(pieces, coded, begin[live] + pieces.begins[p], p, margin)
            good = spent <= pieces.limits[item[live]]
            live, spent, count, nth = live[good], spent[good], count[good], nth + 1
    return out


# ---- the search ---------------------------------------------------------------------------------------------------


@dataclass
class Items:
    """A block of items and what finds them."""

    ids: list
    texts: list[str]
    short: ahocorasick.Automaton | None  # finds the items that are looked for verbatim
    bits: int
    seen: np.ndarray  # by the high bits of a signature: some part has them
    known: np.ndarray  # signatures, ascending, distinct
    firsts: np.ndarray  # for each, where its parts begin
    counts: np.ndarray
    item: np.ndarray  # for each part, by signature
    place: np.ndarray
    pieces: Pieces


def items_of(rows: list[tuple[int, str]]) -> Items:
    rows = [(i, p) for i, p in ((i, plain(t)) for i, t in rows) if p]
    short: dict[str, list[int]] = {}
    sigs, item, place = [], [], []
    for k, (_, text) in enumerate(rows):
        if len(text) < SHORT:
            short.setdefault(text, []).append(k)
            continue
        codes = codes_of(text)
        starts = word_starts(codes)
        starts = starts[(starts + LEAST_PART <= len(codes)) | (starts == 0)]
        sigs.append(signatures(codes, starts).ravel())
        item.append(np.full(WALKS * len(starts), k))
        place.append(np.tile(starts, WALKS))
    flat = [np.concatenate(x) if x else np.empty(0, dtype="int64") for x in (sigs, item, place)]
    order = np.argsort(flat[0], kind="stable")
    h, item, place = (x[order] for x in flat)
    h, firsts, counts = np.unique(h.astype("uint64"), return_index=True, return_counts=True)
    bits = min(28, max(20, len(h).bit_length() + 4))
    seen = np.zeros(1 << bits, dtype=bool)
    seen[h >> np.uint64(64 - bits)] = True
    return Items([i for i, _ in rows], [t for _, t in rows], automaton(short), bits, seen, h, firsts, counts, item, place, pieces_of([t for _, t in rows]))


def windows(codes: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item, where it would begin) of the windows that a draw of the LSH says are near an item; one of those within NEXT."""
    empty = np.empty(0, dtype="int64")
    if not len(items.known):
        return empty, empty
    starts, found = word_starts(codes), []
    for sig in signatures(codes, starts):
        at = np.flatnonzero(items.seen[sig >> np.uint64(64 - items.bits)])
        h = sig[at]
        which = np.minimum(np.searchsorted(items.known, h), len(items.known) - 1)
        same = items.known[which] == h
        at, a, n = starts[at[same]], items.firsts[which[same]], items.counts[which[same]]
        hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        found.append((items.item[hit] << 40) + ((np.repeat(at, n) - items.place[hit] + (1 << 30)) // NEXT))
    once = np.unique(np.concatenate(found)) if found else empty
    return once >> 40, (once & ((1 << 40) - 1)) * NEXT - (1 << 30)


def automaton(short: dict[str, list[int]]) -> ahocorasick.Automaton | None:
    if not short:
        return None
    out = ahocorasick.Automaton()
    for text, members in short.items():
        out.add_word(text, (len(text), members))
    out.make_automaton()
    return out


def verbatim(text: str, short: ahocorasick.Automaton) -> Iterator[tuple[int, int]]:
    """(item, place) of the short items that stand in a text, as whole words."""
    for last, (n, members) in short.iter(text):
        at, end = last + 1 - n, last + 1
        before, behind = at == 0 or text[at - 1] == " " or ord(text[at]) >= UNSPACED, end == len(text) or text[end] == " " or ord(text[last]) >= UNSPACED
        if before and behind:
            yield from ((k, at) for k in members)


def parts_of(texts: list[str], overlap: int) -> Iterator[list[tuple[int, int, str]]]:
    """Slices of (text, offset, characters), about CHARS in each: a longer text comes in parts that overlap."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - overlap), CHARS):
            part = text[at : at + CHARS + overlap]
            held.append((k, at, part))
            size += len(part)
            if size >= CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def search(texts: list[str | None], items: Items) -> list[tuple[int, int, int, float, int]]:
    """(text, item, distance, similarity, first word) for each text and item that match."""
    if not items.ids:
        return []
    longest = max(map(len, items.texts))
    own = [plain(t) for t in texts]
    best: dict[tuple[int, int], tuple[int, int]] = {}  # distance and place
    if items.short is not None:
        for d, text in enumerate(own):
            for k, at in verbatim(text, items.short):
                best.setdefault((d, k), (0, at))
    for part in parts_of(own, 2 * longest + STEPS):
        codes = codes_of("\n".join(t for _, _, t in part))  # no item has a line feed
        item, begin = windows(codes, items)
        if not len(item):
            continue
        coded = items.pieces.letters[np.minimum(codes, len(items.pieces.letters) - 1)]
        good = possible(items.pieces, coded, item, begin)
        ends = np.cumsum([len(t) + 1 for _, _, t in part])
        near: dict[tuple[int, int], list[int]] = {}
        for k, at in zip(item[good].tolist(), begin[good].tolist(), strict=True):
            # a window that begins a little before its text belongs to the text that holds its middle
            d = min(int(np.searchsorted(ends, max(0, at + len(items.texts[k]) // 2), side="right")), len(part) - 1)
            near.setdefault((d, k), []).append(at - int(ends[d]) + len(part[d][2]) + 1)
        for (d, k), begins in sorted(near.items()):
            pattern, (doc, offset, text) = items.texts[k], part[d]
            limit, x = limit_of(len(pattern)), 0
            begins.sort()
            while x < len(begins):  # windows that overlap are verified as one stretch; edits move its ends by the limit at most
                a, b = begins[x], begins[x]
                while x < len(begins) and begins[x] <= b + len(pattern):
                    b, x = begins[x], x + 1
                a = max(0, a - limit - NEXT)
                stretch = text[a : max(0, b + len(pattern) + limit + 2 * NEXT)]
                distance, end = edit_match(pattern, stretch)
                if distance <= limit:
                    found = offset + a + end - edit_match(pattern[::-1], stretch[end - 1 :: -1])[1]  # where it begins
                    best[doc, k] = min(best.get((doc, k), (distance, found)), (distance, found))
    return [(d, k, n, 1 - n / len(items.texts[k]), own[d].count(" ", 0, at)) for (d, k), (n, at) in sorted(best.items())]


def blocks(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items, ITEMS_PER_BLOCK at a time: at no time more than a block in the driver's memory or in a task's."""
    held: list[tuple[int, str]] = []
    for row in items.select(F.col(key), F.col(text)).filter(F.col(text).isNotNull()).orderBy(key, text).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == ITEMS_PER_BLOCK:
            yield items_of(held)
            held = []
    if held:
        yield items_of(held)


LEAK = "item_id long, distance long, similarity double, first_word long"


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, *LEAK): one row for each document and item that it holds."""
    spark = base.ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind, out = docs.schema[key].dataType.simpleString(), None
    for block in blocks(items):
        sent = spark.sparkContext.broadcast(block)

        @base.relieved
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                for part in base.slices(batch, 1, CHARS):
                    found = search(part.column(1).to_pylist(), own)
                    keys = part.column(0)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array([f[0] for f in found], pa.int64())), pa.array([own.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64()), pa.array([f[4] for f in found], pa.int64())],
                        names=["key", *[x.split()[0] for x in LEAK.split(", ")]],
                    )

        got = rows.mapInArrow(run, f"key {kind}, {LEAK}")
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], f"key {kind}, {LEAK}")
    return out.withColumnRenamed("key", key)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item. Each is judged where it is: texts never move."""
    spark = base.ready(docs.sparkSession)
    for block in blocks(items):
        docs = _without(docs, spark.sparkContext.broadcast(block), text)
    return docs


def _without(docs: DataFrame, sent, text: str) -> DataFrame:
    place = docs.columns.index(text)

    @base.relieved
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in base.slices(batch, place, CHARS):
                bad = {f[0] for f in search(part.column(place).to_pylist(), own)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(base.read(spark, sf_dir, "documents"), base.read(spark, sf_dir, "benchmark")).withColumn("contaminated", F.lit(True))
