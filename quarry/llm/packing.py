"""Sum-of-squares online packing of token sequences.

Each task packs its own documents as they come. A document longer than a window fills whole windows first;
its remainder of n ids goes to the fill level that keeps the sum of squared counts of partially filled windows smallest:
moving a window from level h to h + n changes the sum by 2 (N[h+n] - N[h]) + 2, opening a new one by
2 N[n] + 1, and reaching the full size removes the window from the sum. Counts live in an array by level, so a choice
is one vector operation over the levels, and memory is bounded by the window size and the windows still open.

When a task's documents end, its open windows are closed by cutting: the pieces of the emptiest move into the gaps of
the fullest, so that a task leaves one partially filled window at most. A window's place in its sequence is
its offset; sequences of different tasks never mix, so tasks need no common state and a lost one is simply run again.

Defined cases: a null or empty text is the end mark alone; repeated rows are packed as often as they occur;
an empty table gives an empty result; a null key stays null.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import base

WINDOW, END = 2048, 1
#: About so many bytes of text are encoded at a time, and the ids of so many different words are remembered by a worker.
SLICE, WORDS_KEPT = 8 << 20, 1 << 16
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Texts with these are not parted at white space first: Python's str.split() takes them for space, the tokenizer does not.
#: A capital sigma's small form depends on its place in Python, not in the tokenizer.
_ODD = re.compile("[\x1c-\x1f\u03a3]")
_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[b : b + n] for each b, n, one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class LetterModel:
    """Byte-pair merges of many letter words at once, from the vocabulary and merges in a tokenizer's own file.

    A row of a matrix is a word, a cell a symbol. In each round every word makes its best merge (least rank, then
    leftmost), until none is left; the results are those of the tokenizer's model, word by word."""

    LONGEST = 48  # bytes; longer words go to the library

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # bytes that stand for themselves
        hidden = iter(range(256, 512))
        chars = [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in chars], dtype="int64")
        self.last = np.array([vocab[c + model["end_of_word_suffix"]] for c in chars], dtype="int64")
        keys = np.array([vocab[x] * self.base + vocab[y] for x, y in merges], dtype="int64")
        made = np.array([vocab[x + y] for x, y in merges], dtype="int64")
        self.made, order = made, np.argsort(keys)
        self.keys, self.ranks = keys[order], order

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, len(made) if it doesn't merge. Symbols below 0 are none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], len(self.made))

    def encode(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has) of words data[b : b + n], UTF-8 bytes, none empty or longer than LONGEST."""
        counts, rows, found = np.zeros(len(sizes), dtype="int64"), [], []
        order = np.argsort(sizes, kind="stable")
        for low in range(0, len(order), 1 << 15):  # words of like length together: little padding, bounded memory
            part = order[low : low + (1 << 15)]
            n = sizes[part]
            width = int(n.max())
            place = np.arange(width)
            raw = data[np.minimum(begins[part, None] + place, len(data) - 1)]
            s = np.where(place < n[:, None] - 1, self.inner[raw], np.where(place == n[:, None] - 1, self.last[raw], -1))
            s = np.concatenate([s, np.full((len(part), 1), -1)], axis=1)
            r = np.concatenate([self.rank(s[:, :-1], s[:, 1:]), np.full((len(part), 1), len(self.made))], axis=1)
            live = np.arange(len(part))
            while True:
                j = r[live].argmin(axis=1)
                best = r[live, j]
                more = best < len(self.made)
                if not more.any():
                    break
                live, j, best = live[more], j[more], best[more]
                move = np.minimum(np.arange(width + 1) + (np.arange(width + 1) > j[:, None]), width)
                s2, r2 = np.take_along_axis(s[live], move, axis=1), np.take_along_axis(r[live], move, axis=1)
                k = np.arange(len(live))
                s2[k, j] = self.made[best]
                r2[k, j] = self.rank(s2[k, j], s2[k, j + 1])
                before = np.maximum(j - 1, 0)
                r2[k, before] = np.where(j > 0, self.rank(s2[k, before], s2[k, j]), r2[k, before])
                s[live], r[live] = s2, r2
            counts[part] = (s >= 0).sum(axis=1)
            rows.append(part)
            found.append(s[s >= 0])
        if not rows:
            return np.zeros(0, dtype="<u4"), counts
        part, flat = np.concatenate(rows), np.concatenate(found)
        ends = np.cumsum(counts[part])
        at = np.empty(len(part), dtype="int64")
        at[part] = ends - counts[part]
        return gather(flat, at, counts).astype("<u4"), counts


#: The tokenizer's parts for which the ids of a text are those of its words, and a word of letters is one pre-token. Fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
CHECKED = 2000


def by_words(path: str) -> bool:
    """Whether a tokenizer's file says what WordTokenizer builds on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps, model = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}], spec["model"]
    split = steps[0].get("type") == "Split" and steps[0]["pattern"] == {"Regex": SPLIT} and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
    level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    return spec["normalizer"] == NORMALIZER and split and level and all(model.get(k, v) == v for k, v in PLAIN_MODEL.items())


class WordTokenizer:
    """Ids of texts under a tokenizer whose pre-tokens never span white space.

    The tokenizer's own normalizer (NFC, white space, lower case) and pre-tokenizer work within words, so the ids of a text are
    those of its words in order. The distinct words of a slice of texts are found by Arrow's dictionary encoding, each is
    encoded once, and the texts' ids are gathered. A word of letters with punctuation behind is two pre-tokens; letters
    in lower case go to LetterModel, everything else to the library. Where the tokenizer's file says anything else, or LetterModel differs from
    the library on CHECKED words of the vocabulary, the library encodes whole texts."""

    def __init__(self, path: str, kept: int = WORDS_KEPT) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kept, self.known = kept, {}
        self.letters = LetterModel(path) if by_words(path) else None
        if self.letters and not self.agrees():
            self.letters = None

    def agrees(self) -> bool:
        vocab = sorted(x for x in (w.removesuffix("</w>").lower() for w in self.whole.get_vocab()) if x.isalpha() and x.isascii())
        few = vocab[:: max(1, len(vocab) // CHECKED)]
        some = [a + b for a, b in zip(few, reversed(few), strict=True)]
        got, n = self.words(pa.array(some, pa.string()))
        want = [e.ids for e in self.whole.encode_batch(some, add_special_tokens=False)]
        return n.tolist() == [len(x) for x in want] and got.tolist() == [i for x in want for i in x]

    def plain(self, text: str) -> str | None:
        """In lower case, or None if a text has to be encoded whole."""
        low = text.lower()
        if text.isascii():
            return None if _ODD.search(text) else low
        return low if is_normalized("NFC", text) and is_normalized("NFC", low) and not _ODD.search(text) else None

    def others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has), by the library; what is frequent is remembered."""
        if len(self.known) + len(words) > self.kept:
            self.known.clear()
        self.known[""] = b""
        new = list({w for w in words if w not in self.known})
        for w, e in zip(new, self.whole.encode_batch(new, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()
        ids = [self.known[w] for w in words]
        return np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype="int64", count=len(ids)) // 4

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has)."""
        cores = pc.utf8_rtrim(words, characters=_PUNCTUATION)
        size = pc.binary_length(cores).to_numpy(zero_copy_only=False).astype("int64")
        sound = pc.utf8_is_alpha(cores).to_numpy(zero_copy_only=False) & (size > 0) & (size <= LetterModel.LONGEST)
        tailed = np.flatnonzero(~sound | (size < pc.binary_length(words).to_numpy(zero_copy_only=False)))
        # The letters in front, none for other words, then what is behind them, which is the word itself for others.
        offsets = np.frombuffer(cores.buffers()[1], dtype="<i4")[cores.offset : cores.offset + len(cores) + 1].astype("int64")
        front, front_n = self.letters.encode(np.frombuffer(cores.buffers()[2] or b"\0", dtype=np.uint8), offsets[:-1][sound], size[sound])
        pairs = zip(words.take(pa.array(tailed)).to_pylist(), cores.take(pa.array(tailed)).to_pylist(), sound[tailed].tolist(), strict=True)
        back, back_n = self.others([w[len(c) :] if ok else w for w, c, ok in pairs])
        n = np.zeros((len(words), 2), dtype="int64")
        n[sound, 0], n[tailed, 1] = front_n, back_n
        at = np.zeros((len(words), 2), dtype="int64")
        at[sound, 0], at[tailed, 1] = np.cumsum(front_n) - front_n, len(front) + np.cumsum(back_n) - back_n
        return gather(np.concatenate([front, back]), at.ravel(), n.ravel()), n.sum(axis=1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.letters is None:
            return [np.array(e.ids, dtype="<u4") for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        low = [self.plain(t) for t in texts]
        split = pc.utf8_split_whitespace(pa.array([x or "" for x in low], pa.string()))
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        flat, sizes = self.words(coded.dictionary)
        begins = np.cumsum(sizes) - sizes
        ids = gather(flat, begins[at], sizes[at])
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4") if x is None else ids[a:b] for t, x, a, b in zip(texts, low, cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class SumOfSquares:
    """Open windows by fill level, and the rule that picks a level."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.counts = np.zeros(size + 1, dtype="int64")  # windows by fill level; level 0 and size stay 0
        self.open: list[list[int]] = [[] for _ in range(size)]
        self.made = 0

    def level(self, n: int) -> int:
        """The level to add n ids to; 0 opens a window."""
        counts, size = self.counts, self.size
        cost = counts[n + 1 : size] - counts[1 : size - n]  # levels 1 .. size - n - 1 become n + 1 .. size - 1
        best, at = 2 * int(counts[n]) + 1, 0
        if counts[size - n] and 1 - 2 * int(counts[size - n]) < best:  # fills a window
            best, at = 1 - 2 * int(counts[size - n]), size - n
        if len(cost):
            cost = np.where(counts[1 : size - n] > 0, 2 * cost + 2, np.iinfo("int64").max)
            h = len(cost) - 1 - int(cost[::-1].argmin())  # of equal ones the fullest
            if cost[h] < best:
                at = h + 1
        return at

    def put(self, n: int) -> tuple[int, int]:
        """(window, offset) for a piece of n < size ids, or of a whole window."""
        at = self.level(n) if n < self.size else 0
        if at:
            window = self.open[at].pop()
            self.counts[at] -= 1
        else:
            window, self.made = self.made, self.made + 1
        if at + n < self.size:
            self.open[at + n].append(window)
            self.counts[at + n] += 1
        return window, at


def pack(lengths: Iterator[tuple[int, int]], size: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, length) to (document, start, length, window, offset); windows still open at the end come last."""
    rule, held = SumOfSquares(size), {}
    for doc, n in lengths:
        start = 0
        while n - start >= size:
            yield doc, start, size, rule.put(size)[0], 0
            start += size
        if n > start:
            window, at = rule.put(n - start)
            held.setdefault(window, []).append((doc, start, n - start, window, at))
            if at + n - start == size:
                yield from held.pop(window)
    # Close the windows that are open: pieces of the emptiest fill the fullest, cut where a gap ends.
    left = sorted(held.values(), key=lambda p: p[-1][4] + p[-1][2])
    low, high = 0, len(left) - 1
    while low < high:
        window, fill = left[high][0][3], left[high][-1][4] + left[high][-1][2]
        while fill < size and low < high:
            doc, start, n, own, at = left[low].pop()
            take = min(n, size - fill)
            left[high].append((doc, start + n - take, take, window, fill))
            fill += take
            if take < n:
                left[low].append((doc, start, n - take, own, at))
            elif not left[low]:
                low += 1
        if fill == size:
            yield from left[high]
            high -= 1
    for pieces in left[low : high + 1]:
        yield from pieces


def packed(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """One row per piece: key and PIECES. path: the tokenizer's file, present on every machine."""
    spark = base.ready(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    @base.relieved
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        encoder, ids, keys, sums = tokenizer(path), {}, {}, {}

        def lengths() -> Iterator[tuple[int, int]]:
            at = 0
            for batch in batches:
                for part in base.slices(batch, 1, SLICE):
                    for key_, got in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                        ids[at] = np.append(got, np.uint32(END)).astype("<u4").tobytes()
                        keys[at], sums[at] = key_, 0
                        yield at, len(got) + 1
                        at += 1

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            out = []
            for doc, start, n, window, at in pieces:
                whole = ids[doc]
                out.append((keys[doc], start, n, zlib.crc32(whole[4 * start : 4 * (start + n)]), len(whole) // 4, task + window, at))
                sums[doc] += n
                if 4 * sums[doc] == len(whole):  # every id has its place: forget the document
                    del ids[doc], keys[doc], sums[doc]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=key_type), *[pa.array([x[i] for x in out], type=pa.int64()) for i in range(1, 7)]], names=["key", *[x.split()[0] for x in PIECES.split(", ")]])

        key_type, ready = None, []
        first = next(batches, None)
        if first is None:
            return
        key_type = first.schema.field(0).type

        def again(rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield first
            yield from rest

        batches = again(batches)
        for piece in pack(lengths(), size):
            ready.append(piece)
            if len(ready) >= 4096:
                yield table(ready)
                ready = []
        if ready:
            yield table(ready)

    return rows.mapInArrow(run, f"key {kind}, {PIECES}").withColumnRenamed("key", key)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(base.read(spark, sf_dir, "documents"), tokenizer_path())
