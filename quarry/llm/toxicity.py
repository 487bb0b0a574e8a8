"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses of words, and every word as a symbol: which of insult, threat, target (whom or what it points at),
negation and reported speech it is. Five transducers, each a table of states and symbols, read these symbols in a row, and each writes what
the next one reads:

    reported speech   marks what follows a verb of saying, to the end of the clause
    negation          marks what stands within NEAR words after a negation
    target            marks what stands within NEAR words after a target
    threat            a verb of threat, then a target within NEAR words, is a complete pattern
    insult            an insult near a target, before or behind it, near an insult before it, or as the last word of a clause, is a
                      complete pattern

compose() makes one automaton of the five, of the states that can be reached. An insult or a threat opens a path, which counts only if its
pattern is completed; the path's weight is the word's, times the weights of the negation and reported-speech arcs that it took. A word
that no pattern completes counts nothing. A document's evidence is what its clauses' paths weigh and how many there are; logistic
regression turns it into a score.

What is learned, from labelled rows outside the held-out fold only: the insult lexicon (words and word beginnings by
smoothed log odds over labelled texts, near copies counted once) and the weights of the score. Both are fitted to a
bounded sample, FIT_ROWS labelled rows, those whose ids have the least hashes. The other word lists are fixed.

Defined cases: a null or empty text has the score of a text without matches; without labels of both kinds the fixed
words and weights hold; repeated rows are scored alike; a null id is not held out; an empty table gives an
empty result; an input column that is called `_t_score` is replaced, no other column is read or changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import base

FIT_ROWS = 8000
#: Lexicon entries: at least so many toxic texts and this share of them, at least this log odds, a chance of at most
#: CHANCE that random labels would put as many of an entry's texts on the toxic side.
MIN_TEXTS, MIN_SHARE, MIN_ODDS, CHANCE = 3, 0.01, 2.5, 1e-4
STEMS = (4, 5, 6)
THRESHOLD = 0.3

# Words by role in English, German, French and Spanish.
INSULT_SEEDS = frozenset("idiot moron scum dumbass bastard dummkopf arschloch connard salaud imbécile gilipollas cabrón".split())
THREAT = frozenset("kill murder shoot stab strangle töten umbringen erschießen tuer égorger matar asesinar".split())
PRONOUNS = frozenset("you your you're i me my we us our it its he him his she her they them their who this that these those ich du er sie es wir man dich ihr euch dein euer dieser diese dieses je tu il elle on nous ils elles toi te vous ton son ses ce cet cette ces yo tú él ella nosotros ellos tu su usted ustedes ese esa este esta".split())
ARTICLES = frozenset("the a an der die das den dem des ein eine le la les un une el los las una de du".split())
GENITIVES = frozenset("of von vom des du del al au aux with mit avec con as als comme como".split())
COPULAS = frozenset("is are was were be been am ist sind war bist seid est sont était êtes es son eres fue".split())
TARGET = PRONOUNS | ARTICLES | GENITIVES | COPULAS
NEGATION = frozenset("not never no isn't aren't don't nobody nicht kein keine nie niemand pas jamais aucun aucune nunca jamás ningún ninguna".split())
REPORTED = frozenset("said says say called calls claimed claims quoted quote wrote reported sagte sagt nannte dit disait appelé écrit dijo dice llamó escribió".split())

#: Weights of arcs, and how many words apart the parts of a pattern may be. Fixed values.
NEAR, NEGATION_LOSS, REPORTED_LOSS, THREAT_WEIGHT = 6, 0.5, 0.5, 3.0

#: What a symbol says of a word, one bit each, and the end of a clause. Fixed values.
INSULT, MENACE, TO, NOT, SAID, END = 1, 2, 4, 8, 16, 32
#: What the transducers add to a symbol: marks, and what a pattern does, as a kind and the marks that its opening word had.
IS_REPORTED, IS_NEGATED, IS_AIMED = 64, 128, 256
THREAT_AT, INSULT_AT = 9, 13
AT_ONCE, OPENED, COMPLETED = 1, 2, 3

#: Texts are read in slices of about so many bytes, and so many cells of clauses run at a time.
SLICE, CELLS = 4 << 20, 1 << 20
_EDGE = re.compile(r"^\W+|\W+$")
_EDGES = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
_STOP = r"[.!?;:]+[^\p{L}\p{N}_]*$"
_LINE = "\ue000"  # stands for the end of a line


# ---- transducers --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """step[state, symbol] is the next state and out[state, symbol] what is written. State 0 is the first."""

    step: np.ndarray
    out: np.ndarray


def compose(first: Transducer, then: Transducer) -> Transducer:
    """The transducer that writes what `then` writes when it reads what `first` writes."""
    known, states, frontier = {(0, 0): 0}, [(0, 0)], [(0, 0)]
    step, out = [], []
    while frontier:
        a, b = (np.array(x) for x in zip(*frontier, strict=True))
        said = first.out[a]
        nexts = np.stack([first.step[a], then.step[b[:, None], said]], axis=-1)
        out.append(then.out[b[:, None], said])
        new = []
        for pair in map(tuple, np.unique(nexts.reshape(-1, 2), axis=0).tolist()):
            if pair not in known:
                known[pair] = len(states)
                states.append(pair)
                new.append(pair)
        step.append(nexts)
        frontier = new
    nexts = np.concatenate(step)
    at = np.full((int(nexts[..., 0].max()) + 1, int(nexts[..., 1].max()) + 1), -1, dtype="int32")
    for (a, b), k in known.items():
        if a < at.shape[0] and b < at.shape[1]:
            at[a, b] = k
    return Transducer(at[nexts[..., 0], nexts[..., 1]], np.concatenate(out))


def _table(states: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(every symbol of so many bits, no next state yet, the symbols as they come)."""
    symbols = np.arange(1 << bits)
    return symbols, np.zeros((states, len(symbols)), dtype="int32"), np.tile(symbols, (states, 1)).astype("int32")


def reported() -> Transducer:
    s, step, out = _table(2, 6)
    for q in (0, 1):
        step[q] = np.where(s & END, 0, np.where(s & SAID, 1, q))
    out[1] |= IS_REPORTED
    return Transducer(step, out)


def behind(trigger: int, mark: int, bits: int) -> Transducer:
    """Marks what stands within NEAR words behind a trigger. State: how many words ago it was, 0: too many."""
    s, step, out = _table(NEAR + 1, bits)
    for q in range(NEAR + 1):
        step[q] = np.where(s & END, 0, np.where(s & trigger, 1, q + 1 if 0 < q < NEAR else 0))
        if q:
            out[q] |= mark
    return Transducer(step, out)


def pattern(opener: int, place: int, before: bool, last: bool, bits: int) -> Transducer:
    """Completes an opener by a target within NEAR words behind it; before: a target or an open opener before it does as well; last: so does
    the end of the clause, right behind it. State: the marks that the open one had, and how many words ago it was."""
    s, step, out = _table(1 + 4 * NEAR, bits)
    marks = (s >> 6) & 3
    for q in range(1 + 4 * NEAR):
        ago, own = ((q - 1) % NEAR + 1, (q - 1) // NEAR) if q else (0, 0)
        older = q + 1 if 0 < ago < NEAR else 0
        done = COMPLETED | own << 2
        opens = (s & opener > 0) & (s & END == 0)
        now = opens & ((s & IS_AIMED > 0) | (q > 0)) & before
        step[q], write = older, np.zeros(len(s), dtype="int32")
        if q:
            closes = (s & TO > 0) & ~opens
            step[q], write = np.where(closes, 0, step[q]), np.where(closes, done, write)
        step[q] = np.where(opens & ~now, 1 + marks * NEAR, step[q])
        write = np.where(opens, np.where(now, AT_ONCE, OPENED) | marks << 2, write)
        step[q] = np.where(s & END, 0, step[q])
        write = np.where(s & END, done if last and ago == 1 else 0, write)
        out[q] |= (write << place).astype("int32")
    return Transducer(step, out)


def machines(targets: bool = True, negations: bool = True, reports: bool = True) -> list[Transducer]:
    """The five, in the order in which they read. Those that are off mark nothing."""
    return [
        reported() if reports else Transducer(*_table(1, 6)[1:]),
        behind(NOT if negations else 0, IS_NEGATED, 7),
        behind(TO if targets else 0, IS_AIMED, 8),
        pattern(MENACE, THREAT_AT, False, False, 9),
        pattern(INSULT, INSULT_AT, True, True, 13),
    ]


@lru_cache(maxsize=4)
def grammar_of(targets: bool = True, negations: bool = True, reports: bool = True) -> Transducer:
    return reduce(compose, machines(targets, negations, reports))


def _arc(out: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
    """(what the pattern does, the weight of its marks) for what the automaton writes."""
    said = out >> place & 15
    return said & 3, np.where(said & 4, REPORTED_LOSS, 1.0) * np.where(said & 8, NEGATION_LOSS, 1.0)


def paths(automaton: Transducer, symbols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, number) of the complete paths of each clause, a row of symbols each; shorter rows are filled up with END."""
    n = len(symbols)
    state, held, total, count = np.zeros(n, dtype="int32"), np.zeros(n), np.zeros(n), np.zeros(n, dtype="int64")
    for t in range(symbols.shape[1]):
        out, state = automaton.out[state, symbols[:, t]], automaton.step[state, symbols[:, t]]
        if not (out >> THREAT_AT).any():
            continue
        kind, factor = _arc(out, THREAT_AT)
        done = kind == COMPLETED
        total += np.where(done, THREAT_WEIGHT * factor, 0)
        count += done
        kind, factor = _arc(out, INSULT_AT)
        now, done = kind == AT_ONCE, kind == COMPLETED
        total += np.where(now, weights[:, t], np.where(done, held, 0)) * factor
        count += now | done
        held = np.where(kind == OPENED, weights[:, t], held)
    return total, count


# ---- texts --------------------------------------------------------------------------------------------------------


@dataclass
class Grammar:
    """weights: insult words, and word beginnings as "beginning*", to their weight. arcs: which marks are made."""

    weights: dict[str, float]
    bias: float = -2.5
    scale: tuple[float, float] = (1.0, 1.0)
    arcs: tuple[bool, bool, bool] = (True, True, True)
    lists: list[tuple[pa.Array, np.ndarray, int]] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        whole = {w: x for w, x in self.weights.items() if not w.endswith("*")}
        self.lists = [(pa.array(list(whole), pa.string()), np.array([*whole.values(), 0.0]), 0)]
        for n in STEMS:
            own = {w[:-1]: x for w, x in self.weights.items() if w.endswith("*") and len(w) == n + 1}
            self.lists.append((pa.array(list(own), pa.string()), np.array([*own.values(), 0.0]), n))

    def words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, weight, whether it ends a clause) of each word as it stands."""
        core = pc.replace_substring_regex(pc.utf8_lower(words), _EDGES, "")
        size = pc.utf8_length(core).to_numpy(zero_copy_only=False)
        weight = np.zeros(len(words))
        for known, values, n in self.lists:
            at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(core, 0, n) if n else core, value_set=known), len(known)).to_numpy(zero_copy_only=False)
            weight = np.maximum(weight, np.where(size >= n, values[at], 0))
        symbol = np.where(weight > 0, INSULT, 0).astype("uint8")
        for bit, own in ((MENACE, THREAT), (TO, TARGET), (NOT, NEGATION), (SAID, REPORTED)):
            symbol |= np.where(pc.is_in(core, value_set=pa.array(sorted(own))).to_numpy(zero_copy_only=False), bit, 0).astype("uint8")
        symbol[symbol & INSULT > 0] &= ~np.uint8(TO)
        line = pc.equal(words, _LINE).to_numpy(zero_copy_only=False)
        return np.where(line, END, symbol), weight, pc.match_substring_regex(words, _STOP).to_numpy(zero_copy_only=False)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, weights, where each text ends): all clauses of all texts in a row, each with END behind it."""
        split = pc.utf8_split_whitespace(pc.replace_substring(pc.fill_null(texts, ""), "\n", f" {_LINE} "))
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        symbol, weight, stop = self.words(coded.dictionary)
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        behind = stop[at].astype("int64")  # an END is put in behind these, and behind the last word of a text
        np.add.at(behind, ends[ends > 0] - 1, 1)
        place = np.arange(len(at)) + np.cumsum(behind) - behind
        symbols, weights = np.full(len(at) + int(behind.sum()), END, dtype="uint8"), np.zeros(len(at) + int(behind.sum()))
        symbols[place], weights[place] = symbol[at], weight[at]
        total = np.concatenate([[0], np.cumsum(1 + behind)])
        return symbols, weights, total[ends]

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(weight, number) of the complete paths of each text."""
        symbols, weights, ends = self.read(texts)
        total, count = np.zeros(len(ends)), np.zeros(len(ends), dtype="int64")
        if not len(symbols):
            return total, count
        last = np.flatnonzero(symbols == END)  # of each clause
        begins = np.concatenate([[0], last[:-1] + 1])
        clause = np.unique(np.searchsorted(last, np.flatnonzero(symbols & (INSULT | MENACE))))  # no path opens in any other
        clause = clause[np.argsort(last[clause] - begins[clause], kind="stable")]
        automaton, k = grammar_of(*self.arcs), 0
        while k < len(clause):
            sizes = last[clause[k:]] - begins[clause[k:]] + 1
            n = max(1, int(np.searchsorted(sizes * np.arange(1, len(sizes) + 1), CELLS)))
            part, sizes = clause[k : k + n], sizes[:n]
            cell = np.arange(int(sizes[-1]))
            inside = cell < sizes[:, None]
            at = np.where(inside, begins[part][:, None] + cell, 0)
            x, y = paths(automaton, np.where(inside, symbols[at], END), np.where(inside, weights[at], 0))
            text = np.searchsorted(ends, begins[part], side="right")
            np.add.at(total, text, x)
            np.add.at(count, text, y)
            k += n
        return total, count

    def features(self, texts: pa.Array) -> np.ndarray:
        return np.log1p(np.column_stack(self.evidence(texts)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.features(texts) @ np.array(self.scale))))


# ---- learning -----------------------------------------------------------------------------------------------


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def entries(text: str) -> set[str]:
    out = set()
    for raw in set(text.split()):
        word = _EDGE.sub("", raw).lower()
        if len(word) > 2:
            out.add(word)
            out.update(word[:n] + "*" for n in STEMS if len(word) >= n)
    return out


def sketch(text: str) -> int:
    """Near copies mostly share it: the least hash of the 3-word shingles."""
    words = text.encode().split()
    return min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most `rows` labelled documents outside the held-out fold. The label rows are chosen first, so the
    join's small side has `rows` rows at most, whatever the size of either table."""
    fold = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = fold.groupBy(F.col("doc_id").alias("_t_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_t_id"), "_t_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_t_id")).select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))


def lexicon(sample: DataFrame) -> dict[str, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                words, marks, kinds = [], [], []
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found, mark = entries(text), sketch(text)
                    words += found
                    marks += [mark] * len(found)
                    kinds += [toxic] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int64()), pa.array(kinds, pa.int32())], names=["entry", "mark", "toxic"])

    of = lambda y: F.count(F.when(F.col("toxic") == y, 1))
    marks = sample.mapInArrow(run, "entry string, mark long, toxic int").distinct()
    # How many labelled texts there are of each kind, near copies once: at most FIT_ROWS, so one entry's counts are bounded, and so is the
    # lexicon: its entries each stand in a hundredth of the sample's toxic texts.
    counts = marks.groupBy("entry").agg(of(1).alias("pos"), of(0).alias("neg"))
    n = sample.groupBy("toxic").count().collect()
    n = {r[0]: r[1] for r in n}
    if not n.get(0) or not n.get(1):
        return {}
    odds = F.log(((F.col("pos") + 0.25) / (n[1] + 0.5)) / ((F.col("neg") + 0.25) / (n[0] + 0.5)))
    enough = max(MIN_TEXTS, MIN_SHARE * n[1], np.log(CHANCE) / np.log(n[1] / (n[0] + n[1])))
    best = counts.filter(F.col("pos") >= float(enough)).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS).filter(F.col("neg") <= 0.02 * F.col("pos"))
    return {r[0]: float(r[1]) for r in best.select("entry", "odds").collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> np.ndarray:
    """Weights (bias first) by Newton's method; the ridge spares the bias."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, arcs: tuple[bool, bool, bool] = (True, True, True)) -> Grammar:
    """Reads the labelled rows of the training folds only."""
    base.ready(docs.sparkSession)
    sample = base.materialise(labelled(docs, labels))
    grammar = Grammar(dict.fromkeys(INSULT_SEEDS, 4.0) | lexicon(sample), arcs=arcs)
    weights = grammar.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(weights, arcs=arcs)
        for batch in batches:
            for part in base.slices(batch, 0, SLICE):
                got = own.features(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1]), part.column(1)], names=["a", "b", "toxic"])

    got = np.array(sorted(tuple(r) for r in sample.mapInArrow(run, "a double, b double, toxic int").collect()), dtype=float).reshape(-1, 3)
    if len(got) and 0 < got[:, 2].sum() < len(got):
        w = logistic(got[:, :2], got[:, 2])
        if w[1] + w[2] > 0:
            grammar.bias, grammar.scale = float(w[0]), (float(w[1]), float(w[2]))
    base.drop(sample)
    return grammar


def scored(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """docs with _t_score."""
    base.ready(docs.sparkSession)
    weights, bias, scale, arcs = grammar.weights, grammar.bias, grammar.scale, grammar.arcs

    @F.arrow_udf("double")
    def udf(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Grammar(weights, bias, scale, arcs)
        for texts in it:
            batch = pa.RecordBatch.from_arrays([texts], names=["text"])
            yield pa.array(np.concatenate([np.zeros(0), *[own.scores(part.column(0)) for part in base.slices(batch, 0, SLICE)]]))

    return docs.withColumn("_t_score", udf(F.col(text)))


def op3_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, learn(docs, base.read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_t_score").alias("score"), (F.col("_t_score") >= THRESHOLD).cast("int").alias("predicted"))
