"""Quality rules with host evidence.

Every document is measured; failures are aggregated by host (the domain, here `source`); each host's
failure rate is shrunk towards a beta prior fitted to all hosts by the method of moments; the shrunk
rate is then joined back to the host's documents as the prior odds of their verdict.

Defined cases: a null text has no words; a null host is a host of its own; repeated rows count as often as
they occur; an empty table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import base

#: Base rules, fixed by the contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Evidence rules: symbols per 100 words, and per cent of the lines that repeat an earlier one.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
#: Log odds that a rule adds when it fails and when it holds. Dense symbols are strong evidence, repeated lines weak.
SYMBOL_EVIDENCE, DUP_LINE_EVIDENCE = (4.0, -1.0), (0.5, -0.1)
#: Least weight of the prior, in documents, and the prior that a corpus of one host gets.
MIN_PRIOR, MAX_PRIOR = 2.0, 1000.0

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def measure(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The counts in MEASURES of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()  # bytes.split() parts at exactly \x20 \x09-\x0D
    solid = text.translate(None, _SPACE)
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(triples)) != len(triples):
        times, end = Counter(triples), 0
        for i, t in enumerate(triples):
            if times[t] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(solid.decode("utf-8", "replace")), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """docs with a column for each measure, under names that start with prefix."""
    base.ready(docs.sparkSession)
    names = [x.split()[0] for x in MEASURES.split(", ")]

    @F.arrow_udf(MEASURES)
    def udf(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            rows = [measure(x.as_py()) for x in texts]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names=names)
        base.relieve()

    hold = prefix + "all"
    out = docs.withColumn(hold, udf(F.col(text).cast("binary")))
    return out.select(*docs.columns, *[F.col(hold)[n].alias(prefix + n) for n in names])


def base_failed(p: str = "_q_") -> Column:
    return (F.col(p + "n_words") < MIN_WORDS) | (100 * F.col(p + "n_repeat_words") > MAX_REPEAT_PERCENT * F.col(p + "n_words"))


def symbols_failed(p: str = "_q_") -> Column:
    return 100 * F.col(p + "n_symbols") > MAX_SYMBOL_PERCENT * F.col(p + "n_words")


def dup_lines_failed(p: str = "_q_") -> Column:
    return 100 * F.col(p + "n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col(p + "n_lines")


def host_rates(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, n_docs, n_failed, rate): the posterior mean of each host's failure rate. The prior comes from
    all hosts: its mean is the corpus rate, its weight follows from how far hosts spread beyond chance."""
    hosts = base.materialise(rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed")))
    mean, weight = prior(hosts)
    return hosts.withColumn("rate", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and weight of the beta prior: one row of sums over hosts, by the method of moments."""
    n_docs, n_failed = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    k, n, f, n2, f2 = hosts.agg(F.count(F.lit(1)), F.sum(n_docs), F.sum(n_failed), F.sum(n_docs * n_docs), F.sum(n_failed * n_failed / n_docs)).first()
    if not k:
        return 0.0, MAX_PRIOR
    m = f / n
    # sum n (p - m)^2 over hosts is what chance within hosts gives and what hosts differ by
    between = (f2 - m * m * n - (k - 1) * m * (1 - m)) / (n - n2 / n) if n * n > n2 else 0.0
    return m, min(MAX_PRIOR, max(MIN_PRIOR, m * (1 - m) / between - 1)) if between > 0 else MAX_PRIOR


def odds(rate: Column, p: str = "_q_") -> Column:
    """Log odds that a document is bad: its host's shrunk rate, then its own rules."""
    r = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    return (
        F.log(r / (1 - r))
        + F.when(symbols_failed(p), F.lit(SYMBOL_EVIDENCE[0])).otherwise(F.lit(SYMBOL_EVIDENCE[1]))
        + F.when(dup_lines_failed(p), F.lit(DUP_LINE_EVIDENCE[0])).otherwise(F.lit(DUP_LINE_EVIDENCE[1]))
    )


def judged(rows: DataFrame, hosts: DataFrame, host: str, p: str = "_q_") -> DataFrame:
    """rows (measured) with base_failed and kept, behind the prefix p. The host table is broadcast only when it is measured to be
    small; beyond that the join shuffles and AQE splits the hot hosts."""
    rates = base.bounded(hosts.select(F.col("host").alias(p + "host"), F.col("rate").alias(p + "rate")))
    out = rows.join(rates, F.col(host).eqNullSafe(F.col(p + "host")), "left")
    bad = base_failed(p)
    return out.withColumns({p + "base_failed": bad, p + "kept": ~bad & (odds(F.col(p + "rate"), p) <= 0)})


def host_evidence(rows: DataFrame, host: str, p: str = "_q_") -> DataFrame:
    return host_rates(rows.select(F.col(host).alias("host"), (base_failed(p) | symbols_failed(p) | dup_lines_failed(p)).alias("failed")), "host", "failed")


def score(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: key, measures and verdict."""
    rows = base.materialise(measured(docs.select(F.col(key).alias("_q_key"), F.col(host).alias("_q_source"), F.col(text).alias("_q_text")), "_q_text").drop("_q_text"))
    out = judged(rows, host_evidence(rows, "_q_source"), "_q_source")
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return out.select(F.col("_q_key").alias(key), *[F.col("_q_" + n).alias(n) for n in names], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_rate").alias("host_rate"))


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns. Measures are computed where a row is, once for the hosts' rates and once for the
    verdicts: texts are neither moved nor written."""
    p = base.prefix(docs, "_q_")
    rows = measured(docs, text, p)
    return judged(rows, host_evidence(rows, host, p), host, p).filter(p + "kept").select(*docs.columns)


def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(base.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
