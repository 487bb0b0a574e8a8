"""Documents to training sequences: quality rules, near duplicates, repeated substrings, benchmark leaks, packing.

Each stage judges all that the one before it kept, and all but the last return the columns of documents.

Defined cases: null and empty texts go in the quality stage, which asks for words; repeated rows are copies, of which one stays; rows
without an id are judged by the rules but never dropped as copies, as there is nothing to choose them by; an empty table gives an empty result;
further columns, whatever their names, pass through up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import base, decontaminate, packing, quality, similar, simhash, substring

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    base.rest(spark)
    # SimHash's 2 bits miss most texts that are alike in 0.8 of their five-word shingles: of what it keeps, these go as well.
    return similar.first_of_each(base.materialise(simhash.first_of_each(docs)))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    base.rest(spark)
    return substring.cleaned(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    base.rest(spark)
    return decontaminate.clean(docs, base.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    base.rest(spark)
    return packing.packed(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot express SimHash's components; the tests hold the whole pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        since, before = base.mark(), docs
        docs = base.materialise(stage(spark, before, sf_dir))
        base.released(since, docs)  # what the stage made on its way
        if before.inputFiles() and "/quarry-" in before.inputFiles()[0]:
            base.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
