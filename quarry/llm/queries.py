"""The queries of the training-data operators, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import chat, decontaminate, html, oracles, packing, quality, sharding, simhash, substring, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        html.op1_max_subsequence,
        sharding.op2_ring_sharding,
        toxicity.op3_pattern_grammar,
        decontaminate.op4_cgk_decontamination,
        quality.op5_host_quality,
        simhash.op6_simhash,
        warc.op7_zip_warc,
        packing.op8_sum_of_squares,
        substring.op9_block_anchors,
        chat.op10_chat_format,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = dict(oracles.SQL)
