"""Incremental cataloguing, an extension: class items that arrive as files are kept once per name and content.

Item tables (parquet) are read as a stream; a watermark on the arrival time bounds the state, and what arrives again within
it is dropped without looking at what was written before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ITEM = "name string, origin string, grp string, digest string, arrived timestamp"


def arriving(spark: SparkSession, folder: str, schema: str = ITEM, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(items: DataFrame, delay: str = "1 day") -> DataFrame:
    return items.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["name", "digest"])


def rates(items: DataFrame, size: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(window, grp, n): arrivals by group and tumbling window."""
    return items.withWatermark("arrived", delay).groupBy(F.window("arrived", size), "grp").agg(F.count(F.lit(1)).alias("n"))


def catalogue(items: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append new versions to a table; run to the end of what is there."""
    return first_seen(items).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
