"""What a session needs before Python runs on executors, and tables in the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch where the session has Spark's own default of 10,000: texts and contents are far larger than numbers.
BATCH_ROWS = 2500


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and keep batches of texts small. On a cluster
    without a shared file system, install the package or pass it with --py-files."""
    own = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(own) == "10000" and not spark.sparkContext.getConf().contains(own):  # what a session was started with stays
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of our own in local mode, in which
    all is one machine, and an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows of a side may be broadcast when their measured size is at most so many bytes.
BROADCAST_BYTES = 32 << 20


def size_of(df: DataFrame) -> int:
    """Bytes that its rows take, measured: the lengths of texts, and 16 for each other value."""
    texts = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    one = sum(texts, F.lit(16 * len(df.columns))).cast("long")
    return df.agg(F.coalesce(F.sum(one), F.lit(0))).first()[0]


def bounded(small: DataFrame) -> DataFrame:
    """small with a broadcast hint if its rows, measured, take BROADCAST_BYTES at most; else as it is,
    so that the join shuffles (and AQE splits hot partitions)."""
    return F.broadcast(small) if size_of(small) <= BROADCAST_BYTES else small


#: What this process has made in the shared folder and not yet deleted: folders, and tables of the catalog, in order.
_made: list[tuple[str, str]] = []


def made(kind: str, name: str) -> None:
    """kind: folder or table. To be deleted by released()."""
    _made.append((kind, name))


def materialise(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, read by any executor, its lineage cut."""
    spark = ready(df.sparkSession)
    path = f"{scratch(spark)}/quarry-{uuid.uuid4().hex}"
    made("folder", path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """Where released() may begin."""
    return len(_made)


def released(since: int, *kept: DataFrame) -> None:
    """Delete what was made since, but for what the kept tables read: for callers that hold whole results in kept."""
    if not kept:
        raise ValueError("nothing is kept")
    spark = kept[0].sparkSession
    used = {os.path.basename(os.path.dirname(f)) for df in kept for f in df.inputFiles()}
    rest = []
    for kind, name in _made[since:]:
        if os.path.basename(name) in used:
            rest.append((kind, name))
        elif kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            _delete(spark, name)
    _made[since:] = rest


def drop(df: DataFrame) -> None:
    """Delete the files of a table that materialise() made and nothing reads any more."""
    for folder in {os.path.dirname(x) for x in df.inputFiles()}:
        if "/quarry-" in folder:
            _delete(df.sparkSession, folder)
            _made[:] = [x for x in _made if os.path.basename(x[1]) != os.path.basename(folder)]
