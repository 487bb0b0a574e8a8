"""Class files and archives made from the driver's tables, so that scans and exports can run on them. Written byte by byte: no compiler is needed."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import made, scratch
from quarry.sources import sinks


def _u2(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 4, "0"))


def _utf8(text: Column) -> Column:
    """A constant of text: ASCII, so that Java's encoding and UTF-8 are one."""
    return F.concat(F.unhex(F.lit("01")), _u2(F.octet_length(text)), F.encode(text, "UTF-8"))


def class_file(name: Column, body: Column, outer: Column | None = None) -> Column:
    """The bytes of a class without members. body: a constant that makes contents differ; outer: the class that it is nested in, or null."""
    raw = lambda x: F.unhex(F.lit(x))
    start = F.concat(_utf8(name), raw("070001"), _utf8(body))
    rest = "0021" + "0002" + "0000" * 4  # flags, this class, then no superclass, interfaces, fields, methods
    plain = F.concat(raw("CAFEBABE0000003D0004"), start, raw(rest + "0000"))
    if outer is None:
        return plain
    more = F.concat(_utf8(outer), raw("070004"), _utf8(F.lit("InnerClasses")), _utf8(F.substring_index(name, "/", -1)))
    nested = F.concat(raw("CAFEBABE0000003D0008"), start, more, raw(rest + "0001" + "0006" + "0000000A" + "0001" + "0002000500070001"))
    return F.when(outer.isNull(), plain).otherwise(nested)


def folder(spark: SparkSession) -> str:
    """A folder of the shared one, as a local path: archives are read from file systems that machines have mounted."""
    path = f"{scratch(spark).removeprefix('file://')}/quarry-fixture-{uuid.uuid4().hex}"
    made("folder", f"file://{path}")
    return path


def written(files: DataFrame, root: str) -> str:
    """files (file_entry, content) written below root."""
    sinks.export(files, root)
    return root


def jars(entries: DataFrame, nested_in: str | None = None) -> DataFrame:
    """(file_entry, content) of an archive for each jar from rows (jar, entry, content); nested_in: all of them as entries of one archive."""

    def pack(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            rows = sorted(zip(table["entry"].to_pylist(), table["content"].to_pylist(), strict=True))
            for entry, content in rows:
                z.writestr(zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0)), content)
        return pa.table({"file_entry": [table["jar"][0].as_py()], "content": pa.array([out.getvalue()], pa.binary())})

    own = entries.groupBy("jar").applyInArrow(pack, "file_entry string, content binary")
    if nested_in is None:
        return own
    return own.select(F.lit(nested_in).alias("jar"), F.col("file_entry").alias("entry"), "content").groupBy("jar").applyInArrow(pack, "file_entry string, content binary")
