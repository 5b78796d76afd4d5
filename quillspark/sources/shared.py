"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_TABLES: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a folder of its own and a cluster an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back, so that nothing before it runs again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _TABLES.append((df.sparkSession.sparkContext.applicationId, path))
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.qs_path = path
    return back


def is_stored(df: DataFrame) -> bool:
    """Whether what stored gave is still there."""
    return (df.sparkSession.sparkContext.applicationId, df.qs_path) in _TABLES


def drop_tables(spark: SparkSession) -> int:
    """Deletes what stored wrote in this application, once nothing reads it any more; how many tables."""
    context, gone = spark.sparkContext, 0
    for entry in [t for t in _TABLES if t[0] == context.applicationId]:
        where = context._jvm.org.apache.hadoop.fs.Path(entry[1])
        gone += where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        _TABLES.remove(entry)
    return gone
