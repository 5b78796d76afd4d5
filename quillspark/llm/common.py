"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word: letters, digits and underscore, the class that RE2 writes [\p{L}\p{N}_].
WORD = re.compile(r"\w+")
_OWN_DIR: list[str] = []
_WRITTEN: list[tuple[str, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="quillspark-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return "file://" + _OWN_DIR[0]


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark.sparkContext.applicationId, path))
    df.write.partitionBy(*partition_by).parquet(path)
    if partition_by:  # these come last when read
        return spark.read.schema(df.schema).parquet(path).select(df.columns)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Deletes the tables that stored wrote in this application, once nothing reads them any more; how many."""
    context, done = spark.sparkContext, 0
    for mark in [w for w in _WRITTEN if w[0] == context.applicationId]:
        path = context._jvm.org.apache.hadoop.fs.Path(mark[1])
        done += path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(mark)
    return done


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def lowered(text: str) -> str:
    """Lower case, character by character, so that each keeps its place and none depends on those around it: a capital sigma gives σ anywhere, a dotted capital I gives i."""
    return text.replace("\u03a3", "\u03c3").replace("\u0130", "i").lower()


def slices(texts: list[str | None], chars: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows that together hold about so many characters (one row at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches cut to a bounded amount of text, so that memory doesn't follow the length of documents."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        for a, b in slices(texts, chars):
            yield batch.slice(a, b - a), texts[a:b]


def with_text(batch: pa.RecordBatch, texts: list[str | None], schema: pa.Schema) -> pa.RecordBatch:
    """The batch with another text and, where there is one, n_chars to match."""
    columns = []
    for i, field in enumerate(schema):
        if field.name == "text":
            columns.append(pa.array(texts, field.type))
        elif field.name == "n_chars" and pa.types.is_integer(field.type):
            columns.append(pa.array([None if t is None else len(t) for t in texts], field.type))
        else:
            columns.append(batch.column(i).cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)
