"""Encoding of texts as they arrive. The model is fixed, so no state is kept; counts are windowed behind a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.model import Model
from quillspark.operators.encode import count_tokens, encode


def encode_stream(texts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The stream with tokens."""
    return texts.withColumn("tokens", encode(F.col(text), model))


def count_stream(texts: DataFrame, model: Model, at: str = "at", window: str = "5 minutes", late: str = "10 minutes", by: tuple[str | Column, ...] = ()) -> DataFrame:
    """Tokens and texts of each window of event time (and of the columns in by); rows later than the watermark are dropped."""
    counted = texts.withColumn("n", count_tokens(F.col("text"), model)).withWatermark(at, late)
    return counted.groupBy(F.window(at, window), *by).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_texts"))


def write_stream(encoded: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parquet, each row once; stops when what is there has been read."""
    return encoded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
