"""Documents to token ids in five stages, each written as Parquet and read again by the next.

Results by case, for every stage: an empty table gives an empty one; columns beyond those of
documents stay, whatever their names (the last stage has columns of its own); very long texts
are read whole; a null doc_id is carried. Null and empty texts pass every stage and come out
with null and with no ids. Repeated rows: one of them stays after the near-dedup (all, where doc_id
or text is null, or the text has no word); ties there go to the least doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, secrets, sentencepieces, simhash, toxicity
from quillspark.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that toxicity.detect would not report. Null and empty texts are not toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id. Null ids and texts without a word are in no group."""
    return simhash.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without benchmark passages: a passage is cut, a document that is mostly passages is dropped."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every confirmed secret replaced by its kind in brackets; no row is dropped."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and byte spans of every row; null for null text."""
    return sentencepieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: Viterbi decoding, masks of signatures, key encodings and segmentation are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
