"""The queries of the training-data operators and what SQL there is for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bitplanes, decontamination, egojoin, hostfilter, htmltext, katz, secrets, sentencepieces, simhash, toxicity
from quillspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_groups": lambda spark, d: simhash.groups(table(spark, d, "documents")),
    "op2_html_text": lambda spark, d: htmltext.extract(table(spark, d, "pages")),
    "op3_katz_scores": lambda spark, d: katz.train_and_score(table(spark, d, "documents")),
    "op4_secret_scan": lambda spark, d: secrets.scan(table(spark, d, "documents")),
    "op5_toxicity": lambda spark, d: toxicity.detect(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_embedding_links": lambda spark, d: egojoin.links(table(spark, d, "embeddings")),
    "op7_sentencepiece": lambda spark, d: sentencepieces.encode(table(spark, d, "documents")),
    "op8_host_filter": lambda spark, d: hostfilter.verdicts(table(spark, d, "pages"), hostfilter.outcomes_of(table(spark, d, "labels"))),
    "op9_bit_planes": lambda spark, d: bitplanes.write(table(spark, d, "documents")),
    "op10_decontamination": lambda spark, d: decontamination.find(table(spark, d, "documents"), table(spark, d, "benchmark")),
}

ORACLE_SQL: dict[str, str] = {
    "op3_katz_scores": katz.oracle(),
    "op6_embedding_links": egojoin.oracle(),
    "op8_host_filter": hostfilter.oracle(),
    "op10_decontamination": decontamination.oracle(),
}
