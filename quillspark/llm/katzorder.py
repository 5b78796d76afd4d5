"""Operator 3 for any order: Katz backoff tables of n-grams, and scores of other documents.

Tables are DataFrames: of each order k the n-grams of k words with count and log probability,
and the histories of k - 1 words with their backoff weights. A text is padded with order - 1
start marks (the empty word). Counts up to K are discounted by Good-Turing; of order k the weight of history h is

    (1 - sum of p(w|h) over stored w) / (1 - sum of p(w|h less its first word) over stored w),

so the probabilities of all words and the unknown word sum to 1 after every history, of every
order. A gram's probability is its stored one, else the weight of its history (1 for an unseen one) times
that of the gram less its first word, down to single words and the unknown word. Grams are counted by document and made distinct
before anything is looked up, so a common word travels once for each document, and each
distinct gram is looked up once.

Results by case: as in katz, whose query leaves each document out; here documents are others.
Null or empty text, or no word: 0 tokens, log probability 0, null perplexity. Repeated rows:
counted, and scored, each. Null doc_id: carried. Extra columns: ignored. Empty tables: every word is
unknown, with probability 1. Very long texts: whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored
from quillspark.llm.katz import K, discounts

ORDER = 3


def word_list(text: Column) -> Column:
    """Words as WORD and lowered give them."""
    low = F.lower(F.translate(text, "Σİ", "σi"))
    return F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"))


def grams(docs: DataFrame, order: int, *keys: str) -> DataFrame:
    """The columns keys and gram, an array of order words, for each word of each text."""
    padded = docs.select(*keys, F.concat(F.array_repeat(F.lit(""), order - 1), word_list(F.coalesce("text", F.lit("")))).alias("w"))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - (order - 1)), lambda i: F.slice("w", i, order))
    return padded.filter(F.size("w") >= order).select(*keys, F.explode(windows).alias("gram"))


@dataclass(frozen=True)
class Tables:
    """tables[k - 1] has gram, n and logp of order k; weights[k - 2] has history and bow; discounts by order."""

    tables: list[DataFrame]
    weights: list[DataFrame]
    discounts: list[list[float]]
    unknown: float

    @property
    def order(self) -> int:
        return len(self.tables)


def _discounted(n: Column, d: list[float]) -> Column:
    return F.when(n > len(d), n.cast("double")).otherwise(F.element_at(F.array(*(F.lit(r * x) for r, x in enumerate(d, 1))), F.least(n, F.lit(len(d))).cast("int")))


def train(docs: DataFrame, order: int = ORDER, min_count: int = 1, k: int = K) -> Tables:
    """Tables of all documents. min_count: n-grams of two words and more that are seen less often aren't stored."""
    if order < 1:
        raise ValueError("the order is 1 at least")
    tables: list[DataFrame] = []
    weights: list[DataFrame] = []
    ds: list[list[float]] = []
    unknown = 0.0
    for size in range(1, order + 1):
        counts = stored(grams(docs, size).groupBy("gram").agg(F.count("*").alias("n")), "grams")
        seen = {r["n"]: r["c"] for r in counts.filter(F.col("n") <= k + 1).groupBy("n").agg(F.count("*").alias("c")).collect()}
        d = discounts([seen.get(r, 0) for r in range(1, k + 2)], k)
        ds.append(d)
        if size == 1:
            total = counts.agg(F.sum("n")).first()[0] or 0
            freed = sum(r * (1 - x) * seen.get(r, 0) for r, x in enumerate(d, 1)) / total if total else 1.0
            unknown = math.log(freed) if freed > 0 else -math.inf
            tables.append(stored(counts.withColumn("logp", F.log(_discounted(F.col("n"), d) / max(1, total))), "table"))
            continue
        history, left = F.slice("gram", 1, size - 1), F.slice("gram", 2, size - 1)
        is_kept = F.col("n") >= min_count
        kept = F.when(is_kept, _discounted(F.col("n"), d)).otherwise(0.0)
        rows = counts.withColumn("history", history)
        sums = rows.withColumn("kept", kept).groupBy("history").agg(F.sum("n").alias("seen"), F.sum("kept").alias("kept"))
        sums = stored(sums.select("history", "kept", F.when(F.col("seen") - F.col("kept") < 1e-9, F.col("seen") + 0.5).otherwise(F.col("seen").cast("double")).alias("bottom")), "sums")
        below = tables[-1].select(F.col("gram").alias("left"), F.exp("logp").alias("low"))
        named = rows.filter(is_kept).withColumn("left", left)
        lower = named.join(below, "left").groupBy("history").agg(F.sum("low").alias("lower"))
        weight = (1 - F.col("kept") / F.col("bottom")) / (1 - F.coalesce("lower", F.lit(0.0)))
        weights.append(stored(sums.join(lower, "history", "left").select("history", weight.alias("bow")), "weights"))
        tables.append(stored(named.join(sums, "history").select("gram", "n", F.log(_discounted(F.col("n"), d) / F.col("bottom")).alias("logp")), "table"))
    return Tables(tables, weights, ds, unknown)


def evaluate(wanted: DataFrame, t: Tables, size: int) -> DataFrame:
    """gram and logp of distinct grams of that many words."""
    found = wanted.join(t.tables[size - 1].select("gram", "logp"), "gram", "left")
    if size == 1:
        return found.select("gram", F.coalesce("logp", F.lit(t.unknown)).alias("logp"))
    found = stored(found, "found")
    missing = found.filter("logp IS NULL").select("gram", F.slice("gram", 1, size - 1).alias("history"), F.slice("gram", 2, size - 1).alias("left"))
    low = evaluate(missing.select(F.col("left").alias("gram")).distinct(), t, size - 1).select(F.col("gram").alias("left"), F.col("logp").alias("low"))
    backed = missing.join(t.weights[size - 2], "history", "left").join(low, "left")
    return found.filter("logp IS NOT NULL").unionAll(backed.select("gram", (F.coalesce(F.log("bow"), F.lit(0.0)) + F.col("low")).alias("logp")))


def score(docs: DataFrame, t: Tables) -> DataFrame:
    """doc_id, n_tokens, logprob (natural, summed) and perplexity of other documents than those the tables were trained on."""
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "keyed")
    own = stored(grams(keyed, t.order, "key").groupBy("key", "gram").agg(F.count("*").alias("o")), "own")
    logp = evaluate(own.select("gram").distinct(), t, t.order)
    sums = own.join(logp, "gram").groupBy("key").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("logp")).alias("s"))
    out = keyed.select("key", "doc_id").join(sums, "key", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("int").alias("n_tokens"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("logprob"), F.round(F.exp(-F.col("s") / F.col("n")), 4).alias("perplexity"))
