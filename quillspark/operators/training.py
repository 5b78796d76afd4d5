"""Training of vocabularies: words are counted by the cluster, merges learned from the counts.

Words keep the order of their first sight, by doc_id and place in the text, since it decides
ties; so texts need a doc_id. Null texts are left out, null doc_ids come last.
"""

from __future__ import annotations

import json
import logging
import os
import tempfile
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from quillspark.functions.normalize import NormalizerConfig, normalize_text
from quillspark.functions.pretokenize import pretokenize_text
from quillspark.functions.whitespace import SPACER
from quillspark.model import BYTE_TOKENS, Model, SpecialTokens
from quillspark.operators.learner import BLOCK, Learner
from quillspark.sources.shared import stored

logger = logging.getLogger("quillspark")
LOG_EVERY = 500
#: Distinct chunks that a task counts before it passes them on, and their characters; texts and rows taken at once.
COUNTED, COUNTED_CHARS, TEXTS, ROWS = 250_000, 20_000_000, 256, 20_000
OPEN, CLOSE = "\x01", "\x02"


def word_counts(texts: DataFrame, config: NormalizerConfig, by: Sequence[str] = (), keep_empty: bool = False) -> DataFrame:
    """word, n and first (doc_id and place of its first sight), for each value of the columns in by. Chunks are counted where they are read, at most COUNTED distinct ones at once; one shuffle of these counts."""
    rows = texts.filter("text IS NOT NULL").select(*by, "doc_id", "text")
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType([*[StructField(c, kinds[c]) for c in by], StructField("word", StringType()), StructField("n", LongType()), StructField("last", BooleanType()), StructField("doc_id", kinds["doc_id"]), StructField("pos", IntegerType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, dict[str, list]] = {}
        held = chars = 0
        arrow = None
        for batch in batches:
            arrow = arrow or batch.schema
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                *keys, docs, own = (part.column(i).to_pylist() for i in range(len(by) + 2))
                for i, (doc, text) in enumerate(zip(docs, own)):
                    words = found.setdefault(tuple(k[i] for k in keys), {})
                    chunks = pretokenize_text(text, config.chunking)
                    place = dict(zip(reversed(chunks), range(len(chunks) - 1, -1, -1)))
                    for c, n in Counter(chunks).items():
                        if (old := words.get(c)) is None:
                            words[c] = [n, doc, place[c]]
                            held, chars = held + 1, chars + len(c)
                        else:
                            old[0] += n
                            if doc is not None and (old[1] is None or doc < old[1]) or doc == old[1] and place[c] < old[2]:
                                old[1:] = doc, place[c]
                    if held >= COUNTED or chars >= COUNTED_CHARS:
                        yield from _count_rows(found, config, keep_empty, arrow)
                        held = chars = 0
        if arrow is not None:
            yield from _count_rows(found, config, keep_empty, arrow)

    counts = rows.mapInArrow(counted, schema)
    return counts.groupBy(*by, "word").agg(F.sum("n").alias("n"), F.min(F.struct("last", "doc_id", "pos")).alias("first"))


def _count_rows(found: dict[tuple, dict[str, list]], config: NormalizerConfig, keep_empty: bool, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Counts of chunks as rows of counts of words, which leave found."""
    names = [*arrow.names[:-2], "word", "n", "last", "doc_id", "pos"]
    while found:
        key, words = found.popitem()
        while words:
            rows = [(normalize_text(c, config), *x) for c, x in (words.popitem() for _ in range(min(len(words), ROWS)))]
            if not keep_empty:
                rows = [r for r in rows if r[0]]
            word, n, doc, pos = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
            columns = [pa.array([k] * len(rows), arrow.field(i).type) for i, k in enumerate(key)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array([d is None for d in doc], pa.bool_()), pa.array(doc, arrow.field("doc_id").type), pa.array(pos, pa.int32())], names=names)


def without_language(words: DataFrame) -> DataFrame:
    """Counts by language as counts of all, without the empty word."""
    return words.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def base_vocabulary(words: DataFrame) -> DataFrame:
    """Distinct code points of the words."""
    return words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("token")).filter("token <> ''").distinct()


def tokens_of(words: DataFrame) -> DataFrame:
    """Words with their code points as tokens."""
    return words.withColumn("tokens", F.split("word", ""))


def pair_counts(words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """left, right and n of pairs of neighbours in tokens; first: where the pair is met first."""
    at = F.explode(F.sequence(F.lit(1), F.size("tokens") - 1)).alias("i")
    rows = words.filter(F.size("tokens") > 1).select(*by, "tokens", "n", "first", at)
    pairs = rows.select(*by, F.element_at("tokens", F.col("i")).alias("left"), F.element_at("tokens", F.col("i") + 1).alias("right"), "n", F.struct("first", "i").alias("first"))
    return pairs.groupBy(*by, "left", "right").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def may_merge(left: Column, right: Column, max_length: int | None = 16, spacer: str | None = SPACER) -> Column:
    """Whether a pair's joined token is short enough and has the spacer at its start alone."""
    joined, ok = F.concat(left, right), F.lit(True)
    if max_length is not None:
        ok = ok & (F.length(joined) <= max_length)
    return ok & ~F.substring(joined, 2, 1_000_000).contains(spacer) if spacer else ok


def _learned(words: DataFrame, order: Sequence[str], merges: int, alphabet: str, langs: Sequence[str] | None, log_every: int = 0, **options) -> tuple[list[tuple[str, str]], dict]:
    """Merges, and tokens and words by language at the end. words: (lang,) word, n; sorted into one task, which learns."""
    number = F.lit(0) if langs is None else F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(dir=scratch()) as folder:
            yield from learned(batches, folder)

    def learned(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
        kinds = {"flat": np.int32, "sizes": np.int32, "freq": np.int64, "lang": np.int32}
        known = np.zeros(0x110000, bool)
        with ExitStack() as stack:
            files = {k: stack.enter_context(open(f"{folder}/{k}", "wb")) for k in kinds}
            for batch in batches:
                own = batch.column(0).to_pylist()
                if alphabet == "bytes":
                    parts = [w.encode("utf-8", "surrogatepass") for w in own]
                    codes = np.frombuffer(b"".join(parts), np.uint8)
                else:
                    parts = own
                    codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), "<u4")
                known[codes] = True
                for k, x in zip(kinds, (codes, np.fromiter(map(len, parts), np.int32, len(parts)), batch.column(1).to_numpy(), batch.column(2).to_numpy())):
                    files[k].write(x.astype(kinds[k]).tobytes())
        if not os.path.getsize(f"{folder}/sizes"):
            return
        flat, sizes, freq, of = (np.asarray(np.memmap(f"{folder}/{k}", kinds[k], "r+")) if os.path.getsize(f"{folder}/{k}") else np.zeros(0, kinds[k]) for k in kinds)
        if alphabet == "bytes":
            names = list(BYTE_TOKENS)
        else:
            found = np.flatnonzero(known)
            names = [chr(c) for c in found.tolist()]
            number_of = np.cumsum(known, dtype=np.int32) - 1
            for a in range(0, len(flat), BLOCK):
                flat[a : a + BLOCK] = number_of[flat[a : a + BLOCK]]
        learner = Learner(names, flat, sizes, freq, of, len(langs) if langs else 1, folder=folder, **options)
        merges_ = learner.run(merges, log_every)
        stats = {"tokens": learner.tokens.tolist(), "words": learner.total_words.tolist()}
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([merges_, stats])])], names=["result"])

    result = words.select("word", "n", number.cast("int").alias("qs_lang"), *[c for c in order if c not in ("word", "n")]).repartition(1).sortWithinPartitions(*order).select("word", "n", "qs_lang").mapInArrow(run, "result string").first()
    if result is None:  # no words, no task
        return [], {"tokens": [0] * len(langs or [0]), "words": [0] * len(langs or [0])}
    found, stats = json.loads(result[0])
    return [(a, b) for a, b in found], stats


def scratch() -> str | None:
    """A folder of the executor for a task's files."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)


def learn_distributed(words: DataFrame, merges: int, max_length: int | None = 16, spacer: str | None = SPACER, store_every: int = 5, *, alphabet: str = "chars", ties: str = "first", langs: Sequence[str] | None = None, fairness: float = 0.0, empty: int = 0) -> tuple[list[tuple[str, str]], dict]:
    """What _learned gives with one job for each merge, for word tables beyond one task's memory. Tokens stand between marks, so that a merge is one native replace; the table is written every few merges."""
    start = F.split("word", "") if alphabet == "chars" else F.transform(F.regexp_extract_all(F.hex(F.encode("word", "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.concat(F.lit("<0x"), h, F.lit(">")))
    lang = F.lit(0).alias("lang") if langs is None else F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int").alias("lang")
    words = words.select("word", "n", F.struct(lang, F.col("first")).alias("first"), lang, F.when(F.col("word") == "", "").otherwise(F.concat(F.lit(OPEN), F.array_join(start, CLOSE + OPEN), F.lit(CLOSE))).alias("w"))
    numbers = [0] if langs is None else list(range(1, len(langs) + 1))
    tokens = F.when(F.col("w") == "", F.array(*[F.lit("")] * empty).cast("array<string>")).otherwise(F.split(F.expr("substring(w, 2, length(w) - 2)"), CLOSE + OPEN))

    def stats() -> dict:
        found = {r["lang"]: r for r in words.groupBy("lang").agg(F.sum(F.col("n") * F.size(tokens)).alias("t"), F.sum("n").alias("n")).collect()}
        return {"tokens": [found[k]["t"] if k in found else 0 for k in numbers], "words": [found[k]["n"] if k in found else 0 for k in numbers]}

    out: list[tuple[str, str]] = []
    while len(out) < merges:
        if len(out) % store_every == 0:
            words = stored(words, "words")
        pairs = pair_counts(words.select("n", "first", "lang", tokens.alias("tokens")), ["lang"] if fairness else ())
        score = F.col("n")
        if fairness:
            now = stats()
            fertility = [t / w if w else 0.0 for t, w in zip(now["tokens"], now["words"])]
            pairs = pairs.groupBy("left", "right").agg(F.min("first").alias("first"), *[F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in numbers])
            score = F.lit(0.0)
            for k, f in zip(numbers, fertility):
                score = score + F.col(f"n{k}") * F.lit(f**fairness)
        order = ["first"] if ties == "first" else ["left", "right"]
        best = pairs.filter(may_merge(F.col("left"), F.col("right"), max_length, spacer)).orderBy(score.desc(), *order).first()
        if best is None:
            break
        a, b = best["left"], best["right"]
        words = words.withColumn("w", F.replace("w", F.lit(OPEN + a + CLOSE + OPEN + b + CLOSE), F.lit(OPEN + a + b + CLOSE)))
        out.append((a, b))
    return out, stats()


def _learn(strategy: str, words: DataFrame, order: Sequence[str], merges: int, alphabet: str, langs: Sequence[str] | None, **options) -> tuple[list[tuple[str, str]], dict]:
    if strategy == "distributed":
        log = options.pop("log_every", 0)
        options = {"max_length": None, "spacer": None} | options
        found, stats = learn_distributed(words, merges, alphabet=alphabet, langs=langs, **options)
        if log:
            logger.info("%d merges", len(found))
        return found, stats
    if strategy != "task":
        raise ValueError(f"unknown strategy {strategy!r}")
    return _learned(words, order, merges, alphabet, langs, **options)


def _padded(tokens: list[str], size: int) -> list[str]:
    """Tokens and unused ones up to a size. A number that is taken is passed over."""
    out, have, k = list(tokens), set(tokens), len(tokens)
    while len(out) < size:
        if (name := f"<unused_{k}>") not in have:
            out.append(name)
        k += 1
    return out


def train_bpe(texts: DataFrame, vocab_size: int | None = None, *, n_merges: int | None = None, normalizer: NormalizerConfig | None = None, byte_fallback: bool = True, special: SpecialTokens | bool | None = None, max_token_length: int | None = 16, strategy: str = "task", seed: int | None = None, verbose: bool = False, words: DataFrame | None = None) -> Model:
    """Standard training over texts(doc_id, text). Special tokens take ids 0-3 and part of the merge budget; what is missing from vocab_size (and from 4 more with special tokens) is filled with unused tokens. An empty table gives a model without merges. n_merges sets the budget itself, without padding. seed changes nothing. verbose: a line on the worker's standard error every LOG_EVERY merges and at the end. words: what word_counts gives for the texts, stored."""
    if vocab_size is None and n_merges is None:
        raise ValueError("vocab_size is needed")
    config = normalizer or NormalizerConfig()
    named = SpecialTokens() if special is True else special or None
    words = stored(word_counts(texts, config), "words") if words is None else words
    tokens = (named.all() if named else []) + sorted(r["token"] for r in base_vocabulary(words).collect())
    tokens = list(dict.fromkeys(tokens))
    budget = max(vocab_size - len(tokens), 0) if n_merges is None else n_merges
    merges, _ = _learn(strategy, words, ["first"], budget, "chars", None, max_length=max_token_length, spacer=SPACER, log_every=LOG_EVERY * verbose)
    tokens = list(dict.fromkeys(tokens + [a + b for a, b in merges]))
    return Model(tuple(_padded(tokens, 0 if n_merges is not None else vocab_size + (4 if named else 0))), tuple(merges), config, byte_fallback, named)


def train_bpe_fast(texts: DataFrame, vocab_size: int | None = None, *, n_merges: int | None = None, normalizer: NormalizerConfig | None = None, byte_fallback: bool = True, strategy: str = "task", verbose: bool = False, words: DataFrame | None = None) -> Model:
    """Training on byte tokens (code points without byte_fallback); ties go to the least pair, no limit of length, no padding. words: as in train_bpe; the empty one may be missing."""
    config = normalizer or NormalizerConfig()
    words = stored(word_counts(texts, config, keep_empty=True), "words") if words is None else words
    start = _alphabet(words, byte_fallback)
    merges, _ = _learn(strategy, words, ["first"], _budget(vocab_size, n_merges, start), "bytes" if byte_fallback else "chars", None, ties="lex", log_every=LOG_EVERY * verbose)
    return Model(tuple(start + [a + b for a, b in merges]), tuple(merges), config, byte_fallback)


def _budget(vocab_size: int | None, n_merges: int | None, start: list[str]) -> int:
    if n_merges is not None:
        return n_merges
    if vocab_size is None:
        raise ValueError("vocab_size is needed")
    return max(vocab_size - len(start), 0)


def _alphabet(words: DataFrame, byte_fallback: bool) -> list[str]:
    return list(BYTE_TOKENS) if byte_fallback else sorted(r["token"] for r in base_vocabulary(words).collect())


@dataclass(frozen=True)
class FairResult:
    """A model and, by language in order, tokens, words and fertility after training and the share of words."""

    model: Model
    languages: list[dict]

    def fertility_gap(self) -> float:
        values = [x["fertility"] for x in self.languages]
        return max(values) - min(values) if values else 0.0


def train_fair_bpe(texts: DataFrame, vocab_size: int | None = None, fairness_weight: float = 0.3, *, n_merges: int | None = None, languages: Sequence[str] | None = None, normalizer: NormalizerConfig | None = None, byte_fallback: bool = True, strategy: str = "task", verbose: bool = False, words: DataFrame | None = None, empty_tokens: int = 0) -> FairResult:
    """Training over texts(lang, doc_id, text) where languages of high fertility weigh more. languages: their order, which decides ties (by name where not given). Rows of other languages, null ones too, are left out. words: what word_counts gives for the texts by lang with the empty word, stored. empty_tokens: what an empty text counts for, in fertilities too."""
    if fairness_weight < 0 or fairness_weight > 1:
        raise ValueError("fairness_weight must be between 0 and 1")
    there = {r["lang"] for r in (texts.filter("text IS NOT NULL") if words is None else words).filter("lang IS NOT NULL").select("lang").distinct().collect()}
    langs = list(languages) if languages is not None else sorted(there)
    if not langs:
        raise ValueError("no corpus")
    if empty := [x for x in langs if x not in there]:
        raise ValueError(f"no text in {empty}")
    config = normalizer or NormalizerConfig()
    order = F.array_position(F.array(*map(F.lit, langs)), F.col("lang"))
    words = stored(word_counts(texts.filter(F.col("lang").isin(langs)), config, ["lang"], keep_empty=True), "words") if words is None else words.filter(F.col("lang").isin(langs))
    words = words.withColumn("lang_ord", order)
    start = _alphabet(words, byte_fallback)
    merges, stats = _learn(strategy, words, ["lang_ord", "first"], _budget(vocab_size, n_merges, start), "bytes" if byte_fallback else "chars", langs, fairness=fairness_weight, empty=empty_tokens, log_every=LOG_EVERY * verbose)
    everyone = sum(stats["words"]) or 1
    rows = [{"lang": x, "total_tokens": t, "total_words": w, "fertility": t / w if w else 0.0, "target_ratio": w / everyone} for x, t, w in zip(langs, stats["tokens"], stats["words"])]
    return FairResult(Model(tuple(start + [a + b for a, b in merges]), tuple(merges), config, byte_fallback), rows)


def split_by_order(texts: DataFrame, share: float = 0.8) -> DataFrame:
    """texts with part ("train" or "test"): the first share of rows by doc_id trains. Ranks come from counts of ranges of doc_id, without one task for all rows."""
    parts = texts.repartitionByRange("doc_id").select("*", F.spark_partition_id().alias("qs_part"))
    parts = stored(parts, "ranges")
    before = parts.groupBy("qs_part").count().withColumn("qs_before", F.coalesce(F.sum("count").over(Window.orderBy("qs_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    n = parts.count()
    rank = F.row_number().over(Window.partitionBy("qs_part").orderBy("doc_id"))
    ranked = parts.withColumn("qs_rank", rank).join(F.broadcast(before), "qs_part").withColumn("part", F.when(F.col("qs_rank") + F.col("qs_before") <= int(share * n), "train").otherwise("test"))
    return ranked.select(*texts.columns, "part")
