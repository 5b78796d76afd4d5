"""Encoding and decoding with a model.

A chunk's tokens depend on the chunk alone, so workers remember chunks. Merging is greedy:
the lowest rank, of equal ones the leftmost, one pair at a time, by a heap over linked
tokens. Nulls give nulls, empty texts empty lists.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quillspark.functions.normalize import denormalize_text, normalize_text
from quillspark.functions.pretokenize import pretokenize_text
from quillspark.model import BYTE_TOKEN, Model, model_hash

#: Chunks that a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 200_000, 64
#: Characters of texts whose tokens a worker holds at once, tokens that it counts before it passes them on, and rows of counts at once.
CHARS, COUNTED, ROWS = 500_000, 200_000, 5_000
#: Encoders that a worker keeps from task to task, by model.
KEPT = 8
_KEPT: dict[tuple[str, bool], Encoder] = {}
#: As Java's \\s.
_WHITE = re.compile("[ \\t-\\r]")
_BYTES = re.compile(rf"(?:{BYTE_TOKEN.pattern})+")


def merge_steps(tokens: list[str], ranks: dict[tuple[str, str], int]) -> Iterator[tuple[int, str, str, int]]:
    """Merges of a token list in order: place among the tokens as they were given, left, right and rank."""
    n = len(tokens)
    text, after, before = list(tokens), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((text[i], text[i + 1]))) is not None]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or ranks.get((text[i], text[j])) != rank:
            continue
        yield i, text[i], text[j], rank
        text[i] += text[j]
        gone[j] = True
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (r := ranks.get((text[left], text[after[left]]))) is not None:
                heapq.heappush(heap, (r, left))


def merged(tokens: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    if len(tokens) < 2:
        return tokens
    out: list[str | None] = list(tokens)
    size = [1] * len(tokens)
    for i, left, right, _ in merge_steps(tokens, ranks):
        j = i + size[i]
        out[i], out[j] = left + right, None
        size[i] += size[j]
    return [t for t in out if t is not None]


class Encoder:
    """A model at work on strings, inside Python workers."""

    def __init__(self, model: Model, strict_specials: bool = False):
        self.model, self.config, self.strict = model, model.normalizer, strict_specials
        self.special = model.special.all() if model.special else []
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, list[str]] = {}
        self.key = (model_hash(model.to_dict()), strict_specials)

    def __reduce__(self):
        """Where it arrives, the encoder that is there already is used, with what it remembers."""
        return _kept, (self.key, self.model, self.strict)

    def chunk(self, chunk: str) -> list[str]:
        if len(chunk) > MEMO_CHARS:
            return self._chunk(chunk)
        found = self.memo.get(chunk)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[chunk] = self._chunk(chunk)
        return found

    def _plain(self, text: str) -> list[str]:
        return merged(self.model.fallback(normalize_text(text, self.config)), self.model.ranks)

    def _chunk(self, chunk: str) -> list[str]:
        """A chunk that is nothing but a special token is ordinary text unless specials are strict."""
        if self.split is None or chunk in self.special and not self.strict:
            return self._plain(chunk)
        out: list[str] = []
        for part in filter(None, self.split.split(chunk)):
            out += [part] if part in self.special else self._plain(part)
        return out

    def encode(self, text: str | None) -> list[str] | None:
        if text is None:
            return None
        out: list[str] = []
        get = self.memo.get
        for c in pretokenize_text(text, self.config.chunking):
            out += get(c) or self.chunk(c)
        return out

    def word(self, word: str) -> list[str]:
        """Tokens of a chunk in its normal form, of a model without special tokens."""
        return merged(self.model.fallback(word), self.model.ranks)

    def line(self, text: str | None) -> str | None:
        """Tokens between spaces, whitespace inside them as underscores."""
        if text is None:
            return None
        tokens = self.encode(text)
        line = " ".join(tokens)
        return line if len(_WHITE.findall(line)) == max(len(tokens) - 1, 0) else " ".join([_WHITE.sub("_", t) for t in tokens])

    def count(self, text: str | None) -> int | None:
        if text is None:
            return None
        get = self.memo.get
        return sum([len(get(c) or self.chunk(c)) for c in pretokenize_text(text, self.config.chunking)])

    def decode(self, tokens: list[str] | None) -> str | None:
        if tokens is None:
            return None
        special = set(self.special)
        return denormalize_text(join_bytes([t for t in tokens if t is not None and t not in special]), self.config)

    def explain(self, text: str, whole: bool = False) -> Iterator[tuple[int, int, str | None, str | None, int | None, list[str]]]:
        """Chunk number, step, left, right, rank and tokens so far; step 0 has the tokens before any merge. whole: the text is one chunk."""
        for c, chunk in enumerate([text] if whole else pretokenize_text(text, self.config.chunking)):
            tokens = self.model.fallback(normalize_text(chunk, self.config))
            yield c, 0, None, None, None, tokens
            now, size = list(tokens), [1] * len(tokens)
            live: list[str | None] = list(now)
            for step, (i, left, right, rank) in enumerate(merge_steps(tokens, self.model.ranks), 1):
                j = i + size[i]
                live[i], live[j] = left + right, None
                size[i] += size[j]
                yield c, step, left, right, rank, [t for t in live if t is not None]


def _kept(key: tuple[str, bool], model: Model, strict: bool) -> Encoder:
    found = _KEPT.get(key)
    if found is None:
        if len(_KEPT) >= KEPT:
            _KEPT.clear()
        found = _KEPT[key] = Encoder(model, strict)
    return found


def join_bytes(tokens: list[str]) -> str:
    """Text of tokens. Runs of byte tokens, also inside one token, are UTF-8; a run that isn't becomes a question mark for each byte."""
    out: list[str] = []
    for is_bytes, run in groupby(tokens, lambda t: _BYTES.fullmatch(t) is not None):
        if not is_bytes:
            out += run
            continue
        data = bytes(int(h, 16) for t in run for h in BYTE_TOKEN.findall(t))
        try:
            out.append(data.decode("utf-8"))
        except UnicodeDecodeError:
            out.append("?" * len(data))
    return "".join(out)


def readable(token: str) -> str:
    """A token for display: its byte tokens decoded, what is no UTF-8 left out."""
    return _BYTES.sub(lambda m: bytes(int(h, 16) for h in BYTE_TOKEN.findall(m[0])).decode("utf-8", "ignore"), token)


def parts(texts: pd.Series) -> Iterator[pd.Series]:
    """A batch in runs of about CHARS characters, a row at least, so that memory doesn't follow the tokens of a batch."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size >= CHARS:
            yield texts.iloc[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts.iloc[start:]


def encode(text: Column, model: Model, strict_specials: bool = False) -> Column:
    """Tokens of a text column."""
    encoder = Encoder(model, strict_specials)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for part in parts(texts):
                yield part.map(encoder.encode)

    return run(text)


def token_lines(text: Column, model: Model) -> Column:
    """Tokens of each text as a line, for the text sink."""
    encoder = Encoder(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for part in parts(texts):
                yield part.map(encoder.line)

    return run(text)


def roundtrip(text: Column, model: Model) -> Column:
    """Each text encoded and decoded again, one at a time."""
    encoder = Encoder(model)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encoder.decode(encoder.encode(t)))

    return run(text)


def encoded_rows(texts: DataFrame, model: Model, column: str, ids: bool = False) -> DataFrame:
    """column, pos and token (or id) of texts: a row for each token, made where texts are encoded, so that no list of them leaves a worker."""
    encoder, number = Encoder(model), model.ids
    kind = StructField("id", IntegerType()) if ids else StructField("token", StringType())
    rows = texts.select(column, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in parts(pd.Series(batch.column(1).to_pylist(), dtype=object)):
                found = [encoder.encode(t) or [] for t in part]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                flat = [t for tokens in found for t in tokens]
                ends = np.cumsum(sizes)
                pos = np.arange(len(flat), dtype=np.int32) - np.repeat(ends - sizes, sizes).astype(np.int32)
                own = batch.column(0).slice(start, len(part)).take(pa.array(np.repeat(np.arange(len(part)), sizes)))
                start += len(part)
                yield pa.RecordBatch.from_arrays([own, pa.array(pos), pa.array([number.get(t) for t in flat], pa.int32()) if ids else pa.array(flat, pa.string())], names=[column, "pos", kind.name])

    return rows.mapInArrow(run, StructType([rows.schema[column], StructField("pos", IntegerType()), kind]))


def token_counts(words: DataFrame, model: Model, by: str) -> DataFrame:
    """by, token, n and first (doc_id, place of the chunk and place in it) of counted words (by, word, n, first), each encoded once."""
    encoder = Encoder(model)
    rows = words.select(by, "word", "n", "first.last", "first.doc_id", "first.pos")
    kinds = rows.schema
    schema = StructType([kinds[by], StructField("token", StringType()), StructField("n", LongType()), kinds["last"], kinds["doc_id"], kinds["pos"], StructField("k", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        arrow = None

        def out() -> Iterator[pa.RecordBatch]:
            while found:
                own = [(*key, n, *first) for key, (n, first) in (found.popitem() for _ in range(min(len(found), ROWS)))]
                types = [arrow.field(0).type, pa.string(), pa.int64(), pa.bool_(), arrow.field(4).type, pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own), types)], names=schema.names)

        for batch in batches:
            arrow = arrow or batch.schema
            for key, word, n, last, doc, pos in zip(*(c.to_pylist() for c in batch.columns)):
                for k, token in enumerate(encoder.word(word)):
                    first = (last, doc, pos, k)
                    if (old := found.get((key, token))) is None:
                        found[key, token] = [n, first]
                    else:
                        old[0] += n
                        if last < old[1][0] or last == old[1][0] and first[1 + last :] < old[1][1 + last :]:  # of nulls the places alone
                            old[1] = first
            if len(found) >= COUNTED:
                yield from out()
        yield from out()

    spread = rows.repartition(4 * words.sparkSession.sparkContext.defaultParallelism)
    first = F.struct("last", "doc_id", "pos", "k")
    return spread.mapInArrow(run, schema).groupBy(by, "token").agg(F.sum("n").alias("n"), F.min(first).alias("first"))


def count_tokens(text: Column, model: Model) -> Column:
    """Number of tokens, without shipping them."""
    encoder = Encoder(model)

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([encoder.count(t) for t in texts], dtype="Int64")

    return run(text)


def encode_ids(text: Column, model: Model) -> Column:
    """Ids of the tokens; null for a token that the vocabulary lacks, such as byte tokens of a model without them."""
    encoder, ids = Encoder(model), model.ids

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for part in parts(texts):
                yield part.map(lambda t: None if t is None else [ids.get(x) for x in encoder.encode(t)])

    return run(text)


def _null(found: object) -> bool:
    """Null lists come from Arrow as None, or as NaN where a batch has nothing else."""
    return found is None or isinstance(found, float)


def decode(tokens: Column, model: Model) -> Column:
    encoder = Encoder(model)

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: None if _null(ts) else encoder.decode(list(ts)))

    return run(tokens)


def decode_ids(ids: Column, model: Model) -> Column:
    encoder = Encoder(model)

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: None if _null(xs) else encoder.decode([model.token(int(x)) for x in xs if x is not None and x == x]))  # an id that is null comes as NaN

    return run(ids)


def encode_distinct(texts: DataFrame, model: Model) -> DataFrame:
    """texts(doc_id, text, ...) with tokens, encoding every distinct text once; for corpora of many copies."""
    once = texts.select("text").filter("text IS NOT NULL").distinct().withColumn("tokens", encode(F.col("text"), model))
    return texts.join(once, "text", "left")


def explain_function(model: Model, whole: bool = False):
    """A table function of a text: chunk, step, left, right, rank, tokens."""
    encoder = Encoder(model)

    @udtf(returnType="chunk int, step int, left string, right string, rank int, tokens array<string>")
    class Explain:
        def eval(self, text: str):
            if text is not None:
                yield from encoder.explain(text, whole)

    return Explain


def register(spark: SparkSession, model: Model, prefix: str = "bpe") -> None:
    """SQL functions bpe_encode, bpe_decode, bpe_count_tokens and the table function bpe_explain."""
    encoder = Encoder(model)

    @F.pandas_udf("array<string>")
    def to_tokens(texts: pd.Series) -> pd.Series:
        return texts.map(encoder.encode)

    @F.pandas_udf("string")
    def to_text(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: None if _null(ts) else encoder.decode(list(ts)))

    @F.pandas_udf("bigint")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([encoder.count(t) for t in texts], dtype="Int64")

    for name, function in (("encode", to_tokens), ("decode", to_text), ("count_tokens", size)):
        spark.udf.register(f"{prefix}_{name}", function)
    spark.udtf.register(f"{prefix}_explain", explain_function(model))
