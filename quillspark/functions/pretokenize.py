"""Text to chunks. All but the source-code scanners are native column expressions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import codechunks
from quillspark.functions.normalize import NormalizerConfig, normalize, normalize_text
from quillspark.functions.whitespace import WS25_CLASS, WS29_CLASS

#: Contractions, letters, numbers, other signs with a space before, and white runs, of which the last white character goes to the chunk after.
GPT2 = rf"'(?:[stmd]|re|ve|ll)| ?(?:\p{{L}}+|\p{{N}}+|[^{WS25_CLASS}\p{{N}}\p{{L}}]+)|[{WS25_CLASS}]+(?![^{WS25_CLASS}])|[{WS25_CLASS}]+"
#: Operators, names, numbers, strings and any other sign; whitespace is dropped.
SIMPLE_CODE = rf"[><=!+-]=|[=-]>|//|<<|>>|&&|\|\||[A-Za-z_][0-9A-Za-z_]*|\p{{Nd}}+\.?\p{{Nd}}*|\"[^\"]*\"|'[^']*'|[^{WS29_CLASS}]"
_WHITE_OR_NOT = f"[^{WS25_CLASS}]+|[{WS25_CLASS}]+"


def _matches(text: Column, pattern: str) -> Column:
    """All matches; the text itself where there is none, as for the empty text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text == "", F.array(text)).otherwise(found)


def pretokenize(text: Column, chunking: str = "NONE", compat: bool = False) -> Column:
    """array<string> of chunks; null for null."""
    chunking = NormalizerConfig(chunking=chunking).chunking
    if chunking == "NONE":
        return F.when(text == "", F.array().cast("array<string>")).when(text.isNotNull(), F.array(text))
    if chunking == "WHITESPACE":
        return _matches(text, _WHITE_OR_NOT)
    if chunking == "GPT2":
        return _matches(text, GPT2)
    return code_pretokenize(text, compat)


def code_pretokenize(text: Column, compat: bool = False) -> Column:
    @F.pandas_udf("array<string>")
    def chunked(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else codechunks.chunks(t, compat))

    return chunked(text)


def hybrid_code_pretokenize(text: Column, compat: bool = False) -> Column:
    @F.pandas_udf("array<string>")
    def chunked(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else codechunks.hybrid_chunks(t, compat))

    return chunked(text)


def simple_code_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SIMPLE_CODE), F.lit(0))


def normalized_chunks(text: Column, config: NormalizerConfig) -> Column:
    """Chunks, each normalised by itself. Native as far as the form of Unicode allows."""
    chunks = pretokenize(text, config.chunking)
    if config.form == "NONE":
        return F.transform(chunks, lambda c: normalize(c, config))

    @F.pandas_udf("array<string>")
    def normal(lists: pd.Series) -> pd.Series:
        memo = lru_cache(100_000)(lambda c: normalize_text(c, config))
        return lists.map(lambda cs: None if cs is None else [memo(c) for c in cs])

    return normal(chunks)


@lru_cache(1)
def _gpt2() -> regex.Pattern:
    return regex.compile(r"'(?:[stmd]|re|ve|ll)| ?(?:\p{L}+|\p{N}+|[^\p{N}\s\p{L}]+)|\s+(?!\S)|\s+")


@lru_cache(1)
def _white_or_not() -> regex.Pattern:
    return regex.compile(r"\S+|\s+")


def pretokenize_text(text: str, chunking: str, compat: bool = False) -> list[str]:
    """The same for one string, inside Python workers."""
    if chunking == "NONE":
        return [text] if text else []
    if chunking in ("WHITESPACE", "GPT2"):
        return (_gpt2() if chunking == "GPT2" else _white_or_not()).findall(text) or [text]
    return codechunks.chunks(text, compat)
