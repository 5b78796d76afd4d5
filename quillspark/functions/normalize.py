"""Normalisation of text: Unicode form, case and spacer, and back."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.whitespace import SPACER, WS25, WS25_CLASS, strip

FORMS = ("NONE", "NFC", "NFD", "NFKC", "NFKD")
SPACERS = ("PREFIX", "SUFFIX", "ISOLATED", "NONE")
CHUNKINGS = ("NONE", "WHITESPACE", "GPT2", "CODE", "SYNTAX_AWARE")


@dataclass(frozen=True)
class NormalizerConfig:
    """How text becomes words. Names are read in any case; an unknown way of chunking means NONE, other unknown names are errors."""

    form: str = "NFKC"
    spacer: str = "PREFIX"
    lowercase: bool = False
    chunking: str = "NONE"

    def __post_init__(self) -> None:
        form, spacer, chunking = self.form.upper(), self.spacer.upper(), self.chunking.upper()
        spacer = {"SEPARATOR": "ISOLATED"}.get(spacer, spacer)
        chunking = {"PYTHON": "CODE", "SYNTAX": "SYNTAX_AWARE"}.get(chunking, chunking)
        if form not in FORMS:
            raise ValueError(f"unknown normalization {self.form!r}")
        if spacer not in SPACERS:
            raise ValueError(f"unknown spacer {self.spacer!r}")
        for name, value in (("form", form), ("spacer", spacer), ("chunking", chunking if chunking in CHUNKINGS else "NONE")):
            object.__setattr__(self, name, value)

    def to_dict(self) -> dict:
        return {"lowercase": self.lowercase, "spacer": SPACER, "spacer_mode": self.spacer, "normalization_mode": self.form, "pre_tokenization_mode": self.chunking}

    @classmethod
    def from_dict(cls, data: dict) -> NormalizerConfig:
        """Reads the keys of today's and of older model files."""
        pick = lambda *names: next((data[n] for n in names if n in data), None)
        return cls(pick("normalization_mode", "normalization") or "NFKC", pick("spacer_mode") or "PREFIX", bool(data.get("lowercase", False)), pick("pre_tokenization_mode", "pre_tokenization") or "NONE")


def unicode_form(text: Column, form: str) -> Column:
    """Unicode normal form. Only texts beyond ASCII change, and what is ASCII comes back as it was."""
    if form == "NONE":
        return text

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal(text)


def with_spacer(text: Column, spacer: str) -> Column:
    """Spaces to visible marks; the empty text stays empty."""
    if spacer == "NONE":
        return text
    if spacer == "SUFFIX":
        return F.regexp_replace(text, f"([^{WS25_CLASS}]+)", f"$1{SPACER}")
    marked = F.regexp_replace(text, f"[{WS25_CLASS}]+", SPACER)
    return marked if spacer == "ISOLATED" else F.when(text == "", text).otherwise(F.concat(F.lit(SPACER), marked))


def normalize(text: Column, config: NormalizerConfig) -> Column:
    out = unicode_form(text, config.form)
    return with_spacer(F.lower(out) if config.lowercase else out, config.spacer)


def denormalize(text: Column, config: NormalizerConfig) -> Column:
    """Marks to spaces: PREFIX drops one at the start, SUFFIX whitespace at both ends."""
    if config.spacer == "NONE":
        return text
    if config.spacer == "PREFIX":
        text = F.regexp_replace(text, f"^{SPACER}", "")
    plain = F.translate(text, SPACER, " ")
    return strip(plain) if config.spacer == "SUFFIX" else plain


_WHITE = frozenset(WS25)


_WHITE_RUN = re.compile(f"[{WS25}]+")


def _white_runs_to_marks(text: str) -> str:
    return _WHITE_RUN.sub(SPACER, text)


def _suffixed(text: str) -> str:
    out, before = [], True
    for c in text:
        white = c in _WHITE
        if white and not before:
            out.append(SPACER)
        out.append(c)
        before = white
    return "".join(out) + ("" if before else SPACER)


def normalize_text(text: str, config: NormalizerConfig) -> str:
    """The same for one string, inside Python workers."""
    if not text:
        return ""
    if config.form != "NONE" and not text.isascii():
        text = unicodedata.normalize(config.form, text)
    if config.lowercase:
        text = text.lower()
    if config.spacer == "NONE":
        return text
    if config.spacer == "SUFFIX":
        return _suffixed(text)
    return (SPACER if config.spacer == "PREFIX" else "") + _white_runs_to_marks(text)


def denormalize_text(text: str, config: NormalizerConfig) -> str:
    if config.spacer == "NONE":
        return text
    if config.spacer == "PREFIX":
        text = text.removeprefix(SPACER)
    plain = text.replace(SPACER, " ")
    return plain.strip() if config.spacer == "SUFFIX" else plain
