"""The model of a tokenizer: vocabulary, merges and how text is normalised. It never changes."""

from __future__ import annotations

import hashlib
import json
import re
import warnings
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.normalize import NormalizerConfig
from quillspark.functions.whitespace import SPACER

ALGORITHM, FORMAT = "bpe", "0.1.0"
BYTE_TOKENS = tuple(f"<0x{b:02X}>" for b in range(256))
BYTE_TOKEN = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class SpecialTokens:
    eos: str = "<EOS>"
    bos: str = "<BOS>"
    unk: str = "<UNK>"
    pad: str = "<PAD>"

    def all(self) -> list[str]:
        return [self.pad, self.unk, self.bos, self.eos]


def is_byte_token(token: str) -> bool:
    return BYTE_TOKEN.fullmatch(token) is not None


def byte_tokens_of(char: str) -> list[str]:
    return [BYTE_TOKENS[b] for b in char.encode("utf-8", "surrogatepass")]


@dataclass(frozen=True)
class Model:
    """Tokens in order of their ids, merges in order of their ranks."""

    tokens: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]
    normalizer: NormalizerConfig = field(default_factory=NormalizerConfig)
    byte_fallback: bool = True
    special: SpecialTokens | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "tokens", tuple(dict.fromkeys(self.tokens)))
        object.__setattr__(self, "merges", tuple(dict.fromkeys(tuple(m) for m in self.merges)))

    @cached_property
    def ids(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {m: i for i, m in enumerate(self.merges)}

    def __len__(self) -> int:
        return len(self.tokens)

    def __contains__(self, name: object) -> bool:
        return name in self.ids

    def token_id(self, token: str) -> int | None:
        return self.ids.get(token)

    def token(self, token_id: int) -> str | None:
        return self.tokens[token_id] if 0 <= token_id < len(self.tokens) else None

    def special_ids(self) -> dict[str, int | None]:
        """Ids of pad, unk, bos and eos; null where there are none."""
        return {n: self.token_id(getattr(self.special, n)) if self.special else None for n in ("pad", "unk", "bos", "eos")}

    def with_byte_tokens(self) -> Model:
        """The same with byte fallback on and all 256 byte tokens in the vocabulary."""
        return replace(self, tokens=self.tokens + BYTE_TOKENS, byte_fallback=True)

    def kind(self, token: str) -> str:
        if self.special and token in self.special.all():
            return "special"
        if is_byte_token(token):
            return "byte"
        if re.fullmatch(r"<unused_\d+>", token):
            return "unused"
        return "char" if len(token) == 1 else "merged"

    def fallback(self, text: str) -> list[str]:
        """Code points that the vocabulary has, bytes of the others."""
        if not self.byte_fallback:
            return list(text)
        known, out = self.ids, []
        for c in text:
            if c in known:
                out.append(c)
            else:
                out += byte_tokens_of(c)
        return out

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, t, self.kind(t)) for i, t in enumerate(self.tokens)], "id int, token string, kind string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.merges)], "rank int, left string, right string")

    def to_dict(self, metadata: dict | None = None) -> dict:
        vocab: dict = {"tokens": list(self.tokens), "use_special_tokens": self.special is not None, "byte_fallback": self.byte_fallback}
        if self.special:
            vocab["special_tokens"] = {n: getattr(self.special, n) for n in ("pad", "unk", "bos", "eos")}
        out = {"algorithm": ALGORITHM, "version": FORMAT, "created_at": datetime.now().isoformat(), "normalizer": self.normalizer.to_dict(), "byte_fallback": self.byte_fallback, "vocab": vocab, "merges": {"merges": [list(m) for m in self.merges]}}
        if metadata:
            out["metadata"] = metadata
        return out | {"model_hash": model_hash(out)}

    @classmethod
    def from_dict(cls, data: dict) -> Model:
        """Other fields are ignored. A hash that doesn't fit is a warning."""
        if data.get("algorithm") != ALGORITHM:
            raise ValueError(f"unknown algorithm {data.get('algorithm')!r}")
        if (told := data.get("model_hash")) and told != model_hash(data):
            warnings.warn("the model's hash doesn't fit its content", stacklevel=2)
        vocab, named = data["vocab"], data["vocab"].get("special_tokens") or {}
        special = SpecialTokens(**{n: named[n] for n in ("pad", "unk", "bos", "eos") if n in named}) if vocab.get("use_special_tokens") else None
        tokens = (special.all() if special else []) + list(vocab["tokens"])
        return cls(tuple(tokens), tuple((a, b) for a, b in data["merges"]["merges"]), NormalizerConfig.from_dict(data["normalizer"]), bool(data.get("byte_fallback", vocab.get("byte_fallback", True))), special)

    def save(self, path: str | Path, metadata: dict | None = None) -> None:
        """ASCII JSON. Folders are made, a file there is replaced."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(self.to_dict(metadata), indent=2, ensure_ascii=True), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> Model:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))


def model_hash(data: dict) -> str:
    """SHA-256 over canonical JSON of what bears on the model's behaviour."""
    kept = {k: data[k] for k in ("algorithm", "byte_fallback", "merges", "normalizer", "seed", "version", "vocab") if data.get(k) is not None}
    return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()


def model_info(path: str | Path) -> dict:
    """What a model file says of itself."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    return {k: data.get(k) for k in ("algorithm", "version", "created_at", "byte_fallback", "normalizer", "model_hash", "metadata")} | {"vocab_size": len(data["vocab"]["tokens"]), "num_merges": len(data["merges"]["merges"])}


def corpus_hash(spark: SparkSession, path: str, sample: int = 10_000) -> str:
    """SHA-256 of a file's first bytes; "unknown" where there is none."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    try:
        found = spark.read.format("binaryFile").load(path).select(F.sha2(F.substring("content", 1, sample), 256)).first()
    except AnalysisException:
        return "unknown"
    return found[0] if found else "unknown"


__all__ = ["BYTE_TOKENS", "Model", "SPACER", "SpecialTokens", "corpus_hash", "model_hash", "model_info"]
