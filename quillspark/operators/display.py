"""Tokens of one text for the eye: in a row, as a table, or in colour."""

from __future__ import annotations

from collections.abc import Sequence

from quillspark.functions.whitespace import SPACER
from quillspark.model import Model
from quillspark.operators.metrics import CLASS_KEYWORDS, CLASS_OPERATORS

COLOURS = {"keyword": 35, "operator": 31, "identifier": 32, "literal": 33, "other": 37}


def kind_of(token: str) -> str:
    """The class of a token, as token_class has it for columns."""
    if token.strip(SPACER + " ") in CLASS_KEYWORDS:
        return "keyword"
    if token.strip() in CLASS_OPERATORS:
        return "operator"
    if token[:1] in ("'", '"') and token or token.isdigit():
        return "literal"
    return "identifier" if token.replace(SPACER, "").isidentifier() else "other"


def named(tokens: Sequence[str | int], model: Model) -> list[str]:
    """Ids by their tokens, unknown ones in angle brackets."""
    return [t if isinstance(t, str) else model.token(t) or f"<{t}>" for t in tokens]


def inline(tokens: Sequence[str]) -> str:
    return f"{' | '.join(tokens)}\n{len(tokens)} tokens"


def table(text: str, tokens: Sequence[str]) -> str:
    rows = [f"{i}\t{t}\t{len(t.encode('utf-8', 'replace'))}\t{kind_of(t)}" for i, t in enumerate(tokens, 1)]
    share = f"{len(tokens) / len(text):.2%}" if text else "-"
    return "\n".join(["#\ttoken\tbytes\ttype", *rows, f"{len(tokens)} tokens, {len(text)} characters, {share}"])


def coloured(tokens: Sequence[str]) -> str:
    return " ".join(f"\x1b[{COLOURS[kind_of(t)]}m[{t}]\x1b[0m" for t in tokens)


STYLES = {"inline": lambda text, tokens: inline(tokens), "table": table, "colored": lambda text, tokens: coloured(tokens)}


def show(text: str, tokens: Sequence[str], style: str = "inline") -> str:
    return STYLES[style](text, tokens)
