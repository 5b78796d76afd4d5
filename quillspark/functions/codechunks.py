"""Chunks of Python source: strings and comments whole, then operators, names and numbers.

A `#` inside a string also looks like a comment. By default the span that begins first wins.
With compat=True both are emitted where they begin and scanning goes on after the later one,
so text can appear twice, as older chunkings of the same corpora have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

TWO_SIGNS = ("==", "!=", "<=", ">=", "//", "**", "->", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=")
THREE_SIGNS = ("//=", "**=", ">>=", "<<=", "...")
_QUOTED = "|".join([r'"{3}.*?"{3}', r"'{3}.*?'{3}", *(rf"f?{q}(?:[^{q}\\]|\\.)*{q}" for q in "\"'")])
STRING = re.compile(_QUOTED, re.S)
COMMENT = re.compile(r"#[^\n]*")
_SIGN = "|".join(map(re.escape, THREE_SIGNS + TWO_SIGNS))
_NUMBER = r"0[xX][0-9a-fA-F]+|0[bB][01]+|\d+(?:\.\d+)?"
PLAIN = re.compile(rf"(?P<white>[\s\x1c-\x1f]+)|(?:{_SIGN})|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>{_NUMBER})|.", re.S)
INSIDE = re.compile(r"https?://|www\.|\w+|[^\w\s]+|\s+")
LONG_STRING, LONG_COMMENT, LONG_NUMBER, PART = 30, 20, 6, 3


def spans(text: str, compat: bool) -> Iterator[tuple[int, int, bool]]:
    """Strings and comments in order: start, end, whether a comment."""
    found = [(m.start(), m.end(), False) for m in STRING.finditer(text)] + [(m.start(), m.end(), True) for m in COMMENT.finditer(text)]
    found.sort(key=lambda x: x[0])
    if compat:
        yield from found
        return
    at, ahead = 0, [STRING.search(text), COMMENT.search(text)]
    while any(ahead):
        first = min((m for m in ahead if m), key=lambda m: m.start())
        yield first.start(), first.end(), first is ahead[1]
        at = first.end()
        ahead = [m if m is None or m.start() >= at else p.search(text, at) for m, p in zip(ahead, (STRING, COMMENT))]


def plain_chunks(text: str, cut_numbers: bool = False) -> Iterator[str]:
    for m in PLAIN.finditer(text):
        chunk = m[0]
        if cut_numbers and m["number"] and len(chunk) > LONG_NUMBER:
            yield from (chunk[i : i + PART] for i in range(0, len(chunk), PART))
        else:
            yield chunk


def chunks(text: str, compat: bool = False) -> list[str]:
    """Version 1: every string and comment is one chunk."""
    out, at = [], 0
    for start, end, _ in spans(text, compat):
        if at < start:
            out += plain_chunks(text[at:start])
        out.append(text[start:end])
        at = end
    return [c for c in [*out, *plain_chunks(text[at:])] if c]


def string_chunks(text: str) -> list[str]:
    """A short string whole; a long one as its opening, its words and signs, and its closing quote."""
    opening = text[:3] if text[:3] in ('"""', "'''") else text[:2] if text[0] == "f" else text[0]
    closing = opening if len(opening) == 3 else opening[-1]
    body = text[len(opening) : len(text) - len(closing)]
    return [text] if len(body) <= LONG_STRING else [opening, *INSIDE.findall(body), closing]


def comment_chunks(text: str) -> list[str]:
    """A short comment whole; a long one as its sign, one space and the chunks of the rest."""
    body = text[1:].strip()
    return [text] if len(body) <= LONG_COMMENT else ["#", " ", *plain_chunks(body, True)]


def hybrid_chunks(text: str, compat: bool = False) -> list[str]:
    """Version 2: long strings, comments and numbers are cut."""
    out, at = [], 0
    for start, end, comment in spans(text, compat):
        if at < start:
            out += plain_chunks(text[at:start], True)
        out += (comment_chunks if comment else string_chunks)(text[start:end])
        at = end
    return [c for c in [*out, *plain_chunks(text[at:], True)] if c]
