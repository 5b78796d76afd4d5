"""Whitespace classes and counts as native column expressions.

WS25 is what the normaliser calls whitespace; WS29 adds the four separators U+001C-001F that
splitting and stripping also take for white. Both are written out as the inside of a
bracket class, so that Java, RE2 and Python read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACER = "▁"
_POINTS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WS25 = "".join(map(chr, _POINTS))
WS29 = WS25 + "\x1c\x1d\x1e\x1f"


def escaped(chars: str) -> str:
    """Characters for a bracket class of Java, RE2 or Python, all in ASCII; neighbours as ranges, since Java tests the members of a class one by one."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


WS25_CLASS, WS29_CLASS = escaped(WS25), escaped(WS29)


def words(text: Column) -> Column:
    """Runs of characters that aren't white."""
    return F.regexp_extract_all(text, F.lit(f"[^{WS29_CLASS}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; null for null."""
    return F.when(text.isNotNull(), F.size(words(text))).cast("bigint")


def strip(text: Column) -> Column:
    """Text without whitespace at its ends."""
    return F.regexp_replace(text, f"^[{WS29_CLASS}]+|[{WS29_CLASS}]+$", "")


def code_points(text: Column) -> Column:
    return F.split(text, "")
