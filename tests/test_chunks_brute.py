"""Source-code chunks and Unicode forms against scanners that go character by character."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import codechunks as C
from quillspark.plans import registry as R

QUOTES = ("'", '"')


def string_end(text, i):
    """Where a string that begins at i ends; None where none does."""
    for q in QUOTES:
        if text.startswith(q * 3, i) and (end := text.find(q * 3, i + 3)) >= 0:
            return end + 3
    k = i + (text[i] == "f")
    if k < len(text) and text[k] in QUOTES:
        q, k = text[k], k + 1
        while k < len(text):
            if text[k] == q:
                return k + 1
            k += 2 if text[k] == "\\" else 1
    return None


def line_end(text, i):
    end = text.find("\n", i)
    return len(text) if end < 0 else end


def spans(text, compat):
    out, i = [], 0
    if compat:
        while i < len(text):
            end = string_end(text, i)
            if end is not None:
                out.append((i, end, False))
            i = i + 1 if end is None else end
        i = 0
        while (i := text.find("#", i)) >= 0:
            out.append((i, line_end(text, i), True))
            i = line_end(text, i)
        return sorted(out, key=lambda s: s[0])
    while i < len(text):
        end = string_end(text, i)
        if end is not None:
            out.append((i, end, False))
        elif text[i] == "#":
            end = line_end(text, i)
            out.append((i, end, True))
        i = i + 1 if end is None else end
    return out


def run(text, i, test):
    while i < len(text) and test(text[i]):
        i += 1
    return i


def plain(text, cut):
    out, i = [], 0
    ascii_name = lambda c: c.isascii() and (c.isalnum() or c == "_")
    while i < len(text):
        c, number = text[i], False
        if c.isspace():
            end = run(text, i, str.isspace)
        elif any(text.startswith(s, i) for s in C.THREE_SIGNS):
            end = i + 3
        elif text[i : i + 2] in C.TWO_SIGNS:
            end = i + 2
        elif ascii_name(c) and not c.isdigit():
            end = run(text, i, ascii_name)
        elif c.isdecimal():
            number, end = True, run(text, i, str.isdecimal)
            if end + 1 < len(text) and text[end] == "." and text[end + 1].isdecimal():
                end = run(text, end + 1, str.isdecimal)
            for marks, digits in (("xX", "0123456789abcdefABCDEF"), ("bB", "01")):
                if c == "0" and i + 2 < len(text) and text[i + 1] in marks and text[i + 2] in digits:
                    end = run(text, i + 2, lambda d, digits=digits: d in digits)
        else:
            end = i + 1
        chunk, i = text[i:end], end
        out += [chunk[k : k + 3] for k in range(0, len(chunk), 3)] if cut and number and len(chunk) > 6 else [chunk]
    return out


def inside(text):
    out, i = [], 0
    word = lambda c: c.isalnum() or c == "_"
    while i < len(text):
        head = next((h for h in ("http://", "https://", "www.") if text.startswith(h, i)), None)
        if head:
            end = i + len(head)
        elif word(text[i]):
            end = run(text, i, word)
        elif text[i].isspace():
            end = run(text, i, str.isspace)
        else:
            end = run(text, i, lambda c: not word(c) and not c.isspace())
        out.append(text[i:end])
        i = end
    return out


def long_string(s):
    head = s[:3] if s[:3] in ('"""', "'''") else s[:2] if s[0] == "f" else s[0]
    tail = head if len(head) == 3 else head[-1]
    body = s[len(head) : len(s) - len(tail)]
    return [s] if len(body) <= 30 else [head, *inside(body), tail]


def brute(text, version, compat=False):
    out, at = [], 0
    for a, b, comment in spans(text, compat):
        if at < a:
            out += plain(text[at:a], version == 2)
        if version == 1:
            out.append(text[a:b])
        elif comment:
            body = text[a + 1 : b].strip()
            out += [text[a:b]] if len(body) <= 20 else ["#", " ", *plain(body, True)]
        else:
            out += long_string(text[a:b])
        at = b
    return [c for c in [*out, *plain(text[at:], version == 2)] if c]


PIECES = ['"', "'", '"""', "'''", "f", "#", "\n", "\\", " ", "\t", "\x1c", "name_1", "x", "0x1F", "0b12", "0x", "12345678", "3.14", "7.", "٣٤", "é", "ß1", "**=", "//", "->", "...", ">=", "!", "(", "http://", "https://www.", "a longer text of several words in it", "# a comment that is longer than twenty", "　"]


def test_chunks_equal_the_scanner():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        for compat in (False, True):
            assert C.chunks(text, compat) == brute(text, 1, compat), repr(text)
            assert C.hybrid_chunks(text, compat) == brute(text, 2, compat), repr(text)


@pytest.mark.parametrize("name, version, compat", [("code_pretok_v1", 1, False), ("code_pretok_v1_compat", 1, True), ("code_pretok_v2", 2, False)])
def test_queries_equal_the_scanner(spark, data, name, version, compat):
    found = {r.doc_id: r.c for r in R.QUERIES[name](spark, data).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk"))).alias("c")).collect()}
    for r in R.docs(spark, data, "doc_id", "text").collect():
        assert [x.chunk for x in found.get(r.doc_id, [])] == brute(r.text, version, compat)


def test_unicode_forms_equal_the_library(spark, data):
    found = {r.doc_id: r for r in R.QUERIES["nfkc"](spark, data).collect()}
    for r in R.docs(spark, data, "doc_id", "text").collect():
        for form in ("NFKC", "NFKD", "NFD"):
            assert found[r.doc_id][form.lower()] == unicodedata.normalize(form, r.text)
