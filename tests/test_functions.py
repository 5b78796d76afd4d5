import re
import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import codechunks as C
from quillspark.functions.normalize import NormalizerConfig, denormalize, denormalize_text, normalize, normalize_text
from quillspark.functions.pretokenize import hybrid_code_pretokenize, pretokenize, pretokenize_text, simple_code_tokens
from quillspark.functions.whitespace import WS25, WS29, strip, word_count

TEXTS = ["", " ", "Hello world", "  two  spaces ", "I don't know", "They're going", "Hello 你好 world", "Cost: $12.50!", "é é ﬁ ①②③", "a b c\u0085d", "x\x1cy\x1f z", "line\n\n next\t tab", "नमस्ते दुनिया", "🌍é", "▁mark", "İstanbul ΣΑΣ ẞ", "it'S 've 'RE"]


def column(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_whitespace_classes_are_those_of_python():
    every = [chr(c) for c in range(0x3100)]
    assert {c for c in every if regex.fullmatch(r"\s", c)} == set(WS25)
    assert {c for c in every if c.isspace()} == set(WS29)


def test_words_and_strip(spark):
    for text, (n, s) in zip(TEXTS, column(spark, TEXTS, word_count(F.col("text")), strip(F.col("text")))):
        assert n == len(text.split()) and s == text.strip()
    assert column(spark, [None], word_count(F.col("text"))) == [(None,)]


@pytest.mark.parametrize("form", ["NONE", "NFC", "NFD", "NFKC", "NFKD"])
@pytest.mark.parametrize("spacer", ["PREFIX", "SUFFIX", "ISOLATED", "NONE"])
def test_normalising_native_and_by_string(spark, form, spacer):
    config = NormalizerConfig(form, spacer, lowercase=form == "NFD")
    normal = normalize(F.col("text"), config)
    rows = column(spark, [*TEXTS, None], normal, denormalize(normal, config))
    assert rows[-1] == (None, None)
    for text, (there, back) in zip(TEXTS, rows):
        assert there == normalize_text(text, config), repr(text)
        assert back == denormalize_text(there, config)
        plain = text if form == "NONE" else unicodedata.normalize(form, text)
        plain = plain.lower() if config.lowercase else plain
        if spacer == "PREFIX":
            assert there == ("" if not text else "▁" + regex.sub(r"\s+", "▁", plain))
        if spacer == "SUFFIX":
            assert there == regex.sub(r"(\S+)", r"\1▁", plain)


def test_names_are_read_in_any_case():
    assert NormalizerConfig("nfc", "separator", chunking="python") == NormalizerConfig("NFC", "ISOLATED", chunking="CODE")
    assert NormalizerConfig(chunking="whatever").chunking == "NONE"
    for bad in ({"form": "x"}, {"spacer": "x"}):
        with pytest.raises(ValueError):
            NormalizerConfig(**bad)
    config = NormalizerConfig("NFD", "SUFFIX", True, "gpt2")
    assert NormalizerConfig.from_dict(config.to_dict()) == config
    assert NormalizerConfig.from_dict({"normalization": "nfc", "pre_tokenization": "gpt2"}) == NormalizerConfig("NFC", chunking="GPT2")


@pytest.mark.parametrize("chunking", ["NONE", "WHITESPACE", "GPT2", "CODE"])
def test_chunks_native_and_by_string(spark, chunking):
    rows = column(spark, [*TEXTS, None], pretokenize(F.col("text"), chunking))
    assert rows[-1] == (None,)
    for text, (chunks,) in zip(TEXTS, rows):
        assert chunks == pretokenize_text(text, chunking), repr(text)
        assert "".join(chunks) == text


def test_gpt2_chunks():
    assert pretokenize_text("I don't  know", "GPT2") == ["I", " don", "'t", " ", " know"]
    assert pretokenize_text("", "GPT2") == [""] and pretokenize_text("", "NONE") == []


def test_code_chunks():
    assert C.chunks('url = "https://api.example.com/v1"') == ["url", " ", "=", " ", '"https://api.example.com/v1"']
    assert C.chunks("if x >= 100 and y <= 0x1F:") == ["if", " ", "x", " ", ">=", " ", "100", " ", "and", " ", "y", " ", "<=", " ", "0x1F", ":"]
    assert C.chunks("x = 5  # note\ny") == ["x", " ", "=", " ", "5", "  ", "# note", "\n", "y"]
    assert C.chunks('"a # b" c') == ['"a # b"', " ", "c"]
    assert C.chunks('"a # b" c', compat=True) == ['"a # b"', '# b" c']
    assert C.chunks("a //= 2 ** 3.5") == ["a", " ", "//=", " ", "2", " ", "**", " ", "3.5"]
    long = '"' + "see https://www.x.org/a-b and more words" + '"'
    assert C.hybrid_chunks(long)[:4] == ['"', "see", " ", "https://"] and "".join(C.hybrid_chunks(long)) == long
    assert C.hybrid_chunks("n = 12345678") == ["n", " ", "=", " ", "123", "456", "78"]
    assert C.hybrid_chunks("#   a comment of many words") == ["#", " ", "a", " ", "comment", " ", "of", " ", "many", " ", "words"]
    assert C.hybrid_chunks("# short") == ["# short"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1.=>/*#'\"\\ \n_f", max_size=40))
def test_code_chunks_lose_nothing(text):
    assert "".join(C.chunks(text)) == text


def test_code_columns(spark):
    assert column(spark, ["a>=1", None, ""], hybrid_code_pretokenize(F.col("text"))) == [(["a", ">=", "1"],), (None,), ([],)]
    pattern = re.compile(r"&&|\|\||<<|>>|//|=>|->|[-+!=<>]=|[A-Za-z_][0-9A-Za-z_]*|\d+\.?\d*|\"[^\"]*\"|'[^']*'|\S")
    for text, (tokens,) in zip(TEXTS, column(spark, TEXTS, simple_code_tokens(F.col("text")))):
        assert tokens == pattern.findall(text)
