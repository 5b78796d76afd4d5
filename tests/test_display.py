import pytest

from quillspark.model import Model
from quillspark.operators import display as D


def test_styles():
    tokens = ["▁def", "=", "x1", "12", "<0xE2>"]
    assert D.inline(tokens) == "▁def | = | x1 | 12 | <0xE2>\n5 tokens"
    lines = D.show("def = x1", tokens, "table").split("\n")
    assert lines[1] == "1\t▁def\t6\tkeyword" and lines[-1] == "5 tokens, 8 characters, 62.50%" and [x.split("\t")[3] for x in lines[1:-1]] == ["keyword", "operator", "identifier", "literal", "other"]
    assert "\x1b[31m[=]" in D.show("", tokens, "colored") and D.table("", []).endswith("0 tokens, 0 characters, -")
    assert D.named([0, 7, "b"], Model(("a",), ())) == ["a", "<7>", "b"]
    with pytest.raises(KeyError):
        D.show("", [], "x")
