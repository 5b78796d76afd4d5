"""Counting, learning and encoding in bounded memory, and queries from counted words, against their SQL on odd rows."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quillspark.functions.normalize import normalize_text
from quillspark.functions.pretokenize import pretokenize_text
from quillspark.operators import encode as E
from quillspark.operators import learner as L
from quillspark.operators import training as T
from quillspark.plans import registry as R
from tests.test_queries import rows


def odd_rows():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 15))) for _ in range(60)]
    out = [(i * 7 % 61, R.LANGS[i % 4], t) for i, t in enumerate(texts)]
    return out + [(100 + i, "en", "") for i in range(40)] + [(200, "de", ""), (201, "fr", None)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    duckdb = pytest.importorskip("duckdb")
    d = str(tmp_path_factory.mktemp("counted"))
    spark.createDataFrame(odd_rows(), "doc_id bigint, lang string, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    return d, con


@pytest.mark.parametrize("name", ["fair_language_stats", "fairness_sweep"])
def test_empty_texts_count_as_in_the_sql(spark, corpus, name):
    d, con = corpus
    assert rows(R.QUERIES[name](spark, d).toPandas()) == rows(con.execute(R.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["token_class", "top_tokens", "token_stats", "vocab_utilization", "fertility_by_lang", "coverage_by_lang", "encode_tokens", "encode_ids", "sinks_roundtrip"])
def test_pooled_and_encoded_queries_equal_their_sql(spark, corpus, name):
    d, con = corpus
    assert rows(R.QUERIES[name](spark, d).toPandas()) == rows(con.execute(R.ORACLE_SQL[name]).df())


def test_counts_that_are_passed_on_early(spark, monkeypatch):
    monkeypatch.setattr(T, "COUNTED", 10)
    monkeypatch.setattr(T, "ROWS", 3)
    data = [*odd_rows(), (None, "en", "only null ids"), (None, None, "aa b aa")]
    texts = spark.createDataFrame(data, "doc_id bigint, lang string, text string")
    found = {(r.lang, r.word): (r.n, tuple(r["first"])) for r in T.word_counts(texts, R.CONFIG, ["lang"], keep_empty=True).collect()}
    n, first = Counter(), {}
    for doc, lang, text in data:
        for pos, c in enumerate(pretokenize_text(text, "GPT2") if text is not None else []):
            key, at = (lang, normalize_text(c, R.CONFIG)), (doc is None, doc, pos)
            n[key] += 1
            first[key] = min(first.get(key, at), at, key=lambda x: (x[0], x[1] or 0, x[2]))
    assert found == {k: (n[k], first[k]) for k in n}


def test_learner_in_files_and_blocks(monkeypatch, tmp_path):
    rng = random.Random(1)
    words = [(k, [rng.choice("abcd") for _ in range(rng.randint(0, 12))], rng.randint(1, 4)) for k in range(2) for _ in range(60)]
    plain = L.Learner.of(words, 2, fairness=0.3)
    expected = plain.run(80)
    for name, value in (("BLOCK", 7), ("POOL", 16), ("TOP", 3), ("FILE_BYTES", 1)):
        monkeypatch.setattr(L, name, value)
    filed = L.Learner.of(words, 2, fairness=0.3, folder=str(tmp_path))
    assert filed.run(80) == expected and filed.tokens.tolist() == plain.tokens.tolist()
    long = [filed.token, filed.span, filed.freq, filed.lang, *filed.pools]
    assert all(isinstance(x.base, np.memmap) for x in long) and not list(tmp_path.iterdir())


def test_learner_holds_little_for_each_place():
    words = [(0, list("abcdefgh" * 3), 1)] * 20_000
    learner = L.Learner.of(words)
    held = sum(x.nbytes for x in (learner.token, learner.span, learner.freq, *learner.pools))
    assert held < 20 * len(learner.token)


def test_tokens_of_a_batch_are_cut(monkeypatch):
    monkeypatch.setattr(E, "CHARS", 10)
    texts = pd.Series(["abc", None, "x" * 30, "", "abcdef", "abcdef", "z"], dtype=object)
    cut = [list(p) for p in E.parts(texts)]
    assert cut == [["abc", None, "x" * 30], ["", "abcdef", "abcdef"], ["z"]]
