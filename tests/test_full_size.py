"""The queries at a full vocabulary size against brute force on a small fixture, which they merge to the end."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.normalize import normalize_text
from quillspark.functions.pretokenize import pretokenize_text
from quillspark.model import byte_tokens_of
from quillspark.plans import registry as R
from tests.test_bpe import brute_fair, brute_train


def lines(seed, n=24):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 9))) for _ in range(25)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(k * 100 + i, lang, t) for k, lang in enumerate(R.LANGS) for i, t in enumerate(lines(k))]
    d = str(tmp_path_factory.mktemp("full"))
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{d}/documents.parquet")
    return d, rows


def merges(spark, d, name):
    return [(r["left"], r["right"]) for r in R.QUERIES[name](spark, d).orderBy("rank").collect()]


def test_training_goes_on_to_the_size(spark, corpus):
    d, rows = corpus
    texts = [t for *_, t in rows]
    std = merges(spark, d, "train_merges_std_full")
    assert len(std) > 10 * R.MERGES and std == brute_train(texts, R.VOCAB, R.CONFIG)
    assert R.QUERIES["train_vocab_std_full"](spark, d).count() == R.VOCAB
    pieces = lambda w: [t for c in w for t in byte_tokens_of(c)]
    assert merges(spark, d, "train_merges_bytes_lex_full") == brute_train(texts, R.VOCAB, R.CONFIG, pieces, "lex", None, None)


def test_fair_training_goes_on_to_the_size(spark, corpus):
    d, rows = corpus
    by_lang = {x: [t for _, lang, t in rows if lang == x] for x in R.LANGS}
    for name, weight in (("train_merges_fair_full", R.WEIGHT), ("train_merges_fair_0_full", 0)):
        found = merges(spark, d, name)
        assert len(found) > 10 * R.FAIR_MERGES and found == brute_fair(by_lang, R.VOCAB, weight, R.CONFIG)
    assert R.QUERIES["fairness_sweep_full"](spark, d).count() == 4 * len(R.LANGS)


def test_encoding_uses_the_full_model(spark, corpus):
    d, rows = corpus
    ranked = brute_train([t for *_, t in rows], R.VOCAB, R.CONFIG)

    def tokens(text):
        out = []
        for chunk in pretokenize_text(text, R.CONFIG.chunking):
            t = list(normalize_text(chunk, R.CONFIG))
            for a, b in ranked:
                i = 0
                while i + 1 < len(t):
                    t[i : i + 2] = [a + b] if t[i : i + 2] == [a, b] else t[i : i + 2]
                    i += 1
            out += t
        return out

    found = R.QUERIES["encode_tokens_full"](spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x")).collect()
    assert {r.doc_id: [x.token for x in r.x] for r in found} == {i: tokens(t) for i, _, t in rows}
