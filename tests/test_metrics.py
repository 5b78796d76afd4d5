import math
import statistics

import numpy as np
import pytest

from quillspark.functions.normalize import NormalizerConfig
from quillspark.operators import metrics as M
from quillspark.operators.training import train_bpe


def one(df):
    return df.first().asDict()


ROWS = [(1, "en", "def f ( x )", ["▁def", "▁f", "▁(", "▁x", "▁)"]), (2, "en", "a >= b", ["a", ">=", "<0xE2>"]), (3, "de", "", []), (4, "de", "größe über", ["▁größe", "▁ü", "ber"])]


def encoded(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, lang string, text string, tokens array<string>")


def test_pooled_reports(spark):
    by = {r.lang: r for r in M.corpus_report(encoded(spark)).collect()}
    assert (by["en"].n_tokens, by["en"].n_words, by["en"].n_chars) == (8, 8, 17) and by["de"].fertility == 1.5
    cover = {r.lang: r for r in M.coverage(encoded(spark)).collect()}
    assert cover["en"].fallback_rate == 1 / 8 and cover["en"].char_coverage == pytest.approx((3 + 1 + 1 + 1 + 1 + 1 + 2) / 17) and cover["de"].avg_token_length == pytest.approx(9 / 3)
    nulls = encoded(spark, [(1, None, None, None), (2, None, "", [])])
    assert one(M.corpus_report(nulls))["fertility"] == 0.0 and one(M.coverage(nulls))["fallback_rate"] == 0.0
    assert M.corpus_report(encoded(spark).limit(0)).count() == 0


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 8.0], [3.0], [2.0, 2.0], [0.0, 0.0], [0.0, 5.0]])
def test_fairness(spark, values):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "lang string, fertility double")
    s, x = one(M.fairness_summary(df)), np.sort(values)
    n, total = len(x), x.sum()
    gini = 0.0 if n <= 1 or not total else 2 * (np.arange(1, n + 1) * x).sum() / (n * total) - (n + 1) / n
    assert s["gini"] == pytest.approx(gini) and s["std"] == pytest.approx(np.std(x)) and s["median"] == np.median(x)
    assert s["max_min_ratio"] == (x[-1] / x[0] if x[0] > 0 else math.inf)
    assert {r.verdict for r in M.fairness_report(df).collect()} == {"FAIR" if gini < 0.2 else "BIASED"}
    assert one(M.spread(df, ["fertility"]))["variance"] == pytest.approx(np.var(x))


def test_empty_summary(spark):
    s = one(M.fairness_summary(spark.createDataFrame([], "lang string, fertility double")))
    assert s["gini"] == 0.0 and s["mean"] is None


def test_relative_cost_and_gap(spark):
    df = spark.createDataFrame([("en", 1.0, 10), ("de", 2.0, 30)], "lang string, fertility double, n_tokens bigint")
    assert {r.lang: (r.fertility_ratio, r.token_ratio) for r in M.relative_cost(df).collect()} == {"en": (1, 1), "de": (2, 3)}
    assert one(M.fairness_gap(df)) == {"fairness_ratio": 0.5, "efficiency_gap": 2.0, "fertility_gap": 1.0}


def test_entropy_and_information(spark):
    df = encoded(spark, [(1, "a", "aabb", ["aa", "bb"]), (2, "b", "cccc", ["cccc"])])
    assert {r.lang: r.char_entropy for r in M.char_entropy(df).collect()} == {"a": 1.0, "b": 0.0}
    assert {r.lang: r.info_per_token for r in M.info_per_token(df).collect()} == {"a": 0.5, "b": 0.0}


def test_tokens(spark):
    df = encoded(spark)
    tokens = [t for r in ROWS for t in r[3]]
    sizes = [len(t.encode()) for t in tokens]
    s = one(M.token_stats(df))
    assert (s["total_tokens"], s["unique_tokens"], s["max_bytes"]) == (len(tokens), len(set(tokens)), max(sizes)) and s["avg_bytes"] == pytest.approx(statistics.mean(sizes)) and s["median_bytes"] == statistics.median(sizes)
    assert M.token_stats(df.limit(0)).count() == 0
    assert [r.token for r in M.top_tokens(df, 3).collect()] == ["▁def", "▁f", "▁("]
    assert one(M.operator_preservation(df))["preservation"] == 1.0 and one(M.vocab_utilization(df, 22))["used"] == 11
    assert one(M.presence(df, [">=", "=="])) == {"n_present": 1, "rate": 0.5}
    k = one(M.keyword_preservation(df))
    assert (k["as_tokens"], k["as_words"], k["constant_rate"], k["rate"]) == (1, 1, 1.0, 1.0)
    assert one(M.vocab_size_estimate(df))["vocab_size"] == 300
    kinds = {"▁def": "keyword", ">=": "operator", "(": "operator", '"x"': "literal", "12": "literal", "▁größe": "identifier", "ab1": "identifier", "1a": "other", "<0xE2>": "other"}
    rows = spark.createDataFrame([(t,) for t in kinds], "t string")
    assert {r.t: r.k for r in rows.select("t", M.token_class(rows["t"]).alias("k")).collect()} == kinds


def test_neighbours(spark):
    df = spark.createDataFrame([(1, list("abab")), (2, ["a"]), (3, []), (4, None)], "doc_id bigint, tokens array<string>")
    pmi = {(r.left, r.right): r.pmi for r in M.pmi(df).collect()}
    assert pmi["a", "b"] == pytest.approx(math.log2(2 / 3 / (3 / 5 * 2 / 5)))
    b = {r.token: (r.right_entropy, r.left_entropy) for r in M.branching_entropy(df).collect()}
    assert b["a"] == (0.0, 0.0)
    assert [(r.token, r.n) for r in M.ngram_top(df, 2).collect()] == [("a||b", 2), ("b||a", 1)]
    assert [(r.token, r.n) for r in M.ngram_top(df, 1, 1).collect()] == [("a", 3)]


def test_comparisons(spark):
    a = spark.createDataFrame([(1, 10, 40), (2, 20, 60)], "doc_id bigint, n_tokens bigint, n_chars bigint")
    b = spark.createDataFrame([(1, 8), (2, 20)], "doc_id bigint, n_tokens bigint")
    p = one(M.parity(a, b))
    assert p == {"mean_token_diff": 12.5, "max_token_diff": 25.0, "compression_diff": pytest.approx(0.02)}
    runs = spark.createDataFrame([("x", 10, 5, 0.5, 1.0), ("x", 10, 3, 0.3, 3.0), ("y", 10, 2, 0.2, 9.0)], "model string, chars bigint, tokens bigint, compression_ratio double, time_ms_median double")
    s = M.model_summary(runs)
    assert [r.model for r in s.collect()] == ["y", "x"]
    assert {(r.metric, r.winner) for r in M.winners(s, ["mean_compression"], ["mean_ms"]).collect()} == {("mean_compression", "y"), ("mean_ms", "y")}


def test_close_to_another_tokeniser(spark, tmp_path):
    """Compression within a quarter of SentencePiece's BPE at the same size on plain repeated English."""
    spm = pytest.importorskip("sentencepiece")
    from quillspark.operators.encode import Encoder

    lines = ["the quick brown fox jumps over the lazy dog", "a model of language learns from text", "tokens are pieces of words", "people write many words every day", "training data should be clean"] * 40
    source = tmp_path / "lines.txt"
    source.write_text("\n".join(lines))
    spm.SentencePieceTrainer.train(input=str(source), model_prefix=str(tmp_path / "m"), vocab_size=110, model_type="bpe", hard_vocab_limit=False, minloglevel=2)
    theirs = spm.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    texts = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    ours = Encoder(train_bpe(texts, 110, normalizer=NormalizerConfig("NONE", "PREFIX", chunking="NONE")))
    a, b = sum(len(ours.encode(t)) for t in lines), sum(len(theirs.encode(t)) for t in lines)
    assert abs(a - b) / b < 0.25
