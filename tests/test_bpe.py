import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions.normalize import NormalizerConfig, normalize_text
from quillspark.functions.pretokenize import pretokenize_text
from quillspark.model import BYTE_TOKENS, Model, SpecialTokens, byte_tokens_of, corpus_hash, model_hash, model_info
from quillspark.operators.encode import Encoder, count_tokens, decode, decode_ids, encode, encode_distinct, encode_ids, join_bytes, merged, readable, register
from quillspark.operators.learner import Learner
from quillspark.operators.training import split_by_order, train_bpe, train_bpe_fast, train_fair_bpe

LINES = ["hello world hello", "low lower lowest low", "newer wider newer", "the quick brown fox", "the lazy dog and the fox", "abab abab aaaa", "café résumé naïve", ""]


def texts_of(spark, lines=LINES):
    return spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id bigint, text string")


def brute_train(lines, merges, config, start=list, ties="first", limit=16, spacer="▁"):
    """Training by full recount."""
    words = Counter()
    for line in lines:
        for chunk in pretokenize_text(line, config.chunking):
            if word := normalize_text(chunk, config):
                words[tuple(start(word))] += 1
    out = []
    for _ in range(merges):
        pairs = Counter()
        for w, n in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += n
        pairs = {p: n for p, n in pairs.items() if (limit is None or len(p[0] + p[1]) <= limit) and not (spacer and spacer in (p[0] + p[1])[1:])}
        if not pairs:
            break
        top = max(pairs.values())
        best = min((p for p in pairs if pairs[p] == top)) if ties == "lex" else next(p for p in pairs if pairs[p] == top)
        out.append(best)
        new = Counter()
        for w, n in words.items():
            t, i = [], 0
            while i < len(w):
                if w[i : i + 2] == best:
                    t.append(w[i] + w[i + 1])
                    i += 2
                else:
                    t.append(w[i])
                    i += 1
            new[tuple(t)] += n
        words = new
    return out


@pytest.mark.parametrize("config", [NormalizerConfig(), NormalizerConfig(chunking="gpt2"), NormalizerConfig("NONE", "NONE", chunking="whitespace")])
def test_training_equals_a_full_recount(spark, config):
    model = train_bpe(texts_of(spark), n_merges=40, normalizer=config)
    assert list(model.merges) == brute_train(LINES, 40, config)


def test_distributed_training_gives_the_same_merges(spark):
    config = NormalizerConfig(chunking="GPT2")
    one, other = (train_bpe(texts_of(spark), n_merges=6, normalizer=config, strategy=s) for s in ("task", "distributed"))
    assert one == other


@pytest.mark.parametrize("fallback", [True, False])
def test_distributed_byte_and_fair_training_give_the_same(spark, fallback):
    config = NormalizerConfig(chunking="GPT2")
    one, other = (train_bpe_fast(texts_of(spark), n_merges=5, normalizer=config, byte_fallback=fallback, strategy=s) for s in ("task", "distributed"))
    assert one == other and len(one.merges) == 5
    rows = [("de", i, t) for i, t in enumerate(LINES)] + [("en", i, t[::-1] + " aaaa") for i, t in enumerate(LINES)] + [("en", 99, "")]
    texts = spark.createDataFrame(rows, "lang string, doc_id bigint, text string")
    for weight in (0.0, 0.7):
        one, other = (train_fair_bpe(texts, fairness_weight=weight, n_merges=5, normalizer=config, byte_fallback=fallback, strategy=s) for s in ("task", "distributed"))
        assert one == other and len(one.model.merges) == 5
    with pytest.raises(ValueError):
        train_bpe(texts_of(spark), n_merges=1, strategy="none")


def test_runs_of_one_token_merge_from_the_left():
    for n in range(1, 9):
        learner = Learner.of([(0, ["a"] * n, 3), (0, ["b", "a", "a", "a", "b"], 1)])
        learner.merge(("a", "a"))
        left = [learner.names[t] for t in learner.token[learner.token >= 0]]
        assert left == ["aa"] * (n // 2) + ["a"] * (n % 2) + ["b", "aa", "a", "b"]
        assert learner.tokens[0] == 3 * (n - n // 2) + 4


def test_progress_is_told(capsys):
    learner = Learner.of([(0, list("abcabd"), 2)])
    learner.run(3, 1)
    told = capsys.readouterr().err
    assert told.count("of 3 merges") == 3 and "3 merges learned" in told


def test_byte_training(spark):
    config = NormalizerConfig(chunking="GPT2")
    model = train_bpe_fast(texts_of(spark), 256 + 25, normalizer=config)
    assert list(model.merges) == brute_train(LINES, 25, config, lambda w: [t for c in w for t in byte_tokens_of(c)], "lex", None, None)
    assert model.tokens[:256] == BYTE_TOKENS
    encoder = Encoder(model)
    assert encoder.decode(encoder.encode("café 你")) == denormal("café 你", config)
    plain = train_bpe_fast(texts_of(spark), n_merges=5, normalizer=config, byte_fallback=False)
    assert list(plain.merges) == brute_train(LINES, 5, config, list, "lex", None, None)


def denormal(text, config):
    from quillspark.functions.normalize import denormalize_text

    return denormalize_text("".join(normalize_text(c, config) for c in pretokenize_text(text, config.chunking)), config)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=8), st.integers(1, 4)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(1, 12))
def test_learner_equals_a_full_recount(words, merges):
    lines = [w for w, n in words for _ in range(n)]
    order = list(dict.fromkeys(lines))
    counts = Counter(lines)
    found = Learner.of([(0, list(w), counts[w]) for w in order], max_length=5, spacer=None).run(merges)
    assert found == brute_train(lines, merges, NormalizerConfig("NONE", "NONE"), limit=5, spacer=None)


def test_sizes_specials_and_padding(spark):
    model = train_bpe(texts_of(spark), 60, special=True)
    assert len(model) == 64 and model.special_ids() == {"pad": 0, "unk": 1, "bos": 2, "eos": 3}
    tiny = train_bpe(texts_of(spark, ["ab"]), 10)
    assert len(tiny) == 10 and tiny.tokens[-1] == "<unused_9>" and tiny.kind("<unused_9>") == "unused"
    odd = train_bpe(texts_of(spark, ["<unused_12>"]), 40, normalizer=NormalizerConfig("NONE", "NONE"))
    assert len(odd) == 40
    with pytest.raises(ValueError):
        train_bpe(texts_of(spark))
    empty = train_bpe(texts_of(spark, [None, ""]).filter("doc_id > 5"), 3)
    assert empty.tokens == ("<unused_0>", "<unused_1>", "<unused_2>")


def brute_fair(by_lang, merges, weight, config):
    words = {x: Counter() for x in by_lang}
    for x, lines in by_lang.items():
        for line in lines:
            for chunk in pretokenize_text(line, config.chunking):
                words[x][tuple(t for c in normalize_text(chunk, config) for t in byte_tokens_of(c))] += 1
    out = []
    for _ in range(merges):
        fertility = {x: sum(len(w) * n for w, n in c.items()) / sum(c.values()) for x, c in words.items()}
        pairs = {}
        for x, c in words.items():
            for w, n in c.items():
                for p in zip(w, w[1:]):
                    pairs.setdefault(p, Counter())[x] += n
        if not pairs:
            break

        def score(p):
            total = 0.0
            for x in words:
                total += pairs[p][x] * fertility[x] ** weight
            return total if weight else sum(pairs[p].values())

        best = max(pairs, key=score)
        out.append(best)
        for x, c in words.items():
            new = Counter()
            for w, n in c.items():
                t, i = [], 0
                while i < len(w):
                    step = 2 if w[i : i + 2] == best else 1
                    t.append("".join(w[i : i + step]))
                    i += step
                new[tuple(t)] += n
            words[x] = new
    return out


@pytest.mark.parametrize("weight", [0, 0.3, 1])
def test_fair_training(spark, weight):
    by_lang = {"en": LINES[:5], "fr": ["café résumé naïve café", "élève été", ""], "de": ["straße größe über", "über allen"]}
    rows = [(x, i, t) for x, lines in by_lang.items() for i, t in enumerate(lines)] + [(None, 9, "x"), ("zz", 9, None)]
    texts = spark.createDataFrame(rows, "lang string, doc_id bigint, text string")
    config = NormalizerConfig(chunking="GPT2")
    result = train_fair_bpe(texts, n_merges=25, fairness_weight=weight, languages=list(by_lang), normalizer=config)
    assert list(result.model.merges) == brute_fair(by_lang, 25, weight, config)
    assert result.fertility_gap() >= 0 and sum(x["target_ratio"] for x in result.languages) == pytest.approx(1)
    for bad in ({"fairness_weight": 1.5}, {"languages": ["xx"]}):
        with pytest.raises(ValueError):
            train_fair_bpe(texts, 300, **bad)
    with pytest.raises(ValueError):
        train_fair_bpe(texts.limit(0), 300)


def naive_merge(tokens, ranks):
    tokens = list(tokens)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in ranks), default=None)
        if best is None:
            return tokens
        i = best[1]
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=30), st.lists(st.tuples(st.sampled_from(["a", "b", "c", "ab", "bc", "abc", "aa"]), st.sampled_from(["a", "b", "c", "ab", "bc", "ca", "aa"])), max_size=8, unique=True))
def test_merging_is_greedy(text, merges):
    ranks = {m: i for i, m in enumerate(merges)}
    assert merged(list(text), ranks) == naive_merge(text, ranks)
    model = Model(tuple("abc"), tuple(merges), NormalizerConfig("NONE", "NONE"))
    steps = list(Encoder(model).explain(text))
    if text:
        assert steps[-1][5] == naive_merge(text, ranks) and all(len(a[5]) == len(b[5]) + 1 for a, b in zip(steps, steps[1:]))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40).filter(lambda t: "<" not in t and "▁" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_decoding_gives_the_text_back(text):
    config = NormalizerConfig("NONE", "NONE")
    encoder = Encoder(Model(tuple("abc "), (("a", "b"),), config))
    assert encoder.decode(encoder.encode(text)) == text


def test_bytes_and_specials():
    assert join_bytes(byte_tokens_of("你")) == "你" and join_bytes(["<0xE4><0xBD>", "<0xA0>", "x"]) == "你x"
    assert join_bytes(["a", "<0xFF>", "<0xFE>", "b"]) == "a??b" and join_bytes(["<0xZZ>"]) == "<0xZZ>"
    assert readable("a<0xC3><0xA9>b<0xFF>") == "aéb"
    model = Model(tuple("<BOS>helo "), (), NormalizerConfig("NONE", "NONE"), special=SpecialTokens())
    encoder = Encoder(model)
    assert encoder.encode("x<BOS>h<EOS>") == [*byte_tokens_of("x"), "<BOS>", "h", "<EOS>"]
    assert encoder.encode("<BOS>") == list("<BOS>") and Encoder(model, strict_specials=True).encode("<BOS>") == ["<BOS>"]
    assert encoder.decode(["<BOS>", "h", "e", "<EOS>"]) == "he"
    assert len(model.with_byte_tokens()) == len(model) + 256 and model.token_id("zz") is None and model.token(10**6) is None and "h" in model


def test_columns(spark):
    model = train_bpe(texts_of(spark), n_merges=30, normalizer=NormalizerConfig(chunking="GPT2"))
    texts = texts_of(spark, [*LINES, None, "zebra 你"])
    encoder = Encoder(model)
    rows = texts.select("doc_id", "text", encode(F.col("text"), model).alias("t"), count_tokens(F.col("text"), model).alias("n"), encode_ids(F.col("text"), model).alias("ids")).withColumn("back", decode(F.col("t"), model)).withColumn("back_ids", decode_ids(F.col("ids"), model)).collect()
    for r in rows:
        assert r.t == encoder.encode(r.text) and r.n == (None if r.text is None else len(r.t)) and r.back == encoder.decode(r.t)
        assert r.ids == (None if r.text is None else [model.token_id(t) for t in r.t])
        if r.text in LINES:
            assert r.back_ids == r.back
    same = {r.doc_id: r.tokens for r in encode_distinct(texts, model).collect()}
    assert same == {r.doc_id: r.t for r in rows}
    register(spark, model)
    texts.createOrReplaceTempView("some_texts")
    one = spark.sql("SELECT bpe_count_tokens(text) AS n, bpe_decode(bpe_encode(text)) AS back FROM some_texts WHERE doc_id = 0").first()
    assert (one.n, one.back) == (rows[0].n, rows[0].back)
    steps = spark.sql("SELECT * FROM bpe_explain('hello world')").collect()
    assert [t for c in (0, 1) for t in [s for s in steps if s.chunk == c][-1].tokens] == encoder.encode("hello world")


def test_files(spark, tmp_path):
    model = train_bpe(texts_of(spark), 50, special=True)
    path = tmp_path / "déep" / "model.json"
    model.save(path, {"note": "x"})
    assert Model.load(path) == model and path.read_bytes().isascii()
    data = json.loads(path.read_text())
    assert data["model_hash"] == model_hash(data) == model_info(path)["model_hash"] and model_info(path)["vocab_size"] == 54
    with pytest.warns(UserWarning):
        Model.from_dict(data | {"model_hash": "0", "other": 1})
    with pytest.raises(ValueError):
        Model.from_dict(data | {"algorithm": "x"})
    assert model.vocab_table(spark).count() == 54 and model.merge_table(spark).count() == len(model.merges)
    assert corpus_hash(spark, str(path)) != "unknown" and corpus_hash(spark, str(tmp_path / "none")) == "unknown"


def test_split_by_order(spark):
    rows = spark.createDataFrame([(i,) for i in range(103)], "doc_id bigint").repartition(5)
    parts = {r.doc_id: r.part for r in split_by_order(rows).collect()}
    assert all((parts[i] == "train") == (i < 82) for i in range(103))
