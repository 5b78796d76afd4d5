import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillspark.llm import katz as K
from quillspark.llm import katzorder as O

WORDS = "red green blue white black grey pink gold teal plum".split()


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        out = [rng.choice(WORDS)]
        for _ in range(rng.randint(0, 40)):
            k = WORDS.index(out[-1].split("x")[0])
            out.append(WORDS[(k + rng.choice([1, 1, 1, 2, 5])) % 10] if rng.random() > 0.1 else f"{rng.choice(WORDS)}x{rng.randint(0, 60)}")
        rows.append((i, " ".join(out)))
    return rows


class Brute:
    def __init__(self, texts, min_count=K.MIN_COUNT):
        self.one, self.two, self.hist = Counter(), Counter(), Counter()
        for t in texts:
            before = None
            for w in t.split():
                self.one[w] += 1
                self.two[before, w] += 1
                self.hist[before] += 1
                before = w
        nr = lambda c: [sum(x == r for x in c.values()) for r in range(1, K.K + 2)]
        self.d1, self.d2 = K.discounts(nr(self.one)), K.discounts(nr(self.two))
        self.n, self.min_count = sum(self.one.values()), min_count
        self.freed = 1 - sum(self.cut(c, self.d1) for c in self.one.values()) / self.n

    @staticmethod
    def cut(c, d):
        return c * d[c - 1] if c <= len(d) else float(c)

    def p1(self, w):
        return self.cut(self.one[w], self.d1) / self.n if w in self.one else self.freed

    def history(self, h):
        stored = {w: self.cut(c, self.d2) for (g, w), c in self.two.items() if g == h and c >= self.min_count}
        total = self.hist[h]
        bottom = total + 0.5 if total - sum(stored.values()) < 1e-9 else total
        bow = (1 - sum(stored.values()) / bottom) / (1 - sum(self.p1(w) for w in stored)) if total else 1.0
        return {w: c / bottom for w, c in stored.items()}, bow

    def p2(self, h, w):
        stored, bow = self.history(h)
        return stored[w] if w in stored else bow * self.p1(w)

    def score(self, text):
        words = text.split()
        return sum(math.log(self.p2(h, w)) for h, w in zip([None, *words], words))


@pytest.mark.parametrize("hot", [10**9, 40])
def test_scores_match_brute_force_and_sum_to_one(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    brute = Brute([t for _, t in rows])
    model, answered, spread = K.train(docs, size=300, hot_least=hot)
    assert spread.buckets > 3 and model.d1 == brute.d1 and (len(model.hot.ids) > 3) == (hot == 40)
    own = {r.doc_id: r for r in K.score_own(model, answered, spread).collect()}
    assert all(own[i].logprob == pytest.approx(brute.score(t), abs=2e-3) and own[i].n_tokens == len(t.split()) for i, t in rows)
    for h in [None, *list(brute.one)[:8], "never"]:
        assert sum(brute.p2(h, w) for w in brute.one) + brute.history(h)[1] * brute.freed == pytest.approx(1)
    words = {r.id: r.word for r in model.unigrams().collect()}
    table = {(words.get(r.u), words.get(r.w)): r.logp for r in model.bigrams().filter("w IS NOT NULL").collect()}
    assert len(table) == sum(c >= K.MIN_COUNT for c in brute.two.values())
    assert all(math.exp(v) == pytest.approx(brute.p2(h, w)) for (h, w), v in table.items())


class BruteOrder:
    """Katz of any order over texts, by recursion."""

    def __init__(self, texts, order):
        self.order, self.counts, self.hist = order, [Counter() for _ in range(order)], [Counter() for _ in range(order)]
        for t in texts:
            words = [""] * (order - 1) + t.split()
            for i in range(order - 1, len(words)):
                for k in range(1, order + 1):
                    self.counts[k - 1][tuple(words[i - k + 1 : i + 1])] += 1
                    self.hist[k - 1][tuple(words[i - k + 1 : i])] += 1
        self.d = [K.discounts([sum(x == r for x in c.values()) for r in range(1, K.K + 2)]) for c in self.counts]
        self.total = sum(self.counts[0].values())
        self.freed = 1 - sum(Brute.cut(c, self.d[0]) for c in self.counts[0].values()) / self.total
        self.memo = {}

    def p(self, gram):
        k = len(gram)
        if k == 1:
            return Brute.cut(self.counts[0][gram], self.d[0]) / self.total if gram in self.counts[0] else self.freed
        if gram[:-1] not in self.memo:
            h = gram[:-1]
            kept = {g: Brute.cut(c, self.d[k - 1]) for g, c in self.counts[k - 1].items() if g[:-1] == h}
            seen = self.hist[k - 1][h]
            bottom = seen + 0.5 if seen - sum(kept.values()) < 1e-9 else seen
            bow = (1 - sum(kept.values()) / bottom) / (1 - sum(self.p(g[1:]) for g in kept)) if seen else 1.0
            self.memo[h] = {g: c / bottom for g, c in kept.items()}, bow
        stored, bow = self.memo[gram[:-1]]
        return stored[gram] if gram in stored else bow * self.p(gram[1:])

    def score(self, text):
        words = [""] * (self.order - 1) + text.split()
        return sum(math.log(self.p(tuple(words[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(words)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_any_order_matches_brute_force_and_sums_to_one(spark, order):
    rows = corpus()
    brute = BruteOrder([t for _, t in rows], order)
    tables = O.train(spark.createDataFrame(rows, "doc_id bigint, text string"), order)
    assert tables.discounts == brute.d
    for k, table in enumerate(tables.tables):
        found = {tuple(r.gram): r.logp for r in table.collect()}
        assert found.keys() == brute.counts[k].keys() and all(math.exp(x) == pytest.approx(brute.p(g)) for g, x in found.items())
    words = [w for (w,) in brute.counts[0]]
    for h in [("",) * (order - 1), *[g[:-1] for g in list(brute.counts[-1])[:6]], ("never",) * (order - 1)]:
        assert sum(brute.p((*h, w)) for w in [*words, "unseen"]) == pytest.approx(1)
    others = [(1000, "red green never blue"), (1001, "never never"), (1002, "pink"), (1002, "pink"), (None, rows[0][1]), (1003, None), (1004, "")]
    held = O.score(spark.createDataFrame(others, "doc_id bigint, text string").selectExpr("*", "1 AS gram", "2 AS n_tokens"), tables).collect()
    truth = sorted((repr(i), len((t or "").split()), brute.score(t or "")) for i, t in others)
    mine = sorted((repr(r.doc_id), r.n_tokens, r.logprob) for r in held)
    assert [r[:2] for r in mine] == [r[:2] for r in truth] and [r[2] for r in mine] == pytest.approx([r[2] for r in truth], abs=1e-3)
    assert all((r.perplexity is None) == (not r.n_tokens) for r in held)
    with pytest.raises(ValueError):
        O.train(spark.createDataFrame(rows, "doc_id bigint, text string"), 0)


def test_no_text_at_all(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    tables = O.train(none, 2)
    assert O.score(none, tables).count() == 0
    assert [(r.n_tokens, r.logprob) for r in O.score(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), tables).collect()] == [(2, 0.0)]


def left_out(texts, i):
    """The model of the other texts' bigrams over the unigrams of all, no bigram dropped."""
    model, others = Brute(texts, 1), Brute(texts[:i] + texts[i + 1 :], 1)
    model.two, model.hist, model.d2 = others.two, others.hist, others.d2
    return model


@pytest.mark.parametrize("hot", [10**9, 40])
def test_all_bigrams_count_and_no_text_predicts_itself(spark, hot, monkeypatch):
    monkeypatch.setattr(K, "SCORED", 100)
    texts = [t for _, t in corpus()] + ["one two three four five one two"]
    rows = list(enumerate(texts))
    model, answered, spread = K.train(spark.createDataFrame(rows, "doc_id bigint, text string"), size=300, hot_least=hot)
    assert model.bigrams().filter("n = 1").count() == sum(c == 1 for c in Brute(texts, 1).two.values()) > 50
    own = {r.doc_id: r.logprob for r in K.score_own(model, answered, spread, leave_out=True).collect()}
    assert all(own[i] == pytest.approx(left_out(texts, i).score(t), abs=2e-3) for i, t in rows)
    alone = left_out(texts, len(texts) - 1)
    assert own[len(texts) - 1] == pytest.approx(math.log(alone.p2(None, "one")) + sum(math.log(alone.p1(w)) for w in texts[-1].split()[1:]), abs=2e-3)


@pytest.mark.parametrize("tasks", [10_000, 2])
def test_the_query_leaves_each_document_out(spark, monkeypatch, tasks):
    monkeypatch.setattr(K, "MOST_TASKS", tasks)
    rows = corpus(40)
    texts = [t for _, t in rows]
    out = {r.doc_id: r.logprob for r in K.train_and_score(spark.createDataFrame(rows, "doc_id bigint, text string"), size=300).collect()}
    assert all(out[i] == pytest.approx(left_out(texts, i).score(t), abs=2e-3) for i, t in rows)


def test_sql_gives_the_same_scores(spark):
    rows = [*corpus(40), (100, None), (101, ""), (102, "red red red red red red red")]
    out = {r.doc_id: (r.n_tokens, r.logprob) for r in K.train_and_score(spark.createDataFrame(rows, "doc_id bigint, text string"), size=300).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    told = {r[0]: r[1:3] for r in con.execute(K.oracle()).fetchall()}
    assert told.keys() == out.keys() and all(told[i][0] == n and told[i][1] == pytest.approx(x, abs=2e-4) for i, (n, x) in out.items())


def test_slices_grow_with_the_root_of_the_corpus(spark):
    docs = spark.createDataFrame([(1, "word " * 1000)], "doc_id bigint, text string")
    assert K.slice_size(docs) == K.SLICE
    assert K.slice_size(docs.selectExpr("doc_id", "repeat(text, 20000) AS text")) == K.SLICE
    for chars in (10**12, 10**14):
        slices = chars / 6 / max(K.SLICE, 12 * math.sqrt(chars / 6))
        assert slices**2 <= chars / 6 / 144 * 1.01


def test_discounts_fall_back_where_counts_of_counts_are_empty():
    assert K.discounts([0] * 6) == [0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9]
    good = K.discounts([1000, 400, 220, 140, 100, 75])
    assert all(0 < x < 1 for x in good)
    freed = sum(r * (1 - d) * n for r, (d, n) in enumerate(zip(good, [1000, 400, 220, 140, 100]), 1))
    assert freed == pytest.approx(1000)


def test_packing():
    for values in ([], [0], [1, 255, 256], [2**32 - 1, 5]):
        assert K.unpack(K.pack(np.array(values, np.int64))).tolist() == values


def test_cases(spark):
    rows = [(1, "red red", 1), (1, "red red", 1), (None, "blue", 1), (2, None, 1), (3, "", 1), (4, "... !", 1), (5, "red " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    out = K.train_and_score(docs, size=500).collect()
    assert len(out) == len(rows)
    assert sorted(r.n_tokens for r in out) == [0, 0, 0, 1, 2, 2, 5000]
    assert all(r.perplexity is None and r.logprob == 0 for r in out if not r.n_tokens)
    assert K.train_and_score(docs.limit(0)).count() == 0
