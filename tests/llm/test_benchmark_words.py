"""Benchmark passages in any script, against a normaliser and a search written out here."""

import random

import pytest

from quillspark.llm import decontamination as D


def words(text):
    """Runs of letters, digits and underscore, each character lowered alone."""
    out, run = [], ""
    for c in text + " ":
        if c.isalnum() or c == "_":
            run += {"Σ": "σ", "İ": "i"}.get(c, c.lower())
        elif run:
            out.append(run)
            run = ""
    return out


def grams(text, n):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


PASSAGES = [
    "a b c d İstanbul e f g h",
    "Ο ΚΟΣΜΟΣ ΕΙΝΑΙ ΜΕΓΑΛΟΣ ΚΑΙ Ο ΣΟΦΟΣ ΔΑΣΟΣ ΦΩΣ",
    "ο κόσμος είναι μεγάλος και ο σοφός δάσος φως",
    "STRAẞE und Straße und GROẞ ist nicht das Gleiche wie groß",
    "café résumé naïve éclair pièce bête hôte",
    "ﬁne ½ ² Ⅷ ⅷ ǅ ǆ Ǆ ß word another one here",
    "Привет МИР это ПРОСТО длинный ТЕКСТ для ПРОВЕРКИ слов",
    "你好 世界 这 是 一 个 测试 文本 的 词",
]


@pytest.mark.parametrize("max_grams", [2_000_000, 5])
def test_verbatim_copies_are_found_in_any_script(spark, max_grams):
    rng = random.Random(3)
    docs, d = [], 0
    for p in PASSAGES:
        for text in (p, p + " İ", "Σ " + p, p.lower(), p.upper(), f"İ ẞ {p} Σ. " + "filler words " * 30, p.replace(" ", ", ")):
            docs.append((d, text))
            d += 1
    for _ in range(40):
        own = [w for p in rng.sample(PASSAGES, 3) for w in p.split()]
        rng.shuffle(own)
        docs.append((d, " ".join(own)))
        d += 1
    items = list(enumerate(PASSAGES)) + [(90, None), (91, ""), (92, "short")]
    known = {}
    for i, p in items:
        for g in grams(p or "", D.N):
            known.setdefault(g, set()).add(i)
    truth = {i: set().union(*(known[g] for g in grams(t, D.N) & known.keys())) for i, t in docs}
    truth = {i: named for i, named in truth.items() if named}
    rows = D.find(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), max_grams=max_grams).collect()
    assert {r.doc_id: set(map(int, r["items"].split(","))) for r in rows} == truth
    assert all(7 * k in truth and 7 * k + 1 in truth for k in range(len(PASSAGES)))


def test_very_long_texts_null_ids_and_ties(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, passage), (1, "filler " * 400_000 + passage), (2, ""), (3, passage), (3, passage)], "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "'x' AS action", "2 AS item_id")
    bench = spark.createDataFrame([(7, passage), (5, passage), (None, passage)], "item_id bigint, text string").selectExpr("*", "'x' AS gram")
    rows = D.find(docs, bench).collect()
    assert sorted((repr(r.doc_id), r.action, r["items"]) for r in rows) == [("1", "cut", "5,7"), ("3", "drop", "5,7"), ("3", "drop", "5,7"), ("None", "drop", "5,7")]
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(len(r.text) for r in kept.collect()) == [0, 7 * 400_000]
