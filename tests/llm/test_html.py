import random
import re
from itertools import product

import numpy as np

from quillspark.llm import htmltext as H

PAGE = "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></ul></nav><div class='ad'>Buy now.</div><article><h1>Head &amp; line</h1><p>{body}<p>Second paragraph, with more words in it.<br>third line</article><footer>Copyright.</footer></body></html>"


def test_parsing_follows_implied_ends():
    page = H.Page("<ul><li>a<li>b</ul><p>one<p>two<b>x<div>y</div>")
    tags = page.tag
    li = [i for i, t in enumerate(tags) if t == "li"]
    assert [tags[page.parent[i]] for i in li] == ["ul", "ul"]
    p = [i for i, t in enumerate(tags) if t == "p"]
    assert [tags[page.parent[i]] for i in p] == ["#root", "#root"]
    raw = H.Page("<script>if (a < b) '</p>'</script><p>x")
    assert [t for n, t in raw.texts if raw.tag[n] == "p"] == ["x"]


def test_decoding_is_the_best_consistent_labelling():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 9)
        parent = np.array([-1] + [rng.randint(0, i - 1) for i in range(1, n)])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        odds, weight = np.array([rng.gauss(0, 2) for _ in range(n)]), np.array([rng.random() for _ in range(n)])

        def score(keep):
            return sum(-w * np.logaddexp(0, -o if k else o) for k, o, w in zip(keep, odds, weight))

        best = max((k for k in product([False, True], repeat=n) if all(parent[i] < 0 or not k[i] or k[parent[i]] for i in range(n))), key=score)
        assert np.isclose(score(best), score(H.decode(odds, parent, depth, weight)))


def test_held_out_accuracy_without_the_labelling_names(spark, data):
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect()]
    train, test = pages[:30], pages[30:]
    parsed = [H.Page(p) for p in train]
    labels = [H.taught(p) for p in parsed]
    x, *_ = H.features(parsed)
    w = H.weights(x)
    trees = H.Trees.load(H.Trees.fit(x[w > 0], np.concatenate(labels)[w > 0], np.sqrt(w[w > 0])).dump())
    right = total = 0
    for source in test:
        bare = H.Page(re.sub(r'(class|id|role)="[^"]*"', "", re.sub(r"(</?)(?:article|main|footer|nav|aside)\b", r"\1div", source)))
        assert not any(t in H.GOOD | H.BAD for t in bare.tag) and not any(bare.tokens)
        truth = H.taught(H.Page(source))
        x, parent, depth, own = H.features([bare])
        kept = H.decode(trees.odds(x), parent, depth, H.weights(x))
        right += own[kept == (truth > 0)].sum()
        total += own.sum()
    assert right / total > 0.95


def test_labelling_names_are_no_features():
    def rows(mark):
        return H.features([H.Page(f"<body><div {mark}><p>some words, here</p><a>link</a></div><p class=story>text</p></body>")])[0]

    for mark in ('class="sidebar advert"', 'class="ad"', 'id="nav"', 'role="navigation"', 'role=main', 'class="cookiebar"'):
        assert (rows(mark) == rows("")).all(), mark
    assert (rows('class="teaser"') != rows("")).any()
    same = lambda tag: H.features([H.Page(f"<body><{tag}><p>some words</p></{tag}></body>")])[0]
    assert all((same(t) == same("div")).all() for t in ("article", "main", "nav", "footer", "aside"))


def test_features_match_a_walk_of_the_tree():
    source = "<body><div><p>One, two; <a>three</a> four.</p><ul><li><a>five six</a></li><li>seven</li></ul></div><script>no words</script><p>eight! nine?</p></body>"
    page = H.Page(source)
    x, parent, depth, own = H.features([page])
    n = len(page.tag)
    kids = [[j for j in range(n) if page.parent[j] == i] for i in range(n)]
    under = lambda i: [i, *(k for j in kids[i] for k in under(j))]
    above = lambda i: [] if i < 0 else [i, *above(page.parent[i])]
    for i in range(n):
        texts = [(node, t) for node, t in page.texts if node in under(i) and not page.unseen[node]]
        words = [w for _, t in texts for w in t.split()]
        chars = sum(map(len, words))
        links = sum(len(w) for node, t in texts for w in t.split() if any(page.tag[k] == "a" for k in above(node)))
        signs = sum(t.count(s) for _, t in texts for s in ".,!?;")
        told = [np.log1p(chars), np.log1p(len(words)), chars / len(under(i)), links / chars if chars else 0, signs / len(words) if words else 0, chars / len(words) if words else 0, np.log1p(len(under(i)))]
        assert np.allclose(x[i, :7], told), (page.tag[i], x[i, :7], told)
        assert depth[i] == len(above(i)) - 1 and x[i, 9] == len(kids[i])
        assert x[i, 10] == (kids[page.parent[i]].index(i) if page.parent[i] >= 0 else 0)


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (80, 3)).astype(float)
    y, w = ((x[:, 1] > 2) ^ (rng.random(80) < 0.1)).astype(float), rng.random(80) + 0.1
    trees = H.Trees.fit(x, y, w)
    p = np.average(y, weights=w)
    g, h = w * (y - p), w * p * (1 - p)

    def gain(rows, f, cut):
        left, right = rows & (x[:, f] <= cut), rows & (x[:, f] > cut)
        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + H.RIDGE)
        return part(left) + part(right) - part(rows)

    rows = np.ones(80, bool)
    best = max(gain(rows, f, c) for f in range(3) for c in range(5))
    assert np.isclose(gain(rows, trees.feature[0][0], trees.cut[0][0]), best)

    def walk(v):
        out = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            k = 0
            while k < len(feature):
                k = 2 * k + (2 if v[feature[k]] > cut[k] else 1)
            out += leaf[k - len(feature)]
        return out

    assert np.allclose(trees.odds(x), [walk(v) for v in x]) and ((trees.odds(x) > 0) == (y > 0)).mean() > 0.85
    again = H.Trees.load(trees.dump())
    assert np.allclose(again.odds(x), trees.odds(x))


def test_cases(spark):
    body = "This is the main text of the page, and it goes on for a while; nobody minds. " * 4
    rows = [(i, "http://x", PAGE.format(body=body + str(i)), i) for i in range(40)]
    rows += [(100, None, None, 1), (101, None, "", 1), (None, None, "<p>a", 1), (102, None, "<b>" * 3000 + "deep", 1), (103, None, "<p " * 5000, 1), (0, "http://x", rows[0][2], 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    out = H.extract(pages).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[100].text is None and by[101].text == "" and by[100].n_nodes == 0
    text = by[7].text
    assert "main text" in text and "Head & line" in text and "third line" in text and "Buy now" not in text and "Copyright" not in text and "Home" not in text
    assert H.extract(pages.limit(0)).count() == 0
    unlabelled = spark.createDataFrame([(1, "<p>kept <b>all</b></p><style>x</style>")], "page_id bigint, html string")
    assert H.extract(unlabelled).first().text == "kept all"
