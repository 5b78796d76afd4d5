"""Operator 2: HTML main text by gradient-boosted trees over DOM nodes.

A page is cut into tags and texts in one linear pass and made a tree (void elements, raw
text elements, implied ends of p, li, table cells). Every element gets features of its
subtree: text, link and punctuation density, tags, depth, place among siblings and what they
hold, and hashed tokens of its class, id and role. Boosted trees give each the probability of
holding main text. A tree of labels is then decoded as a whole: an element below a dropped one is
dropped, and of all labellings that obey this the likeliest, weighted by text, is taken.

The trees are fitted here, on at most SAMPLE pages (taken by hash of page_id). A page's own
markup labels it: text in article or main is main text, text in nav, footer, aside or an
advertisement isn't. These names (is_label) are no features: as tags they count as any other
section, as tokens of class, id or role they are left out, so pages without them are read by the rest. Pages
without article or main teach nothing.

Results by case. Null html: null text, no nodes. Empty html, or no text: empty text. No page
to learn from: all rendered text is kept. Very long or broken pages: unclosed tags and
endless nesting cost linear time. Repeated rows: one result each. Null page_id: carried.
Extra columns: ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import lowered, pieces

SAMPLE = 400
TREES, DEPTH, BINS, RATE, RIDGE = 60, 3, 32, 0.2, 1.0
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|([^<]+|<)", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))", re.I)
PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title noscript template iframe noembed noframes svg math object select option textarea button xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul br".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div dl footer form header html main nav ol section table td th ul blockquote".split())
KINDS = [{"p"}, {"div", "section", "article", "main", "nav", "aside", "footer", "header"}, {"li", "dd", "dt"}, {"a"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "table", "tr", "td", "tbody"}, {"pre", "blockquote", "code"}]
HASHED = 64
GOOD, BAD = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "menu"))
#: Names that label, and roles that say the same; they are no features.
ROLES = frozenset("main navigation banner contentinfo complementary content article".split())
MARK = re.compile(r"^(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|cookie\w*)$")


def is_label(token: str) -> bool:
    return token in GOOD or token in BAD or token in ROLES or MARK.match(token) is not None


class Page:
    """Elements in document order (parents before children) and texts with the element they stand in."""

    __slots__ = ("parent", "tag", "tokens", "texts", "unseen")

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.unseen = [-1], ["#root"], [()], [False]
        self.texts: list[tuple[int, str]] = []
        stack, opened, low, at, n = [0], {}, None, 0, len(source)

        def close(down_to: int) -> None:
            while len(stack) > down_to:
                opened[self.tag[stack.pop()]] -= 1

        while at < n:
            m = TOKEN.match(source, at)
            at = m.end()
            end, name, attributes, text = m.groups()
            if text is not None:
                self.texts.append((stack[-1], text))
                continue
            if not name:
                continue
            name = name.lower()
            if end:
                if opened.get(name):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    close(k)
                continue
            shut = CLOSES.get(name, ()) if name in CLOSES else {"p"} if name in BLOCKS and name != "br" else ()
            if any(opened.get(s) for s in shut):
                k = len(stack) - 1
                while k and self.tag[stack[k]] not in shut and self.tag[stack[k]] not in SCOPE - shut:
                    k -= 1
                if k and self.tag[stack[k]] in shut:
                    close(k)
            tokens = tuple(p for a in NAMED.finditer(attributes) for p in PART.findall((a[1] or a[2] or a[3] or "").lower())) if attributes else ()
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.tokens.append(tokens)
            self.unseen.append(self.unseen[stack[-1]] or name in UNSEEN)
            if name == "br":
                self.texts.append((stack[-1], "\n"))
            if name in VOID or attributes.endswith("/"):
                continue
            if name in RAW:
                low = low if low is not None else lowered(source)
                stop = low.find(f"</{name}", at)
                at = n if stop < 0 else stop
            stack.append(len(self.tag) - 1)
            opened[name] = opened.get(name, 0) + 1


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, parent (-1 for roots), depth and own characters of the elements of all pages, one page after another."""
    sizes = np.array([len(p.tag) for p in pages], np.int64)
    first = np.cumsum(sizes) - sizes
    parent = np.concatenate([np.array(p.parent, np.int64) + np.where(np.array(p.parent) < 0, 0, f) for p, f in zip(pages, first)])
    n, tags = len(parent), [t for p in pages for t in p.tag]
    own = np.zeros((n, 5))  # characters, words, signs, link characters, elements
    own[:, 4] = 1
    start = np.zeros(n)
    for p, f in zip(pages, first.tolist()):
        for node, text in p.texts:
            if not p.unseen[node]:
                w = text.split()
                k = sum(map(len, w))
                own[f + node, 0] += k
                own[f + node, 1] += len(w)
                own[f + node, 2] += text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count(";")
        start[f : f + len(p.tag)] = np.arange(len(p.tag)) / len(p.tag)
    link = np.array([t == "a" for t in tags])
    depth = np.zeros(n, np.int64)
    for i in range(n):  # parents come first
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
            link[i] |= link[parent[i]]
    own[link, 3] = own[link, 0]
    total = own.copy()
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        if depth[level[0]] > 0:
            np.add.at(total, parent[level], total[level])
    up = np.where(parent < 0, np.arange(n), parent)
    kids = np.bincount(up, minlength=n) - (parent < 0)
    rank = np.zeros(n)
    seen: dict[int, int] = {}
    same: dict[tuple[int, str], int] = {}
    for i, u in enumerate(up.tolist()):
        if u != i:  # a root is its own parent here
            rank[i] = seen.get(u, 0)
            seen[u] = int(rank[i]) + 1
        same[u, tags[i]] = same.get((u, tags[i]), 0) + 1
    twins = np.array([same[u, t] for u, t in zip(up.tolist(), tags)], float)
    page = np.repeat(first, sizes)
    with np.errstate(divide="ignore", invalid="ignore"):
        density = lambda a, b: np.where(b > 0, a / np.maximum(b, 1e-9), 0.0)
        x = [np.log1p(total[:, 0]), np.log1p(total[:, 1]), density(total[:, 0], total[:, 4]), density(total[:, 3], total[:, 0]), density(total[:, 2], total[:, 1]), density(total[:, 0], total[:, 1]), np.log1p(total[:, 4]), np.log1p(own[:, 0]), depth.astype(float), kids.astype(float), rank, density(rank, kids[up]), twins]
        x += [density(total[:, 0], total[up, 0]), density(total[up, 3], total[up, 0]), density(total[up, 0], total[up, 4]), density(total[:, 0], total[page, 0]), start, density(total[up, 0] - total[:, 0], np.maximum(kids[up] - 1, 0))]
    flags = np.zeros((n, len(KINDS) + HASHED))
    kinds = {t: k for k, group in enumerate(KINDS) for t in group}
    tokens = [t for p in pages for t in p.tokens]
    hashed: dict[str, int] = {}
    for i, t in enumerate(tags):
        if t in kinds:
            flags[i, kinds[t]] = 1
        for w in tokens[i]:
            if w not in hashed:
                hashed[w] = -1 if is_label(w) else len(KINDS) + zlib.crc32(w.encode()) % HASHED
            if hashed[w] >= 0:
                flags[i, hashed[w]] = 1
    return np.column_stack([*x, flags]), parent, depth, own[:, 0]


class Trees:
    """Boosted complete trees of fixed depth for log odds."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
        share = float(np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4))
        base, inner = float(np.log(share / (1 - share))), (1 << DEPTH) - 1
        score, feature, cut, leaf = np.full(len(y), base), [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            node, fs, cs = np.zeros(len(y), np.int64), [0] * inner, [np.inf] * inner
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                best = (1e-9, 0, np.inf, 0)
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if len(rows) and len(e):
                        gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                        gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                        j = int(np.argmax(gain))
                        if gain[j] > best[0]:
                            best = (float(gain[j]), f, float(e[j]), j)
                fs[k], cs[k] = best[1], best[2]
                right = binned[rows, best[1]] > best[3] if best[2] < np.inf else np.zeros(len(rows), bool)
                node[rows] = 2 * k + 1 + right
            values = [RATE * g[node == k].sum() / (h[node == k].sum() + RIDGE) for k in range(inner, 2 * inner + 1)]
            score += np.array(values)[node - inner]
            feature.append(fs)
            cut.append(cs)
            leaf.append(values)
        return cls(base, np.array(feature), np.array(cut), np.array(leaf))

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def dump(self) -> str:
        return json.dumps([self.base, self.feature.tolist(), np.minimum(self.cut, 1e300).tolist(), self.leaf.tolist()])

    @classmethod
    def load(cls, text: str) -> Trees:
        base, feature, cut, leaf = json.loads(text)
        return cls(base, np.array(feature), np.array(cut), np.array(leaf))


def taught(page: Page) -> np.ndarray | None:
    """1 for elements that hold main text by the page's own markup; None where it has no article or main."""
    n = len(page.tag)
    if not GOOD.intersection(page.tag):
        return None
    inside, label = [False] * n, np.zeros(n)
    for i in range(1, n):
        bad = page.tag[i] in BAD or any(MARK.match(t) for t in page.tokens[i])
        inside[i] = not bad and (page.tag[i] in GOOD or inside[page.parent[i]])
    for node, text in page.texts:
        if inside[node] and not text.isspace():
            label[node] = 1
    for i in range(n - 1, 0, -1):
        if label[i]:
            label[page.parent[i]] = 1
    return label


def decode(odds: np.ndarray, parent: np.ndarray, depth: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The likeliest labels in which nothing is kept below a dropped element."""
    keep, drop = -weight * np.logaddexp(0, -odds), -weight * np.logaddexp(0, odds)
    order = np.argsort(-depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
    for level in levels:
        if depth[level[0]] > 0:
            np.add.at(keep, parent[level], np.maximum(keep[level], drop[level]))
            np.add.at(drop, parent[level], drop[level])
    kept = keep > drop
    for level in reversed(levels):
        if depth[level[0]] > 0:
            kept[level] &= kept[parent[level]]
    return kept


def weights(x: np.ndarray) -> np.ndarray:
    """What an element's label weighs: the root of its subtree's words."""
    return np.sqrt(np.expm1(x[:, 1]))


def fit(pages: DataFrame, sample: int = SAMPLE) -> str:
    """Trees, as text, from at most sample pages that label themselves; empty where none does."""
    chosen = pages.filter("html IS NOT NULL").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()
    texts = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id").select("page_id", "html")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, labels = [], []
        for _, rows in pieces(batches, "html"):
            for page in map(Page, filter(None, rows)):
                if (own := taught(page)) is not None:
                    found.append(page)
                    labels.append(own)
        text = ""
        if found:
            x, _, _, _ = features(found)
            w, y = weights(x), np.concatenate(labels)
            if (w > 0).any():
                text = Trees.fit(x[w > 0], y[w > 0], np.sqrt(w[w > 0])).dump()
        yield pa.RecordBatch.from_arrays([pa.array([text])], names=["model"])

    return "".join(r["model"] for r in texts.repartition(1).sortWithinPartitions("page_id", "html").select("html").mapInArrow(train, "model string").collect())


def render(page: Page, kept: np.ndarray) -> str:
    """Texts of kept elements, blocks on lines of their own."""
    out, before = [], 0
    block = [t in BLOCKS for t in page.tag]
    home = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        home[i] = i if block[i] else home[page.parent[i]]
    for node, text in page.texts:
        if kept[node] and not page.unseen[node]:
            out.append(("\n" if home[node] != before else "") + entities.unescape(text))
            before = home[node]
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def extract_texts(sources: list[str | None], trees: Trees | None) -> list[tuple[str | None, int, int]]:
    """Text, elements and kept elements of each page."""
    pages = [Page(s) for s in sources if s]
    results = iter(())
    if pages:
        x, parent, depth, _ = features(pages)
        kept = decode(trees.odds(x), parent, depth, weights(x)) if trees else np.ones(len(parent), bool)
        bounds = np.cumsum([0, *(len(p.tag) for p in pages)])
        parts = [kept[a:b] for a, b in zip(bounds, bounds[1:])]
        results = iter([(render(p, k), len(p.tag) - 1, int(k[1:].sum())) for p, k in zip(pages, parts)])
    return [next(results) if s else (s, 0, 0) for s in sources]


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, text, n_nodes and n_kept for every row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, sample))
    loaded: list[Trees | None] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not loaded:
            loaded.append(Trees.load(shared.value) if shared.value else None)
        for batch, sources in pieces(batches, "html", 600_000):
            rows = extract_texts(sources, loaded[0])
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32())))], names=["page_id", "text", "n_nodes", "n_kept"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id bigint, text string, n_nodes int, n_kept int")
