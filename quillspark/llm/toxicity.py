"""Operator 5: toxicity by noisy-channel deobfuscation.

A classifier is fitted on a bounded sample of labelled documents (at most SAMPLE of each
label, taken by hash of doc_id): sequential covering picks whole words, word beginnings and
beginnings shared by several different words that mark toxic documents and no others, each
with the posterior share of toxic documents that hold it. A character trigram model counts the words of all documents. Tokens that look
disguised (digits or signs for letters, single letters or signs set apart by whatever else, letters repeated) become
lattices of possible letters, decoded by Viterbi under that model; the lexicon scores the
restored words together with the ordinary ones. A document's score is the noisy-or of its
distinct units.

Results by case. Null or empty text, or no labels: score 0, not toxic. Empty documents: empty
result. Very long texts: whole, in batches cut by characters. Ties between units that mark as
many documents: the longer, then the later in order; between readings of a token: the lesser. Null doc_id: carried. Several labels of one
document: toxic if any says so. Null labels don't count. Repeated rows: one result each.
Extra columns: ignored by detect, kept by keep_clean.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, lowered, pieces

SAMPLE = 6_000
THRESHOLD = 0.8
PURITY = 0.95
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
KEYS, MARKS = (re.escape("".join(c for c in LEET if not c.isalnum() or digits)) for digits in (True, False))
SIGNS = re.compile(f"[{KEYS}]")
DISGUISED = re.compile(rf"[^\W\d_]*[{KEYS}](?:[^\W_]|[{MARKS}])*")
#: Letters, digits and signs one by one, between them anything else.
SPACED = re.compile(rf"(?<!\w)(?:(?:[^\W_]|[{MARKS}])(?:[^\w{MARKS}]|_)++){{2,}}(?:[^\W_]|[{MARKS}])(?!\w)")
REPEATED = re.compile(r"([^\W\d_])\1\1")
EDGE_RUN = re.compile(r"^([@$|+!])\1{2,}|([@$|+!])\2{2,}$|!+$")
OTHER = "\x7f"
MIN_LETTERS = 3


class Letters:
    """Interpolated character trigram model."""

    def __init__(self, grams: dict[str, float]):
        three, two, one = Counter(), Counter(), Counter()
        for g, n in grams.items():
            three[g] += n
            two[g[1:]] += n
            one[g[2]] += n
        pairs: Counter = Counter()
        for g, n in three.items():
            pairs[g[:2]] += n
        singles: Counter = Counter()
        for g, n in two.items():
            singles[g[0]] += n
        self.three, self.two, self.one, self.pairs, self.singles = dict(three), dict(two), dict(one), dict(pairs), dict(singles)
        self.total, self.kinds = sum(one.values()) + 1.0, len(one) + 2
        self.memo: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        """Negative log probability of the third character after the first two."""
        c = self.memo.get(gram)
        if c is None:
            p = 0.001 * (self.one.get(gram[2], 0) + 1) / (self.total + self.kinds)
            p += 0.199 * self.two.get(gram[1:], 0) / (self.singles.get(gram[1], 0) or 1)
            p += 0.8 * self.three.get(gram, 0) / (self.pairs.get(gram[:2], 0) or 1)
            c = self.memo[gram] = -math.log(p)
        return c


def known(c: str) -> str:
    """Letters of the Latin blocks are themselves, all others one class, so the model's size doesn't follow the corpus."""
    return c if c.isalpha() and c < "ɐ" else OTHER


def word_grams(words: dict[str, int]) -> Counter:
    """Character trigrams of words between marks of their ends."""
    out: Counter = Counter()
    for w, n in words.items():
        s = "  " + "".join(map(known, w)) + " "
        for i in range(len(s) - 2):
            out[s[i : i + 3]] += n
    return out


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Options of each place: what may have been meant, and the channel's cost."""
    out, i = [], 0
    while i < len(token):
        c, j = token[i], i
        apart = not c.isalnum() and c not in LEET
        while j < len(token) and (token[j] == c or apart and not token[j].isalnum() and token[j] not in LEET):
            j += 1
        run = j - i
        if c.isalpha():
            out.append([(c, 0.0 if run == 1 else 3.0 if run == 2 else 1.0)] + ([(c * 2, 0.0 if run == 2 else 1.2)] if run > 1 else []))
        elif c in LEET:
            read = [(x * k, 1.0 + 0.2 * (run > 1)) for x in LEET[c] for k in ((1, 2) if run > 1 else (1,))]
            out.append([*read, ("" if c == "!" else OTHER, 2.5)])
        elif apart:
            out.append([("", 0.3), (" ", 1.5 if run == 1 else 0.5)])
        else:
            out.append([(OTHER, 0.0)])
        i = j
    return out


def restore(token: str, model: Letters) -> str:
    """The likeliest reading of a lattice: Viterbi over pairs of last characters."""
    best: dict[str, tuple[float, str]] = {"  ": (0.0, "")}
    for options in [*lattice(token), [(" ", 0.0)]]:
        after: dict[str, tuple[float, str]] = {}
        for state, (cost, text) in best.items():
            for letters, extra in options:
                s, total = state, cost + extra
                for c in letters:
                    k = c if c == " " else known(c)
                    total += model.cost(s + k)
                    s = "  " if k == " " else s[1] + k
                if s not in after or total < after[s][0]:
                    after[s] = (total, text + letters)
        best = after
    return min(best.values())[1].strip()


def undo(token: str, model: Letters, memo: dict[str, str]) -> str:
    """restore, remembered by token."""
    found = memo.get(token)
    if found is None:
        if len(memo) > 200_000:
            memo.clear()
        found = memo[token] = restore(token, model)
    return found


def disguised(low: str) -> set[str]:
    """Tokens that may hide a word."""
    out: set[str] = set()
    if SIGNS.search(low):
        for m in DISGUISED.finditer(low):
            token = EDGE_RUN.sub("", m[0])
            if sum(c.isalpha() for c in token) and len(token) >= MIN_LETTERS and not token.isalpha():
                out.add(token)
    for m in SPACED.finditer(low):
        if len(set(m[0])) > 3:
            out.add(m[0])
    end = 0
    for m in REPEATED.finditer(low):
        if m.start() >= end:
            a, end = m.start(), m.end()
            while a and low[a - 1].isalnum():
                a -= 1
            while end < len(low) and low[end].isalnum():
                end += 1
            out.add(low[a:end])
    return out


PREFIXES, TIMES = (4, 5, 6), (2, 3, 4)


def beginnings(words: set[str], k: int) -> Counter:
    """How many of the words begin with each k characters and go on."""
    return Counter(w[:k] for w in words if len(w) > k)


def units(words: set[str]) -> set[str]:
    """Lexicon units that words show: themselves, their beginnings marked by a hyphen, and beginnings of several different words with their number (at least)."""
    out = set(words)
    for k in PREFIXES:
        for start, n in beginnings(words, k).items():
            out.add(f"{start}-")
            out.update(f"{start}-{t}" for t in TIMES if n >= t)
    return out


FADE = 0.4


def cover(toxic: list[set[str]], clean: Iterator[set[str]]) -> dict[str, float]:
    """Sequential covering: again and again the pure unit that marks most of the toxic documents, where each unit taken leaves a document FADE of its weight, until the best could be an accident."""
    where: dict[str, set[int]] = {}
    for i, s in enumerate(toxic):
        for u in s:
            where.setdefault(u, set()).add(i)
    where = {u: d for u, d in where.items() if len(d) >= 3}
    against, n_clean = Counter(), 0
    for s in clean:
        n_clean += 1
        against.update(u for u in s if u in where)
    base = len(toxic) / max(1, len(toxic) + n_clean)
    posterior = {u: (len(d) + 0.5) / (len(d) + against[u] + 1) for u, d in where.items()}
    least = math.log(1e-4 / max(1, len(where))) / math.log(min(max(base, 1e-9), 0.9))
    where = {u: d for u, d in where.items() if (posterior[u] >= PURITY or not against[u]) and len(d) >= least}
    weight, out = [1.0] * len(toxic), {}
    while where:
        worth = {u: sum(weight[i] for i in d) for u, d in where.items()}
        u = max(where, key=lambda u: (round(worth[u], 6), len(u), u))
        if worth[u] < least:
            break
        out[u] = posterior[u]
        for i in where.pop(u):
            weight[i] *= FADE
        where = {v: d for v, d in where.items() if worth[v] >= least}
    return out


def copies(text: str, seen: set[int]) -> bool:
    """Whether a text shares one of its four least word-pair hashes with an earlier one, as near copies do; then it would count twice."""
    words = WORD.findall(lowered(text))
    least = sorted({zlib.crc32(f"{a} {b}".encode("utf-8", "replace")) for a, b in zip(words, [*words[1:], ""])})[:4]
    known_ = any(x in seen for x in least)
    seen.update(least)
    return known_


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Units of the lexicon and their posteriors, from at most sample labelled documents of each label."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("qs_toxic"))
    chosen = [marks.filter(t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in ("qs_toxic", "NOT qs_toxic")]
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").select("text", "qs_toxic", "doc_id")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, seen = [], [], set()
        for batch, rows in pieces(batches):
            for text, bad in zip(rows, batch.column(1).to_pylist()):
                if not bad:
                    clean.append(text)
                elif not copies(text, seen):
                    toxic.append(units(set(WORD.findall(lowered(text)))))
        found = cover(toxic, (units(set(WORD.findall(lowered(t)))) for t in clean))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], names=["unit", "posterior"])

    return {r["unit"]: r["posterior"] for r in texts.repartition(1).sortWithinPartitions("doc_id", "text").mapInArrow(train, "unit string, posterior double").collect()}


def letter_model(docs: DataFrame) -> dict[str, int]:
    """Character trigrams of the words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        words: Counter = Counter()
        for _, texts in pieces(batches, chars=4_000_000):
            words.update(WORD.findall("\n".join(t for t in texts if t).lower()))
            if len(words) > 400_000:
                total.update(word_grams(words))
                words.clear()
        total.update(word_grams(words))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    return {r["gram"]: r["n"] for r in docs.select("text").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()}


class Scorer:
    def __init__(self, lexicon: dict[str, float], grams: dict[str, int]):
        self.lexicon = lexicon
        self.words = {u for u in lexicon if "-" not in u}
        self.starts: dict[int, dict[str, list[int]]] = {k: {} for k in PREFIXES}
        for start, _, times in (u.partition("-") for u in lexicon if "-" in u):
            self.starts[len(start)].setdefault(start, []).append(int(times or 1))
        share = sum(grams.values()) * 0.02 / max(1, len(lexicon))
        both: Counter = Counter(grams)
        for u in lexicon:  # those who disguise a word more often mean one of the lexicon than the corpus does
            both.update({g: int(share) + 1 for g in word_grams({u.partition("-")[0]: 1}) if not ("-" in u and g.endswith(" "))})
        self.model = Letters(both)
        self.memo: dict[str, str] = {}

    def found(self, words: set[str]) -> set[str]:
        out = words & self.words
        for k, starts in self.starts.items():
            if starts:
                for start, n in Counter(w[:k] for w in words if len(w) > k and w[:k] in starts).items():
                    out.update(f"{start}-{t if t > 1 else ''}" for t in starts[start] if n >= t)
        return out

    def score(self, text: str) -> tuple[float, set[str], set[str]]:
        """Noisy-or of the units, the units, and those that only restoring showed."""
        low = lowered(text)
        words = set(WORD.findall(low))
        plain = self.found(words)
        restored = {w for token in disguised(low) for w in undo(token, self.model, self.memo).split(" ")}
        every = self.found(words | restored) if restored - words else plain
        miss = 1.0
        for u in every:
            miss *= 1 - self.lexicon[u]
        return 1 - miss, every, every - plain


def _scorer(docs: DataFrame, labels: DataFrame, sample: int):
    lexicon = fit(docs, labels, sample)
    grams = letter_model(docs) if lexicon else {}
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, grams))
    kept: list[Scorer] = []

    def get() -> Scorer:
        if not kept:
            kept.append(Scorer(*shared.value))
        return kept[0]

    return get


def detect(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Toxic documents: score, the units found, and how many of them were disguised."""
    get = _scorer(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = get()
        for batch, texts in pieces(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                score, units_, hidden = scorer.score(text) if text else (0.0, set(), set())
                if score >= threshold:
                    rows.append((doc_id, round(score, 6), " ".join(sorted(units_)), len(hidden)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, (pa.int64(), pa.float64(), pa.string(), pa.int32()))], names=["doc_id", "score", "units", "n_restored"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, units string, n_restored int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs without those that detect would report; all columns stay."""
    get = _scorer(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = get()
        for batch, texts in pieces(batches):
            yield batch.filter(pa.array([not t or scorer.score(t)[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
