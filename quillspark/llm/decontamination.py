"""Operator 10: benchmark decontamination.

The benchmark's texts are cut to normalised word n-grams (by the function that reads the
documents), which go to the workers as a hash set of bounded size: beyond max_grams the set
is cut by hash and the corpus scanned once for each part. A scan maps words to benchmark word numbers (a word that no n-gram has rules out
every window over it), hashes the windows that are left, looks them up and verifies each hit
word by word. Hits join to spans; a document of which they cover drop_share or more is
dropped, from another the spans are cut, from the first character of the span to its last.

Results by case. Null or empty text, or fewer words than n: no hit. Benchmark items of fewer
than n words have no n-gram and match nothing; empty or null items neither. Passages that
several items share name all of them. Repeated rows: one result row each. Extra columns:
ignored by find, kept by clean. Empty benchmark: nothing is found. Empty documents: empty
result. Null doc_id: scanned and carried like any other. Very long texts: whole; batches are
cut by characters. Ties: none arise, as every hit counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, lowered, pieces, stored, with_text

N = 8
DROP_SHARE = 0.5
#: Of one part of the hash set, which is on the driver and broadcast: n-grams and their characters.
MAX_GRAMS, MAX_CHARS = 2_000_000, 128_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """N-grams as numbers of their words, by hash, with the items that hold them."""

    def __init__(self, rows: list[tuple[list[str], list[int]]], n: int):
        self.n, self.words, self.items = n, {}, {}
        for words, items in rows:
            self.items[tuple(self.words.setdefault(w, len(self.words)) for w in words)] = items
        grams = np.array(list(self.items), np.int64).reshape(-1, n)
        self.keys = np.unique(self.mix([grams[:, k] for k in range(n)]))

    @staticmethod
    def mix(columns: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[int, int, list[int]]]]:
        """Words in each text, and verified hits: text, first word, items."""
        get, numbers, sizes = self.words.get, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                words = normal_words(t)
                sizes[i] = len(words)
                numbers += [get(w, -1) for w in words]
            numbers.append(-1)
        ids, n = np.array(numbers, np.int64), self.n
        if len(ids) < n or not len(self.keys):
            return sizes, []
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        at = np.flatnonzero(known[n:] - known[:-n] == n)
        at = at[np.isin(self.mix([ids[at + k] for k in range(n)]), self.keys)]
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = []
        for p, t in zip(at.tolist(), (np.searchsorted(first, at, "right") - 1).tolist()):
            if items := self.items.get(tuple(ids[p : p + n].tolist())):
                out.append((t, p - int(first[t]), items))
        return sizes, out


def normal_words(text: str | None) -> list[str]:
    """Words as both sides compare them; the place of each is that of the text's own."""
    return WORD.findall(lowered(text)) if text else []


def grams(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct normalised n-grams of the benchmark with the ids of their items."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, chars=200_000):
            owners, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), texts):
                words = normal_words(text)
                own = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
                owners += [i] * len(own)
                found += map(list, own)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["item_id", "gram"])

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(windows, "item_id bigint, gram array<string>")
    return rows.groupBy("gram").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _parts(benchmark: DataFrame, n: int, max_grams: int) -> Iterator[tuple[Grams, int]]:
    """The hash set, in as many parts as its size asks for; one part is on the driver at a time."""
    rows = stored(grams(benchmark, n), "grams")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("gram", " ")) + 8 * F.size("items")).alias("chars")).first()
    cuts = max(1, -(-size["n"] // max_grams), -(-(size["chars"] or 0) // MAX_CHARS))
    part = F.pmod(F.xxhash64("gram"), F.lit(cuts))
    for k in range(cuts):
        yield Grams([(r["gram"], r["items"]) for r in (rows if cuts == 1 else rows.filter(part == k)).collect()], n), cuts


def spans_of(starts: set[int], n: int) -> list[tuple[int, int]]:
    """Word ranges that windows cover, joined where they overlap or touch."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return [(a, b) for a, b in out]


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words."""
    places = [m.span() for m in WORD.finditer(lowered(text))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def _found(g: Grams, texts: list[str | None]) -> dict[int, tuple[int, set[int], set[int]]]:
    """By number of the text: its words, where hits begin, and their items."""
    found: dict[int, tuple[int, set[int], set[int]]] = {}
    sizes, hits = g.hits(texts)
    for t, p, items in hits:
        _, starts, named = found.setdefault(t, (int(sizes[t]), set(), set()))
        starts.add(p)
        named.update(i for i in items if i is not None)
    return found


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, max_grams: int, columns: list[str], decide, schema) -> DataFrame:
    """decide(batch, texts, found) over docs with what is found in them. One part of the hash set: one scan without a shuffle. More: documents are numbered and stored; each part in turn is broadcast, its hits, which are few, are stored, and it is freed; hits meet again by number."""
    context, parts = docs.sparkSession.sparkContext, _parts(benchmark, n, max_grams)
    first, cuts = next(parts)
    docs = docs.select(*[docs[c] for c in columns])
    if cuts == 1:
        only = context.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(batches):
                yield decide(batch, texts, _found(only.value, texts))

        return docs.mapInArrow(run, schema)

    at = len(columns)
    keyed = stored(docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(columns)], F.monotonically_increasing_id().alias("k")), "keyed")
    text = f"c{columns.index('text')}"
    fields = "k bigint, words int, starts array<int>, items array<bigint>"

    def hits_of(part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(batches, text):
                found = _found(part.value, texts)
                keys = batch.column(1).take(pa.array(list(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([w for w, _, _ in found.values()], pa.int32()), pa.array([sorted(s) for _, s, _ in found.values()], pa.list_(pa.int32())), pa.array([sorted(i) for _, _, i in found.values()], pa.list_(pa.int64()))], names=["k", "words", "starts", "items"])

        return stored(keyed.select(text, "k").mapInArrow(run, fields), "hits")

    found_in = []
    for grams_ in chain([first], (g for g, _ in parts)):
        part = context.broadcast(grams_)
        found_in.append(hits_of(part))
        part.destroy()
    hits = reduce(DataFrame.unionAll, found_in).groupBy(F.col("k").alias("h")).agg(F.max("words").alias("words"), F.flatten(F.collect_set("starts")).alias("starts"), F.flatten(F.collect_set("items")).alias("items"))
    joined = keyed.join(hits, keyed["k"] == hits["h"], "left").select(*[f"c{i}" for i in range(at)], "words", "starts", "items")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text):
            words, starts, items = (batch.column(at + k).to_pylist() for k in range(3))
            found = {t: (w, set(starts[t]), set(items[t])) for t, w in enumerate(words) if w is not None}
            yield decide(pa.RecordBatch.from_arrays(batch.columns[:at], names=columns), texts, found)

    return joined.mapInArrow(again, schema)


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, drop_share: float = DROP_SHARE, max_grams: int = MAX_GRAMS) -> DataFrame:
    """Contaminated documents: words, covered words, spans, items, the action, and the text that is left (null where dropped)."""
    fields = "doc_id bigint, n_words int, n_covered int, n_spans int, items string, action string, clean_text string"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())

    def decide(batch: pa.RecordBatch, texts: list[str | None], found: dict) -> pa.RecordBatch:
        ids, rows = batch.column(0).to_pylist(), []
        for t, (words, starts, items) in sorted(found.items()):
            spans = spans_of(starts, n)
            covered = sum(b - a for a, b in spans)
            drop = covered >= drop_share * words
            rows.append((ids[t], words, covered, len(spans), ",".join(map(str, sorted(items))), "drop" if drop else "cut", None if drop else cut(texts[t], spans)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=names)

    return _scan(docs, benchmark, n, max_grams, ["doc_id", "text"], decide, fields)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, drop_share: float = DROP_SHARE, max_grams: int = MAX_GRAMS) -> DataFrame:
    """docs without contaminated documents and spans; other rows and all columns stay, n_chars following the text."""

    def decide(batch: pa.RecordBatch, texts: list[str | None], found: dict) -> pa.RecordBatch:
        keep, out = np.ones(len(texts), bool), list(texts)
        for t, (words, starts, _) in found.items():
            spans = spans_of(starts, n)
            if sum(b - a for a, b in spans) >= drop_share * words:
                keep[t] = False
            else:
                out[t] = cut(texts[t], spans)
        return with_text(batch, out, batch.schema).filter(pa.array(keep))

    return _scan(docs, benchmark, n, max_grams, docs.columns, decide, docs.schema)


def oracle(n: int = N, drop_share: float = DROP_SHARE) -> str:
    """DuckDB SQL for find over the tables documents and benchmark."""
    word = r"[\p{L}\p{N}_]+"
    return rf"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '{word}') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM b, unnest(range(1, len(w) - {n - 2})) AS r(i)),
d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{word}') AS w FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM d, unnest(range(1, len(w) - {n - 2})) AS r(i)),
hit AS (SELECT doc_id, i, item_id FROM win JOIN g USING (gram)),
its AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, unnest(range(0, {n})) AS r(k)),
edge AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM cov),
span AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM edge GROUP BY doc_id, run),
tot AS (SELECT doc_id, count(*)::INT AS n_spans, sum(b - a + 1)::INT AS n_covered FROM span GROUP BY doc_id),
part AS (SELECT doc_id, j, regexp_extract_all(text, '{word}|[^\p{{L}}\p{{N}}_]+') AS pieces FROM d SEMI JOIN tot USING (doc_id), unnest(range(1, 2)) AS r(j)),
piece AS (SELECT doc_id, k, pieces[k] AS s, regexp_matches(pieces[k], '^{word}$') AS isw FROM part, unnest(range(1, len(pieces) + 1)) AS r(k)),
num AS (SELECT *, sum(isw::INT) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM piece),
kept AS (SELECT n.doc_id, coalesce(string_agg(n.s, '' ORDER BY n.k), '') AS clean_text FROM num n WHERE NOT EXISTS (SELECT 1 FROM span s WHERE s.doc_id = n.doc_id AND n.p BETWEEN s.a AND s.b AND (n.isw OR n.p < s.b)) GROUP BY n.doc_id)
SELECT t.doc_id, len(d.w)::INT AS n_words, n_covered, n_spans, items,
       CASE WHEN n_covered >= {drop_share} * len(d.w) THEN 'drop' ELSE 'cut' END AS action,
       CASE WHEN n_covered >= {drop_share} * len(d.w) THEN NULL ELSE coalesce(clean_text, '') END AS clean_text
FROM tot t JOIN d USING (doc_id) JOIN its USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
