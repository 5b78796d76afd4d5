"""Operator 3: LM scoring with a Katz backoff bigram model of the whole corpus (katzorder has other orders).

A word follows the word before it, the first one a start mark. Counts come from every
document. Counts up to K are discounted by Good-Turing (Katz's form, so that the mass freed
is that of the singletons); where counts of counts don't allow it, half a count is taken off
instead. Every bigram is stored (MIN_COUNT is 1). Unigram mass that discounting frees is the
unknown word's. The backoff weight of a history h is exactly

    (1 - sum of p(w|h) over stored w) / (1 - sum of p(w) over stored w),

so the probabilities of all words and the unknown word sum to 1 after every history. A token
is evaluated recursively: its stored bigram, else the weight of the history times its
unigram, else the unknown word.

So that no text predicts itself, a document of the corpus is scored by the bigrams of all
other documents: its own are taken off the counts, the counts of counts (so the discounts)
and the sums behind the weights, exactly. Unigrams remain those of the whole corpus, so a
word of that document alone has the probability of a word seen once, not the unknown one's.

How it runs. Texts become slices of word numbers once, stored. Each slice sends its distinct
words, then its distinct bigrams with counts, to buckets by hash of the word or history, as
packed arrays; a bucket adds them up, stores its part of the table, and answers each slice
with the totals in the order asked. So no table has to fit anywhere, and what moves is some bytes
for each distinct n-gram of a slice. Slices grow with the root of the corpus (slice_size), so
that the rows exchanged, one for each slice and bucket, grow with the corpus. Followers of a hot history (the count of which is at
least that of HOT_SHARE of all tokens, and HOT_LEAST) are spread over several buckets by
word; the sums over them, of at most 1 / HOT_SHARE histories, meet on the driver.

Results by case. Null or empty text, or no word: 0 tokens, log probability 0, null
perplexity. Repeated rows: counted and scored each (one predicts the other). Null doc_id: carried. Extra columns:
ignored. Empty table: empty result. Very long texts: whole, in a slice of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, lowered, pieces, stored

K, MIN_COUNT = 5, 1
SLICE = 2_000_000
SCORED = 250_000
MOST_TASKS = 10_000
HOT_LEAST, HOT_SHARE = 2_000_000, 5e-6
_ROW = "kind int, key bigint, bucket int, a binary, b binary, c binary, d binary"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
TABLE, REPLY, HOT, SLICED = 0, 1, 2, -1


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as byte planes, compressed."""
    v = np.ascontiguousarray(values, "<u4")
    width = max(1, -(-int(v.max(initial=0)).bit_length() // 8))
    return _bytes(bytes([width]) + v.view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(_plain(blob), np.uint8)
    width = int(raw[0])
    out = np.zeros(((len(raw) - 1) // width, 4), np.uint8)
    out[:, :width] = raw[1:].reshape(width, -1).T
    return out.view("<u4").reshape(-1).astype(np.uint32)


def _bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _plain(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def pack_words(words: list[str]) -> bytes:
    return _bytes("\n".join(words).encode("utf-8", "surrogatepass"))


def unpack_words(blob: bytes) -> list[str]:
    text = _plain(blob).decode("utf-8", "surrogatepass")
    return text.split("\n") if text else []


def row(kind: int, key: int, bucket: int, *blobs: bytes) -> pa.RecordBatch:
    values = [kind, key, bucket, *blobs, *[None] * (4 - len(blobs))]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NAMES)


def word_bucket(words: list[str], buckets: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int64, len(words))


def id_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def discounts(n: list[int], k: int = K) -> list[float]:
    """What is left of a count of r, for r = 1..k, from the numbers n of n-grams seen 1..k+1 times; above k all is left."""
    for top in range(k, 1, -1):
        if all(n[: top + 1]):
            common = (top + 1) * n[top] / n[0]
            d = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if common < 1 else 0.0 for r in range(1, top + 1)]
            if all(0 < x < 1 for x in d):
                return d + [1.0] * (k - top)
    return [1 - 0.5 / r for r in range(1, k + 1)]


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts after discounting."""
    table = np.array([0.0, *(r * x for r, x in enumerate(d, 1))])
    return np.where(counts <= len(d), table[np.minimum(counts, len(d))], counts.astype(float))


def _slices(docs: DataFrame, size: int) -> DataFrame:
    """Texts as word numbers: bucket the texts with a word, a the slice's words, b the numbers, c doc_ids (with a mark for null), d words per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base, number = (context.partitionId() if context else 0) << 32, 0
        index: dict[str, int] = {}
        parts: list[np.ndarray] = []
        ids: list[int | None] = []
        counts: list[int] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, total
            number += 1
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            names = np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
            out = row(SLICED, base + number, sum(n > 0 for n in counts), pack_words(list(index)), pack(flat), _bytes(names), pack(np.array(counts)))
            index.clear(), parts.clear(), ids.clear(), counts.clear()
            total = 0
            return out

        for batch, texts in pieces(batches):
            own = batch.column(0).to_pylist()
            for doc_id, text in zip(own, texts):
                words = WORD.findall(lowered(text)) if text else []
                if total and total + len(words) > size:
                    yield flush()
                get, n = index.setdefault, len(words)
                parts.append(np.fromiter((get(w, len(index)) for w in words), np.int32, n))
                ids.append(doc_id)
                counts.append(n)
                total += n
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _ROW)


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows, sorted by a column, in groups of equal values."""
    now, held = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            r = {name: batch.column(c)[k].as_py() for c, name in enumerate(_NAMES)}
            if held and r[by] != now:
                yield now, held
                held = []
            now = r[by]
            held.append(r)
    if held:
        yield now, held


@dataclass(frozen=True)
class Places:
    """A partition for each bucket and for each slice, which a key names by its task and its number there (from 1 to most)."""

    buckets: int
    tasks: int
    most: int

    @property
    def parts(self) -> int:
        """Partitions: MOST_TASKS at most, then each has several buckets or slices, one after another."""
        return min(self.tasks * self.most, MOST_TASKS)

    @classmethod
    def of(cls, slices: DataFrame) -> tuple[Places, int]:
        """Also how many texts have a word."""
        r = slices.agg(F.count("*"), F.max(F.shiftright("key", 32)), F.max(F.col("key").bitwiseAND(0xFFFFFFFF)), F.sum("bucket")).first()
        return cls(max(1, r[0]), (r[1] or 0) + 1, r[2] or 1), r[3] or 0

    def by_bucket(self, df: DataFrame) -> DataFrame:
        n = min(self.buckets, MOST_TASKS)
        return df.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket", "kind", "key")

    def by_slice(self, df: DataFrame) -> DataFrame:
        """Slices come before the answers to them."""
        at = F.shiftright("key", 32) * self.most + F.col("key").bitwiseAND(0xFFFFFFFF) - 1
        return df.repartitionById(self.parts, (at % self.parts).cast("int")).sortWithinPartitions("key", "kind", "bucket")


class Slice:
    """A slice with the totals that its words were answered with."""

    def __init__(self, rows: list[dict], buckets: int):
        first = rows[0]
        if first["kind"] != SLICED:
            raise RuntimeError("answers came without their slice")
        words, self.tokens = unpack_words(first["a"]), unpack(first["b"]).astype(np.int64)
        self.sizes = unpack(first["d"]).astype(np.int64)
        names = _plain(first["c"])
        n = len(self.sizes)
        ids, gone = np.frombuffer(names[: 8 * n], "<i8"), np.frombuffer(names[8 * n :], np.uint8)
        self.doc_ids = [None if g else int(i) for i, g in zip(ids, gone)]
        bucket = word_bucket(words, buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket, self.words = bucket, words
        self.ids, self.counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = 0
        for r in rows[1:]:
            if r["kind"] == REPLY and r["d"] is None:
                own = unpack(r["a"])
                place = self.order[at : at + len(own)]
                self.ids[place], self.counts[place] = own, unpack(r["b"])
                at += len(own)

    def bigrams(self, spread: Spread) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (u, w, count of the pair, count of w, bucket) in order of bucket and pair, and the place of each token's bigram in it."""
        w, n_w = self.ids[self.tokens], self.counts[self.tokens]
        u, n_u = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (w, n_w))
        starts = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        u[starts], n_u[starts] = 0, spread.starts
        keys = (u.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)
        distinct, first, inverse, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        us, ws = (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
        bucket = spread.bucket(us, ws, n_u[first])
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return us[order], ws[order], n[order], n_w[first][order], bucket[order], place[inverse.reshape(-1)]


@dataclass(frozen=True)
class Spread:
    """Where bigrams go: by history, those of a history of `hot` tokens or more by word too. starts: how often the start mark is a history."""

    buckets: int
    hot: int
    starts: int

    def bucket(self, u: np.ndarray, w: np.ndarray, n_u: np.ndarray) -> np.ndarray:
        ways = np.where(n_u >= self.hot, 1 + n_u // self.hot, 1)
        return id_bucket(u + (id_bucket(w, 1 << 40) % ways) * 0x1F123BB5, self.buckets)


@dataclass(frozen=True)
class Hot:
    """Sums over all buckets for hot histories, in order of history: tokens, stored bigrams of each count up to k, tokens in greater counts, unigram mass of stored words."""

    ids: np.ndarray
    sums: np.ndarray
    lower: np.ndarray

    def put(self, h: np.ndarray, sums: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sums (a column for each history) and lower with those of hot histories in their places."""
        at = np.minimum(np.searchsorted(self.ids, h), max(0, len(self.ids) - 1))
        here = self.ids[at] == h if len(self.ids) else np.zeros(len(h), bool)
        return np.where(here, self.sums[:, at], sums) if here.any() else sums, np.where(here, self.lower[at], lower) if here.any() else lower

    def has(self, h: np.ndarray) -> np.ndarray:
        return np.isin(h, self.ids)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted column."""
    starts = runs(bucket)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(bucket)])]


@dataclass(frozen=True)
class Model:
    """Packed tables by bucket, and what is known of the whole corpus. Words have numbers below 2^32."""

    words: DataFrame | None
    pairs: DataFrame | None
    total: int
    d1: list[float]
    d2: list[float]
    freed: float
    hot: Hot
    least: int
    n2: list[int]

    def bare(self) -> Model:
        """Without tables, for workers."""
        return replace(self, words=None, pairs=None)

    def p_word(self, counts: np.ndarray) -> np.ndarray:
        return discounted(counts, self.d1) / max(1, self.total)

    def weights(self, h: np.ndarray, sums: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What counts after each history are divided by, and its backoff weight. sums as in Hot."""
        return _weights(*self.hot.put(h, sums, lower), np.array(self.d2)[:, None])

    def discounts_of(self, n: list[int]) -> list[float]:
        """Discounts of bigrams from their counts of counts; 0 for those not stored."""
        return [0.0 if r < self.least else x for r, x in enumerate(discounts(n, len(self.d2)), 1)]

    def unigrams(self) -> DataFrame:
        """word, id, n and logp."""
        total, d1 = self.total, self.d1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _grouped(batches, "bucket"):
                words, n = unpack_words(rows[0]["a"]), unpack(rows[0]["b"]).astype(np.int64)
                ids = 1 + np.arange(len(words)) * int.from_bytes(rows[0]["c"], "little") + bucket
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(ids), pa.array(n), pa.array(np.log(discounted(n, d1) / total))], names=["word", "id", "n", "logp"])

        return self.words.mapInArrow(run, "word string, id bigint, n bigint, logp double")

    def bigrams(self) -> DataFrame:
        """u, w, n and logp of stored bigrams; w and n null: the backoff weight (logp) of a history u. History 0 is the start mark."""
        m = self.bare()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    h, seen, size, w, n, cw = _table_row({x: batch.column(c)[k].as_py() for c, x in enumerate(_NAMES)})
                    owner = np.repeat(np.arange(len(h)), size)
                    bottom, bow = m.weights(h, *_sums_of(owner, n, m.p_word(cw), seen, len(m.d2)))
                    logp = np.log(discounted(n, m.d2) / bottom[owner])
                    own = ~m.hot.has(h)  # the weights of hot histories come once, below
                    none = np.repeat([False, True], [len(w), own.sum()])
                    pad = np.zeros(own.sum(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[owner], h[own]])), pa.array(np.concatenate([w, pad]), mask=none), pa.array(np.concatenate([n, pad]), mask=none), pa.array(np.concatenate([logp, np.log(bow[own])]))], names=["u", "w", "n", "logp"])

        fields = "u bigint, w bigint, n bigint, logp double"
        rows = self.pairs.mapInArrow(run, fields)
        if not len(self.hot.ids):
            return rows
        _, bow = self.weights(self.hot.ids, self.hot.sums, self.hot.lower)
        return rows.unionAll(self.pairs.sparkSession.createDataFrame([(int(u), None, None, float(x)) for u, x in zip(self.hot.ids, np.log(bow))], fields))

    def unknown(self) -> float:
        return math.log(self.freed)


def _weights(sums: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counts are divided by and the backoff weight, by column of sums; d has a row for each count up to k."""
    seen, by_count, above = sums[0].astype(float), sums[1:-1], sums[-1]
    kept = above + (np.arange(1, len(d) + 1)[:, None] * d * by_count).sum(axis=0)
    bottom = np.where(seen - kept < 1e-9, seen + 0.5, seen)
    with np.errstate(divide="ignore", invalid="ignore"):  # where every word is stored, nothing backs off
        return bottom, (1 - kept / np.maximum(bottom, 0.5)) / (1 - lower)


def _sums_of(owner: np.ndarray, n: np.ndarray, p: np.ndarray, seen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums by history (as in Hot) over stored bigrams of counts n and unigram probabilities p."""
    h = len(seen)
    by_count = [np.bincount(owner[n == r], minlength=h) for r in range(1, k + 1)]
    above = np.bincount(owner, np.where(n > k, n, 0), h).astype(np.int64)
    return np.stack([seen, *by_count, above]), np.bincount(owner, p, h)


def _table_row(r: dict) -> tuple[np.ndarray, ...]:
    """Histories, tokens after each, stored bigrams of each; and of these the word, count and the word's count."""
    h, seen, size = np.split(unpack(r["a"]).astype(np.int64), 3)
    w, n, cw = np.split(unpack(r["b"]).astype(np.int64), 3)
    return h, seen, size, w, n, cw


def train(docs: DataFrame, min_count: int = MIN_COUNT, k: int = K, size: int = SLICE, hot_least: int = HOT_LEAST) -> tuple[Model, DataFrame, Spread]:
    """The model, the slices with all their answers, and where their bigrams went (both for score_own)."""
    slices = stored(_slices(docs, size), "slices")
    places, starts = Places.of(slices)
    buckets = places.buckets

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches, "key"):
            s = Slice(rows, buckets)
            n = np.bincount(s.tokens, minlength=len(s.words))
            for b, i, j in _cuts(s.bucket[s.order]):
                place = s.order[i:j]
                yield row(SLICED, key, b, pack_words([s.words[x] for x in place.tolist()]), pack(n[place]))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _grouped(batches, "bucket"):
            total: dict[str, int] = {}
            asked = [(r["key"], unpack_words(r["a"]), unpack(r["b"]).tolist()) for r in rows]
            for _, words, n in asked:
                for w, x in zip(words, n):
                    total[w] = total.get(w, 0) + x
            ranked = sorted(total, key=lambda w: (-total[w], w))
            number = {w: 1 + i * buckets + b for i, w in enumerate(ranked)}
            counts = np.array([total[w] for w in ranked], np.int64)
            yield row(TABLE, b, b, pack_words(ranked), pack(counts), buckets.to_bytes(8, "little"), np.array([(counts == r).sum() for r in range(1, k + 2)] + [counts.sum(), len(counts)], "<i8").tobytes())
            for key, words, _ in asked:
                yield row(REPLY, key, b, pack(np.array([number[w] for w in words])), pack(np.array([total[w] for w in words])))

    answered = _stored_by_kind(places.by_bucket(slices.mapInArrow(ask_words, _ROW)).mapInArrow(count_words, _ROW), "words")
    words, word_replies = answered(TABLE), answered(REPLY)
    one = _sums(words, k)
    d1 = discounts(one[: k + 1].tolist(), k)
    total = int(one[k + 1])
    spread = Spread(buckets, max(hot_least, math.ceil(total * HOT_SHARE)), starts)
    freed = 1.0 if not total else sum(r * (1 - x) * int(one[r - 1]) for r, x in enumerate(d1, 1)) / total
    known = slices.unionAll(word_replies)
    hot_ids = _hot_words(words, spread)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _grouped(batches, "key"):
            u, w, n, cw, bucket, _ = Slice(rows, buckets).bigrams(spread)
            for b, i, j in _cuts(bucket):
                first = runs(u[i:j])
                h = u[i:j][first]
                yield row(SLICED, key, b, pack(np.concatenate([np.diff(h, prepend=0), np.diff(np.append(first, j - i))])), pack(w[i:j]), pack(n[i:j]), pack(cw[i:j]))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _grouped(batches, "bucket"):
            lists: list[tuple[np.ndarray, ...]] = []
            for r in rows:
                gap, size_ = np.split(unpack(r["a"]).astype(np.int64), 2)
                h = np.cumsum(gap)
                lists.append((h, np.repeat(h, size_), unpack(r["b"]), unpack(r["c"]), unpack(r["d"])))
            u, w, n, cw = (np.concatenate([x[c] for x in lists]) for c in (1, 2, 3, 4))
            keys = (u.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)
            order = np.argsort(keys, kind="stable")
            first = runs(keys[order])
            counts = np.add.reduceat(n[order].astype(np.int64), first)
            us, ws, cws = u[order][first], w[order][first].astype(np.int64), cw[order][first].astype(np.int64)
            hs = runs(us)
            h, seen = us[hs], np.add.reduceat(counts, hs)
            keep = counts >= min_count
            size_ = np.add.reduceat(keep.astype(np.int64), hs)
            yield row(TABLE, b, b, pack(np.concatenate([h, seen, size_])), pack(np.concatenate([ws[keep], counts[keep], cws[keep]])), None, np.array([(counts == r).sum() for r in range(1, k + 2)] + [counts.sum(), len(counts)], "<i8").tobytes())
            which = np.empty(len(order), np.int64)
            which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
            owner = np.searchsorted(hs, np.flatnonzero(keep), "right") - 1
            sums, lower = _sums_of(owner, counts[keep], discounted(cws[keep], d1) / max(1, total), seen, k)
            if (hot := np.isin(h, hot_ids)).any():
                yield row(HOT, b, b, h[hot].astype("<i8").tobytes(), sums[:, hot].astype("<i8").tobytes(), lower[hot].astype("<f8").tobytes())
            at = 0
            for r, (own, long, *_) in zip(rows, lists):
                place = np.searchsorted(h, own)
                yield row(REPLY, r["key"], b, pack(counts[which[at : at + len(long)]]), pack(sums[:, place].reshape(-1)), _bytes(lower[place].astype("<f8").tobytes()), b"pairs")
                at += len(long)

    answered = _stored_by_kind(places.by_bucket(places.by_slice(known).mapInArrow(ask_pairs, _ROW)).mapInArrow(count_pairs, _ROW), "pairs")
    pairs, pair_replies = answered(TABLE), answered(REPLY)
    n2 = _sums(pairs, k)[: k + 1].tolist()
    d2 = [0.0 if r < min_count else x for r, x in enumerate(discounts(n2, k), 1)]
    return Model(words, pairs, total, d1, d2, freed, _hot_sums(answered(HOT), k), min_count, n2), places.by_slice(known.unionAll(pair_replies)), spread


def _hot_words(words: DataFrame, spread: Spread) -> np.ndarray:
    """Numbers of words so common that their followers are spread; the start mark too where it is."""
    hot = spread.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches, "bucket"):
            n = unpack(rows[0]["b"])
            ids = 1 + np.flatnonzero(n >= hot) * int.from_bytes(rows[0]["c"], "little") + bucket
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"])

    found = [r["id"] for r in words.mapInArrow(run, "id bigint").collect()]
    return np.array(sorted(found + [0] * (spread.starts >= hot)), np.int64)


def _hot_sums(parts: DataFrame, k: int) -> Hot:
    """Parts of hot histories, added up."""
    ids, sums, lower = [np.zeros(0, np.int64)], [np.zeros((k + 2, 0), np.int64)], [np.zeros(0)]
    for r in parts.orderBy("bucket").toLocalIterator():
        ids.append(np.frombuffer(r["a"], "<i8"))
        sums.append(np.frombuffer(r["b"], "<i8").reshape(k + 2, -1))
        lower.append(np.frombuffer(r["c"], "<f8"))
    distinct, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    total, mass = np.zeros((k + 2, len(distinct)), np.int64), np.zeros(len(distinct))
    np.add.at(total.T, inverse, np.concatenate(sums, axis=1).T)
    np.add.at(mass, inverse, np.concatenate(lower))
    return Hot(distinct, total, mass)


def _sums(table: DataFrame, k: int) -> np.ndarray:
    """Counts of counts, tokens and kinds over all buckets of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = sum((np.frombuffer(x.as_py(), "<i8") for x in batch.column(0)), np.zeros(k + 3, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 3), pa.int32()), pa.array(total, pa.int64())], names=["i", "v"])

    out = np.zeros(k + 3, np.int64)
    for r in table.select("d").mapInArrow(run, "i int, v bigint").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def _stored_by_kind(df: DataFrame, name: str) -> Callable[[int], DataFrame]:
    """Rows written once, read by kind."""
    whole = stored(df, f"katz-{name}", "kind")
    return lambda kind: whole.filter(F.col("kind") == kind)


def _document_scores(m: Model, n: np.ndarray, p: np.ndarray, history: np.ndarray, sums: np.ndarray, lower: np.ndarray, place: np.ndarray, sizes: np.ndarray, leave_out: bool) -> np.ndarray:
    """Log probabilities of documents of those sizes, one after another in place, the bigram of each token. n, p and history are by bigram: count, unigram probability, column of sums and lower."""
    docs, k = len(sizes), len(m.d2)
    keys, own = np.unique(np.repeat(np.arange(docs), sizes) * len(n) + place, return_counts=True)
    doc, pair = np.divmod(keys, max(1, len(n)))
    before = n[pair]
    after = before - own if leave_out else before
    keys, at = np.unique(doc * max(1, len(lower)) + history[pair], return_inverse=True)
    at = at.reshape(-1)
    whose, h = np.divmod(keys, max(1, len(lower)))
    moved = lambda owner, size, was, now: np.bincount(owner, now, size) - np.bincount(owner, was, size)
    gone = (before >= m.least) & (after < m.least)
    held = [np.where(x >= m.least, x, 0) for x in (before, after)]
    steps = [moved(at, len(h), *(x == r for x in held)) for r in range(1, k + 1)]
    steps = [np.bincount(at, after - before, len(h)), *steps, moved(at, len(h), *(np.where(x > k, x, 0) for x in held))]
    ones = np.array(m.n2)[:, None] + np.stack([moved(doc, docs, before == r, after == r) for r in range(1, k + 2)])
    d = np.array([m.discounts_of(x) for x in ones.astype(np.int64).T.tolist()]).T
    bottom, bow = _weights(sums[:, h] + np.stack(steps), lower[h] - np.bincount(at, np.where(gone, p[pair], 0.0), len(h)), d[:, whose])
    left = np.where(after > k, after, after * np.concatenate([np.zeros((1, docs)), d])[np.minimum(after, k), doc])
    stored_, top = after >= m.least, bow[at] * p[pair]
    logp = np.log(np.where(stored_, left / bottom[at], top))
    return np.bincount(doc, own * logp, docs)


def score_own(model: Model, answered: DataFrame, spread: Spread, leave_out: bool = False) -> DataFrame:
    """doc_id, n_tokens, logprob (natural, summed) and perplexity of the documents that the model was trained on; leave_out: each by the bigrams of all others."""
    m = model.bare()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "key"):
            s = Slice(rows, spread.buckets)
            u, _, _, cw, _, place = s.bigrams(spread)
            distinct, history = np.unique(u, return_inverse=True)
            history = history.reshape(-1)
            n, sums, lower = np.zeros(len(u), np.int64), np.zeros((len(m.d2) + 2, len(distinct)), np.int64), np.zeros(len(distinct))
            at = 0
            for r in rows:
                if r["kind"] == REPLY and r["d"] is not None:
                    own = unpack(r["a"])
                    here = slice(at, at + len(own))
                    first = runs(u[here])
                    to = history[here][first]
                    sums[:, to], lower[to] = m.hot.put(u[here][first], unpack(r["b"]).astype(np.int64).reshape(-1, len(first)), np.frombuffer(_plain(r["c"]), "<f8"))
                    n[here] = own
                    at += len(own)
            p, ends, score = m.p_word(cw), np.cumsum(s.sizes), np.zeros(len(s.sizes))
            for a, b in _shares(s.sizes):
                score[a:b] = _document_scores(m, n, p, history, sums, lower, place[ends[a] - s.sizes[a] : ends[b - 1]], s.sizes[a:b], leave_out)
            none = s.sizes == 0
            perplexity = np.exp(-score / np.maximum(1, s.sizes))
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(s.sizes, pa.int32()), pa.array(np.where(none, 0.0, np.round(score, 4))), pa.array(np.round(perplexity, 4), mask=none)], names=["doc_id", "n_tokens", "logprob", "perplexity"])

    return answered.mapInArrow(run, "doc_id bigint, n_tokens int, logprob double, perplexity double")


def _shares(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Documents from and to, of about SCORED tokens together."""
    cuts = runs((np.cumsum(sizes) - sizes) // SCORED).tolist()
    return list(zip(cuts, [*cuts[1:], len(sizes)]))


def slice_size(docs: DataFrame) -> int:
    """Tokens of a slice: SLICE, or so many that the rows that slices and buckets exchange, the square of their number, stay a share of the tokens (the 144th)."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(SLICE, math.ceil(12 * math.sqrt(chars / 6)))


def train_and_score(docs: DataFrame, min_count: int = MIN_COUNT, size: int | None = None) -> DataFrame:
    """Scores of docs, each under the model of the others."""
    return score_own(*train(docs, min_count, K, size or slice_size(docs)), leave_out=True)


def _discounts_sql(n: list[str], k: int = K) -> str:
    """discounts over columns with the numbers of n-grams seen 1..k+1 times."""
    out = "[" + ", ".join(repr(1 - 0.5 / r) for r in range(1, k + 1)) + "]"
    for top in range(2, k + 1):
        common = f"(({top + 1} * {n[top]})::DOUBLE / {n[0]})"
        d = [f"((({r + 1} * {n[r]})::DOUBLE / ({r} * {n[r - 1]}) - {common}) / (1 - {common}))" for r in range(1, top + 1)]
        right = " AND ".join([f"{x} > 0" for x in n[: top + 1]] + [f"{common} < 1"])
        inside = " AND ".join(f"{x} > 0 AND {x} < 1" for x in d)
        out = f"CASE WHEN CASE WHEN {right} THEN {inside} ELSE false END THEN [{', '.join(d + ['1.0'] * (k - top))}] ELSE {out} END"
    return out


def oracle(k: int = K) -> str:
    """DuckDB SQL for train_and_score over the table documents, whose doc_ids differ."""
    rs, n = range(1, k + 2), [f"n{r}" for r in range(1, k + 2)]
    ones = ", ".join(f"count(*) FILTER (WHERE n = {r}) AS n{r}" for r in rs)
    moved = lambda r: f"sum((n - o = {r})::INT - (n = {r})::INT)"
    left = f"CASE WHEN %s > {k} THEN %s ELSE 0 END"
    cut = lambda c, d: f"CASE WHEN {c} > {k} THEN ({c})::DOUBLE ELSE ({c}) * {d}[({c})::INT] END"
    kept = " + ".join([f"(a.above + h.above - h.above0)::DOUBLE", *(f"{r} * d[{r}] * (a.b{r} + h.m{r})" for r in range(1, k + 1))])
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, unnest(list_prepend('', w)[1:len(w)]) AS u, unnest(w) AS w FROM t),
own AS MATERIALIZED (SELECT doc_id, u, w, count(*) AS o FROM b GROUP BY ALL),
one AS (SELECT w, sum(o)::BIGINT AS n FROM own GROUP BY w),
g1 AS (SELECT {_discounts_sql(n, k)} AS d, total FROM (SELECT {ones}, sum(n) AS total FROM one)),
p AS MATERIALIZED (SELECT w, ({cut("n", "d")}) / total AS p FROM one, g1),
two AS MATERIALIZED (SELECT u, w, n, p FROM (SELECT u, w, sum(o)::BIGINT AS n FROM own GROUP BY u, w) JOIN p USING (w)),
g2 AS (SELECT {ones} FROM two),
a AS (SELECT u, sum(n) AS seen, sum(p) AS lower, {", ".join(f"count(*) FILTER (WHERE n = {r}) AS b{r}" for r in range(1, k + 1))}, sum({left % ("n", "n")}) AS above FROM two GROUP BY u),
j AS MATERIALIZED (SELECT doc_id, u, w, o, n, p FROM own JOIN two USING (u, w)),
dd AS (SELECT doc_id, {_discounts_sql(n, k)} AS d FROM (SELECT doc_id, {", ".join(f"max(g2.n{r}) + {moved(r)} AS n{r}" for r in rs)} FROM j, g2 GROUP BY doc_id)),
h AS (SELECT doc_id, u, sum(o) AS o, sum(CASE WHEN n = o THEN p ELSE 0 END) AS gone, {", ".join(f"{moved(r)} AS m{r}" for r in range(1, k + 1))}, sum({left % ("n - o", "n - o")}) AS above, sum({left % ("n", "n")}) AS above0 FROM j GROUP BY doc_id, u),
s AS (SELECT doc_id, u, seen - h.o AS seen, {kept} AS kept, lower - gone AS lower FROM h JOIN a USING (u) JOIN dd USING (doc_id)),
z AS (SELECT doc_id, u, kept, lower, CASE WHEN seen - kept < 1e-9 THEN seen + 0.5 ELSE seen::DOUBLE END AS bottom FROM s),
l AS (SELECT doc_id, sum(o) AS n_tokens, sum(o * ln(CASE WHEN n > o THEN ({cut("n - o", "d")}) / bottom ELSE (1 - kept / greatest(bottom, 0.5)) / (1 - lower) * p END)) AS s FROM j JOIN z USING (doc_id, u) JOIN dd USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0)::INT AS n_tokens, round(coalesce(s, 0), 4)::DOUBLE AS logprob, round(exp(-s / n_tokens), 4) AS perplexity FROM documents LEFT JOIN l USING (doc_id)
"""
