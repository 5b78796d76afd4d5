"""Operator 1: SimHash near-dedup by covering locality-sensitive hashing.

Each text gets 256 signature bits: the signs of a sum over its distinct words, each weighted
by the root of its count. The bits are cut into b blocks, and each block into k + 1 pieces.
Of b(k + 1) - 1 differing bits one block has at most k, so one of its pieces has none: each
row travels once for each piece, with its signature, to the rows that share the piece. There
are about as many pieces as the radius has bits, whatever the number of rows, so what travels
is in proportion to the rows, and nothing travels again because pieces are shared by chance.

In a bucket of rows that share a piece, those with at most k differing bits in the rest of its
block are found by covering: every position has a vector of k + 1 bits, and for each of the
2^(k+1) - 1 non-zero v a mask takes the positions whose vector has odd product with v. Up to k
differing positions span less than k + 1 dimensions, so some v is orthogonal to them all and
its mask agrees. Rows that a mask doesn't tell apart are compared, in the block and then in all
256 bits, and joined within the radius. So the result is that of comparing all pairs, whichever
Scheme of b and k is used: the cheapest for the number of rows (fewer, longer blocks have more
masks, but fewer chance meetings).

Texts of equal signature are one node and stay out of the components, so copies cost nothing. Rows
that one mask has joined aren't compared under the next, and of the close pairs of a bucket only
links to the least node of each component are emitted, so thousands of rows yield thousands of edges,
mostly the same from each table. Buckets of more than BUCKET nodes
are counted beforehand and cut into parts, each pair of parts a bucket of its own. Components
come from alternating large-star and small-star rounds, each written to the shared folder.

Results by case. Null doc_id or text, and texts without a word: in no group, and kept.
Repeated rows (same doc_id and text): one node, and one row is kept. A doc_id with several
texts is one document that belongs to the groups of all of them. Very long texts: read whole,
in batches cut by characters. Ties of the sum: bit 0. The representative is the least doc_id.
Extra columns: ignored by groups, kept by keep_one. Empty tables: empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, free_name, lowered, pieces, stored

BITS, WORDS = 256, 4
#: Differing bits up to which texts are near copies.
RADIUS = 28
BUCKET, SMALL = 500_000, 32
#: Rows that share a masked block up to which their pairs are listed, and pairs listed at once.
RUN, PAIRS = 512, 300_000
#: Share of a masked block's bits that tell texts apart, as measured, and rows for which schemes are chosen at least.
FREE, LEAST_ROWS = 0.7, 1_000_000
CACHE = 150_000
SIG = ["s0", "s1", "s2", "s3"]


def masks(radius: int, bits: int) -> np.ndarray:
    """2^(radius+1) - 1 masks over so many positions (64 at most); any `radius` positions are outside one of them."""
    n = 1 << (radius + 1)
    vector = [1 + (i * 7 + i // (n - 1)) % (n - 1) for i in range(bits)]
    return np.array([sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, n)], np.uint64)


def _cut(lo: int, hi: int, parts: int) -> list[tuple[int, int]]:
    at = [lo + (hi - lo) * k // parts for k in range(parts + 1)]
    return list(zip(at, at[1:]))


def _bits(sig: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits lo to hi (64 at most) of each signature."""
    if lo == hi:
        return np.zeros(len(sig), np.uint64)
    w, shift = lo // 64, lo % 64
    out = sig[:, w] >> np.uint64(shift)
    if hi > 64 * (w + 1):
        out = out | sig[:, w + 1] << np.uint64(64 - shift)
    return out & np.uint64((1 << hi - lo) - 1)


@dataclass(frozen=True)
class Scheme:
    """Blocks, and differing bits of one that its masks bear; a block has a piece more than that."""

    blocks: int
    block_radius: int

    def __post_init__(self):
        if not WORDS <= self.blocks <= BITS or self.block_radius < 0:
            raise ValueError("4 to 256 blocks, as one holds 64 bits at most")

    @property
    def radius(self) -> int:
        return self.tables - 1

    @property
    def tables(self) -> int:
        return self.blocks * (self.block_radius + 1)

    def cost(self, rows: int) -> float:
        """Of a row: its keys, that travel, and in each bucket the masks, by which it is sorted, and the comparisons. Texts of one language share bits: a masked block tells them apart as FREE of its bits would."""
        piece, n = BITS / self.tables, (2 << self.block_radius) - 1
        kept = piece + self.block_radius * piece * (1 << self.block_radius) / n
        met = max(rows, LEAST_ROWS) / 2.0 ** (FREE * kept)
        return self.tables * (20 + n * (1 + 0.1 * met))

    @classmethod
    def of(cls, radius: int, rows: int) -> Scheme:
        """The cheapest scheme that guarantees the radius."""
        if not 0 <= radius < BITS:
            raise ValueError("the radius is a number of bits of the signature")
        found = [cls(b, max(0, -(-(radius + 1) // b) - 1)) for b in range(WORDS, BITS + 1)]
        return min((s for s in found if s.block_radius < 12), key=lambda s: s.cost(rows))

    def places(self, table: int) -> tuple[tuple[int, int], tuple[int, int]]:
        """Bounds of the table's block and of its piece."""
        block = _cut(0, BITS, self.blocks)[table // (self.block_radius + 1)]
        return block, _cut(*block, self.block_radius + 1)[table % (self.block_radius + 1)]

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """The key of each signature in each of the tables: table number and piece, mixed to 40 bits (equal keys of unlike pieces only cost a comparison)."""
        keys = np.stack([_bits(sig, *self.places(t)[1]) for t in range(self.tables)], axis=1)
        return _mixed(keys) | np.arange(self.tables, dtype=np.uint64)[None, :] << np.uint64(40)

    def masks(self, table: int) -> np.ndarray:
        """Masks over the table's block, each with the whole piece; any block_radius positions of the rest are outside one of them."""
        (lo, hi), (a, b) = self.places(table)
        own = masks(self.block_radius, hi - lo - (b - a))
        low, piece = np.uint64((1 << a - lo) - 1), np.uint64((1 << b - a) - 1)
        rest = (own & low) | piece << np.uint64(a - lo)
        return rest | (own >> np.uint64(a - lo)) << np.uint64(b - lo) if b < hi else rest


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x >> np.uint64(24)


class Signer:
    """Signatures of texts; remembers the bits of words."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.signs = np.zeros((4096, BITS), np.int8)

    def _learn(self, words: list[str]) -> None:
        raw = b"".join(xxhash.xxh3_128_digest(b, 1) + xxhash.xxh3_128_digest(b, 2) for b in (w.encode("utf-8", "replace") for w in words))
        m, n = len(self.index), len(words)
        while m + n > len(self.signs):
            self.signs = np.concatenate([self.signs, np.zeros_like(self.signs)])
        self.signs[m : m + n] = (np.unpackbits(np.frombuffer(raw, np.uint8)).view(np.int8) * 2 - 1).reshape(n, BITS)
        self.index.update(zip(words, range(m, m + n)))

    def sign(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Four words of 64 bits for each text, and whether the text has a word at all."""
        if len(self.index) > CACHE:
            self._reset()
        counts = [Counter(WORD.findall(lowered(t))) if t else Counter() for t in texts]
        new = {w for c in counts for w in c if w not in self.index}
        if new:
            self._learn(sorted(new))
        out = np.zeros((len(texts), BITS // 8), np.uint8)
        get = self.index.__getitem__
        for i, c in enumerate(counts):
            if c:
                rows = np.fromiter(map(get, c), np.int64, len(c))
                weight = np.sqrt(np.fromiter(c.values(), np.float32, len(c)))
                total = np.zeros(BITS, np.float64)
                for k in range(0, len(rows), 2048):
                    total += weight[k : k + 2048] @ self.signs[rows[k : k + 2048]].astype(np.float32)
                out[i] = np.packbits(total > 0)
        return out.view("<u8").astype(np.uint64), np.array([bool(c) for c in counts], bool)


_SIGNERS: list[Signer] = []


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id and signature of every text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SIGNERS:
            _SIGNERS.append(Signer())
        for batch, texts in pieces(batches):
            sig, there = _SIGNERS[0].sign(texts)
            keep = np.flatnonzero(there)
            ids = batch.column(0).cast(pa.int64()).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(sig[keep, k].view(np.int64)) for k in range(WORDS))], names=["doc_id", *SIG])

    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{s} bigint" for s in SIG))


def _sigs(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.stack([batch.column(at + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(WORDS)], axis=1)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by column 0, cut so that no key is in two of them, with the bounds of the keys."""
    rest: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()
        return t[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and (not rest or rest[0].column(0)[0].as_py() == keys[-1]):
            rest.append(batch)
            continue
        full = whole([*rest, batch.slice(0, last)]) if rest else batch.slice(0, last)
        rest = [batch.slice(last)]
        k = full.column(0).to_numpy(zero_copy_only=False)
        yield full, np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
    if rest:
        full = whole(rest)
        k = full.column(0).to_numpy(zero_copy_only=False)
        yield full, np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])


def forest(sig: np.ndarray, radius: int, block: np.ndarray | None = None, block_radius: int = 0) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of rows within the radius (and, where there are blocks, within block_radius there); every pair is compared unless already joined."""
    left, edges = np.arange(len(sig)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            at = np.arange(len(left)) if block is None else np.flatnonzero(np.bitwise_count(block[left] ^ block[i]) <= block_radius)
            at = at[np.bitwise_count(sig[left[at]] ^ sig[i]).sum(axis=1) <= radius]
            if len(at):
                found = left[at].tolist()
                edges += [(i, j) for j in found]
                front += found
                left = np.delete(left, at)
    return edges


def joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component, from those before (root) and links a to b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from the least node of each component of the pairs to its other nodes: the same from many buckets."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = joined_roots(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def covered_pairs(sig: np.ndarray, block: np.ndarray, covers: np.ndarray, block_radius: int, radius: int) -> np.ndarray:
    """Row numbers (two columns) of pairs within the radius, and within block_radius in the block, whose blocks agree under one of the masks: enough of them to connect all that are. Rows that one mask has joined aren't compared under the next."""
    found, root = [np.zeros((0, 2), np.int64)], np.arange(len(sig))
    for cover in covers:
        masked = block & cover
        order = np.argsort(masked)
        masked = masked[order]
        starts = np.flatnonzero(np.concatenate([[True], masked[1:] != masked[:-1]]))
        size = np.diff(np.append(starts, len(order)))
        before, own = len(found), root[order]
        apart = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts) if len(own) else size > 1
        for k in np.flatnonzero(apart & (size > RUN)).tolist():
            own = order[starts[k] : starts[k] + size[k]]
            if pairs := forest(sig[own], radius, block[own], block_radius):
                found.append(own[np.array(pairs)])
        few = np.flatnonzero(apart & (size <= RUN))
        work = np.cumsum(size[few] * (size[few] - 1) // 2)
        for runs in np.split(few, np.searchsorted(work, np.arange(PAIRS, int(work[-1]) if len(work) else 0, PAIRS))):
            n = size[runs]
            run, ends = np.repeat(np.arange(len(runs)), n), np.cumsum(n)
            row = order[np.arange(len(run)) + np.repeat(starts[runs] - ends + n, n)]
            later = ends[run] - np.arange(len(run)) - 1
            a = np.repeat(np.arange(len(run)), later)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
            own = block[row]
            near = np.flatnonzero(np.bitwise_count(own[a] ^ own[b]) <= block_radius)
            near = near[root[row[a[near]]] != root[row[b[near]]]]
            a, b = a[near], b[near]
            near = np.bitwise_count(sig[row[a]] ^ sig[row[b]]).sum(axis=1) <= radius
            a, b = a[near], b[near]
            full = (n > SMALL) & (np.bincount(run[a], minlength=len(runs)) >= n)  # more than a tree needs
            for k in np.flatnonzero(full).tolist():
                dense = row[ends[k] - n[k] : ends[k]]
                found.append(dense[np.array(forest(sig[dense], radius, block[dense], block_radius))])
            loose = ~full[run[a]]
            found.append(np.stack([row[a[loose]], row[b[loose]]], axis=1))
        if len(found) > before:
            new = np.concatenate(found[before:])
            root = joined_roots(root, new[:, 0], new[:, 1])
    return np.concatenate(found)


def close_pairs(keys: np.ndarray, sig: np.ndarray, bounds: np.ndarray, radius: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs within the radius in the buckets between bounds: enough of them to connect all that the buckets' tables guarantee. Buckets of equal size up to SMALL are compared together."""
    size, left, right = np.diff(bounds), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in np.unique(size[(size > 1) & (size <= SMALL)]).tolist():
        i, j = np.triu_indices(m, 1)
        own = np.flatnonzero(size == m)
        for k in range(0, len(own), step := max(1, 100_000 // len(i))):
            part = own[k : k + step]
            a, b = bounds[part][:, None] + i, bounds[part][:, None] + j
            near = np.bitwise_count(sig[a] ^ sig[b]).sum(axis=2, dtype=np.int64) <= radius
            left.append(a[near])
            right.append(b[near])
    large = np.repeat(size > SMALL, size)
    tables = keys >> 40
    for table in np.unique(tables[large]).tolist():  # masks tell the buckets of a table apart
        own = np.flatnonzero(large & (tables == table))
        pairs = own[covered_pairs(sig[own], _bits(sig[own], *scheme.places(table)[0]), scheme.masks(table), scheme.block_radius, radius)]
        left.append(pairs[:, 0])
        right.append(pairs[:, 1])
    return np.concatenate(left), np.concatenate(right)


def large_buckets(nodes: DataFrame, scheme: Scheme) -> dict[int, int]:
    """Parts of each bucket of more than BUCKET nodes, by key: at most rows / BUCKET buckets of each table."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            more, m = np.unique(scheme.keys(_sigs(batch, 0)), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, m]), len(keys)).astype(np.int64)
            if len(keys) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])
                keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    sums = nodes.select(*SIG).mapInArrow(counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return {r.key: -(-r.n // BUCKET) for r in sums.filter(F.col("n") > BUCKET).collect()}


def keyed(nodes: DataFrame, scheme: Scheme, parts: dict[int, int]) -> DataFrame:
    """A row (key, node, signature) for each node and table; in a bucket that has parts, one for each pair of parts that the node's part is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = np.array(sorted(parts), np.int64).view(np.uint64)
        number = np.array([parts[k] for k in sorted(parts)], np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                nodes, sig = batch.column(0).to_numpy(zero_copy_only=False), _sigs(batch, 1)
                keys = scheme.keys(sig)
                row, keys = np.repeat(np.arange(len(sig)), keys.shape[1]), keys.reshape(-1)
                if len(large):
                    at = np.minimum(np.searchsorted(large, keys), len(large) - 1)
                    n = np.where(large[at] == keys, number[at], 1)
                    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, keys, n = (np.repeat(x, n) for x in (row, keys, n))
                    own = _mixed(nodes.view(np.uint64))[row].astype(np.int64) % n
                    pair = np.minimum(own, other) * n + np.maximum(own, other)
                    cut = _mixed(keys ^ _mixed(pair.astype(np.uint64) + np.uint64(1))) | keys >> np.uint64(40) << np.uint64(40)
                    keys = np.where(n > 1, cut, keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[row]), *(pa.array(sig[row, w].view(np.int64)) for w in range(WORDS))], names=["key", "node", *SIG])

    return nodes.select("node", *SIG).mapInArrow(run, "key bigint, node bigint, " + ", ".join(f"{s} bigint" for s in SIG))


def edges(nodes: DataFrame, radius: int = RADIUS, scheme: Scheme | None = None) -> DataFrame:
    """Links (a, b) of nodes(node, signature) that have the components of all pairs within the radius; two nodes linked may be further apart, joined by others."""
    rows = nodes.count()
    scheme = scheme or Scheme.of(radius, rows)
    if scheme.radius < radius:
        raise ValueError(f"tables that guarantee {scheme.radius} bits don't find all pairs within {radius}")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _by_key(batches):
            ids, sig = batch.column(1).to_numpy(zero_copy_only=False), _sigs(batch, 2)
            i, j = close_pairs(batch.column(0).to_numpy(zero_copy_only=False), sig, bounds, radius, scheme)
            a, b = star(ids[i], ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = keyed(nodes, scheme, large_buckets(nodes, scheme) if rows > BUCKET else {})
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(joined, "a bigint, b bigint").filter("a < b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the pairs, by alternating large-star and small-star. Minima are aggregated and joined back, so that a node of very many neighbours isn't one task's."""
    now = stored(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        after = least.select("u", F.col("m").alias("v")).unionAll(large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        now = stored(after, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(docs: DataFrame, radius: int = RADIUS, scheme: Scheme | None = None) -> DataFrame:
    """doc_id and group_id (the least doc_id of its group) of every document that has a near copy; one row a document."""
    signed = stored(signatures(docs).distinct(), "signatures")
    nodes = stored(signed.groupBy(*SIG).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    twice = signed.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    links = edges(nodes, radius, scheme)
    several = signed.join(twice, "doc_id", "left_semi").join(nodes, SIG).select("doc_id", "node")  # texts of one document are linked
    links = links.unionAll(several.join(several.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b"))
    named = nodes.select(*SIG, "node", "least", "n").join(components(links), "node", "left")
    named = stored(named.select(*SIG, "least", "n", F.col("root").isNotNull().alias("linked"), F.coalesce("root", "node").alias("root")), "named")
    heads = named.filter("linked").groupBy("root").agg(F.min("least").alias("head"))
    named = named.join(heads, "root", "left").filter("n > 1 OR linked").select(*SIG, F.coalesce("head", "least").alias("group_id"))
    return signed.join(named, SIG).select("doc_id", "group_id").distinct()


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group: the least doc_id's. Rows in no group stay; of rows that repeat a doc_id with its text one stays."""
    gone = groups(docs, radius).filter("doc_id <> group_id").select(F.col("doc_id").alias("qs_id"))
    left = docs.join(gone, docs["doc_id"] == gone["qs_id"], "left_anti")
    twice = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("qs_id")).count().filter("count > 1").select("qs_id")
    if twice.isEmpty():
        return left
    twice = stored(twice, "repeated")
    order = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*docs.columns))
    number = free_name(docs, "qs_n")
    repeated = left.join(twice, left["doc_id"] == twice["qs_id"], "left_semi").withColumn(number, F.row_number().over(order)).filter(F.col(number) == 1).drop(number)
    return left.join(twice, left["doc_id"] == twice["qs_id"], "left_anti").unionByName(repeated)
