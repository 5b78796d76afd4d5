"""Operator 6: embedding near-dedup by an epsilon grid order join.

Every link (two vectors at a distance of at most EPS) is found, exactly. Equal vectors are one
class, joined once. The classes' vectors are rotated to their principal axes (from a
covariance summed over all vectors), get grid cells of width EPS on the LEADING axes, and
are sorted by cell, first axis first, over range partitions. Runs of that sequence become
intervals with bounding boxes. Two intervals meet by cells of the first axis and only if
their boxes are within EPS; they are joined by halving both again and again, leaving out
halves whose boxes over all axes are farther apart than EPS, down to LEAF vectors, which are
compared in full.

Pairs are never emitted: where two intervals are joined, links are counted for each vector
(copies of a partner count each), and a spanning forest of what they connect is kept, so
what leaves a task follows its vectors, also where a third of all are near each other.
An interval goes to PARTNERS others at a time, so no task grows with their number.

Results by case. One row for each vec_id and different vector of it: a vec_id with several
vectors has a row, and links, for each. Repeated rows: one. Null vec_id or embedding, an
empty one, a null, NaN or infinite element: no row. Vectors of different lengths have no
link; each length is joined by itself. 0.0 and -0.0 are equal. Distance exactly EPS: a link.
Ties: the least vec_id names a class and a group. Extra columns: ignored. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored
from quillspark.llm.simhash import components

#: Unit vectors of cosine 0.95.
EPS = 0.1**0.5
LEADING, LEAF = 6, 256
#: Bytes and rows of an interval at most and at least, and into how many the sequence is cut between these.
INTERVAL_BYTES, LEAST, INTERVALS = 16 << 20, 1024, 8
PARTNERS, MOST_TASKS = 16, 20_000
HELD_LINKS = 500_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and its hash in two parts, of the vectors that can be compared."""
    good = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    good = good.filter("vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('infinity'))")
    plain = F.expr("transform(embedding, x -> if(x = 0, float(0), x))")
    good = good.select("vec_id", plain.alias("embedding"))
    return good.select("*", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))


def axes(nodes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (columns, the widest first) of all nodes."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])

    rows = nodes.select("embedding").mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(1 + dim + dim * dim)
    for r in rows:
        total[r["k"]] = r["v"]
    n = max(total[0], 1.0)
    mean = total[1 : dim + 1] / n
    values, basis = np.linalg.eigh(total[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean))
    return mean, basis[:, np.argsort(-values)]


def box_gap(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(0.0, np.maximum(lo - hi2, lo2 - hi))
    return float(gap @ gap)


def join_intervals(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, eps: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of x and y (i < j where both are the same interval) within eps, leaf by leaf; rx and ry are the rotated coordinates in sequence order."""
    slack, work = 1e-5 * (1 + eps), [(0, len(x), 0, len(y))]
    boxes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
    sizes = [np.einsum("ij,ij->i", v, v) for v in (x, y)]

    def box(which: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (which, a, b) not in boxes:
            r = (rx, ry)[which][a:b]
            boxes[which, a, b] = (r.min(axis=0), r.max(axis=0))
        return boxes[which, a, b]

    while work:
        a, b, c, d = work.pop()
        if a >= b or c >= d or same and a >= d or box_gap(*box(0, a, b), *box(1, c, d)) > (eps + slack) ** 2:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            near = sizes[0][a:b, None] + sizes[1][None, c:d] - 2 * (x[a:b] @ y[c:d].T) <= (eps + slack) ** 2
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            exact = ((x[i] - y[j]) ** 2).sum(axis=1) <= eps * eps
            if exact.any():
                yield i[exact], j[exact]
        else:
            m, n = (a + b) // 2, (c + d) // 2
            halves = [(a, m), (m, b)] if b - a > LEAF else [(a, b)]
            work += [(*h, *k) for h in halves for k in ([(c, n), (n, d)] if d - c > LEAF else [(c, d)])]


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs (i, j) connect: each index with the least of its component."""
    names, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = np.split(at.reshape(-1), 2)
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    own = np.flatnonzero(label != np.arange(len(names)))
    return names[own], names[label[own]]


class Links:
    """Links between two lots of nodes: how many vectors each node is near to, and edges that connect as the links do."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray):
        self.ids, self.weight, self.n = ids, weight, np.zeros(len(ids), np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        n = len(self.ids)
        self.n += np.bincount(i, self.weight[j], n).astype(np.int64) + np.bincount(j, self.weight[i], n).astype(np.int64)
        self.held.append((i, j))
        self.size += len(i)
        if self.size > HELD_LINKS:
            self.held = [self.edges()]
            self.size = len(self.held[0][0])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return forest(*(np.concatenate(x) for x in zip(*self.held)))

    def batch(self) -> pa.RecordBatch:
        """node, its links and null; then node, null and a node that it is connected with."""
        there = np.flatnonzero(self.n)
        a, b = self.edges()
        node = np.concatenate([self.ids[there], self.ids[a]])
        is_edge = np.repeat([False, True], [len(there), len(a)])
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([self.n[there], a]), mask=is_edge), pa.array(np.concatenate([there, self.ids[b]]), mask=~is_edge)], names=["node", "n", "other"])


def _joined(nodes: DataFrame, dim: int, eps: float) -> DataFrame:
    """node, n and other as in Links.batch, in parts, over nodes(node, weight, embedding) of one length."""
    rows = nodes.count()
    mean, basis = axes(nodes, dim)
    lead = min(LEADING, dim)
    cells = [f"c{k}" for k in range(lead)]
    length = min(max(LEAST, -(-rows // INTERVALS)), max(LEAF, INTERVAL_BYTES // (4 * dim)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            at = np.floor((x - mean) @ basis[:, :lead] / eps).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(at[:, k]) for k in range(lead))], names=["node", "weight", "embedding", *cells])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            x = _matrix(t.column("embedding").combine_chunks(), dim)
            r = (x - mean) @ basis
            number += 1
            values = [((context.partitionId() if context else 0) << 32) + number, r.min(axis=0)[:lead].tolist(), r.max(axis=0)[:lead].tolist(), *(t.column(c).to_numpy().astype("<i8").tobytes() for c in ("node", "weight")), x.astype("<f4").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()))], names=["part", "lo", "hi", "ids", "weights", "data"])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size > 1.3 * length:
                whole = pa.Table.from_batches(held)
                yield flush(whole.slice(0, length))
                held, size = whole.slice(length).to_batches(), size - length
        if size:
            yield flush(pa.Table.from_batches(held))

    ordered = nodes.select("node", "weight", "embedding").mapInArrow(placed, "node bigint, weight bigint, embedding array<float>, " + ", ".join(f"{c} bigint" for c in cells))
    ordered = ordered.repartitionByRange(min(MOST_TASKS, -(-rows // length)), *cells, "node").sortWithinPartitions(*cells, "node")
    parts = stored(ordered.mapInArrow(cut, "part bigint, lo array<double>, hi array<double>, ids binary, weights binary, data binary"), "intervals")

    slack = 1e-5 * (1 + eps)
    first = lambda side: f"cast(floor({side}[0] / {eps!r}) as bigint)"
    left = parts.select(F.col("part").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.expr(f"explode(sequence({first('lo')}, {first('hi')})) AS cell"))
    right = parts.select(F.col("part").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.expr(f"explode(sequence({first('lo')} - 2, {first('hi')} + 2)) AS cell"))
    gap = F.expr("aggregate(zip_with(zip_with(lo_a, hi_b, (x, y) -> greatest(0D, x - y)), zip_with(lo_b, hi_a, (x, y) -> greatest(0D, x - y)), (x, y) -> greatest(x, y) * greatest(x, y)), 0D, (s, x) -> s + x)")
    met = left.join(right, "cell").filter("a <= b").filter(gap <= (eps + slack) ** 2).select("a", "b").distinct()
    turned = F.xxhash64("a", "b") % 2 != 0  # so that no interval stands first in most of its pairs
    met = met.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
    ways = F.lit(max(1, -(-parts.count() // PARTNERS)))
    met = stored(met.withColumn("g", F.pmod(F.xxhash64("b"), ways)), "meetings")
    groups_ = met.select("a", "g").distinct()
    tasks = max(1, min(MOST_TASKS, 2 * groups_.count()))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x, rx, ids, weight = None, None, None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                a, g, b, ids_b, weight_b, data = (batch.column(c)[k].as_py() for c in range(6))
                y = np.frombuffer(data, "<f4").astype(np.float64).reshape(-1, dim)
                ry, ids_y, weight_y = (y - mean) @ basis, np.frombuffer(ids_b, "<i8"), np.frombuffer(weight_b, "<i8")
                if b is None:
                    own, x, rx, ids, weight = (a, g), y, ry, ids_y, weight_y
                    continue
                if own != (a, g):
                    raise RuntimeError("partners came without their interval")
                if a == b:
                    found, shift = Links(ids, weight), 0
                else:
                    found, shift = Links(np.concatenate([ids, ids_y]), np.concatenate([weight, weight_y])), len(ids)
                for i, j in join_intervals(x, y, rx, ry, eps, a == b):
                    found.add(i, j + shift)
                yield found.batch()

    mine = groups_.join(parts, F.col("a") == F.col("part")).select("a", "g", F.lit(None).cast("bigint").alias("b"), "ids", "weights", "data")
    theirs = met.join(parts, F.col("b") == F.col("part")).select("a", "g", "b", "ids", "weights", "data")
    work = mine.unionAll(theirs).repartition(tasks, "a", "g").sortWithinPartitions("a", "g", F.asc_nulls_first("b"))
    return stored(work.mapInArrow(joined, "node bigint, n bigint, other bigint"), "links")


def links(vectors: DataFrame, eps: float = EPS) -> DataFrame:
    """vec_id, class_id (least vec_id of equal vectors), group_id (least vec_id of all that links connect) and n_links (other vectors within eps, equal ones among them)."""
    good = clean(vectors)
    members = stored(good.select("vec_id", "h1", "h2").distinct(), "members")
    weights = members.groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("class_id"))
    nodes = good.groupBy("embedding").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2")).join(weights, ["h1", "h2"])
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    lengths = [r["d"] for r in nodes.groupBy(F.size("embedding").alias("d")).count().filter("count > 1").orderBy("d").collect()]
    none = vectors.sparkSession.createDataFrame([], "node bigint, n bigint, other bigint")
    found = reduce(DataFrame.unionAll, [_joined(nodes.filter(F.size("embedding") == d), d, eps) for d in lengths], none)
    counts = found.filter("n IS NOT NULL").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("node", "h1", "h2", "weight", "class_id").join(counts, "node", "left").join(roots, "node", "left")
    named = stored(named.select("h1", "h2", "class_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")), "classes")
    least = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return members.join(named.join(least, "root"), ["h1", "h2"]).select("vec_id", "class_id", "group_id", "n_links")


def oracle(eps: float = EPS) -> str:
    """DuckDB SQL for links over the table embeddings."""
    return f"""
WITH RECURSIVE d AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, embedding::DOUBLE[] AS e, min(vec_id) OVER (PARTITION BY embedding) AS class_id FROM d),
l AS MATERIALIZED (SELECT x.i, y.i AS j FROM v x JOIN v y ON x.i <> y.i AND len(x.e) = len(y.e) AND CASE WHEN len(x.e) = len(y.e) THEN list_distance(x.e, y.e) <= {eps!r} END),
r AS (SELECT i, i AS j FROM v UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
g AS (SELECT r.i, min(v.vec_id) AS group_id FROM r JOIN v ON r.j = v.i GROUP BY r.i),
n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT vec_id, class_id, group_id, coalesce(n, 0)::BIGINT AS n_links FROM v JOIN g USING (i) LEFT JOIN n USING (i)
"""
