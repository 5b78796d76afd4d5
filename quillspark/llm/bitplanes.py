"""Operator 9: token ids as bit-plane shuffled, zstandard-compressed blocks with a chunk index.

Documents are encoded (operator 7) and their ids run on into blocks of BLOCK ids. A block is
transposed into planes, the k-th of which holds bit (or byte) k of every id; there are as
many planes as the largest id of the block asks for. Each plane is compressed on its own.
The chunk index of a block holds the end of every plane in its data, so a reader fetches and
unpacks single planes, and names the rows of the block: a segment is a row number of the
shard, its doc_id and how many of its ids lie here, so a long document spans blocks.

Results by case. Null text: a segment of size -1, read back as null ids. Empty text: a
segment of no ids. Null doc_id: carried. Repeated rows: stored again, told apart by row
number. Extra columns: ignored. Empty table: no block. Very long texts: cut over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import pieces
from quillspark.llm.sentencepieces import MODEL, codec

BLOCK = 65_536
LEVEL = 3
#: Word pieces come out a fifth smaller in byte planes than in bit planes.
KIND = "byte"
FIELDS = "shard int, block int, n_ids int, planes int, kind string, plane_ends array<int>, seg_rows array<bigint>, seg_docs array<bigint>, seg_sizes array<int>, checksum bigint, data binary"
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def planes_of(ids: np.ndarray, kind: str = KIND) -> list[bytes]:
    """Planes of ids below 2^32, the lowest first; none where there are no ids or all are 0."""
    raw = np.ascontiguousarray(ids, "<u4")
    width = int(raw.max(initial=0)).bit_length()
    if kind == "byte":
        return [np.ascontiguousarray(raw.view(np.uint8)[k::4]).tobytes() for k in range(-(-width // 8))]
    if width <= 16:
        raw = raw.astype("<u2")
    return [np.packbits((raw >> raw.dtype.type(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(width)]


def ids_of(planes: list[bytes], n: int, kind: str = KIND) -> np.ndarray:
    """The ids that planes_of took apart."""
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        part = np.frombuffer(p, np.uint8)
        if kind == "byte":
            out |= part.astype(np.uint32) << np.uint32(8 * k)
        else:
            out |= np.unpackbits(part, count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return out


def write(docs: DataFrame, model: str = MODEL, block: int = BLOCK, kind: str = KIND, level: int = LEVEL) -> DataFrame:
    """Blocks of the ids of docs' texts, each partition a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, squeeze = codec(model), zstandard.ZstdCompressor(level=level)
        context = TaskContext.get()
        shard, number, row = context.partitionId() if context else 0, 0, 0
        ids: list[np.ndarray] = []
        segments: list[tuple[int, int | None, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, segments, size, number
            own = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            packed = [squeeze.compress(p) for p in planes_of(own, kind)]
            rows, names, sizes = (list(x) for x in zip(*segments))
            values = [shard, number, len(own), len(packed), kind, np.cumsum([len(p) for p in packed]).tolist(), rows, names, sizes, xxhash.xxh3_64_intdigest(own.astype("<u4").tobytes()) >> 1, b"".join(packed)]
            ids, segments, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _KINDS)], names=NAMES)

        for batch, texts in pieces(batches):
            flat, _, counts, _ = c.encode(texts)
            at = 0
            for doc_id, text, n in zip(batch.column(0).to_pylist(), texts, counts.tolist()):
                if text is None:
                    segments.append((row, doc_id, -1))
                elif not n:
                    segments.append((row, doc_id, 0))
                while n:
                    take = min(n, block - size)
                    segments.append((row, doc_id, take))
                    ids.append(flat[at : at + take])
                    at, n, size = at + take, n - take, size + take
                    if size == block:
                        yield flush()
                row += 1
        if segments:
            yield flush()

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).mapInArrow(run, FIELDS)


def index(blocks: DataFrame) -> DataFrame:
    """The chunk index alone: everything but the data."""
    return blocks.drop("data")


def read_block(row: dict) -> np.ndarray:
    """Ids of one block; an error if they don't fit its checksum."""
    ends, data = [0, *row["plane_ends"]], row["data"]
    unpack = zstandard.ZstdDecompressor()
    ids = ids_of([unpack.decompress(data[a:b]) for a, b in zip(ends, ends[1:])], row["n_ids"], row["kind"])
    if xxhash.xxh3_64_intdigest(ids.astype("<u4").tobytes()) >> 1 != row["checksum"]:
        raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
    return ids


def read(blocks: DataFrame) -> DataFrame:
    """doc_id and ids of every row that went in. Rows inside one block come without a shuffle; only the ends of blocks meet by row."""
    fields = "shard int, row bigint, block int, whole boolean, doc_id bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                flat, sizes, last = read_block(r).astype(np.int32), r["seg_sizes"], len(r["seg_sizes"]) - 1
                ends = np.cumsum([max(0, s) for s in sizes])
                parts = [None if s < 0 else flat[e - s : e] for s, e in zip(sizes, ends.tolist())]
                columns = [[r["shard"]] * len(sizes), r["seg_rows"], [r["block"]] * len(sizes), [s <= 0 or 0 < i < last for i, s in enumerate(sizes)], r["seg_docs"], parts]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int32())))], names=["shard", "row", "block", "whole", "doc_id", "ids"])

    parts = blocks.mapInArrow(run, fields)
    ends = parts.filter("NOT whole").groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "ids"))), lambda s: s["ids"])).alias("ids"))
    return parts.filter("whole").select("doc_id", "ids").unionByName(ends.select("doc_id", "ids"))
