"""Operator 7: SentencePiece encoding with original byte spans, and decoding.

The normaliser is written out here: it walks the text by the longest prefix that the
model's compiled character map (a double-array trie) knows and records, for every
normalised byte, the original byte that it came from. Pieces then carry spans over the
original UTF-8 text. Segmentation itself is the library's, run on normalised chunks that
no piece can straddle and remembered per chunk, so a word is segmented once per worker.

The model is a parameter: a path that every executor can read. The default one has an empty
character map, so its texts are their own normal form.

Results by case. Null text: null ids and spans, null count. Empty text, and one that
normalises to nothing: empty lists. Null doc_id: carried. Empty table: empty result. A
character that the vocabulary lacks: one byte piece for each of its bytes, each ending with
the byte it stands for; in a model without byte pieces one <unk> for a run of
them, spanning the run. Very long texts: whole. Ties between segmentations: as the library
breaks them. Repeated rows: one result row each. Extra columns: ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from quillspark.llm.common import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 500_000
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_CODECS: dict[str, PieceCodec] = {}


class CharMap:
    """The compiled character map: a darts double array and the strings it points to."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
            self.strings = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and its replacement."""
        units, best = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return best


class PieceCodec:
    """Encoder and decoder of one model file or serialized model."""

    def __init__(self, model: str | bytes = MODEL):
        proto = pb.ModelProto()
        proto.ParseFromString(model if isinstance(model, bytes) else open(model, "rb").read())  # noqa: SIM115
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.user = sorted((p.piece.encode() for p in proto.pieces if p.type == _USER), key=len, reverse=True)
        self.kinds = np.array([p.type for p in proto.pieces], np.int8)
        self.unk = next((i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN), 0)
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else b" \xe2\x81\x87 " if p.type == _UNKNOWN else p.piece.encode() for p in proto.pieces]
        #: Normalised bytes that a piece covers; unknown pieces get theirs while encoding.
        self.norm_len = np.array([0 if k in (_CONTROL, _UNKNOWN) else len(b) for k, b in zip(self.kinds, self.bytes_of)], np.int32)
        self.marks = np.array([b.count(MARK.encode()) for b in self.bytes_of], np.int32)
        inner = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type in (_NORMAL, _USER))
        whole = bool((self.kinds == _BYTE).any())  # else neighbouring characters that the vocabulary lacks are one <unk>
        self.chunked = (whole or any(p.piece == MARK for p in proto.pieces)) and not inner and self.escape and not self.suffix and proto.trainer_spec.model_type in (1, 2) and not self.user
        self.lines = self.chunked and whole and not any("\n" in p.piece for p in proto.pieces)
        self.plain = self.lines and self.prefix and not self.trim and not self.map.units
        proto.normalizer_spec.precompiled_charsmap = b""
        proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.remove_extra_whitespaces = proto.normalizer_spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor()
        self.bare.LoadFromSerializedProto(proto.SerializeToString())
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.counts, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.flat, self.spans, self.size = np.zeros(4096, np.int32), np.zeros(4096, np.int32), 0
        self.right: list[bool] = []

    def normalize(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original byte offset."""
        data = text.encode("utf-8", "replace")
        out, at = bytearray(), []
        i, n = 0, len(data)
        mark = MARK.encode() if self.escape else b" "

        def step(i: int) -> tuple[int, bytes]:
            for u in self.user:
                if data.startswith(u, i):
                    return len(u), u
            if found := self.map.longest(data, i):
                return found
            size = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            return size, data[i : i + size]

        if self.trim:
            while i < n and not step(i)[1].strip(b" "):
                i += step(i)[0]
        if i == n:
            return b"", np.array([n], np.int64)
        if self.prefix and not self.suffix:
            out += mark
            at += [i] * len(mark)
        spaced = self.trim
        while i < n:
            size, new = step(i)
            if spaced:
                new = new.lstrip(b" ")
            if new:
                same = size == len(new) and new == data[i : i + size]
                for k, b in enumerate(new):
                    add = mark if b == 32 else bytes([b])
                    out += add
                    at += [i + k if same else i] * len(add)
                spaced = self.trim and new.endswith(b" ")
            i += size
        if self.trim:
            while out.endswith(mark):
                n = at[len(out) - len(mark)]
                del out[-len(mark) :], at[-len(mark) :]
        if self.prefix and self.suffix:
            out += mark
            at += [n] * len(mark)
        return bytes(out), np.array([*at, n], np.int64)

    def _learn(self, chunks: list[str], first: list[str]) -> None:
        """Segment chunks (first: as written in normal form) and remember them under their own text."""
        found = self.bare.encode(first, num_threads=1)
        counts = np.fromiter(map(len, found), np.int32, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        lens = self.norm_len[ids]
        strange = np.zeros(len(found), bool)
        if (unknown := self.kinds[ids] == _UNKNOWN).any():
            strange[np.repeat(np.arange(len(found)), counts)[unknown]] = True
            at = np.concatenate([[0], np.cumsum(counts)])
            for i in np.flatnonzero(strange):
                lens[at[i] : at[i + 1]] = self._unknown(first[i])
        of = self.bytes_of
        self.right += [not odd and b"".join([of[k] for k in own]) == norm.encode() for own, norm, odd in zip(found, first, strange.tolist())]
        m, n = self.used, len(found)
        while m + n > len(self.starts):
            self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
        while self.size + len(ids) > len(self.flat):
            self.flat, self.spans = np.resize(self.flat, 2 * len(self.flat)), np.resize(self.spans, 2 * len(self.spans))
        self.flat[self.size : self.size + len(ids)], self.spans[self.size : self.size + len(ids)] = ids, lens
        self.starts[m : m + n], self.counts[m : m + n] = self.size + np.cumsum(counts) - counts, counts
        self.index.update(zip(chunks, range(m, m + n)))
        self.used, self.size = m + n, self.size + len(ids)

    def _unknown(self, norm: str) -> np.ndarray:
        """Normalised byte lengths where <unk> pieces stand for text."""
        proto = self.bare.encode(norm, return_type="proto")
        return np.array([p.end - p.begin for p in proto.pieces], np.int32)

    def _chunks(self, text: str) -> list[str] | None:
        """Chunks of a text that needs no normalising, keyed without the mark of the space before; None: go the general way."""
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " " or MARK in text or "\0" in text:
            return None
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, end of each piece's original byte span, pieces per text, and whether decoding gives the normal form again. Spans touch: each begins where the one before ends, the first at 0."""
        if len(self.index) > CACHE:
            self._reset()
        keys: list[str] = []
        sizes, aligned = np.zeros(len(texts), np.int64), {}
        for t, text in enumerate(texts):
            own: list[str] | None = [] if not text else self._chunks(text) if self.plain else None
            if own is None:
                norm, at = self.normalize(text)
                whole = norm.decode("utf-8", "replace")
                own = re.findall(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+", whole) if self.lines else re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", whole) if self.chunked else [whole] * bool(whole)
                own = ["\0" + c for c in own]
                aligned[t] = at
            sizes[t] = len(own)
            keys += own
        get = self.index.get
        found = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        if (found < 0).any():
            new = list(dict.fromkeys(keys[i] for i in np.flatnonzero(found < 0).tolist()))
            self._learn(new, [k[1:] if k[0] == "\0" else k if k[0] == "\n" else MARK + k for k in new])
            gaps = np.flatnonzero(found < 0)
            found[gaps] = np.fromiter((self.index[keys[i]] for i in gaps.tolist()), np.int64, len(gaps))
        counts = self.counts[found]
        ends = np.cumsum(counts, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total) + np.repeat(self.starts[found] - ends + counts, counts)
        ids, lens = self.flat[place], self.spans[place]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        token_at = np.concatenate([[0], ends])[bounds]
        lens_orig = lens - 2 * self.marks[ids] if self.plain else lens
        spans = np.cumsum(lens_orig, dtype=np.int64)
        base = np.concatenate([[0], spans])[token_at]
        spans -= np.repeat(base[:-1], np.diff(token_at))
        if self.plain:
            spans -= 1
        for t, at in aligned.items():
            a, b = token_at[t], token_at[t + 1]
            spans[a:b] = at[np.minimum(np.cumsum(lens[a:b]), len(at) - 1)]
        flags = np.concatenate([[0], np.cumsum(~np.array(self.right, bool)[found])]) if len(found) else np.zeros(1, np.int64)
        right = flags[bounds[1:]] == flags[bounds[:-1]]
        return ids, spans.astype(np.int32), np.diff(token_at), right

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, a dummy prefix is dropped, bytes that are no UTF-8 become U+FFFD."""
        out = b"".join([self.bytes_of[i] for i in ids])
        text = out.decode("utf-8", "replace")
        if self.escape:
            text = text.replace(MARK, " ")
        if self.prefix and text.startswith(" ") and not self.suffix:
            text = text[1:]
        elif self.prefix and self.suffix and text.endswith(" "):
            text = text[:-1]
        return text


def codec(model: str = MODEL) -> PieceCodec:
    """One codec for each worker and model."""
    if model not in _CODECS:
        _CODECS[model] = PieceCodec(model)
    return _CODECS[model]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, span_ends and roundtrip (decoding gives the normalised text) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch, texts in pieces(batches):
            ids, ends, counts, right = c.encode(texts)
            null = np.array([t is None for t in texts], bool)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(null, False))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts.astype(np.int32), mask=null), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(ends)), pa.array(right, mask=null)],
                names=["doc_id", "n_tokens", "ids", "span_ends", "roundtrip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens int, ids array<int>, span_ends array<int>, roundtrip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of ids. Null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            texts = [None if ids is None else c.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
