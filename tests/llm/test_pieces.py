"""Ids, spans and texts against the library, under the character maps that it compiles."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from quillspark.llm import sentencepieces as P


def model(rule, bytes_too=True, size=4000, trim=False):
    """The bundled pieces, cut to the first ones, with another normaliser and with or without byte pieces."""
    proto = pb.ModelProto()
    proto.ParseFromString(open(P.MODEL, "rb").read())  # noqa: SIM115
    pieces = [p for p in proto.pieces if bytes_too or p.type != 6]
    singles = [p for p in pieces if p.type == 1 and len(p.piece) == 1 and p.piece.isascii() or p.piece == P.MARK]
    own = {p.piece: p for p in pieces[:size] + singles}
    del proto.pieces[:]
    proto.pieces.extend(own.values())
    proto.trainer_spec.byte_fallback = bytes_too
    proto.trainer_spec.vocab_size = len(own)
    proto.normalizer_spec.remove_extra_whitespaces = trim
    if rule:
        compiled = pb.ModelProto()
        compiled.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.precompiled_charsmap = compiled.normalizer_spec.precompiled_charsmap
    return proto.SerializeToString()


ALPHABET = list("the quickbrown  \n\tﬁ½Ａé你😀ÉＢ　́a㌔ß İΣ")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", ""])
@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("bytes_too", [False, True])
def test_ids_and_spans_equal_the_librarys(rule, trim, bytes_too):
    blob = model(rule, bytes_too, trim=trim)
    library, codec = sentencepiece.SentencePieceProcessor(), P.PieceCodec(blob)
    library.LoadFromSerializedProto(blob)
    assert bool(codec.map.units) == bool(rule)
    rng = random.Random(9)
    texts = ["", " ", "\n", "ﬁ", "你😀", *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(250)), "the brown fox ½ " * 2000]
    ids, ends, counts, _ = codec.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist()):
        own, spans = ids[at : at + n].tolist(), ends[at : at + n].tolist()
        at += n
        assert own == library.encode(text), repr(text)
        told = library.encode(text, return_type="proto").pieces
        mine, theirs = [], []
        for k, (end, piece) in enumerate(zip(spans, told)):
            if codec.kinds[own[k]] != 6:  # the library gives all bytes of a character to the last of its byte pieces
                mine.append(end)
                theirs.append(piece.end)
        assert mine == theirs and spans == sorted(spans), repr(text)
        assert spans[-1:] <= [len(text.encode())]


def test_normal_form_equals_the_librarys_normaliser():
    for rule in ("nmt_nfkc", "nmt_nfkc_cf", "nfkc"):
        normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        codec = P.PieceCodec(model(rule))
        for c in map(chr, range(1, 0x3400, 7)):
            text = f"a{c}b"
            norm, at = codec.normalize(text)
            assert norm.decode().replace(P.MARK, " ").strip() == normalizer.normalize(text).replace(P.MARK, " ").strip(), repr(c)
            assert len(at) == len(norm) + 1 and at.tolist() == sorted(at.tolist()) and at[-1] == len(text.encode())
