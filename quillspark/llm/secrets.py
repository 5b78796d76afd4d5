"""Operator 4: secret scan with structural confirmation.

A candidate is reported only after it has been decoded: an access-key id by its base32
payload, a signed token by its JSON header, payload and signature length, a key block or a
bare base64 / hex run by the nested lengths of the DER or OpenSSH encoding inside, a
checksummed token by its CRC, and the value of a credential assignment by its hex or base64
bytes. Anything that fails its parse is left alone, so hashes, ids and long words stay.

Results by case. Null or empty text: no finding. Empty table: empty result. Very long texts:
whole, in batches cut by characters. Overlapping findings: the earlier, at the
same place the longer. Repeated rows and repeated secrets: a finding for each. Null doc_id:
carried as null. Extra columns: ignored by scan, kept by redact.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import pieces, with_text

ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])A(?:KIA|SIA|IDA|ROA|GPA|NPA|NVA|IPA)[A-Z2-7]{16}(?![A-Za-z0-9])")
SIGNED = re.compile(r"(?<![\w-])ey[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----(.*?)-----END \1-----", re.S)
CHECKED = re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
#: Ahead of the separator, so that the name in a nested assignment isn't eaten as the outer one's value.
VALUE = re.compile(r"[=:](?=\s{0,3}[\"']?([A-Za-z0-9+/_-]{12,}={0,2}))")
ESCAPED = re.compile(r"\\+[nr]")
NAME = re.compile(r"(?:password|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)[\"']?\s{0,3}$", re.I)
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{64,}={0,2}")
HEX = re.compile(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+")
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "none": 0}
KEY_OIDS = {bytes.fromhex(x): n for x, n in (("2a864886f70d010101", "rsa"), ("2a8648ce3d0201", "ec"), ("2b6570", "ed25519"), ("2b6571", "ed448"), ("2b656e", "x25519"), ("2a8648ce380401", "dsa"))}


def unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").translate({45: "+", 95: "/"})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag and bounds of the value at a place, where its length fits the enclosing one."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 128:
        n = size & 127
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 128:
            return None
    return (tag, at, at + size) if at + size <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All values between two places; None unless they fill it."""
    out = []
    while at < end:
        if (x := der(data, at, end)) is None:
            return None
        out.append(x)
        at = x[2]
    return out


def der_key(data: bytes) -> str | None:
    """What private key a DER encoding holds: PKCS#1, SEC1 or PKCS#8."""
    top = der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return None
    parts = children(data, top[1], top[2])
    if not parts or parts[0][0] != 2:
        return None
    version, tags = int.from_bytes(data[parts[0][1] : parts[0][2]], "big"), [p[0] for p in parts]
    if version in (0, 1) and len(parts) in (9, 10) and tags[:9] == [2] * 9:
        modulus, prime = (parts[i][2] - parts[i][1] for i in (1, 4))
        return "rsa" if abs(modulus - 2 * prime) <= 3 else None
    if version == 1 and len(parts) >= 2 and tags[1] == 4 and all(t in (0xA0, 0xA1) for t in tags[2:]) and parts[1][2] - parts[1][1] in (20, 24, 28, 32, 48, 66):
        return "ec"
    if version in (0, 1) and tags[1:3] == [0x30, 4]:
        algorithm = children(data, parts[1][1], parts[1][2])
        if algorithm and algorithm[0][0] == 6:
            return KEY_OIDS.get(data[algorithm[0][1] : algorithm[0][2]])
    return None


def openssh_key(data: bytes) -> str | None:
    """Kind of an openssh-key-v1 block whose length-prefixed fields fill it."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, fields = len(magic), []
    for k in range(6):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if k == 3:
            if size != 1:
                return None
            continue
        if at + size > len(data):
            return None
        fields.append(data[at : at + size])
        at += size
    name = fields[3][4 : 4 + int.from_bytes(fields[3][:4], "big")]
    return name.decode("ascii", "replace") if at == len(data) and len(fields) == 5 else None


def token_header(text: str) -> str | None:
    """Algorithm of a signed token, where header and payload are JSON objects and the signature has its length."""
    head, body, sign = text.split(".")
    try:
        header, payload = (json.loads(unbase64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return None
    signature = unbase64(sign) if sign else b""
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(alg := header.get("alg"), str) or signature is None:
        return None
    fits = len(signature) == SIGNATURE[alg] if alg in SIGNATURE else alg[:2] in ("RS", "PS") and len(signature) in (128, 256, 384, 512)
    return alg if fits else None


def checksum(text: str) -> bool:
    """Whether the last six base-62 digits are the CRC-32 of the token's body."""
    value, digits = zlib.crc32(text[4:-6].encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[d] + digits
    return digits == text[-6:]


def bare(text: str) -> tuple[str, int, str] | None:
    """Key inside a base64 or hex run, whatever stands around it."""
    for kind, data in (("hex", bytes.fromhex(text) if HEX.fullmatch(text) else None), ("base64", unbase64(text))):
        if data:
            if what := der_key(data):
                return f"{kind}_key", len(data), what
            if what := openssh_key(data):
                return f"{kind}_key", len(data), what
    return None


def assigned(value: str) -> tuple[str, int, str] | None:
    """Value given to a credential's name: hex or base64 of random-looking bytes."""
    if len(value) >= 16 and HEX.fullmatch(value):
        data = bytes.fromhex(value)
        if len(set(data)) * 2 > len(data) and not value.isdigit() and not value.isalpha():
            return "assigned_hex", len(data), "bytes"
    if len(value) >= 16 and re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value):
        data = unbase64(value)
        if data and len(set(data)) * 2 > len(data):
            return "assigned_base64", len(data), "bytes"
    return None


def find(text: str) -> list[tuple[int, int, str, int, str]]:
    """Confirmed secrets of a text: start, end, kind, decoded bytes and detail."""
    out = []
    if "A" in text:
        for m in ACCESS_KEY.finditer(text):
            data = base64.b32decode(m[0][4:])
            if len(set(data)) > 3:
                out.append((m.start(), m.end(), "access_key_id", len(data), m[0][:4]))
    if "ey" in text:
        for m in SIGNED.finditer(text):
            if alg := token_header(m[0]):
                out.append((m.start(), m.end(), "signed_token", len(m[0]), alg))
    if "-----BEGIN" in text:
        for m in BLOCK.finditer(text):
            data = unbase64("".join(x for x in ESCAPED.sub(" ", m[2]).replace("\\/", "/").split() if ":" not in x and "," not in x))
            if data and (what := der_key(data) or openssh_key(data)):
                out.append((m.start(), m.end(), "key_block", len(data), what))
    if "gh" in text and "_" in text:
        for m in CHECKED.finditer(text):
            if checksum(m[0]):
                out.append((m.start(), m.end(), "checksummed_token", 30, m[0][:3]))
    for m in VALUE.finditer(text):
        if NAME.search(text, max(0, m.start() - 24), m.start()) and (x := assigned(m[1]) or bare(m[1])):
            out.append((m.start(1), m.end(1), *x))
    for m in RUN.finditer(text):
        if x := bare(m[0]):
            out.append((m.start(), m.end(), *x))
    kept: list[tuple[int, int, str, int, str]] = []
    for x in sorted(out, key=lambda x: (x[0], -x[1], x[2])):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def scan(docs: DataFrame) -> DataFrame:
    """A row for each confirmed secret: place in code points, kind, decoded size, detail and a fingerprint instead of the secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            rows = [(d, *x, hashlib.sha256(t[x[0] : x[1]].encode("utf-8", "replace")).hexdigest()) for d, t in zip(batch.column(0).to_pylist(), texts) if t for x in find(t)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "end", "kind", "n_bytes", "detail", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start int, end int, kind string, n_bytes int, detail string, fingerprint string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every confirmed secret replaced by its kind in brackets, n_chars following; rows and columns stay."""

    def clean(text: str | None) -> str | None:
        if not text or not (found := find(text)):
            return text
        out, at = [], 0
        for start, end, kind, *_ in found:
            out += [text[at:start], f"[{kind}]"]
            at = end
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            yield with_text(batch, [clean(t) for t in texts], batch.schema)

    return docs.mapInArrow(run, docs.schema)
