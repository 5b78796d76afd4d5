"""The secret scan against one that reads character by character, with no regular expression."""

import base64
import json
import random

from quillspark.llm import secrets as X
from tests.llm.test_small_operators import b64, docs_of, rsa, tlv, url64

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALNUM = UPPER + LOWER + DIGITS
SAFE = ALNUM + "_-"


def run_of(text, at, allowed):
    end = at
    while end < len(text) and text[end] in allowed:
        end += 1
    return end


def wordlike(c):
    return c.isalnum() or c == "_"


def brute(text):
    found = []
    n = len(text)
    for i in range(n):
        before = text[i - 1] if i else " "
        if text[i] == "A" and text[i : i + 4] in {f"A{k}" for k in ("KIA", "SIA", "IDA", "ROA", "GPA", "NPA", "NVA", "IPA")} and before not in ALNUM:
            end = i + 20
            body = text[i + 4 : end]
            if len(body) == 16 and all(c in UPPER + "234567" for c in body) and (end == n or text[end] not in ALNUM) and len(set(base64.b32decode(body))) > 3:
                found.append((i, end, "access_key_id"))
        if text.startswith("gh", i) and text[i + 2 : i + 3] in tuple("pousr") and text[i + 3 : i + 4] == "_" and before not in ALNUM + "_":
            end = run_of(text, i + 4, ALNUM)
            if end == i + 40 and X.checksum(text[i:end]):
                found.append((i, end, "checksummed_token"))
        if text.startswith("-----BEGIN ", i):
            stop = text.find("-----", i + 11)
            name = text[i + 11 : stop]
            if stop > 0 and name.endswith("PRIVATE KEY") and all(c in UPPER + DIGITS + " " for c in name):
                tail = f"-----END {name}-----"
                last = text.find(tail, stop + 5)
                if last > 0:
                    lines = text[stop + 5 : last].replace("\\n", "\n").split()
                    data = X.unbase64("".join(x for x in lines if ":" not in x))
                    if data and (X.der_key(data) or X.openssh_key(data)):
                        found.append((i, last + len(tail), "key_block"))
    i = 0
    while i < n:  # signed tokens: three runs with dots between
        if text.startswith("ey", i) and (i == 0 or not (wordlike(text[i - 1]) or text[i - 1] == "-")):
            a = run_of(text, i, SAFE)
            b = run_of(text, a + 1, SAFE) if text[a : a + 1] == "." else a
            c = run_of(text, b + 1, SAFE) if text[b : b + 1] == "." else b
            if a - i >= 10 and b - a > 2 and c > b:
                if X.token_header(text[i:c]):
                    found.append((i, c, "signed_token"))
                i = c
                continue
        i += 1
    names = ("password", "passwd", "pwd", "secret", "token", "credential", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "privatekey", "private_key", "private-key", "authkey", "auth_key", "auth-key")
    for i in range(n):
        if text[i] in "=:":
            head = text[max(0, i - 24) : i].lower().rstrip()
            if i - len(text[:i].rstrip()) > 3:
                continue
            head = head[:-1] if head[-1:] in ("'", '"') else head
            at = i + 1
            while at < n and text[at].isspace() and at - i - 1 < 3:
                at += 1
            at += text[at : at + 1] in ("'", '"') and at < n
            end = run_of(text, at, ALNUM + "+/_-")
            if end - at >= 12 and head.endswith(names):
                end += len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
                if told := X.assigned(text[at:end]) or X.bare(text[at:end]):
                    found.append((at, end, told[0]))
    i = 0
    while i < n:
        end = run_of(text, i, ALNUM + "+/_-")
        if end - i >= 64:
            stop = end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
            if told := X.bare(text[i:stop]):
                found.append((i, stop, told[0]))
        i = max(end, i + 1)
    kept = []
    for f in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
        if not kept or f[0] >= kept[-1][1]:
            kept.append(f)
    return kept


def parts(rng):
    value = "".join(rng.choices(ALNUM, k=40))
    key = b64(rsa())
    signed = ".".join([url64(json.dumps({"alg": rng.choice(["HS256", "HS512", "none"])}).encode()), url64(json.dumps({"sub": rng.randint(0, 99)}).encode()), url64(rng.randbytes(rng.choice([32, 64, 31])))])
    ec = tlv(0x30, tlv(2, b"\1") + tlv(4, rng.randbytes(32)) + tlv(0xA0, tlv(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
    return ["AKIA" + "".join(rng.choices(UPPER + "234567", k=16)), "AKIA" + "A" * 16, signed, signed[:-2], key, key[:-4], rsa().hex(), b64(ec), ec.hex(), f"token={value}", f'"password": "{rng.randbytes(16).hex()}"', f"env: secret_key={value}", f"api_key : {value}", "pwd=" + "a" * 20, f"-----BEGIN RSA PRIVATE KEY-----\n{key}\n-----END RSA PRIVATE KEY-----", f"-----BEGIN EC PRIVATE KEY-----\\n{b64(ec)}\\n-----END EC PRIVATE KEY-----", f"-----BEGIN PRIVATE KEY-----\n{value}\n-----END PRIVATE KEY-----", "ghp_" + value[:36], rng.randbytes(32).hex(), value * 2, "word", "token", "= :", "été", "-", "A", "ey.ey.ey"]


def test_scan_equals_the_one_without_regular_expressions():
    rng, kinds = random.Random(11), set()
    for _ in range(300):
        text = "".join(x for _ in range(rng.randint(1, 12)) for x in (rng.choice(parts(rng)), rng.choice([" ", "\n", "", ", ", "'", "=", ": ", " . "])))
        mine = [f[:3] for f in X.find(text)]
        assert mine == brute(text), text
        kinds |= {f[2] for f in mine}
    assert len(kinds) >= 7


def test_very_long_texts_empty_tables_and_clashing_names(spark):
    secret = "token=deadbeef00112233445566778899aabb"
    docs = docs_of(spark, [(1, "filler words " * 200_000 + secret, "en"), (2, "x" * 2_000_000 + " " + secret, "en"), (2, "x" * 2_000_000 + " " + secret, "en")]).selectExpr("*", "1 AS start", "'k' AS kind", "2 AS fingerprint", "3 AS n_chars")
    rows = X.scan(docs).collect()
    assert sorted((r.doc_id, r.start, r.kind) for r in rows) == [(1, 2_600_006, "assigned_hex"), (2, 2_000_007, "assigned_hex"), (2, 2_000_007, "assigned_hex")]
    clean = X.redact(docs)
    assert clean.columns == docs.columns and all(r.text.endswith("token=[assigned_hex]") and r.n_chars == len(r.text) for r in clean.collect())
    assert X.redact(docs.limit(0)).count() == 0
