import random
from itertools import combinations

import numpy as np
import pytest

from quillspark.llm import simhash as S


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


@pytest.mark.parametrize("scheme", [S.Scheme(4, 4), S.Scheme(5, 4), S.Scheme(5, 5), S.Scheme(6, 4), S.Scheme(11, 2), S.Scheme(29, 0)])
def test_every_pair_within_the_radius_shares_a_key(scheme):
    rng, py = np.random.default_rng(2), random.Random(1)
    for bits in {256 * (k + 1) // scheme.blocks - 256 * k // scheme.blocks for k in range(scheme.blocks)}:
        masks = [int(m) for m in S.masks(scheme.block_radius, bits)]
        for _ in range(500):
            gone = sum(1 << i for i in py.sample(range(bits), scheme.block_radius))
            assert any(not m & gone for m in masks)
    base = rng.integers(0, 2**63, (200, 4), dtype=np.uint64)
    flipped = base.copy()
    for r in range(200):
        for bit in rng.choice(256, scheme.radius, replace=False):
            flipped[r, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    assert scheme.keys(base).shape[1] == scheme.tables
    assert all(set(a) & set(b) for a, b in zip(scheme.keys(base), scheme.keys(flipped)))


def test_schemes_hold_their_radius():
    for radius in (0, 3, 19, 28, 40):
        found = [S.Scheme.of(radius, rows) for rows in (10, 10**5, 10**7, 10**10)]
        assert all(s.radius >= radius for s in found)
        assert all(s.cost(rows) <= S.Scheme(radius + 1 if radius > 2 else 4, 0).cost(rows) for s, rows in zip(found, (10, 10**5, 10**7, 10**10)))
        if radius != 19:  # there 4 and 5 blocks cost nearly the same for 10^7 rows
            assert [s.blocks for s in found] == sorted((s.blocks for s in found), reverse=True)
    for bad in (-1, 256):
        with pytest.raises(ValueError):
            S.Scheme.of(bad, 10)


def brute(sig, radius=S.RADIUS):
    """The least member of each signature's component."""
    root = {i: i for i in sig}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sig), 2):
        if sum((int(x) ^ int(y)).bit_count() for x, y in zip(sig[a], sig[b])) <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sig}


@pytest.mark.parametrize("radius, bucket", [(19, 20_000), (28, 20_000), (28, 7), (40, 20_000)])
def test_no_pair_within_the_radius_is_missed(spark, monkeypatch, radius, bucket):
    """Signatures at every distance from others, chains and hot buckets among them."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = np.random.default_rng(7)
    sig = [rng.integers(0, 2**63, 4, dtype=np.uint64) for _ in range(150)]
    for k in range(450):
        new = sig[int(rng.integers(0, 150 if k < 300 else len(sig)))].copy()
        for bit in rng.choice(256, int(rng.integers(1, 60)) if k < 300 else int(rng.integers(1, 12)), replace=False):
            new[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        sig.append(new)
    nodes = spark.createDataFrame([(i, *(int(x) for x in v.view(np.int64))) for i, v in enumerate(sig)], "node bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint").repartition(3)
    found = {r.node: r.root for r in S.components(S.edges(nodes, radius)).collect()}
    assert {i: found.get(i, i) for i in range(len(sig))} == brute(dict(enumerate(sig)), radius)
    with pytest.raises(ValueError):
        S.edges(nodes, 28, S.Scheme(4, 4))


def corpus(rng):
    texts, near = {}, []
    for k in range(60):
        own = words(rng, rng.randint(150, 260))
        texts[k] = " ".join(own)
        if k % 3 == 0:
            changed = list(own)
            for i in rng.sample(range(len(own)), 2):
                changed[i] = "zz" + changed[i]
            texts[100 + k] = " ".join(changed)
            texts[200 + k] = texts[k]
            near += [(k, 100 + k), (k, 200 + k)]
    return texts, near


def test_groups_match_brute_force(spark):
    texts, near = corpus(random.Random(3))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: r.group_id for r in S.groups(docs).collect()}
    sig, _ = S.Signer().sign(list(texts.values()))
    exact = {i: r for i, r in brute(dict(zip(texts, sig))).items()}
    wide = {i for i, r in exact.items() if sum(x == r for x in exact.values()) > 1}
    assert found == {i: exact[i] for i in wide}
    assert all(found.get(a) == found.get(b) is not None for a, b in near)
    kept = {r.doc_id for r in S.keep_one(docs).collect()}
    assert kept == set(texts) - {i for i, r in found.items() if i != r}


def test_cases(spark):
    rng = random.Random(4)
    text = " ".join(words(rng, 200))
    rows = [(5, text, "a"), (5, text, "a"), (3, text, "b"), (None, text, "c"), (None, text, "c"), (7, None, "d"), (8, "", "e"), (9, " .,", "f"), (10, text * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    found = {(r.doc_id, r.group_id) for r in S.groups(docs).collect()}
    assert found == {(3, 3), (5, 3), (10, 3)}
    several = spark.createDataFrame([(1, text), (1, "quite other words"), (2, "quite other words"), (9, text)], "doc_id bigint, text string")
    assert {(r.doc_id, r.group_id) for r in S.groups(several).collect()} == {(1, 1), (2, 1), (9, 1)}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 3 in ids and 5 not in ids and {7, 8, 9} <= set(ids)
    single = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (2, "x y", 1)], "doc_id bigint, text string, u int")
    assert sorted(r.doc_id for r in S.keep_one(single).collect()) == [1, 2]
    empty = docs.limit(0)
    assert S.groups(empty).count() == 0 and S.keep_one(empty).count() == 0


def test_thousands_of_copies_and_a_chain(spark):
    rng = random.Random(5)
    own = words(rng, 300)
    rows = [(i, " ".join(own)) for i in range(3000)]
    chain = list(own)
    for i in range(5):
        chain = list(chain)
        chain[i * 7] = f"changed{i}"
        rows.append((5000 + i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert S.keep_one(docs).count() == 1


def test_rows_travel_once_for_each_bit_of_the_radius(spark):
    """However many rows there are, and however many share a key by chance."""
    for rows in (10, 10**6, 3 * 10**6, 15 * 10**6, 10**9):
        scheme = S.Scheme.of(28, rows)
        assert 29 <= scheme.tables <= 33 and scheme.radius >= 28
        assert S.keyed(skewed_nodes(spark, skewed(200)), scheme, {}).count() == 200 * scheme.tables


def skewed(n):
    """Signatures of which most share most pieces, with near copies, chains of these and thick groups."""
    rng = np.random.default_rng(n)
    bits = rng.random((n, 256)) < np.where(rng.random(256) < 0.5, 0.06, 0.3)
    for i in range(n // 2, n):
        bits[i] = bits[int(rng.integers(0, i if i % 3 else 4))]
        bits[i] ^= rng.random(256) < rng.choice([0.01, 0.05, 0.1])
    return np.packbits(bits, axis=1).view("<u8").astype(np.uint64)


def skewed_nodes(spark, sig):
    return spark.createDataFrame([(i, *(int(x) for x in v.view(np.int64))) for i, v in enumerate(sig)], "node bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint").repartition(3)


def joined(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def all_close(sig, radius):
    return [(int(i), int(j)) for i in range(len(sig)) for j in np.flatnonzero(np.bitwise_count(sig ^ sig[i]).sum(axis=1) <= radius) if i < j]


@pytest.mark.parametrize("run, pairs", [(512, 300_000), (8, 50)])
@pytest.mark.parametrize("scheme", [S.Scheme(6, 4), S.Scheme(5, 5), S.Scheme(10, 2), S.Scheme(29, 0), S.Scheme(4, 7)])
def test_full_buckets_are_those_of_all_pairs(monkeypatch, scheme, run, pairs):
    for name, value in (("RUN", run), ("PAIRS", pairs)):
        monkeypatch.setattr(S, name, value)
    sig = skewed(1200)
    keys, found, large = scheme.keys(sig), [], 0
    for t in range(scheme.tables):
        (lo, hi), (a, b) = scheme.places(t)
        assert all(int(m) >> (a - lo) & (1 << b - a) - 1 == (1 << b - a) - 1 and int(m) < 1 << hi - lo for m in scheme.masks(t))
        order = np.argsort(keys[:, t])
        own = keys[order, t]
        bounds = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
        large = max(large, int(np.diff(bounds).max()))
        i, j = S.close_pairs(own.view(np.int64), sig[order], bounds, 28, scheme)
        found += zip(order[i].tolist(), order[j].tolist())
    close = all_close(sig, 28)
    assert large > S.SMALL and set(map(tuple, map(sorted, found))) <= set(close)
    assert joined(1200, found) == joined(1200, close)


def test_large_buckets_are_cut_into_pairs_of_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 40)
    sig = skewed(500)
    nodes = skewed_nodes(spark, sig)
    scheme = S.Scheme.of(28, 500)
    parts = S.large_buckets(nodes, scheme)
    keys, counts = np.unique(scheme.keys(sig).view(np.int64), return_counts=True)
    assert parts == {k: -(-n // 40) for k, n in zip(keys.tolist(), counts.tolist()) if n > 40} and max(parts.values()) > 3
    sizes = S.keyed(nodes, scheme, parts).groupBy("key").count().toPandas()["count"]
    assert sizes.max() < counts.max()
    found = [(r.a, r.b) for r in S.edges(nodes).collect()]
    assert joined(500, found) == joined(500, all_close(sig, 28))


def test_comparisons_are_those_that_masks_leave(monkeypatch):
    """A bucket of many rows isn't compared in pairs, nor a row met by chance in all 256 bits."""
    rng = np.random.default_rng(8)
    scheme = S.Scheme(6, 4)
    (lo, hi), (a, b) = scheme.places(0)
    sig = rng.integers(0, 2**63, (4000, 4), dtype=np.uint64)
    sig[:, 0] &= ~np.uint64((1 << b) - (1 << a))  # one bucket
    sig[3000:] = sig[:1000] ^ np.uint64(1) << np.uint64(b + 3)
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(S.np, "bitwise_count", lambda x: (compared.append(len(x)) if x.ndim == 2 else None, count(x))[1])
    pairs = S.covered_pairs(sig, S._bits(sig, lo, hi), scheme.masks(0), 4, 28)
    assert set(map(tuple, np.sort(pairs, axis=1).tolist())) == {(i, 3000 + i) for i in range(1000)}
    assert sum(compared) < 100_000 < 4000 * 3999 // 2


def variants(texts, each):
    """Signatures of which so many are a few bits from one another, as in a table of edited copies."""
    rng = np.random.default_rng(texts)
    sig = np.repeat(rng.integers(0, 2**63, (texts, 4), dtype=np.uint64), each, axis=0)
    for _ in range(5):
        bit = rng.integers(0, 256, len(sig))
        sig[np.arange(len(sig)), bit // 64] ^= np.uint64(1) << (bit % 64).astype(np.uint64)
    return sig


def test_near_copies_are_compared_under_one_mask(monkeypatch):
    """A pair that one mask has joined isn't compared under the others."""
    sig, scheme, compared, count = variants(100, 12), S.Scheme(6, 4), [], np.bitwise_count
    (lo, hi), (a, b) = scheme.places(0)
    sig[:, 0] &= ~np.uint64((1 << b) - (1 << a))  # one bucket
    monkeypatch.setattr(S.np, "bitwise_count", lambda x: (compared.append(len(x)) if x.ndim == 2 else None, count(x))[1])
    pairs = S.covered_pairs(sig, S._bits(sig, lo, hi), scheme.masks(0), 4, 28)
    monkeypatch.undo()
    assert joined(1200, pairs.tolist()) == joined(1200, all_close(sig, 28)) == [i // 12 * 12 for i in range(1200)]
    assert sum(compared) <= 100 * 66 and len(pairs) <= 100 * 66  # the pairs there are


def test_near_copies_are_linked_by_few_rows(spark):
    """What goes to the components is in proportion to the rows, not to the pairs."""
    sig = variants(50, 30)
    found = [(r.a, r.b) for r in S.edges(skewed_nodes(spark, sig)).collect()]
    assert joined(1500, found) == joined(1500, all_close(sig, 28)) == [i // 30 * 30 for i in range(1500)]
    assert len(found) < 10 * 1500 < 50 * 30 * 29 // 2


def test_stars_have_the_components_of_the_pairs():
    rng = np.random.default_rng(9)
    for n, links in ((0, 0), (1, 3), (40, 25), (300, 200), (300, 2000)):
        a, b = rng.integers(0, max(1, n), (2, links))
        if n == 40:
            a, b = np.arange(40, 1, -1), np.arange(39, 0, -1)  # a chain
        x, y = S.star(a, b)
        pairs = list(zip(x.tolist(), y.tolist()))
        assert joined(n + 1, pairs) == joined(n + 1, zip(a.tolist(), b.tolist()))
        assert len(set(y.tolist())) == len(y) and not set(x.tolist()) & set(y.tolist()) and (x < y).all()
