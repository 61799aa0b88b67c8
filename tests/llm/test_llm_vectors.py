"""Hard negatives, whitening and SimHash groups against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barflow.llm import cover_tree, hard_negatives, simhash, whitening
from llm_cases import TEXTS, documents, lower

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int, id string, q string, score int, weight int, component int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", "q", 2, 3, 4) for r in rows], SCHEMA)


def vectors(rng, n, d=12, hot=0):
    centres = rng.normal(size=(6, d))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] * rng.uniform(0.2, 1.5) + rng.normal(size=d) * rng.choice([0.02, 0.3])
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(4))))
    rows += [(n + i, rows[3][1], int(rng.integers(2))) for i in range(hot)]
    return rows


ODD = [(None, [1.0] * 12, 1), (9000, None, 1), (9001, [float("nan")] * 12, 1), (9002, [None] + [1.0] * 11, 2), (9003, [float("inf")] * 12, 0),
       (9004, [1.0] * 12, None), (9005, [1.0] * 5, 1), (9006, [], 1)]


def mined(rows, k=5):
    """Brute force over rows (id, vector, label)."""
    ok = [(i, np.floor(256 * np.array(v)), c) for i, v, c in rows if i is not None and v and c is not None and len(v) == 12
          and all(e is not None and np.isfinite(e) for e in v)]
    out = []
    for a, (i, v, c) in enumerate(ok):
        if i % 10:
            continue
        scored = sorted((-int(v @ w), j, e) for b, (j, w, e) in enumerate(ok) if b != a)
        for s, p, _ in [x for x in scored if x[2] == c][:k]:
            near = [x for x in scored if x[2] != c and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block", [40, 1024])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 20)
    rows = vectors(np.random.default_rng(block), 400, hot=80) + ODD
    rows += [rows[0], rows[10], (20, rows[30][1], 2)]
    got = hard_negatives.mine(table(spark, rows), F.expr("id % 10 = 0"))
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_odd_tables(spark):
    assert hard_negatives.mine(table(spark, ODD), F.expr("id % 10 = 0")).count() == 0
    assert hard_negatives.mine(table(spark, ODD).limit(0), F.expr("id % 10 = 0")).count() == 0
    zero = [(i, [0.0] * 12, i % 2) for i in range(30)]
    assert sorted(map(tuple, hard_negatives.mine(table(spark, zero), F.expr("id % 10 = 0")).collect())) == mined(zero)
    huge = [(i, [1e30 if i % 3 else -1e30] * 12, i % 2) for i in range(12)]
    assert hard_negatives.mine(table(spark, huge), F.expr("id % 10 = 0")).count() > 0


def test_cover_tree_bounds_hold_and_skip(spark):
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.02, size=(200, 8)) for c in rng.normal(size=(10, 8))]))
    n = len(x)
    tree = cover_tree.build(x, np.arange(n), np.arange(n), np.arange(n) % 3)
    assert sorted(tree.ids) == list(range(n))
    for at in range(len(tree.centre)):
        inside = tree.x[tree.begin[at]:tree.end[at]]
        assert np.sqrt(((inside - tree.x[tree.centre[at]]) ** 2).sum(1).max()) <= tree.plain[at] + 1e-6
    wide = np.full(20, 1 << 60)
    best = cover_tree.Best(20, 5)
    seen = cover_tree.search(cover_tree.unpacked(tree.packed()), cover_tree.Queries(x[:20], np.arange(20), np.arange(20) % 3, -wide, wide, True), best)
    assert seen < 20 * n / 4  # whole clusters are skipped
    for a in range(20):
        want = sorted((-int(x[a] @ x[b]), b) for b in range(n) if b != a and b % 3 == a % 3)[:5]
        assert list(zip((-best.scores[a]).tolist(), best.ids[a].tolist())) == want


def whitened(rows, most=16):
    """(n, {id: deviation}, covariance, mean, {id: x}) by brute force."""
    x = {i: np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000 for i, v, _ in rows if v and len(v) == 12 and all(e is not None and np.isfinite(e) for e in v)}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    return n, {i: int(((n * v - s) ** 2).sum()) for i, v in x.items()}, np.cov(fit.T, bias=True), s / n, x


@pytest.mark.parametrize("counts", [False, True])
def test_whitening(spark, counts):
    rows = vectors(np.random.default_rng(3), 300, hot=100) + [r for r in ODD if r[0] is not None]
    n, deviation, cov, mean, x = whitened(rows)
    if counts:
        every = np.array(list(x.values()))
        n, cov, mean = len(every), np.cov(every.T, bias=True), every.mean(0)
        deviation = {i: int(((n * v - every.sum(0)) ** 2).sum()) for i, v in x.items()}
    values, vecs = (m[..., ::-1] for m in np.linalg.eigh(cov))
    got = defaultdict(dict)
    for r in whitening.whiten(table(spark, rows).repartition(3), counts=counts).collect():
        assert r.n == n and int(r.deviation) == deviation[r.vec_id] and r.identity_error < 1e-6
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
        got[r.vec_id][r.component] = r.whitened
    assert set(got) == set(x) and all(sorted(v) == list(range(1, 13)) for v in got.values())
    for c in range(12):
        want = np.array([(x[i] - mean) @ vecs[:, c] / np.sqrt(values[c]) for i in x])
        have = np.array([got[i][c + 1] for i in x])
        assert np.abs(have * np.sign(have @ want) - want).max() < 1e-6


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(table(spark, ODD).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0] * 12, 1)] * 3)).count() == 0
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 0.0], 1) for i in range(20)] + [(None, [0.0, 0.0, 0.0], None)]
    out = whitening.whiten(table(spark, flat)).collect()
    assert len(out) == 21 and {r.component for r in out} == {1} and max(abs(r.explained - 1) for r in out) < 1e-12
    huge = whitening.whiten(table(spark, [(i, [1e30 * (i % 2), float(i), 1.0], 1) for i in range(9)])).collect()
    assert {int(r.deviation) for r in huge} and max(r.identity_error for r in huge) < 1e-4


def fingerprint(text):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(prints):
    """{key: smallest key within chains of two bits} by brute force."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in prints}


def test_golay_keys():
    rng = random.Random(7)
    words = np.array([rng.randrange(1 << 23) for _ in range(400)] + [0, (1 << 23) - 1])
    keys, count = simhash.golay_keys(words)
    ends = np.cumsum(count)
    assert set(count) <= {1, 6}
    for w, lo, hi in zip(words.tolist(), ends - count, ends):
        for flips in [(), (rng.randrange(23),), tuple(rng.sample(range(23), 2))]:
            other = w
            for f in flips:
                other ^= 1 << f
            assert set(keys[lo:hi]) & set(simhash.golay_keys(np.array([other]))[0])


@pytest.mark.parametrize("crowd", [2, 128])
def test_links_between_fingerprints(spark, crowd):
    rng = random.Random(crowd)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:12]:
        for _ in range(12):
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
            prints.add(base)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), crowd).collect()}
    assert got == {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def test_simhash_groups(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = list(TEXTS) + ["One two", "ONE  two\n", "a b c", "A\tb C ", "x " * 40]
    for _ in range(5):
        base = [rng.choice(words) for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(8):
            w = list(base)
            w[rng.randrange(400)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    want = near_groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert simhash.near_duplicates(documents(spark, texts).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(odd).collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_fingerprint_chunks():
    texts = ["a b c d e f g " * 50, "", "q", "z y x w " * 30]
    data = "".join(texts).encode()
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    one, two = (simhash.fingerprints(np.frombuffer(data, np.uint8), offsets, chunk=c) for c in (1 << 16, 7))
    assert one.tolist() == two.tolist() == [fingerprint(t) for t in texts]
