"""Near-duplicate groups and repeated strings against brute force."""

import hashlib
import random

import pytest

from barflow.llm import components, jaccard_join, suffix_dedup
from llm_cases import TEXTS, documents, groups, repeats, twins


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = list(TEXTS)
    passage = " ".join(rng.choice(words) for _ in range(40))
    for _ in range(4):
        base = " ".join(rng.choice(words) for _ in range(rng.randint(20, 120)))
        texts += near_copies(rng, base, 25, len(base.split()) // 20 + 1)
    texts += [passage + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randint(0, 25))) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["A b C d", "a B c D", "a\tb\nc d", "x " * 50, "x " * 60]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("options", [{}, {"rare": 2, "rare_again": 2, "turns": 1, "crowd": 3}, {"rare": 2, "rare_again": 2, "turns": 2}])
def test_jaccard_groups(spark, options):
    texts = corpus(len(options))
    ids = list(range(len(texts)))
    want = groups(texts, ids)
    got = jaccard_join.similar_groups(documents(spark, texts), **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(ids)


def test_jaccard_threshold_is_exact(spark):
    words = [f"t{i}" for i in range(200)]
    texts = [" ".join(words[:k]) for k in (104, 79, 78, 80)]  # 100, 75, 74 and 76 shingles
    want = groups(texts, range(4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(documents(spark, texts)).collect()} == want
    two = documents(spark, [texts[0], texts[2]])
    assert {r.component_id for r in jaccard_join.similar_groups(two).collect()} == {0, 1}
    two = documents(spark, texts[:2])
    assert {r.component_id for r in jaccard_join.similar_groups(two).collect()} == {0}


def test_jaccard_keep_one_and_odd_tables(spark):
    texts = corpus(9)
    df = documents(spark, texts).withColumnRenamed("_hits", "_lost")
    want = groups(texts, range(len(texts)))
    out = jaccard_join.keep_one(df)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {i for i, (_, c) in want.items() if c == i}
    assert jaccard_join.similar_groups(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.similar_groups(odd).collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    random.Random(2).shuffle(links)
    got = {r.key: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: i // 20 * 20 for i in range(60)} | {i: 100 for i in range(100, 140)}
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if k != 60} | {60: 40} if 60 in got else want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("length, gram, hot", [(200, 64, 1 << 15), (20, 8, 1 << 15), (20, 8, 1)])
def test_repeated_strings(spark, length, gram, hot):
    rng = random.Random(length + hot)
    passage = "".join(rng.choice("abcdé ") for _ in range(3 * length))
    texts = list(TEXTS[:7]) + TEXTS[9:] + ["For " * 120, "For " * 30, "ab" * length]
    for _ in range(25):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 3 * length)))
        cut = rng.randint(0, len(passage))
        texts.append(a + passage[cut:cut + rng.randint(0, 2 * length)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, length))))
    texts += [texts[-1], texts[-2] + "!", "x" * (length - 1), "x" * length, "y" * length + "z" + "y" * length]
    df = documents(spark, texts).repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.drop_repeats(df, length=length, gram=gram, hot=hot).collect()}
    assert got == dict(enumerate(repeats(texts, length)))


def test_repeats_in_odd_tables(spark):
    text = "0123456789" * 3 + "".join(chr(97 + i % 26) for i in range(300)) + "end"
    odd = spark.createDataFrame([(1, text), (1, text), (None, "tail " + text), (None, None)], "doc_id bigint, text string")
    want = sorted((n, k) for n, k, _, _ in repeats([text, text, "tail " + text, None]))
    rows = suffix_dedup.digests(odd).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == want
    assert {r.kept_sha256 for r in rows if not r.n_bytes} == {hashlib.sha256(b"").hexdigest()}
    assert suffix_dedup.digests(odd.limit(0)).count() == 0


def test_jaccard_tells_twin_words_apart(spark):
    one, two = twins(1024)
    texts = [one, two, f"{one} {two}", f"{two} {one}", one]
    got = jaccard_join.similar_groups(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(texts, range(5)) and {r.component_id for r in got} == {0, 1, 2, 3}


def test_one_large_open_area(spark):
    """Sets of one area in many blocks: none is linked with another component, yet all share tokens."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(24)]
    texts = [" ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(12)]) for _ in range(900)]
    texts += [t + " z" for t in texts[:40]]
    got = jaccard_join.similar_groups(documents(spark, texts), rare=2, rare_again=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(texts, range(len(texts)))
