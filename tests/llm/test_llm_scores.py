"""Classifiers and language identification: held-out accuracy, parts by hand, odd tables."""

import random
import time
import zlib

import numpy as np
import pytest

from barflow.llm import labelled, language_id, quality, textstats, toxicity
from llm_cases import TEXTS, documents

GOOD = "the river ran on through quiet fields and people walked along its banks talking of the day".split()


def labelled_corpus(spark, n=900):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(GOOD) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randint(30, 90))]
        bad, toxic = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "worthless", "zzvor" + rng.choice(["a", "en", "ist"])]))
        text = " ".join(w).capitalize() + "."
        if bad:
            text = [" ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join(x + "$$$" for x in w), (w[0] + " ") * 80][i % 4 if i % 4 else rng.randrange(4)]
        rows.append(text)
        labels.append((i, int(not bad), int(toxic and not (bad and text.count(" ") == 80))))
    return documents(spark, rows), spark.createDataFrame(labels + [(n + 5, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def accuracy(scores, labels, label):
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    return np.mean([r.predicted == r[label] for r in rows]), rows


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled_corpus(spark)
    scores = quality.quality_scores(docs, labels)
    share, rows = accuracy(scores, labels, "quality")
    assert share > 0.97 and len(rows) > 200 and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scores.where("predicted = 1").count()


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled_corpus(spark)
    share, rows = accuracy(toxicity.toxicity_scores(docs, labels), labels, "toxic")
    assert share > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled_corpus(spark, 60)
    ids = {r.id for r in labelled.training_rows(docs, labels, "quality").collect()}
    assert ids == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert labelled.training_rows(docs, labels, "quality", bound=7).count() == 7


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_tables(spark, scores):
    docs, labels = labelled_corpus(spark, 200)
    odd = docs.unionByName(documents(spark, TEXTS).selectExpr("if(doc_id < 2, null, doc_id + 1000) AS doc_id", "text", "lang", "source", "n_chars", "_score", "_hits"))
    got = scores(odd, labels).collect()
    assert len(got) == 200 + len(TEXTS) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert scores(docs.limit(0), labels).count() == 0
    none = scores(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    one = labels.where("quality = 1 and toxic = 0")
    assert {r.score for r in scores(docs, one).collect()} in ({1.0}, {0.0})


def test_discriminant_is_the_gaussian_density():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    cov = np.array([[2.0, 0.3, 0], [0.3, 1.0, 0.1], [0, 0.1, 0.5]])
    factor = np.linalg.inv(np.linalg.cholesky(cov))
    m = quality.Discriminant(np.zeros((2, 3)), np.stack([factor, np.eye(3)]), np.array([-0.5 * np.log(np.linalg.det(cov)), 0.0]), 1.0)
    by_hand = -0.5 * (x ** 2).sum(1) + 0.5 * np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov), x) + 0.5 * np.log(np.linalg.det(cov))
    assert np.allclose(m.log_odds(x), by_hand)


def test_statistics_do_not_depend_on_neighbours():
    texts = [t.encode() for t in TEXTS if t is not None and len(t) < 1000] + ["É É é".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    together = textstats.quality_matrix(data, offsets)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], textstats.quality_matrix(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])
    assert textstats.byte_counts(data, offsets)[-1][textstats.UPPER] == 2


# ---- language identification

EN, DE = "the quick brown fox jumps over the lazy dog and runs away", "der schnelle braune Fuchs springt über den faulen Hund und läuft weg"


def page_table(spark):
    rows = [(i, f"https://www.haus.example.de/{i}", f'<html lang="de"><body><p>{DE}</p></body></html>') for i in range(20)]
    rows += [(100 + i, f"http://shop.example.com/en/{i}", f"<HTML LANG='en-GB'><!-- {DE} --><script>{DE}</script><p>{EN}</p>") for i in range(20)]
    rows += [(200, "https://www.haus.example.de/x", "<p>12</p>"), (201, None, f"<p>{EN}</p>"), (202, "nonsense", None), (203, "", ""), (203, "", ""),
             (204, "http://shop.example.com/de/1", f'<html lang="de"><p>{EN} {EN}</p>')]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, lang string")


def test_language_identification(spark):
    docs = spark.createDataFrame([(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)] + [(99, None, "fr"), (98, "x", None)], "doc_id bigint, text string, lang string")
    got = {r.page_id: r for r in language_id.identify(page_table(spark), docs).collect()}
    assert all(got[i].lang == "de" for i in range(20)) and all(got[100 + i].lang == "en" for i in range(20))
    assert got[200].lang == "de" and got[201].lang == "en" and got[204].lang == "en"
    assert got[202].host == "" and 0 < got[202].posterior <= 1 and got[101].declared == "en" and got[101].address == "en"
    assert language_id.identify(page_table(spark), docs).count() == page_table(spark).count()
    assert language_id.identify(page_table(spark).limit(0), docs).count() == 0
    assert {r.lang for r in language_id.identify(page_table(spark), docs.limit(0)).collect()} == {None}


def test_posterior_against_hand_count(spark):
    docs = spark.createDataFrame([(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)], "doc_id bigint, text string, lang string")
    names, table = language_id.train(docs)
    pages = page_table(spark)
    got = {r.page_id: r for r in language_id.identify(pages, docs).collect()}
    clear_de, clear_en, k = 20, 22, language_id.PRIOR  # pages 201 and 204 hold English texts
    prior = np.array([clear_de + 1, clear_en + 1]) / (clear_de + clear_en + 2)
    for _ in range(3):  # the address label, the domain and the host of page 200 hold the twenty German pages alone
        prior = (np.array([clear_de, 0]) + k * prior) / (clear_de + k)
    address = np.log(np.array([clear_de + 1, 1 + 1]) / np.array([clear_de + 2, clear_en - 1 + 2]))  # label or code "de": 20 German pages, page 204
    data = np.frombuffer(b"12", np.uint8)
    assert names == ["de", "en"] and len(data) < 3  # no trigram: the text says nothing
    joint = np.exp(address + np.log(prior))
    assert abs(got[200].posterior - joint[0] / joint.sum()) < 1e-6 and table.shape == (2, language_id.BUCKETS)


def test_declared_language_after_a_long_preamble(spark):
    tag = '<html class="no-js" lang="de"><p>x</p></html>'
    long = "licence text " * 2000
    pages = {1: f"<!-- {long} -->{tag}", 2: " \n" * 5000 + tag, 3: f"<script>var a = '{long}';</script>{tag}", 4: f'<!--[if IE]><html lang="fr"><![endif]-->{tag}', 5: f'<!--[if IE]><!-->{tag}<!--<![endif]-->',
             6: f'<script>a = "<html lang=fr>"</script>{tag}', 7: f'<!-- {tag}', 8: "<p>lang=de</p>", 9: None, 10: f"<!-->{tag}<!-- -->"}
    df = spark.createDataFrame([(i, None, h) for i, h in pages.items()], "page_id bigint, url string, html string")
    got = {r.id: r.declared for r in language_id.evidence(df).collect()}
    assert got == {i: None if i in (7, 8, 9) else "de" for i in pages}


def test_every_language_and_value_counts(spark):
    """70 languages of two words of their own and 300 host suffixes; the rarest of each are used."""
    own = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{chr(97 + i % 26)}z{chr(97 + i // 26)} " * 20 for i in range(70)]
    docs = spark.createDataFrame([(100 * i + j, t, f"l{i:02d}") for i, t in enumerate(own) for j in range(1 + (i < 69))], "doc_id bigint, text string, lang string")
    names, table = language_id.train(docs)
    assert names == [f"l{i:02d}" for i in range(70)] and table.shape == (70, language_id.BUCKETS)
    assert language_id.train(docs, bound=1)[0] == names
    rows = [(2 * i + j, f"http://a.s{i:03d}/", f"<p>{own[i % 69]}</p>") for i in range(300) for j in range(1 + (i < 299))] + [(999, "http://b/", f"<p>{own[69]}</p>")]
    rows += [(1000, "http://new.s299/", "<p>1</p>")]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), docs).collect()}
    assert len(got) == len(rows) and got[999].lang == "l69"
    seen = np.ones(70)
    for i in range(300):
        seen[i % 69] += 1 + (i < 299)
    seen[69] += 1
    best = 299 % 69
    joint = (1 + np.eye(70)[best]) / (seen - 1 + 301) * seen / seen.sum()  # one page of 301 values has the suffix; the host is new
    assert got[1000].lang == f"l{best:02d}" and abs(got[1000].posterior - (joint / joint.sum())[best]) < 1e-6


def test_unclosed_markup_is_read_once(spark):
    size = 1 << 20
    pages = {i: (p * (size // len(p) + 1))[:size] for i, p in enumerate(["<!--", "<script>", "<script ", "<", "<a ", "<html ", "</script", "<nav x>y</na", "<!-- x -- ", "<html lang "])}
    df = spark.createDataFrame([(i, None, h) for i, h in pages.items()], "page_id bigint, url string, html string")
    begun = time.time()
    got = {r.id: r for r in language_id.evidence(df).collect()}
    assert time.time() - begun < 30 and len(got) == len(pages) and all(r.declared is None for r in got.values())
    few = {1: "a <!-- b", 2: "a <script>b", 3: "a < b > c <b>d</b>", 4: "x<p", 5: "<nav>q</nav>r<!-->s"}
    df = spark.createDataFrame([(i, None, h) for i, h in few.items()], "page_id bigint, url string, html string")
    assert {r.id: r.text for r in language_id.evidence(df).collect()} == {1: "a", 2: "a", 3: "a < b > c d", 4: "x", 5: "r s"}


def test_training_rows_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None), (None, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id bigint, toxic int")
    keep = [i for i in (1, 2) if zlib.crc32(str(i).encode()) % 3 != 1]
    got = {r.id: (r.text, r.label) for r in labelled.training_rows(docs, labels, "toxic").collect()}
    assert got == {k: v for k, v in {1: ("text 0", 1), 2: ("", 0)}.items() if k in keep}


def words_of(text):
    """Runs of letters (non-ASCII bytes count as letters) of the lower-cased text, as bytes."""
    low = text.encode().lower()
    out, word = [], b""
    for b in low + b" ":
        if 97 <= b <= 122 or b >= 128:
            word += bytes([b])
        elif word:
            out.append(word)
            word = b""
    return out


def starts_of(word):
    """The stems of a word: itself, and its beginnings of each length."""
    return {(0, word)} | {(k, word[:k]) for k in toxicity.STEMS if len(word) >= k}


def test_stem_evidence_and_lexicons_by_hand(spark):
    rng = random.Random(11)
    common, rare = [f"word{chr(97 + i)}" for i in range(26)], ["grobian", "zounds"]
    rows = []
    for i in range(240):
        w = [rng.choice(common) for _ in range(rng.randint(3, 12))] + (["every"] if i % 2 else [])
        rows.append((i % 4, " ".join(w + ([rare[i % 8 // 4]] if i % 4 == 1 and i % 40 < 20 else [])) + ("  " if i % 3 else "!"), int(i % 4 == 1)))
    df = spark.createDataFrame(rows, "fold int, text string, label int").selectExpr("fold", "text", "label")
    seen, total = {}, np.zeros((toxicity.FOLDS, 2))
    for fold, text, label in rows:
        total[fold, label] += 1
        for stem in {s for w in words_of(text) for s in starts_of(w)}:
            seen.setdefault(stem, np.zeros((toxicity.FOLDS, 2)))[fold, label] += 1

    def coded(stem):
        k, word = stem
        data = np.frombuffer(word, np.uint8)
        starts, ends = np.array([0]), np.array([len(data)])
        found = toxicity.stems(data, starts, ends, textstats.hash_runs(data, starts, ends))
        return int((found[0] if k == 0 else found[k - toxicity.STEMS[0] + 1])[1][0])
    want = {coded(s): n for s, n in seen.items() if n[:, 1].sum() >= toxicity.TOXIC}
    got = {r.stem & (1 << 64) - 1: np.array([[r[f"c{f}_{k}"] for k in (0, 1)] for f in range(toxicity.FOLDS)]) for r in toxicity.stem_evidence(df).collect()}
    assert set(got) == set(want) and all((got[s] == want[s]).all() for s in want)
    for left_out, lexicon in zip([*range(toxicity.FOLDS), None], toxicity.learn_lexicons(df)):
        folds = [f for f in range(toxicity.FOLDS) if f != left_out]
        size, odds = total[folds].sum(0), {}
        for s, n in want.items():
            clean, toxic = n[folds].sum(0)
            value = np.log((toxic + .5) / (size[1] + 1)) - np.log((clean + .5) / (size[0] + 1))
            if toxic >= toxicity.TOXIC and value >= toxicity.ODDS:
                odds[s] = value
        assert dict(zip(lexicon.hashes.tolist(), lexicon.weights.round(9).tolist())) == {s: round(v, 9) for s, v in odds.items()}
    assert odds


def test_calibration_is_isotonic_and_scores_follow_the_parts(spark):
    docs, labels = labelled_corpus(spark, 500)
    model = toxicity.fit(labelled.training_rows(docs, labels, "toxic"))
    texts = docs.select("doc_id", "text")
    rows = toxicity.scored(texts, model).collect()
    x = {r.doc_id: r._x for r in toxicity.with_features(texts, model.lexicons, "text", False).collect()}
    raw = np.array([r.p for r in rows])
    bounds, values = np.array(model.calibration.boundaries), np.array(model.calibration.predictions)
    assert (np.diff(values) >= 0).all() and (np.diff(bounds) >= 0).all()
    by_hand = 0.999 * np.clip(np.interp(raw, bounds, values), 0, 1) + 0.001 * raw
    assert np.allclose([r._score for r in rows], by_hand)
    for r in rows[:40]:  # the trees' probability is the logistic of twice their weighted sum
        margin = sum(w * t.predict(r.features) for w, t in zip(model.trees.treeWeights, model.trees.trees))
        assert abs(r.p - 1 / (1 + np.exp(-2 * margin))) < 1e-9 and list(r.features) == list(x[r.doc_id])


def test_quality_end_to_end_by_hand(spark):
    """Moments, shrinkage, densities and scores of the whole query from plain numpy on the training rows."""
    docs, labels = labelled_corpus(spark, 400)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = {r.doc_id: r.text or "" for r in docs.collect()}

    def features(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return textstats.quality_matrix(data, np.array([0, len(data)]))[0]
    x = {i: features(t) for i, t in rows.items()}
    train = {k: np.array([x[i] for i in rows if truth.get(i) == k and zlib.crc32(str(i).encode()) % 3 != 1]) for k in (0, 1)}
    total = sum(len(v) for v in train.values())
    own = {k: np.cov(v.T, bias=True) for k, v in train.items()}
    both = sum(len(train[k]) * own[k] for k in (0, 1)) / total

    def density(k, v):
        cov = 0.9 * own[k] + 0.1 * both + 0.02 * np.diag(np.maximum(np.diag(both), 1e-6))
        d = v - train[k].mean(0)
        return np.log(len(train[k]) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.solve(cov, d)
    for r in quality.quality_scores(docs, labels).collect():
        odds = density(1, x[r.doc_id]) - density(0, x[r.doc_id])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(odds / 4, -35, 35)))) < 1e-6
