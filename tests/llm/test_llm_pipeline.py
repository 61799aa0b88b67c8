"""The corpus pipeline and the registered queries, on a small folder of tables, against brute force."""

import hashlib
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from barflow.llm import queries
from compare import difference
from llm_cases import contamination, documents, groups, repeats

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, out = random.Random(8), tmp_path_factory.mktemp("tables")
    words = "the river ran on through quiet fields and people walked along its banks talking of day night wood stone light wind".split()
    texts = [" ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 80))).capitalize() + "." for _ in range(150)]
    texts += [texts[3], texts[3], texts[5].replace("river", "stream"), texts[7] + " " + ITEM, ITEM, None, "", "  "]
    texts += [" ".join(w.upper() + "!!" for w in t.split()) for t in texts[:60]]
    spark_docs = documents(spark, texts, extra=False)
    spark_docs.write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(i < 158), int(i % 9 == 0)) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "short one")], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice([f"turn <|{t}|>", None, "", "plain"])) for c in range(6) for t in range(c)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{out}/conversations.parquet")
    pages = [(i, f"http://h{i % 3}.example.org/en/{i}", f"<html lang=en><p>{texts[i]}</p>") for i in range(20)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{out}/pages.parquet")
    vectors = [(i, [rng.gauss(i % 3, 0.4) for _ in range(8)], i % 4) for i in range(240)]
    vectors += [(240, None, 1), (241, [0.5] * 7 + [None], 2), (242, vectors[0][1], None), (300, vectors[0][1], 0)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{out}/embeddings.parquet")
    return str(out), texts


def test_each_stage_against_brute_force(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in queries.op5_quality(spark, path).where("score >= 0.5").collect()}
    after = []
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, path), "test_stage")
        assert docs.columns == columns
        after.append({r.doc_id: r.text for r in docs.collect()})
    assert after[0] == {i: t for i, t in rows.items() if i in good} and set(range(150)) <= set(after[0]) and len(after[0]) < len(rows)
    last = {t or "": i for i, t in sorted(after[0].items())}
    assert after[1] == {i: after[0][i] for i in last.values()}
    ids = sorted(after[1])
    linked = groups([after[1][i] for i in ids], ids)
    assert after[2] == {i: after[1][i] for i in ids if linked[i][1] == i} and len(after[2]) < len(after[1])
    items = [(1, ITEM), (2, None), (3, "short one")]
    found = {i: contamination(t, items) for i, t in after[2].items()}
    assert set(after[3]) == {i for i, (n, hit, _) in found.items() if hit <= n / 2}
    for i, t in after[3].items():
        assert t == after[2][i] if not found[i][1] else contamination(t, items)[1] == 0 and len(t) < len(after[2][i])
    tokens = {r.doc_id: r for r in P.STAGES[-1][1](spark, docs, path).collect()}
    whole = {r.doc_id: r for r in P.run(spark, path).collect()}
    assert tokens == whole and set(whole) == set(after[3])
    assert all(r.decoded_sha256 == hashlib.sha256((after[3][i] or "").encode()).hexdigest() for i, r in whole.items())


def test_queries_return_one_row_a_document_and_match_sql(spark, folder):
    import duckdb
    path, texts = folder
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    for name, query in queries.QUERIES.items():
        got = query(spark, path).toPandas()
        if name not in ("op1_chat_format", "op7_language_id", "op11_hard_negatives", "op13_whitening"):
            assert sorted(got["doc_id"]) == list(range(len(texts))), name
        if name in queries.SQL:
            assert difference(got, con.execute(queries.SQL[name]).df()) is None, name
        if name in ("op11_hard_negatives", "op13_whitening"):
            assert len(got) > 0, name
    want = {i: (n, k, s, hashlib.sha256(kept).hexdigest()) for i, (n, k, s, kept) in enumerate(repeats(texts))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, path).collect()}
    assert got == want


def test_registered(spark):
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
