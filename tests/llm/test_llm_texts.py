"""Chat formatting, exact deduplication, decontamination and tokenisation on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers

from barflow.llm import byte_bpe, chat_format, decontaminate, exact_dedup, pretokens, textbytes, token_blocks
from llm_cases import LONG, TEXTS, contamination, documents, twins

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ---- chat formatting

def by_hand(turns):
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha(whole), len(loss), sha(loss)


def test_chat_round_trip(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    turns = {1: [("user", control), ("assistant", control), ("assistant", None), ("assistant", "")], 2: [(None, "x"), ("a\nb%0A<|im_end|>", "\\<\\\\|<|<\\|\n")],
             3: [("assistant", LONG), ("user", "é😀\n<")], None: [("user", "no id")]}
    rows = [(c, i, r, t) for c, ts in turns.items() for i, (r, t) in enumerate(ts)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_format.format_digests(chat_format.canonical_turns(df)).collect()}
    assert set(got) == set(turns)
    for c, ts in turns.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == by_hand(ts)
    text = chat_format.render(df.where("conv_id = 1")).first().formatted
    assert text.count("<|im_end|>") == 4 and text.count("<|im_start|>") == 4


def test_chat_ties_repeats_and_empty_table(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "z")], schema)
    assert [t.text for t in chat_format.read_back(chat_format.render(df)).first().turns] == ["z", "a", "a", "b"]
    assert chat_format.format_digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("schema, row, turns", [
    ("conv_id int, prompt string, response string", (1, "p", "r"), [("user", "p"), ("assistant", "r")]),
    ("conv_id int, instruction string, input string, output string", (1, "i", "", "o"), [("user", "i"), ("assistant", "o")]),
    ("conv_id int, instruction string, input string, output string", (1, "i", "n", None), [("user", "i\n\nn"), ("assistant", "")]),
    ("conv_id int, messages array<struct<role:string,content:string>>", (1, [("system", "s"), ("user", None)]), [("system", "s"), ("user", "")]),
    ("conv_id int, conversations array<struct<from:string,value:string>>", (1, [("human", "h"), ("gpt", "g")]), [("user", "h"), ("assistant", "g")]),
    ("conv_id int, question string, answer string, extra map<string,int>", (1, "q", "a", None), [("user", "q"), ("assistant", "a")]),
])
def test_layouts_by_fingerprint(spark, schema, row, turns):
    df = spark.createDataFrame([row], schema)
    assert [(r.role, r.text) for r in chat_format.canonical_turns(df).orderBy("turn").collect()] == turns


def test_unknown_layout_and_json_rows(spark):
    with pytest.raises(ValueError):
        chat_format.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id int, blob string"))
    rows = [(1, '{"prompt":"p","completion":"c"}'), (2, '{"messages":[{"role":"user","content":"m"}]}'), (3, "not json"), (4, None)]
    got = chat_format.json_turns(spark.createDataFrame(rows, "conv_id int, payload string")).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.layout, r.role, r.text) for r in got] == [
        (1, "prompt_completion", "user", "p"), (1, "prompt_completion", "assistant", "c"), (2, "messages", "user", "m"), (3, None, None, None), (4, None, None, None)]


def test_native_operators_use_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat_format.format_digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- exact deduplication

@pytest.mark.parametrize("heavy", [1, 1024])
def test_exact_dedup(spark, heavy):
    texts = TEXTS + ["often"] * 300 + ["twice", "twice"]
    df = documents(spark, texts).repartition(5)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(df, heavy=heavy).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(same), len(same), i == max(same), sha(t or ""))
    kept = exact_dedup.drop_copies(df, heavy=heavy)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_exact_dedup_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a"), (7, "a"), (None, "a"), (None, "b")], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.kept) for r in exact_dedup.exact_dedup(df).collect()) == [(-1, False), (-1, True), (7, False), (7, True)]
    assert exact_dedup.drop_copies(df).count() == 2
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


# ---- decontamination

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "tiny item"), (3, None), (4, "--- !"), (5, "solo"),
         (6, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (7, "tiny item"), (8, "Ünï 中文 a1")]


def item_table(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, doc_id int")


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination_against_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu tiny item solo x".split()
    texts = TEXTS + [rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += ["pre " + ITEMS[0][1].upper() + " post " + ITEMS[5][1], "ünï-中文/A1", "Ünï 中文 a1", " ".join([ITEMS[0][1]] * 3)]
    got = {r.doc_id: r for r in decontaminate.report(documents(spark, texts), item_table(spark), block_bytes=block_bytes).collect()}
    for i, t in enumerate(texts):
        n, hit, found = contamination(t, ITEMS)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, hit, len(found), hit > 0), t
        assert got[i].items_sha256 == sha(",".join(sorted(map(str, found))))


def test_decontaminate_cuts_spans_and_keeps_clean_texts(spark):
    clean = "a perfectly clean text with many of its own words " * 3
    texts = [clean + ITEMS[0][1] + " end é", ITEMS[0][1], clean, None, ""]
    df = documents(spark, texts)
    out = decontaminate.decontaminate(df, item_table(spark))
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: clean + "  end é", 2: clean, 3: None, 4: ""}
    kept = decontaminate.decontaminate(df, item_table(spark), span_words=50, coverage=1.0).collect()
    assert {r.doc_id: r.text for r in kept} == dict(enumerate(texts))
    assert decontaminate.report(df.limit(0), item_table(spark)).count() == 0
    assert decontaminate.report(df, item_table(spark).limit(0)).where("contaminated").count() == 0


# ---- tokenisation

def tiktoken_encoding():
    import base64

    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward_texts(n=400):
    rng = random.Random(5)
    signs = list("abst rvelmd'  \n\t 　\x1c\x85éß1२中,.!_😀́ñL'S")
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["a" * 1000, "ab" * 400, " " * 700, "中" * 500, "".join(rng.choice("abcdefgh") for _ in range(2000))]


def test_pattern_is_the_public_one():
    assert pretokens.PATTERN == public_tokenizers.PATTERN


def test_byte_bpe_equals_the_library_and_decodes(spark):
    texts, library = TEXTS + awkward_texts(), tiktoken_encoding()
    df = documents(spark, texts)
    encoded = byte_bpe.encode(df, RANKS)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    assert ids == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(encoded, RANKS).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in byte_bpe.digests(df, RANKS).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), sha(",".join(map(str, ids[r.doc_id]))), sha(texts[r.doc_id] or ""))
    assert byte_bpe.digests(df.limit(0), RANKS).count() == 0


def test_word_cache_empties_itself():
    v = byte_bpe.vocabulary(RANKS)
    small, large = pretokens.WordCache(v.encode_words, 3), pretokens.WordCache(v.encode_words)
    for text in (b"one two", b"two three", b"one"):
        data = np.frombuffer(text, np.uint8)
        starts = pretokens.split_words(data, np.array([0, len(data)]))
        assert small.gather(small.lookup(data, starts))[0].tolist() == large.gather(large.lookup(data, starts))[0].tolist()


@pytest.mark.parametrize("most", [0, 3, 20])
def test_digests_survive_an_emptied_cache(spark, most):
    library, texts = tiktoken_encoding(), ["xqzv" * 30, "one two three", "four five six seven", "eight nine ten", "one ten", "zzqx" * 2000, *awkward_texts(30)]
    df = spark.createDataFrame([("\n".join(texts[:k + 1][-2:]), k) for k in range(len(texts))], "text string, doc_id bigint").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # each text is a slice
    try:
        got = byte_bpe.digests(df, RANKS, most=most).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(texts)
    for r in got:
        text = "\n".join(texts[:r.doc_id + 1][-2:])
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(text))


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000])
@pytest.mark.parametrize("high", [1, 3, 50_000, 2**32 - 1])
def test_segments_round_trip(n, high):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.integers(0, n, 3) if n else []] = 2**32 - 1
    packed = token_blocks.pack_segment(ids)
    assert (token_blocks.unpack_segment(packed) == ids).all() and len(token_blocks.unpack_segment(packed)) == n
    for k in range(-(-n // token_blocks.BLOCK)):
        assert (token_blocks.unpack_segment(packed, k) == ids[k * token_blocks.BLOCK:(k + 1) * token_blocks.BLOCK]).all()


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = TEXTS + awkward_texts(100) + ["<|endoftext|> inside"]
    df = documents(spark, texts).repartition(3)
    got = {r.id: r for r in token_blocks.read_segments(token_blocks.write_segments(df, path, 2)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts)
    assert token_blocks.read_segments(token_blocks.write_segments(df.limit(0), path, 2)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id bigint, text string")
    rows = token_blocks.read_segments(token_blocks.write_segments(twice, path, 2)).orderBy("start").collect()
    assert [(r.id, r.start) for r in rows] == [(None, 0), (1, 2), (1, 4)]


def test_token_query_equals_the_unmodified_library(spark, tmp_path):
    from tokenizers import Tokenizer

    from barflow.llm import queries
    t, end = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "<|endoftext|>"
    texts = TEXTS + awkward_texts(60) + [end, end * 3, f"a {end} b", f"one  {end}  two\n{end}\n", f"it'{end}s don't{end}", f"<|{end}|>", "<|endof", "text|> x", f" {end} ", f"é中{end}😀", f"<|endoftext{end}"]
    documents(spark, texts).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_token_blocks(spark, str(tmp_path)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)
    assert len(got) == len(texts) and t.encode(end, add_special_tokens=False).ids == [50256]


# ---- words that a polynomial hash confuses

def test_hashes_of_twin_words_differ():
    for n in (512, 1024, 4096):
        data = np.frombuffer("".join(twins(n)).encode(), np.uint8)
        h = textbytes.hash_runs(data, np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]
    data = np.frombuffer(b"abcdefgh" * 80, np.uint8)
    starts = np.array([0, 8, 3, 0, 0, 0, 0])
    ends = np.array([8, 16, 11, 7, 16, 0, 600])
    h = textbytes.hash_runs(data, starts, ends)
    assert h[0] == h[1] and len(set(h.tolist())) == 6


def test_word_cache_compares_bytes(monkeypatch):
    """With a hash that confuses all words of a length, ids stay those of the words."""
    monkeypatch.setattr(pretokens, "hash_runs", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    cache = pretokens.WordCache(lambda data, s, e: (np.concatenate([data[a:b] for a, b in zip(s, e)]).astype(np.int32), e - s))
    for text in (b"aa bb a aa", b"bb aa c cc bb"):
        data = np.frombuffer(text, np.uint8)
        starts = pretokens.split_words(data, np.array([0, len(data)]))
        ids, lens = cache.gather(cache.lookup(data, starts))
        assert bytes(ids.tolist()) == text and lens.sum() == len(text)


def test_tokenisers_tell_twin_words_apart(spark, tmp_path):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe
    from tokenizers import Tokenizer
    one, two = twins(1024)
    texts = [one, two, f"{two} {one}"]
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.digests(documents(spark, texts), RANKS).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t))
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, start = Tokenizer.from_file(path), 0
    written = token_blocks.write_segments(documents(spark, texts), path, end_id=2, added=True)
    got = {r.id: r for r in token_blocks.read_segments(written).collect()}
    for i, t in enumerate(texts):
        ids = other.encode(t, add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("block_bytes", [2 << 20, 20])
def test_contamination_of_twins_and_null_items(spark, block_bytes):
    one, two = twins(1024)
    texts = [two, f"x {one} y", "alpha beta gamma delta", "beta gamma", "alpha", None]
    items = [(7, one), (None, "alpha beta"), (5, "beta gamma"), (None, "delta"), (6, None), (8, ""), (9, "beta")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(documents(spark, texts), table, block_bytes=block_bytes).collect()}
    for i, t in enumerate(texts):
        n, hit, found = contamination(t, items)
        assert got[i] == (n, hit, len(found), sha(",".join(sorted(str(x) for x in found if x is not None))))
    assert got[0][2] == 0 and got[2][2] == 3
    clean = {r.doc_id: r.text for r in decontaminate.decontaminate(documents(spark, texts), table, coverage=1.0).collect()}
    assert clean[0] == two and clean[3].strip() == ""
