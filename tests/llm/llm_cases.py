"""Small tables and brute-force counterparts for the training-data operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [None, "", "   \n", "a", "one two three four", "The same text, twice over and over again.", "The same text, twice over and over again.", LONG, LONG + "x",
         "naïve café — 中文字符 ١٢٣ 😀", "'s don't we'll I'VE \t\t tab  two", "<|im_end|> <\\| control"]


def documents(spark, texts=None, extra=True):
    """(doc_id, text, lang, source, n_chars) and, with ``extra``, columns whose names operators use inside."""
    texts = TEXTS if texts is None else texts
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _score int, _hits string")
    return df if extra else df.drop("_score", "_hits")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(texts, ids):
    """{id: (set size, smallest linked id)}."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], d)
    return {d: (len(sets[i]), least[find(i)]) for i, d in enumerate(ids)}


def repeats(texts, length=200):
    """(bytes, removed bytes, removed runs, rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def contamination(text, items, window=10):
    """(words, hit words, item ids found) of a text."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, found = pattern.findall(lower(text)), set(), set()
    for item, t in items:
        v = pattern.findall(lower(t))
        n = min(len(v), window)
        windows = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i:i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), found


def twins(n):
    """Two words of n letters that polynomial hashes modulo 2 ** 64 confuse, whatever their base."""
    sign = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[s] for s in sign), "".join("ba"[s] for s in sign)
