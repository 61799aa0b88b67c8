"""Document statistics from whole texts, over slices of UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from .textbytes import hash_runs, mix, odd_constants, runs

LOWER, UPPER, DIGIT, SPACE, NEWLINE, PUNCT, SYMBOL, SHOUT, INNER = range(9)
_KIND = np.full(256, SYMBOL, np.uint8)
_KIND[97:123] = LOWER
_KIND[65:91] = UPPER
_KIND[48:58] = DIGIT
_KIND[[9, 11, 12, 13, 32]] = SPACE
_KIND[10] = NEWLINE
_KIND[[ord(c) for c in ".,;:'\"-()"]] = PUNCT
_KIND[[ord(c) for c in "!?"]] = SHOUT
_KIND[0x80:0xC0] = INNER
_KIND[0xC0:] = LOWER
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
_STEP = odd_constants(4, 101)

QUALITY_FEATURES = ("size", "words", "word_length", "word_spread", "upper", "digits", "punctuation", "symbols", "shouts", "marked_words",
                    "bare_symbols", "lines", "new_words", "top_word", "repeated_next", "repeated_triples", "repeated_lines", "capitalised")


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each kind in each row; accented capitals of the Latin-1 range count as upper case."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    kind = _KIND[data]
    c3 = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    kind[c3[(data[c3 + 1] >= 0x80) & (data[c3 + 1] <= 0x9E)]] = UPPER
    return np.bincount(row * 9 + kind, minlength=9 * n).reshape(n, 9)


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct keys of each row, and the count of its most frequent key."""
    with np.errstate(over="ignore"):
        _, first, count = np.unique(mix(keys + rows.astype(np.uint64) * _STEP[3]), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, rows[first], count)
    return np.bincount(rows[first], minlength=n), most


def quality_matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row a text, columns as QUALITY_FEATURES.

    Shares are log-odds of counts smoothed towards a usual value with the weight of about 40 characters or 8 words, so
    short and empty texts lie near the usual values.
    """
    n = len(offsets) - 1
    count = byte_counts(data, offsets).astype(np.float64)
    chars = count.sum(axis=1) - count[:, INNER]
    white = (data == 32) | ((data >= 9) & (data <= 13))
    starts, ends = runs(~white, offsets)
    cut = np.searchsorted(starts, offsets)
    words = np.diff(cut)
    row = np.repeat(np.arange(n), words)
    low = LOWERED[data]
    h = hash_runs(low, starts, ends)
    inner = np.append(0, np.cumsum((data & 0xC0) == 0x80))
    length = (ends - starts - (inner[ends] - inner[starts])).astype(np.float64)
    mean = np.bincount(row, length, n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, length ** 2, n) / np.maximum(words, 1) - mean ** 2, 0))
    last, first = _KIND[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8), _KIND[data[starts]] if len(starts) else np.zeros(0, np.uint8)
    marked = np.bincount(row, (last == SYMBOL) | (last == SHOUT), n)
    bare = np.bincount(row, (length == 1) & (last == SYMBOL), n)
    capital = np.bincount(row, first == UPPER, n)
    distinct, most = _distinct(h, row, n)
    same = np.zeros(len(h), bool)
    triple, triple_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    if len(h) > 2:
        with np.errstate(over="ignore"):
            triple = h[:-2] * _STEP[0] + h[1:-1] * _STEP[1] + h[2:] * _STEP[2]
        keep = row[2:] == row[:-2]
        triple, triple_row = triple[keep], row[:-2][keep]
    triples = np.bincount(triple_row, minlength=n)
    new_triples, _ = _distinct(triple, triple_row, n)
    line_s, line_e = runs(data != 10, offsets)
    line_row = np.searchsorted(offsets, line_s, side="right") - 1
    lines = np.bincount(line_row, minlength=n)
    new_lines, _ = _distinct(hash_runs(data, line_s, line_e), line_row, n)

    def share(part, whole, usual, weight):
        p = (part + usual * weight) / (whole + weight)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p) - np.log1p(-p)
    letters = count[:, LOWER] + count[:, UPPER]
    w = words.astype(np.float64)
    return np.column_stack([
        np.log1p(chars), np.log1p(w), np.log((mean * w + 40) / (w + 8)), np.log1p(spread),
        share(count[:, UPPER], letters, .03, 40), share(count[:, DIGIT], chars, .005, 40), share(count[:, PUNCT], chars, .03, 40),
        share(count[:, SYMBOL], chars, .005, 40), share(count[:, SHOUT], chars, .005, 40), share(marked, w, .02, 8), share(bare, w, .01, 8),
        share(lines, w, .04, 8), share(distinct, w, .8, 8), share(most, w, .1, 8), share(np.bincount(row, same, n), w, .02, 8),
        share(triples - new_triples, triples, .02, 8), share(lines - new_lines, lines, .05, 2), share(capital, w, .1, 8)])
