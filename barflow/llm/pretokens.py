"""Splitting of UTF-8 bytes by the public byte-level BPE pattern, and a bounded cache of encoded words.

``PATTERN`` is the pattern this module implements on byte arrays: contractions, optional-space runs of letters, digits or
other signs, and white space whose last character is left to the next run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from .textbytes import hash_runs

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
MOST = 1 << 22


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """Class of every Unicode code point."""
    table = np.zeros(0x110000, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):
        text = "".join(map(chr, range(first, last)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                table[first + m.start():first + m.end()] = kind
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    table = code_point_classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        d = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
        b0, b1, b2, b3 = d[lead], d[lead + 1] & 63, d[lead + 2] & 63, d[lead + 3] & 63
        two, three = b0 < 0xE0, b0 < 0xF0
        cp = np.where(two, (b0 & 31) << 6 | b1, np.where(three, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = table[np.minimum(cp, 0x10FFFF)]
        length = 2 + (b0 >= 0xE0).astype(np.int64) + (b0 >= 0xF0)
        for k in range(4):
            on = k < length
            at = lead[on] + k
            fit = at < len(data)
            out[at[fit]] = kind[on][fit]
    return out


def split_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches, which cover all bytes; matches never cross the row ``offsets``."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offsets] = True
    cut[0] = cut[n] = True
    row_edge = np.zeros(n + 1, bool)
    row_edge[offsets] = True
    row_edge[n] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    space = (kind[starts] == SPACE) & ~row_edge[ends]
    s, e = starts[space], ends[space]
    last = e - 1
    wide = np.flatnonzero(data[last] >= 0x80)
    while len(wide):  # back to the first byte of the run's last character
        step = (data[last[wide]] & 0xC0) == 0x80
        last[wide[step]] -= 1
        wide = wide[step]
    joins = data[last] == 0x20
    cut[last] = True
    cut[e[joins]] = False
    quote = (ends - starts == 1) & (data[starts] == 0x27) & cut[starts] & ~row_edge[ends]
    q = starts[quote]
    if len(q):
        pad = np.concatenate((data, np.zeros(2, np.uint8)))
        a, b = pad[q + 1], pad[q + 2]
        second = (q + 2 <= n - 1) & ~row_edge[np.minimum(q + 2, n)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = second & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        for on, k in ((one, 2), (two, 3)):
            cut[q[on] + 1] = False
            cut[q[on] + k] = True
    return np.flatnonzero(cut[:n])


class WordCache:
    """Ids of distinct words, found by hash and compared byte by byte; emptied when it holds more than ``most`` ids.

    Words whose hash another word has taken are kept by their bytes.  ``generation`` counts how often it was emptied: slots
    of an earlier generation name other words.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int = MOST) -> None:
        self.encode, self.most, self.generation = encode, most, 0
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.starts, self.lens = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.bytes, self.byte_starts, self.sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.others: dict[bytes, int] = {}

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """New slots of distinct words."""
        ids, lens = self.encode(data, starts, ends)
        slot, size = len(self.lens) + np.arange(len(starts)), ends - starts
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lens) - lens))
        self.lens = np.concatenate((self.lens, lens))
        self.ids = np.concatenate((self.ids, ids))
        self.byte_starts = np.concatenate((self.byte_starts, len(self.bytes) + np.cumsum(size) - size))
        self.sizes = np.concatenate((self.sizes, size))
        self.bytes = np.concatenate((self.bytes, data[spans(starts, size)]))
        return slot

    def _unlike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Which words differ from their slots' words."""
        size = ends - starts
        out = size != self.sizes[slots]
        same = np.flatnonzero(~out & (size > 0))
        if len(same):
            differ = data[spans(starts[same], size[same])] != self.bytes[spans(self.byte_starts[slots[same]], size[same])]
            if differ.any():
                out[same] = np.logical_or.reduceat(differ, np.cumsum(size[same]) - size[same])
        return np.flatnonzero(out)

    def lookup(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Slot of each word; ``starts``, ``lens`` and ``ids`` hold a slot's ids."""
        if len(self.ids) > self.most:
            self.clear()
            self.generation += 1
        ends = np.append(starts[1:], len(data))
        found, first, inverse = np.unique(hash_runs(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, found)
        place[place == len(self.hashes)] = 0
        known = self.hashes[place] == found if len(self.hashes) else np.zeros(len(found), bool)
        slot = np.empty(len(found), np.int64)
        slot[known] = self.slots[place[known]] if len(self.hashes) else 0
        new = np.flatnonzero(~known)
        if len(new):
            slot[new] = self._add(data, starts[first[new]], ends[first[new]])
            where = np.searchsorted(self.hashes, found[new])
            self.hashes = np.insert(self.hashes, where, found[new])
            self.slots = np.insert(self.slots, where, slot[new])
        out = slot[inverse]
        for i in self._unlike(data, starts, ends, out).tolist():
            word = data[starts[i]:ends[i]].tobytes()
            if word not in self.others:
                self.others[word] = int(self._add(data, starts[i:i + 1], ends[i:i + 1])[0])
            out[i] = self.others[word]
        return out

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in order, and the number of ids of each word."""
        lens = self.lens[slots]
        return self.ids[spans(self.starts[slots], lens)], lens


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.arange(total) + np.repeat(starts - before, lens)
