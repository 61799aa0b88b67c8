"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Texts are split by the public pattern; each distinct word of a slice is encoded once.  Words are put into matrices by
length class, one word a row, padded.  In each round every row merges its leftmost pair of least rank, found in a hash
table of pairs; finished rows leave the matrix and the rest is compacted.  Words of over ``LONG`` bytes merge all
occurrences of the least pair in one round where that equals merging them one by one.

Null texts count as empty and have no ids.  Any bytes can be encoded, and decoding gives them back.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import MOST, WordCache, spans, split_words
from .textbytes import hash_runs, slices

NONE = np.int32(2**31 - 1)
LONG = 256
MATRIX = 1 << 18  # cells of one matrix
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Byte strings by rank, and the hash table of the pairs that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.lens = np.array([len(t) for t in self.tokens], np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts = np.cumsum(self.lens) - self.lens
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keep = np.flatnonzero(self.lens)
        h = hash_runs(self.blob, self.starts[keep], self.starts[keep] + self.lens[keep])
        order = np.argsort(h)
        self.word_hash, self.word_id = h[order], keep[order].astype(np.int32)
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        keys, values = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32)
        self.early = np.zeros(size, bool)  # tokens that form a pair ranking before themselves
        for part in (keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)):
            self.early[part[values < part].astype(np.int64)] = True
        self.shift = np.uint64(64 - int(np.ceil(np.log2(max(len(keys), 2) * 3))))
        self.keys = np.full(1 << int(64 - self.shift), np.uint64(2**64 - 1))
        self.values = np.full(len(self.keys), NONE)
        self.mask = len(self.keys) - 1
        at = (keys * _MUL >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):  # one key takes a free slot in each pass, the others move on
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            slot, first = np.unique(at[left[free]], return_index=True)
            took = left[free][first]
            self.keys[slot], self.values[slot] = keys[took], values[took]
            left = np.setdiff1d(left, took, assume_unique=True)
            at[left] = np.where(self.keys[at[left]] == np.uint64(2**64 - 1), at[left], (at[left] + 1) & self.mask)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that the pair merges to, or NONE; negative ids are padding."""
        out = np.full(a.shape, NONE)
        ask = np.flatnonzero(((a | b) >= 0).ravel())
        key = a.ravel()[ask].astype(np.uint64) << np.uint64(32) | b.ravel()[ask].astype(np.uint64)
        at = (key * _MUL >> self.shift).astype(np.int64)
        flat = out.ravel()
        while len(ask):
            found = self.keys[at]
            hit = found == key
            flat[ask[hit]] = self.values[at[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            ask, key, at = ask[more], key[more], (at[more] + 1) & self.mask
        return out

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        n, size = len(starts), ends - starts
        h = hash_runs(data, starts, ends)
        at = np.minimum(np.searchsorted(self.word_hash, h), len(self.word_hash) - 1)
        whole = self.word_hash[at] == h
        lens = np.ones(n, np.int64)
        rest = np.flatnonzero(~whole)
        parts, owners = [self.word_id[at[whole]]], [np.flatnonzero(whole)]
        width = np.maximum(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), 4)
        for w in np.unique(width[rest]):
            rows = rest[width[rest] == w]
            if w > LONG:
                for r in rows:
                    ids = self._long(self.single[data[starts[r]:ends[r]]])
                    lens[r] = len(ids)
                    parts.append(ids)
                    owners.append(np.array([r]))
                continue
            for lo in range(0, len(rows), max(1, MATRIX // int(w))):
                some = rows[lo:lo + max(1, MATRIX // int(w))]
                self._matrix(data, starts[some], size[some], some, int(w), lens, parts, owners)
        owner = np.concatenate(owners)
        ids = np.concatenate(parts)
        begin = np.empty(n, np.int64)
        begin[owner] = np.cumsum(lens[owner]) - lens[owner]
        return ids[spans(begin, lens)], lens

    def _matrix(self, data, starts, size, rows, width, lens, parts, owners) -> None:
        column = np.arange(width)
        inside = column < size[:, None]
        m = np.full((len(rows), width), -1, np.int32)
        m[inside] = self.single[data[(starts[:, None] + column)[inside]]]
        rank = np.full((len(rows), width), NONE)
        rank[:, :-1] = self.rank(m[:, :-1], m[:, 1:])
        n = size.copy()
        while len(rows):
            j = rank.argmin(axis=1)
            line = np.arange(len(rows))
            best = rank[line, j]
            done = best == NONE
            if done.any():
                lens[rows[done]] = n[done]
                parts.append(m[done][column[:m.shape[1]] < n[done][:, None]])
                owners.append(rows[done])
                keep = ~done
                rows, n, m, rank, j, best = rows[keep], n[keep], m[keep], rank[keep], j[keep], best[keep]
                if not len(rows):
                    return
                line = np.arange(len(rows))
                w = int(n.max())
                m, rank = m[:, :w], rank[:, :w]
            w = m.shape[1]
            source = np.minimum(column[:w] + (column[:w] > j[:, None]), w - 1)
            m[line, j] = best
            m = np.take_along_axis(m, source, 1)
            rank = np.take_along_axis(rank, source, 1)
            n = n - 1
            m[line, n] = -1
            rank[line, n] = NONE
            rank[line, n - 1] = NONE
            right = np.minimum(j + 1, w - 1)
            has = j + 1 < n
            rank[line[has], j[has]] = self.rank(m[line[has], j[has]], m[line[has], right[has]])
            has = j > 0
            rank[line[has], j[has] - 1] = self.rank(m[line[has], j[has] - 1], m[line[has], j[has]])

    def _long(self, ids: np.ndarray) -> np.ndarray:
        rank = self.rank(ids[:-1], ids[1:])
        while len(rank):
            best = int(rank.min())
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            if self.early[best]:
                at = at[:1]
            elif len(at) > 1:  # of overlapping occurrences every other one merges, from the left
                group = np.cumsum(np.append(True, np.diff(at) > 1))
                first = np.flatnonzero(np.append(True, np.diff(group) > 0))
                at = at[(np.arange(len(at)) - first[group - 1]) % 2 == 0]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
            rank = np.delete(rank, np.minimum(at + 1, len(rank) - 1) if at[-1] + 1 < len(rank) else at[:-1] + 1)
            rank = rank[:len(ids) - 1]
            now = at - np.arange(len(at))
            for p in (now[now > 0] - 1, now[now < len(ids) - 1]):
                rank[p] = self.rank(ids[p], ids[p + 1])
        return ids

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, number of bytes of each id)."""
        lens = self.lens[ids]
        return self.blob[spans(self.starts[ids], lens)], lens


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded_slices(texts: pa.Array, cache: WordCache) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last, slots of the words, first word of each row, ids, first id of each row) for slices of texts."""
    for lo, hi, data, offsets in slices(texts):
        starts = split_words(data, offsets)
        slots = cache.lookup(data, starts) if len(starts) else np.zeros(0, np.int64)
        ids, lens = cache.gather(slots)
        words = np.searchsorted(starts, offsets)
        yield lo, hi, slots, words, ids, np.append(0, np.cumsum(lens))[words]


def encode(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of each row."""
    def run(batches):
        cache = WordCache(vocabulary(path).encode_words)
        for b in batches:
            for lo, hi, _, _, ids, first in encoded_slices(b.column(1), cache):
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))],
                                      [id_col, "ids"])
    d = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    return d.mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id, bytes binary) of each row of ids; null ids give null."""
    def run(batches):
        v = vocabulary(path)
        for b in batches:
            col = b.column(1)
            out = [None if x is None else v.decode(np.asarray(x, np.int64))[0].tobytes() for x in
                   (None if not s.is_valid else s.values.to_numpy(zero_copy_only=False) for s in col)]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])
    d = encoded.select(F.col(f"`{id_col}`"), F.col(f"`{ids}`"))
    return d.mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", most: int = MOST) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): ids are digested, then decoded and the bytes digested; words of over ``most`` ids are not kept."""
    def run(batches):
        v = vocabulary(path)
        cache, names, generation = WordCache(v.encode_words, most), [], 0
        for b in batches:
            for lo, hi, slots, words, ids, first in encoded_slices(b.column(1), cache):
                if generation != cache.generation:
                    names, generation = [], cache.generation
                if len(names) < len(cache.lens):
                    k = len(names)
                    known, begin, end = cache.ids.tolist(), cache.starts[k:].tolist(), (cache.starts[k:] + cache.lens[k:]).tolist()
                    names += [",".join(map(str, known[s:e])).encode() for s, e in zip(begin, end)]
                back, lens = v.decode(ids)
                byte = np.append(0, np.cumsum(lens))[first]
                back, slots = back.tobytes(), slots.tolist()
                a, c = [], []
                for i in range(hi - lo):
                    a.append(hashlib.sha256(b",".join(map(names.__getitem__, slots[words[i]:words[i + 1]]))).hexdigest())
                    c.append(hashlib.sha256(back[byte[i]:byte[i + 1]]).hexdigest())
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(a, pa.string()), pa.array(c, pa.string())],
                                      [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
    d = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    return d.mapInArrow(run, f"`{id_col}` {d.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
