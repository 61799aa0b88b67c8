"""Token ids in files of patched frame-of-reference blocks.

A segment holds the ids of whole documents in ascending id order, each followed by the end id.  Its ids are cut into
blocks of ``BLOCK``; a block stores its minimum, the differences to it packed at a width chosen among percentiles of their
bit lengths (whichever is smallest in all), and the positions and values of the exceptions that the width cannot hold.
Layout of a segment, little-endian: b"PFR1", count u32, block size u32, number of blocks u32, block starts u32 each
(offsets into the segment), blocks.  Layout of a block: minimum u32, width u8, exceptions u16, packed bits, exception
positions u16 each, exception differences u32 each.

Documents are dealt by ranges of their id, so files follow the ids and a task holds one segment at a time.  Segments are
rows of a Parquet folder in the shared store, because the store may be one that only Spark's writers reach; Spark commits
them task by task, so lost executors cost their own tasks only.  Positions over all files come from one sum per range.

With ``added`` the library's added tokens (such as ``<|endoftext|>``) are cut out of the texts first and give their own
ids, as the library does by default; without it they are ordinary text.

Null texts count as empty and hold the end id alone.  Rows that share an id are ordered by text.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import stored
from .pretokens import WordCache, split_words
from .textbytes import slices

BLOCK = 1024
SEGMENT = 1 << 16
PERCENTILES = (90, 95, 99, 100)
JOINED = 512  # words that are encoded in one call


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    if width % 8 == 0:
        return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(len(values), -1, 4)[:, :, :width // 8].reshape(len(values), -1)
    bits = (values[:, :, None] >> np.arange(width, dtype=np.uint32) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    if width % 8 == 0:
        wide = np.zeros((len(rows), n, 4), np.uint8)
        wide[:, :, :width // 8] = rows.reshape(len(rows), n, width // 8)
        return wide.reshape(len(rows), -1).view("<u4").astype(np.uint32)
    bits = np.unpackbits(rows, axis=1, count=n * width, bitorder="little").reshape(len(rows), n, width)
    out = np.zeros((len(rows), n), np.uint32)
    for k in range(width):
        out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def pack_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The bytes of a segment; ``block`` is a multiple of 8 and at most 65,528."""
    ids = np.asarray(ids, np.uint32)
    n = -(-len(ids) // block)
    head = b"PFR1" + struct.pack("<III", len(ids), block, n)
    if not n:
        return head
    grid = np.full(n * block, ids[-1], np.uint32)
    grid[:len(ids)] = ids
    grid = grid.reshape(n, block)
    low = grid.min(axis=1)
    delta = grid - low[:, None]
    order = np.sort(delta, axis=1)
    widths = np.stack([_bits(order[:, min(block - 1, -(-block * p // 100) - 1)]) for p in PERCENTILES])
    over = np.stack([(delta >= (np.uint64(1) << w.astype(np.uint64))[:, None]).sum(axis=1) for w in widths])
    pick = (widths * (block // 8) + over * 6).argmin(axis=0)
    width, count = widths[pick, np.arange(n)], over[pick, np.arange(n)]
    held = delta < (np.uint64(1) << width.astype(np.uint64))[:, None]
    packed = {}
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed |= dict(zip(rows.tolist(), _pack(np.where(held[rows], delta[rows], 0), int(w))))
    blocks, at, starts = [], len(head) + 4 * n, []
    for i in range(n):
        where = np.flatnonzero(~held[i])
        b = struct.pack("<IBH", int(low[i]), int(width[i]), int(count[i])) + (packed[i].tobytes() if width[i] else b"")
        b += where.astype("<u2").tobytes() + delta[i, where].astype("<u4").tobytes()
        starts.append(at)
        at += len(b)
        blocks.append(b)
    return head + np.array(starts, "<u4").tobytes() + b"".join(blocks)


def unpack_segment(segment: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a segment, or of its block number ``only``."""
    if segment[:4] != b"PFR1":
        raise ValueError("not a token segment")
    total, block, n = struct.unpack_from("<III", segment, 4)
    if not n:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(segment, "<u4", n, 16)
    chosen = range(n) if only is None else [only]
    data = np.frombuffer(segment, np.uint8)
    out = np.zeros((len(chosen), block), np.uint32)
    low, width, count = (np.empty(len(chosen), np.int64) for _ in range(3))
    for row, i in enumerate(chosen):
        low[row], width[row], count[row] = struct.unpack_from("<IBH", segment, int(starts[i]))
    first = starts[list(chosen)].astype(np.int64) + 7
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        out[rows] = _unpack(data[first[rows][:, None] + np.arange(block * int(w) // 8)], int(w), block)
    for row in np.flatnonzero(count):
        at, k = int(first[row] + block * width[row] // 8), int(count[row])
        out[row, np.frombuffer(segment, "<u2", k, at)] = np.frombuffer(segment, "<u4", k, at + 2 * k)
    out += low.astype(np.uint32)[:, None]
    flat = out.reshape(-1)
    if only is not None:
        return flat[:min(block, total - only * block)]
    return flat[:total]


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # added tokens are cut out before, or are ordinary text
    return t


@lru_cache(2)
def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokenizer's added tokens, which may stand anywhere in a text."""
    found = _tokenizer(path).get_added_tokens_decoder()
    if any(a.single_word or a.lstrip or a.rstrip or not a.special for a in found.values()):
        raise ValueError("only special added tokens without single_word, lstrip and rstrip are supported")
    return {a.content: i for i, a in found.items() if a.content}


def split_with_added(data: np.ndarray, offsets: np.ndarray, added: dict[str, int]) -> np.ndarray:
    """Starts of the words of ``split_words``; each added token is a word of its own, the leftmost longest first."""
    if not added:
        return split_words(data, offsets)
    raw, pattern = data.tobytes(), re.compile(b"|".join(re.escape(x.encode()) for x in sorted(added, key=len, reverse=True)))
    if not pattern.search(raw):
        return split_words(data, offsets)
    found = np.array([m.span() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for m in pattern.finditer(raw, lo, hi)], np.int64).reshape(-1, 2)
    starts = split_words(data, np.union1d(offsets, found))
    if not len(found):
        return starts
    last = np.maximum(np.searchsorted(found[:, 0], starts, side="right") - 1, 0)
    return starts[(starts <= found[last, 0]) | (starts >= found[last, 1])]


def library_words(path: str, added: bool = False):
    """Encoder of distinct words by the tokenizers library; with ``added``, a word that is an added token has its id.

    A word that begins with one space and has no other white space can follow another such word without changing where
    the library splits, so many are encoded in one call and told apart by their word numbers.
    """
    def encode(data, starts, ends):
        t, own = _tokenizer(path), added_tokens(path) if added else {}
        words = [data[s:e].tobytes().decode() for s, e in zip(starts.tolist(), ends.tolist())]
        plain = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace() and w[1:].isalpha() and w not in own]
        ids: list[list[int]] = [[own[w]] if w in own else [] for w in words]
        alone = {i for i, w in enumerate(words) if w not in own}.difference(plain)
        groups = [plain[k:k + JOINED] for k in range(0, len(plain), JOINED)]
        for group, e in zip(groups, t.encode_batch(["".join([words[i] for i in g]) for g in groups], add_special_tokens=False) if groups else []):
            numbers = e.word_ids
            if numbers[-1] != len(group) - 1:
                alone.update(group)
                continue
            for k, x in zip(numbers, e.ids):
                ids[group[k]].append(x)
        alone = sorted(alone)
        for i, e in zip(alone, t.encode_batch([words[i] for i in alone], add_special_tokens=False) if alone else []):
            ids[i] = e.ids
        return np.array([x for w in ids for x in w], np.int32), np.array([len(w) for w in ids], np.int64)
    return encode


@lru_cache(1)
def _cache(path: str, added: bool) -> WordCache:
    """Encoded words of this Python worker, shared by the tasks that it runs one after another."""
    return WordCache(library_words(path, added))


def write_segments(docs: DataFrame, path: str, end_id: int, text: str = "text", id_col: str = "doc_id", block: int = BLOCK,
                   added: bool = False) -> DataFrame:
    """Encode, pack and write all documents; gives the written segments.

    Rows: part and first (position of the segment's first id within the part), ids (of the documents), counts, segment.
    """
    def run(batches):
        cache, part, first = _cache(path, added), TaskContext.get().partitionId(), 0
        own = added_tokens(path) if added else {}
        names, counts, held, size = [], [], [], 0

        def row():
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())),
                                    pa.array([pack_segment(np.concatenate(held), block)], pa.binary())], ["part", "first", "ids", "counts", "segment"])
        for b in batches:
            kind = b.column(0).type
            keys = b.column(0).to_pylist()
            for lo, hi, data, offsets in slices(b.column(1)):
                starts = split_with_added(data, offsets, own)
                ids, lens = cache.gather(cache.lookup(data, starts)) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                cut = np.append(0, np.cumsum(lens))[np.searchsorted(starts, offsets)]
                for i in range(hi - lo):
                    names.append(keys[lo + i])
                    counts.append(int(cut[i + 1] - cut[i]) + 1)
                    held += [ids[cut[i]:cut[i + 1]].astype(np.uint32), np.array([end_id], np.uint32)]
                    size += counts[-1]
                    if size >= SEGMENT:
                        yield row()
                        first, names, counts, held, size = first + size, [], [], [], 0
        if names:
            yield row()
    key, value = F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")
    dealt = docs.select(key, value).repartitionByRange("id").sortWithinPartitions("id", "text")
    kind_name = dealt.schema["id"].dataType.simpleString()
    return stored(dealt.mapInArrow(run, f"part int, first bigint, ids array<{kind_name}>, counts array<bigint>, segment binary"), "token_blocks")


def read_segments(segments: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the written segments."""
    parts = segments.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of ids
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                counts = np.asarray(b.column(1)[k].as_py(), np.int64)
                ids = unpack_segment(b.column(2)[k].as_py()).astype("<u4")
                at = np.append(0, np.cumsum(counts))
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.record_batch([b.column(0)[k].values, pa.array(at[:-1] + b.column(3)[k].as_py()), pa.array(counts), pa.array(crc, pa.int64())],
                                      ["id", "start", "n_tokens", "ids_crc32"])
    placed = segments.join(F.broadcast(parts), "part").select("ids", "counts", "segment", (F.col("first") + F.col("base")).alias("at"))
    kind = segments.schema["ids"].dataType.elementType.simpleString()
    return placed.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
