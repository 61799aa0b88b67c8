"""Removal of repeated 200-byte strings by sparse distributed prefix doubling.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts anywhere else.  Ranks are fingerprints of
growing strings; in each round Spark sorts (rank, position) rows, positions of a unique rank leave, the others go on with
the rank of a longer string, until a rank is unique or its string is past the threshold.  Full prefix doubling keeps every
position of the corpus in every round; here rounds keep *anchors* only:

1. Every window of ``LENGTH`` bytes contains ``LENGTH - GRAM + 1`` strings of ``GRAM`` bytes; the one of least fingerprint
   (the first of ties) is the window's anchor.  Equal windows have equal anchors at equal places.  About one position in
   55 is an anchor; each owns a run of windows.  Anchors are ranked by their ``GRAM`` bytes; unique ones leave, as then
   all windows that they own are unique.
2. The rest are ranked by their whole context, all bytes that their windows can reach.  Of equal contexts all windows are
   repeated, and one anchor goes on as their representative.
3. For anchors of unique contexts and these representatives every owned window is ranked by its own ``LENGTH`` bytes.
   A class of at most ``HOT`` anchors is one group of a sorted stream; larger ones are counted with partial sums.

Texts are UTF-8 bytes; null counts as empty; matches never cross documents; strings are judged on the input.  Rows are
told apart by a 64-bit hash of id and text, so rows that repeat both are one document that occurs twice.  A window's rank
is its 64-bit fingerprint mixed with its anchor's rank and place.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import stored
from .pretokens import spans
from .textbytes import BYTE_VALUE, mix, odd_constants, row_of, slices

LENGTH = 200
GRAM = 64
HOT = 1 << 15
_STEP = odd_constants(6, 401)
_BASE = int(_STEP[0])
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n at least."""
    if len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 2**64)
        for k, base in enumerate((_BASE, inverse)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS


class Fingerprints:
    """Fingerprints of any byte range from prefix sums."""

    def __init__(self, data: np.ndarray) -> None:
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * power[:len(data)], out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.inverse[s])

    def grams(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[:len(self.sums) - k])


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    m, width = h, 1
    while width * 2 <= w:
        m, width = np.minimum(m[:-width], m[width:]), width * 2
    return np.minimum(m[:len(m) - (w - width)], m[w - width:]) if width < w else m


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first owned window, last owned window, rank, context rank) for the rows of a slice."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    w = length - gram + 1
    f = Fingerprints(data)
    h = f.grams(gram)
    m = _window_minima(h, w)
    n = len(m)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = (m[1:] < m[:-1]) | (h[:n - 1] == m[:-1])
    entered = np.zeros(n + 1, bool)
    entered[1:n] = m[1:] < m[:-1]
    row_start, row_stop = offsets[:-1], offsets[1:] - length + 1  # windows of a row: [start, stop)
    fit = row_stop > row_start
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, row_start[fit], 1)
    np.add.at(inside, row_stop[fit], -1)
    inside = np.cumsum(inside[:n]) > 0
    edge[row_start[fit]] = True
    entered[row_start[fit]] = False
    first = np.flatnonzero(edge[:n] & inside)
    stop = np.zeros(n + 1, bool)
    stop[:n] = edge[:n] | ~inside
    stop[n] = True
    ends = np.flatnonzero(stop)
    last = ends[np.searchsorted(ends, first, side="right")] - 1
    at = first + w - 1
    look = np.flatnonzero(~entered[first])
    for lo in range(0, len(look), 4096):
        some = look[lo:lo + 4096]
        at[some] = first[some] + h[first[some][:, None] + np.arange(w)].argmin(axis=1)
    row = row_of(at, offsets)
    s, e = np.maximum(at - (w - 1), offsets[row]), np.minimum(at + length, offsets[row + 1])
    context = mix(f.of(s, e) + (at - s).astype(np.uint64) * _STEP[1] + (e - at).astype(np.uint64) * _STEP[2])
    return at, first, last, h[at], context


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(rank, context, key, at, n): ``at`` packs position, and first and last owned window as distances before it.

    Anchors of one context within a slice go on as one row with their number ``n``; the others are known to be repeated
    and get a rank of their own with n = 2, so common lines do not gather in one group.
    """
    def run(batches):
        for b in batches:
            keys = np.asarray(b.column(0))
            for lo, hi, data, offsets in slices(b.column(1)):
                at, first, last, rank, context = anchors(data, offsets, length, gram)
                row = row_of(at, offsets)
                own = at - offsets[row] << 20 | (at - last) << 10 | (at - first)
                key = keys[lo + row]
                _, one, count = np.unique(mix(rank + context * _STEP[5]), return_index=True, return_counts=True)
                n = np.full(len(at), 2)
                n[one] = count
                alone = np.ones(len(at), bool)
                alone[one] = False
                rank[alone] = mix(mix(key[alone].view(np.uint64)) + own[alone].astype(np.uint64))
                yield pa.record_batch([pa.array(rank.view(np.int64)), pa.array(context.view(np.int64)), pa.array(key), pa.array(own), pa.array(n)],
                                      ["rank", "context", "key", "at", "n"])
    return docs.mapInArrow(run, "rank bigint, context bigint, key bigint, at bigint, n bigint")


def _window_ranks(joined: DataFrame, length: int) -> DataFrame:
    """For (text, list of anchors): one row an anchor with the ranks of its owned windows, nearest first."""
    def run(batches):
        for b in batches:
            lists = b.column(2)
            count = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            rank, at, size, judged = (np.asarray(flat.field(i)) for i in range(4))
            begin = np.cumsum(count) - count
            keys = np.asarray(b.column(0))
            for lo, hi, data, offsets in slices(b.column(1)):
                pick = slice(begin[lo], begin[hi - 1] + count[hi - 1])
                row = np.repeat(np.arange(hi - lo), count[lo:hi])
                near, far = at[pick] >> 10 & 1023, at[pick] & 1023
                n = far - near + 1
                f = Fingerprints(data)
                back = spans(near, n)
                s = np.repeat((at[pick] >> 20) + offsets[row], n) - back
                w = mix(f.of(s, s + length) + back.astype(np.uint64) * _STEP[3] + np.repeat(rank[pick].view(np.uint64), n) * _STEP[4])
                first = np.append(0, np.cumsum(n)) * 8
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(w)])
                yield pa.record_batch([pa.array(rank[pick]), pa.array(keys[lo + row]), pa.array(at[pick]), pa.array(size[pick]), pa.array(judged[pick]), blob],
                                      ["rank", "key", "at", "size", "judged", "windows"])
    return joined.mapInArrow(run, "rank bigint, key bigint, at bigint, size bigint, judged boolean, windows binary")


def _covered(key, at, near, hit, n, length) -> pa.RecordBatch:
    """Byte ranges covered by repeated windows; ``hit`` has one flag a window, ``n`` windows an anchor."""
    back = spans(near, n)
    start = np.repeat(at >> 20, n) - back
    owner = np.repeat(np.arange(len(n)), n)
    run = hit & np.append(True, ~hit[:-1] | (owner[1:] != owner[:-1]))[:len(hit)]  # first window of a run, which has the last start
    stop = hit & np.append(~hit[1:] | (owner[1:] != owner[:-1]), True)[:len(hit)]
    return pa.record_batch([pa.array(key[owner[run]]), pa.array(start[stop]), pa.array(start[run] + length)], ["key", "s", "e"])


def _repeated_windows(windows: DataFrame, length: int) -> DataFrame:
    """(key, s, e) of repeated windows, from rows sorted by rank; holds one class of anchors at a time."""
    def judge(t: pa.Table):
        blob = t.column("windows").combine_chunks()
        n = np.diff(np.frombuffer(blob.buffers()[1], np.int32)[blob.offset:blob.offset + len(blob) + 1]).astype(np.int64) // 8
        begin = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset] if len(blob) else 0
        w = np.frombuffer(blob.buffers()[2], np.uint64, int(n.sum()), int(begin)) if len(blob) else np.zeros(0, np.uint64)
        _, group, count = np.unique(w, return_inverse=True, return_counts=True)
        judged = np.asarray(t.column("judged").combine_chunks())
        hit = (count[group] > 1) & np.repeat(judged, n)
        at = np.asarray(t.column("at").combine_chunks())
        return _covered(np.asarray(t.column("key").combine_chunks()), at, at >> 10 & 1023, hit, n, length)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rank = np.asarray(b.column(0))
            cut = int(np.searchsorted(rank, rank[-1]))
            if held and rank[0] == rank[-1] and held[0].column(0)[0].as_py() == rank[0]:
                held.append(b)
                continue
            if cut or held:
                first = int(np.searchsorted(rank, rank[0], side="right")) if held and held[0].column(0)[0].as_py() == rank[0] else 0
                cut = max(cut, first)
                yield judge(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = [b.slice(cut)] if cut < b.num_rows else []
        if held:
            yield judge(pa.Table.from_batches(held))
    d = windows.repartition("rank").sortWithinPartitions("rank")
    return d.mapInArrow(run, "key bigint, s bigint, e bigint")


def _hot_windows(windows: DataFrame, length: int) -> DataFrame:
    """(key, s, e) of repeated windows of very large classes, with partial counts by window."""
    places = F.sequence(F.lit(0), (F.octet_length("windows") / 8).cast("int") - 1)
    w = windows.select("key", "at", "judged", "windows", F.explode(places).alias("i"))
    w = w.select("key", "at", "judged", "i", F.substring("windows", F.col("i") * 8 + 1, F.lit(8)).alias("w"))
    often = w.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w")
    start = F.shiftright("at", 20) - (F.shiftright("at", 10).bitwiseAND(1023) + F.col("i"))
    return w.where("judged").join(often, "w", "left_semi").select("key", start.alias("s"), (start + length).alias("e"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, ranges) for (key, text): sorted byte ranges covered by repeated strings of ``length`` bytes (at most 1,000)."""
    same, context = Window.partitionBy("rank"), Window.partitionBy("rank", "context")
    found = _anchor_rows(docs, length, gram).withColumn("size", F.sum("n").over(same)).where("size > 1")
    found = found.withColumn("twins", F.sum("n").over(context))
    found = found.withColumn("place", F.row_number().over(context.orderBy("key", "at"))).withColumn("mixed", F.min("twins").over(same) == 1)
    found = stored(found.select("rank", "key", "at", "size", "twins", ((F.col("twins") == 1) | (F.col("mixed") & (F.col("place") == 1))).alias("open")), "anchors")
    far, near = F.col("at").bitwiseAND(1023), F.shiftright("at", 10).bitwiseAND(1023)
    place = F.shiftright("at", 20)
    whole = found.where("twins > 1").select("key", (place - far).alias("s"), (place - near + length).alias("e"))
    judged = found.where("open").groupBy("key").agg(F.collect_list(F.struct("rank", "at", "size", (F.col("twins") == 1).alias("judged"))).alias("anchors"))  # one text's
    windows = stored(_window_ranks(docs.join(judged, "key").select("key", "text", "anchors"), length), "windows")
    ranges = whole.unionByName(_repeated_windows(windows.where(F.col("size") <= hot), length)).unionByName(_hot_windows(windows.where(F.col("size") > hot), length))
    return ranges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("ranges"))  # one text's


def drop_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` is binary, as a removed run may split a character."""
    raw, kind = F.coalesce(F.col(f"`{text}`"), F.lit("")), docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.xxhash64(F.col(f"`{id_col}`"), raw).alias("key"), raw.alias("text"), F.col(f"`{id_col}`").alias("id"))
    ranges = stored(repeated_ranges(d.select("key", "text"), length, gram, hot), "ranges")

    def run(batches):
        for b in batches:
            lists = b.column(2)
            for lo, hi, data, offsets in slices(b.column(1)):
                removed, n_spans, kept = [], [], []
                for i in range(hi - lo):
                    own = data[offsets[i]:offsets[i + 1]]
                    if not lists[lo + i].is_valid:
                        removed.append(0)
                        n_spans.append(0)
                        kept.append(own.tobytes())
                        continue
                    v = lists[lo + i].values
                    depth = np.zeros(len(own) + 1, np.int64)
                    np.add.at(depth, np.asarray(v.field(0)), 1)
                    np.add.at(depth, np.asarray(v.field(1)), -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    removed.append(int(gone.sum()))
                    n_spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                    kept.append(own[~gone].tobytes())
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
                                       pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])
    joined = d.join(ranges, "key", "left").select("id", "text", "ranges")
    out = joined.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return drop_repeats(docs, text, id_col).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
