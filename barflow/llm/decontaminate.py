"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of digits, letters a-z (A-Z lower-cased) and bytes of non-ASCII characters.  A window is ``WINDOW``
consecutive words of an item; a shorter item is one window.  The automaton is built over item words; training tokens are
streamed through it and the longest matching length is tracked at each word, so a word is hit when a match of at least
``WINDOW`` words, or a whole short item, covers it.  Items that own an occurring window are named.

Before streaming, words outside the items' vocabulary and neighbours that are no item's neighbours cut a text into
stretches; a match lies inside one stretch, so only stretches that could hold a window are streamed.

Items are read in blocks of about ``BLOCK_BYTES`` of text; each block is broadcast by itself (its size is its bound) and
meets all documents.  Of several blocks each writes only the hits of documents that have some, by row number; one last pass
unites them.  Null texts have no words, and an item without words no window.  Items with a null id share one id: null, which
counts as one item and comes last.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.stage import stored
from .textbytes import fresh_names, hash_runs, row_of, runs, slices

WINDOW = 10
BLOCK_BYTES = 2 << 20
ADDED = ("_n_words", "_n_hit", "_hits", "_items")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of all rows; a character of several bytes is whole, as all its bytes count."""
    low = _LOWER[data]
    starts, ends = runs(_WORD[low], offsets)
    return starts, ends, hash_runs(low, starts, ends)


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that own each window."""

    def __init__(self, items: list[tuple[object, list[int]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, seq in items:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.owners: dict[int, set] = {}  # state of a full window -> items
        self.short: dict[int, tuple[int, set]] = {}  # state of a whole short item -> its length and the items
        for item, seq in items:
            if 0 < len(seq) < window:
                state = 0
                for c in seq:
                    state = self.next[state][c]
                self.short.setdefault(state, (len(seq), set()))[1].add(item)
            elif seq:
                for state, length in self.walk(seq):
                    if length >= window:
                        self.owners.setdefault(self.cut(state), set()).add(item)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.wholes: list[list[tuple[int, set]]] = [[] for _ in order]  # short items that are suffixes of a state's strings
        for s in order[1:]:
            up = self.wholes[self.link[s]]
            self.wholes[s] = [self.short[s], *up] if s in self.short else up

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def walk(self, seq) -> Iterator[tuple[int, int]]:
        """State and longest matching length after each word."""
        state, matched = 0, 0
        for c in seq:
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            yield state, matched

    def cut(self, state: int) -> int:
        """The state of the last ``window`` words of the match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, seq) -> tuple[list[tuple[int, int]], set]:
        """Covered word ranges and the items that own windows found."""
        ranges, items = [], set()
        for i, (state, matched) in enumerate(self.walk(seq)):
            covered = 0
            if matched >= self.window:
                covered = matched
                items |= self.owners[self.cut(state)]
            for n, own in self.wholes[state]:
                if n <= matched:
                    covered = max(covered, n)
                    items |= own
            if covered:
                ranges.append((i + 1 - covered, i + 1))
        return ranges, items


class Block:
    """One block of items, ready to scan: vocabulary, neighbour pairs and automaton."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        texts = pa.array([t for _, t in items], pa.string())
        coded, sequences = [], []
        for lo, hi, data, offsets in slices(texts):
            starts, _, h = words(data, offsets)
            cut = np.searchsorted(starts, offsets)
            coded += [(items[lo + i][0], h[cut[i]:cut[i + 1]]) for i in range(hi - lo)]
        self.vocabulary = np.unique(np.concatenate([h for _, h in coded])) if coded else np.zeros(0, np.uint64)
        self.n = np.int64(len(self.vocabulary))
        pairs = []
        for item, h in coded:
            c = np.searchsorted(self.vocabulary, h)
            sequences.append((item, c.tolist()))
            pairs.append(c[:-1] * self.n + c[1:])
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        lengths = [len(s) for _, s in sequences if s]
        self.least = min([window, *lengths])
        self.automaton = ItemAutomaton(sequences, window) if lengths else None

    def stretches(self, starts: np.ndarray, h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, first words, last words + 1) of stretches long enough for a window."""
        none = np.zeros(0, np.int64)
        if self.automaton is None or not len(h):
            return none, none, none
        code = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[code] == h
        linked = np.zeros(len(h), bool)  # to the word before
        if len(h) > 1 and len(self.pairs):
            pair = code[:-1] * self.n + code[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            linked[1:] = (self.pairs[at] == pair) & known[:-1] & known[1:]
        linked[np.searchsorted(starts, offsets[:-1])[np.searchsorted(starts, offsets[:-1]) < len(h)]] = False
        first = np.flatnonzero(known & ~linked)
        if not len(first):
            return none, none, none
        stop = np.flatnonzero(~linked)
        last = np.append(stop, len(h))[np.searchsorted(stop, first) + 1]
        keep = last - first >= self.least
        return code, first[keep], last[keep]


_BLOCKS: dict = {}


def _block(broadcast, key, window: int) -> Block:
    if key not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[key] = Block(broadcast.value, window)
    return _BLOCKS[key]


def _item_blocks(items: DataFrame, text: str, id_col: str, block_bytes: int) -> Iterator[list]:
    """The items' rows in hash blocks of about ``block_bytes`` of text."""
    d = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        yield [(r.id, r.text) for r in d.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()]


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
         window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus _n_words, _n_hit, _hits (byte ranges of maximal hit runs) and _items (ids found, distinct).

    The names of the new columns, the last four, get more underscores where ``docs`` has them already.
    """
    kind = items.schema[item_id].dataType.simpleString()
    names = fresh_names(docs.columns, *ADDED)
    kinds = ["bigint", "bigint", "array<struct<s:bigint,e:bigint,w:bigint>>", f"array<{kind}>"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` {k}" for n, k in zip(names, kinds)])
    kind_arrow, spark, rows = to_arrow_type(items.schema[item_id].dataType), docs.sparkSession, fresh_names([*docs.columns, *names], "_row")[0]

    def passed(table: DataFrame, block: list, out_schema: str, before: bool, narrow: bool) -> DataFrame:
        """One pass over the texts; ``narrow``: row number, hits and items of the rows that have hits only."""
        sent, key, at = spark.sparkContext.broadcast(block), uuid.uuid4().hex, table.columns.index(text)

        def run(batches):
            made = _block(sent, key, window)
            for b in batches:
                for lo, hi, data, offsets in slices(b.column(at)):
                    part = b.slice(lo, hi - lo)
                    old = list(zip(part.column(names[2]).to_pylist(), part.column(names[3]).to_pylist())) if before else None
                    out = _scanned(part, data, offsets, made, old, kind_arrow, names)
                    if narrow:
                        out = out.filter(pc.greater(out.column(names[1]), 0)).select([rows, names[2], names[3]])
                    yield out
        return table.mapInArrow(run, out_schema)

    blocks = _item_blocks(items, item_text, item_id, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return passed(docs, first, schema, False, False)
    numbered = stored(docs.withColumn(rows, F.monotonically_increasing_id()), "numbered")
    found = [stored(passed(numbered.select(rows, text), block, f"`{rows}` bigint, `{names[2]}` {kinds[2]}, `{names[3]}` {kinds[3]}", False, True), "block_hits")
             for block in chain((first, second), blocks)]
    hits = reduce(DataFrame.unionByName, found).groupBy(rows).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in names[2:]])  # one list a block
    return passed(numbered.join(hits, rows, "left").select(*[F.col(f"`{c}`") for c in (*docs.columns, *names[2:])]), [], schema, True, False)


def _scanned(part, data, offsets, block: Block, before, kind, added) -> pa.RecordBatch:
    starts, ends, h = words(data, offsets)
    n = len(offsets) - 1
    cut = np.searchsorted(starts, offsets)
    found: dict[int, set] = {}
    depth = np.zeros(len(h) + 1, np.int64)
    code, first, last = block.stretches(starts, h, offsets)
    for s, e in zip(first.tolist(), last.tolist()):
        ranges, items = block.automaton.hits(code[s:e].tolist())
        if ranges:
            found.setdefault(int(row_of(starts[s:s + 1], offsets)[0]), set()).update(items)
            for a, z in ranges:
                depth[s + a] += 1
                depth[s + z] -= 1
    for i, (old, items) in enumerate(before or []):
        if old:
            found.setdefault(i, set()).update(items)
            for r in old:  # word numbers of the row
                at = int(np.searchsorted(starts, offsets[i] + r["s"]))
                depth[at] += 1
                depth[at + r["w"]] -= 1
    hit = np.cumsum(depth[:-1]) > 0
    hits = [[] for _ in range(n)]
    first, last = runs(hit, cut)
    for s, e in zip(first.tolist(), last.tolist()):
        i = int(row_of(starts[s:s + 1], offsets)[0])
        hits[i].append({"s": int(starts[s] - offsets[i]), "e": int(ends[e - 1] - offsets[i]), "w": e - s})
    total = np.append(0, np.cumsum(hit))
    keep = len(part.columns) - (0 if before is None else len(added) - 2)
    span = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("w", pa.int64())])
    return pa.record_batch([*part.columns[:keep], pa.array(np.diff(cut)), pa.array(total[cut[1:]] - total[cut[:-1]]), pa.array(hits, pa.list_(span)),
                            pa.array([sorted(found.get(i, ()), key=lambda v: (v is None, v)) for i in range(n)], pa.list_(kind))], [*part.schema.names[:keep], *added])


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    d = scan(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")), items, text=text, window=window, block_bytes=block_bytes)
    found = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return d.select(F.col(f"`{id_col}`"), F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"),
                    F.sha2(found.cast("binary"), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, span_words: int = 1, coverage: float = 0.5) -> DataFrame:
    """``docs`` without hit spans of at least ``span_words`` words and without documents hit over ``coverage`` of their words.

    A removed span leaves one space.  Documents without such spans keep their text as it is.
    """
    d = scan(docs, items, text=text, window=window)
    n_words, n_hit, hits, _ = d.columns[-len(ADDED):]
    d = d.where(F.col(n_hit) <= coverage * F.greatest(F.col(n_words), F.lit(1)))
    cut = F.filter(hits, lambda h: h["w"] >= span_words)
    raw = F.col(f"`{text}`").cast("binary")
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cut, lambda h: h["e"]))
    ends = F.concat(F.transform(cut, lambda h: h["s"]), F.array(F.octet_length(F.col(f"`{text}`")).cast("bigint")))
    pieces = F.zip_with(edges, ends, lambda s, e: F.substring(raw, (s + 1).cast("int"), (e - s).cast("int")).cast("string"))
    new = F.when(F.size(cut) > 0, F.array_join(pieces, " ")).otherwise(F.col(f"`{text}`"))
    return d.withColumn(text, new).select(*[F.col(f"`{c}`") for c in docs.columns])
