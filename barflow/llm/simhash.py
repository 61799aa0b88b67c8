"""SimHash near-duplicate groups with Golay-code fuzzy hashing.

A text's fingerprint takes the majority of each bit over the XXH64 hashes (seed 42) of its 3-word shingles, repeats
included.  Rows of equal fingerprints are one key from there on.

Search for fingerprints at two or fewer differing bits: the 64 bits are cut into segments of 22, 21 and 21 bits, each read as
a word of the binary Golay code of length 23.  A segment's keys are the indices of the codewords within distance four: one
where the word is within two bits of a codeword, six otherwise.  Two words that differ in at most two bits share a key,
since the codeword within three bits of a word halfway between them is within four bits of both.  By the pigeonhole
principle two errors leave one of the three segments without any; so each fingerprint posts, for each segment, its exact bits
with the keys of the next segment (about 16 postings), and every link shares a posting.

Buckets of at most ``crowd`` fingerprints are joined with themselves, the number of differing bits being part of the join
condition.  Members of larger buckets are posted again under all 65 words within one bit of them: a link shares the word
halfway, and no such bucket has more than 65 members.  So results are whole and no group is unbounded.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; fewer than three words are one shingle.  Null, empty and
blank texts have fingerprint zero, linked like any other.  Long texts are hashed in chunks.  Null ids are never the
smallest id of a group unless it has no other; repeated rows stay.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import stored
from .components import components
from .pretokens import spans
from .textbytes import row_of, runs, slices
from .textstats import LOWERED

WORDS = 3
SEED = 42
CHUNK = 1 << 16
CROWD = 128
APART = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(words joined by one space, start and end of each shingle in them, shingles of each row)."""
    n = len(offsets) - 1
    low = LOWERED[data]
    starts, ends = runs(~_BLANK[low], offsets)
    row, lens = row_of(starts, offsets), ends - starts
    held = np.bincount(row, minlength=n)
    joined = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
    to = np.cumsum(lens + 1) - lens - 1
    joined[spans(to, lens)] = low[spans(starts, lens)]
    count = np.where(held >= words, held - words + 1, held > 0)
    first = spans(np.cumsum(held) - held, count)
    last = first + np.repeat(np.minimum(held, words), count) - 1
    return joined.tobytes(), to[first], (to + lens)[last], count


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, chunk: int = CHUNK) -> np.ndarray:
    """64-bit fingerprint of each row."""
    text, starts, ends, count = _shingles(data, offsets, words)
    digest, seen = xxhash.xxh64_intdigest, np.append(0, np.cumsum(count))
    out = np.zeros(len(count), np.uint64)
    row = 0
    while row < len(count):  # rows of about ``chunk`` shingles; a longer row is counted in pieces
        stop = max(int(np.searchsorted(seen, seen[row] + chunk, side="right")) - 1, row + 1)
        stop = min(stop, row + chunk)
        ones = np.zeros((stop - row, 64), np.int64)
        for lo in range(int(seen[row]), int(seen[stop]), chunk):
            hi = min(lo + chunk, int(seen[stop]))
            h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())), np.uint64, hi - lo)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            owner = np.searchsorted(seen, np.arange(lo, hi), side="right") - 1
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            ones[owner[at] - row] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[row:stop] = np.packbits(2 * ones > count[row:stop, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        row = stop
    return out


def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by the generator of the words of the 12 low and of the 11 high bits."""
    def rest(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GENERATOR << (k - 11)
        return word
    return (np.array([rest(w) for w in range(1 << 12)], np.int64), np.array([rest(w << 12) for w in range(1 << 11)], np.int64))


@lru_cache(1)
def _decoder() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainder tables, and for each remainder its error patterns of weight up to four and their number."""
    low, high = _remainders()
    patterns, number = np.zeros((1 << 11, 6), np.int64), np.zeros(1 << 11, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for e, s in zip(errors.tolist(), (low[errors & 4095] ^ high[errors >> 12]).tolist()):
            patterns[s, number[s]] = e
            number[s] += 1
    return low, high, patterns, number


def golay_keys(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the codewords within distance four of each 23-bit word, number of indices of each)."""
    low, high, patterns, number = _decoder()
    syndrome = low[word & 4095] ^ high[word >> 12]
    count = number[syndrome]
    owner = np.repeat(np.arange(len(word)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return (word[owner] ^ patterns[syndrome[owner], place]) >> 11, count


def _postings(distinct: DataFrame) -> DataFrame:
    """(key, fp): the exact bits of each segment with each key of the next one."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                fp = np.asarray(b.column(0).slice(at, CHUNK))
                parts = [(fp.view(np.uint64) >> np.uint64(lo)).astype(np.int64) & ((1 << n) - 1) for lo, n in SEGMENTS]
                for k, exact in enumerate(parts):
                    index, count = golay_keys(parts[(k + 1) % len(parts)])
                    key = np.repeat(k << 40 | exact << 12, count) | index
                    yield pa.record_batch([pa.array(key), pa.array(np.repeat(fp, count))], ["key", "fp"])
    return distinct.select("fp").mapInArrow(run, "key bigint, fp bigint")


def _linked(postings: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between fingerprints that share a bucket of ``postings``."""
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= APART)
    one, two = postings.select("key", F.col("fp").alias("a")), postings.select(F.col("key").alias("other"), F.col("fp").alias("b"))
    return one.join(two, (F.col("key") == F.col("other")) & near).select("a", "b").distinct()


def _around(fp: Column) -> Column:
    """All words within one bit of a fingerprint."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("bigint")) for k in range(64)])


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between the fingerprints ``fp`` of ``distinct`` at two or fewer differing bits."""
    postings = stored(_postings(distinct), "golay_postings")
    size = stored(postings.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "golay_sizes")
    few = stored(postings.join(size.where(F.col("size") <= crowd).select("key"), "key"), "golay_buckets")
    many = postings.join(size.where(F.col("size") > crowd).select("key"), "key").select("fp").distinct()
    balls = stored(many.select(F.explode(_around(F.col("fp"))).alias("key"), "fp"), "ball_postings")
    return _linked(few).unionByName(_linked(balls)).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(id, fingerprint, component_id) of every row; ``crowd`` steers the work only."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(1)):
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(fingerprints(data, offsets).view(np.int64))], ["id", "fp"])
    rows = stored(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"id {kind}, fp bigint"), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("id")), "distinct_fingerprints")
    roots = stored(components(links(distinct, crowd)).select(F.col("key").alias("fp"), "root"), "simhash_roots")
    named = distinct.join(roots, "fp")
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = stored(distinct.join(named.join(lowest, "root").select("fp", "component_id"), "fp", "left")
                    .select("fp", F.coalesce("component_id", "id").alias("component_id")), "simhash_labels")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(labels, "fp").select(F.col("id").alias(id_col), digits, "component_id")
