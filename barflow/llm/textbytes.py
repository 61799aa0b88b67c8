"""Flat byte views of Arrow string columns, so that numpy handles many texts at once.

Texts are taken in slices of about ``SLICE`` bytes (a longer text is a slice of its own), which bounds the
memory of a task whatever the Arrow batch holds.  Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers derived from ``seed``."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed)) | np.uint64(1)


BYTE_VALUE = odd_constants(256, 11)
LONG = 256
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets of the rows within these bytes)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a row boundary."""
    n = len(flag)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = flag[1:] != flag[:-1]
    edge[0] = edge[n] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = flag[starts]
    return starts[keep], ends[keep]


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the row that holds each start."""
    return np.searchsorted(offsets, starts, side="right") - 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each run: eight bytes a round through a bijective mixer, so order and place of every byte count.

    Runs of over ``LONG`` bytes are hashed by BLAKE2b.
    """
    lens = ends - starts
    with np.errstate(over="ignore"):
        out = mix(lens.astype(np.uint64) * _GOLDEN + _GOLDEN)
        words = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))  # the eight bytes from each place on
        on, at = np.flatnonzero(lens <= LONG), 0
        while len(on):
            out[on] = mix((out[on] ^ (words[starts[on] + at] & _LOW_BYTES[np.minimum(lens[on] - at, 8)])) + _GOLDEN)
            at += 8
            on = on[lens[on] > at]
    for i in np.flatnonzero(lens > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores added to those that a table has already (in any letter case)."""
    have = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
