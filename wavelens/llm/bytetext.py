"""Byte-level helpers shared by the operators: text batches as one flat buffer.

Arrow hands a text column over as one byte buffer with offsets. The helpers
here work on that buffer with numpy, several documents at a time, and never
build a Python string per word. A document larger than the block size forms a
block of its own, so memory follows the largest document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
_FNV = np.uint64(0x100000001B3)
_FNV_BASIS = np.uint64(0xCBF29CE484222325)
_FOLD = np.uint64(0x9E3779B97F4A7C15)

#: the white space of the word rule [^\x20\x09-\x0D]+
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64-bit result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    arr = pc.fill_null(batch.column(name).cast(pa.large_binary()), b"")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data, offs


def blocks(batch: pa.RecordBatch, name: str,
           block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``block_bytes`` of text: (first row, end row,
    bytes, offsets from 0)."""
    data, offs = column_bytes(batch, name)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + block_bytes, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray,
               is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; a word never spans documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~is_space[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offs[:-1][offs[:-1] < len(data)]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[firsts[firsts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes (byte-wise FNV-1a, then mixed with the
    length). Spans are handled side by side, one byte position at a time."""
    h = np.full(len(starts), _FNV_BASIS, np.uint64)
    length = ends - starts
    active = np.arange(len(starts))
    at = starts.copy()
    step = 0
    while len(active):
        if step >= 256:      # a few very long spans: one at a time
            for i in active:
                x = int(h[i])
                for b in data[starts[i] + step:ends[i]].tobytes():
                    x = ((x ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
                h[i] = x
            break
        keep = length[active] > step
        if not keep.all():
            active = active[keep]
            at = at[keep]
        h[active] = (h[active] ^ data[at]) * _FNV
        at = at + 1
        step += 1
    return mix(h ^ (length.astype(np.uint64) << np.uint64(40)))


def window_hashes(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of ``n`` words of one document."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(docs[:m] == docs[n - 1:])
    h = np.full(len(first), np.uint64(n), np.uint64)
    for j in range(n):
        h = h * _FOLD + words[first + j]
        h ^= h >> np.uint64(29)
    return mix(h), first


def cover_count(positions: np.ndarray, width: int) -> int:
    """Number of places covered by the runs [p, p + width), ``positions`` ascending."""
    if not len(positions):
        return 0
    return int(width + np.minimum(np.diff(positions), width).sum())
