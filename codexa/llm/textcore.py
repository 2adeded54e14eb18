"""Vectorised text primitives over Arrow string columns.

A batch of documents is one byte buffer plus offsets, so words, hashes and
windows of all documents in a chunk come from a few numpy passes.  Chunks hold
whole documents and about ``CHUNK`` bytes; a longer document is a chunk alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 2_000_000
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BASE = 0x9E3779B97F4A7C15 | 1
WORD_JAVA = r"[^\x20\x09-\x0D]+"


def arrow_text(col):
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def chunks(buf, offs, limit=CHUNK):
    """Yield (first doc, past last doc, bytes, offsets within those bytes)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf, offs):
    """Starts and ends of the words, and the word offsets of the documents."""
    sep = np.zeros(256, dtype=bool)
    sep[list(SEPARATORS)] = True
    is_word = ~sep[buf]
    if not len(is_word):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | edge[1:-1]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | edge[1:-1]
    ws, we = np.flatnonzero(start), np.flatnonzero(end) + 1
    return ws, we, np.searchsorted(ws, offs)


def mix(x):
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base, n):
    p = np.full(n + 1, np.uint64(base), dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def table(salt):
    """A scrambled value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(salt))


class Prefix:
    """Hashes of any slices of a sequence of uint64 values, by prefix sums."""

    def __init__(self, values, base=BASE):
        n = len(values)
        self.up = powers(base, n)
        self.down = powers(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=self.sums[1:])

    def of(self, starts, ends):
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


#: Longest word that is hashed as a polynomial of its bytes; longer ones could be built to collide.
POLYNOMIAL = 32


def word_hashes(buf, ws, we):
    h = Prefix(table(1)[buf]).of(ws, we)
    long = np.flatnonzero(we - ws > POLYNOMIAL)
    if len(long):
        raw = memoryview(buf)
        h[long] = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], 1) for a, b in zip(ws[long].tolist(), we[long].tolist(), strict=True)), np.uint64, len(long))
    return h


def covered(n, starts, length):
    """Which of n positions lie in [s, s + length) for a start s."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def merge_spans(starts, ends):
    """Disjoint sorted spans with the same union."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    return s[first], e[np.append(first[1:] - 1, len(s) - 1)]
