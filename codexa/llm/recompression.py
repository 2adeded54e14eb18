"""Substring dedup by recompression.

Rounds name runs of one symbol, then pairs whose left and right symbols fall on
different sides of a seeded partition; a name is a hash of what it names, so it
is global, and equal substrings have equal symbols but for a margin at either
end.  The margin is computed, not assumed: for each word it is known which
symbols of a level are certain if a window begins or ends there.  Of the
certain symbols that lie in the first ``REACH`` words of a window, at the
highest level that has any, that with the least name is the window's anchor;
its name and the words behind it are the key under which shared passages are
found and verified (see ``repeats``).

Defined results: a null text has no words; documents that share a doc_id, and
those with a null one, are each judged as whole rows: a null doc_id counts as
the largest, and rows of one id don't repeat each other; an empty table gives
no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .repeats import Kind, remove_repeats
from .store import documents
from .textcore import Prefix, merge_spans, mix, word_hashes, word_spans

WIDTH = 50
REACH = 36
LEVELS = 3


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS low FROM x GROUP BY h),
c AS (SELECT DISTINCT doc_id, k FROM (SELECT x.doc_id, unnest(range(i, i + 50)) AS k FROM x JOIN f ON x.h = f.h AND x.doc_id > f.low)),
p AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.k) AS kept, count(*) AS n_kept FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.k = c.k WHERE c.k IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


def _name(a, b, salt):
    return mix(a * np.uint64(0x9E3779B97F4A7C15) ^ mix(b + np.uint64(salt)))


class Level:
    """Symbols (names, first word) with, by word, the certain symbols of a window that starts or ends there."""

    def __init__(self, sym, start, first, begin, end):
        self.sym, self.start, self.first, self.begin, self.end = sym, start, first, begin, end

    def up(self, salt):
        n = len(self.sym)
        # Runs: a run that a window's edge touches may be longer outside.
        new = np.ones(n + 1, bool)
        new[1:n] = (self.sym[1:] != self.sym[:-1]) | self.first[1:]
        at = np.flatnonzero(new)
        rid = np.cumsum(new) - 1
        length = np.diff(at).astype(np.uint64)
        at = at[:-1]
        sym = np.where(length > 1, _name(self.sym[at], length, salt), self.sym[at])
        start, first = self.start[at], self.first[at]
        m = len(sym)
        begin = np.minimum(rid[np.minimum(self.begin, n - 1)] + 1, m)
        begin = np.where(self.begin >= n, m, begin)
        end = np.where(self.end > 0, rid[np.maximum(self.end - 1, 0)], 0)
        # Pairs: a left symbol followed by a right one.
        right = (mix(sym ^ np.uint64(salt * 0x2545F4914F6CDD1D & (2**64 - 1))) & np.uint64(1)).astype(bool)
        pair = np.zeros(m + 1, bool)
        pair[: m - 1] = ~right[:-1] & right[1:] & ~first[1:]
        second = np.zeros(m + 1, bool)
        second[1:] = pair[:-1]
        nid = np.cumsum(~second) - 1
        keep = np.flatnonzero(~second[:m])
        nxt = np.minimum(keep + 1, m - 1)
        named = np.where(pair[keep], _name(sym[keep], sym[nxt], salt + 1), sym[keep])
        edge = np.append(right, False)
        begin = nid[np.minimum(begin + edge[begin], m)]
        end = end - ((end > 0) & ~np.append(False, right)[end])
        end = np.where(end > 0, nid[np.maximum(end - 1, 0)] + 1, 0)
        return Level(named, start[keep], first[keep], begin, end)


def least(values, lo, hi):
    """Index of the least of values[lo:hi], the first if several; hi > lo."""
    # The same 32 bits decide in any chunk; between equals, the first.
    bits = np.uint64(32)
    packed = (mix(values) >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    span = hi - lo
    out = np.zeros(len(lo), dtype=np.uint64)
    table, k = packed, 0
    while True:
        own = (span >> (k + 1) == 0) & (span >> k == 1)
        if own.any():
            out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << k)])
        if not (span >> (k + 1)).any():
            return (out & np.uint64(0xFFFFFFFF)).astype(np.int64)
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1


def blocks(buf, offs):
    """Blocks of WIDTH-word windows: document, first window, windows, key, hash."""
    ws, we, word_at = word_spans(buf, offs)
    n = len(ws)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(word_at))
    p = np.flatnonzero(doc[: n - WIDTH + 1] == doc[WIDTH - 1 :]) if n >= WIDTH else np.zeros(0, np.int64)
    if not len(p):
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    h = word_hashes(buf, ws, we)
    first = np.zeros(n, bool)
    first[word_at[:-1][np.diff(word_at) > 0]] = True
    levels = [Level(h, np.arange(n), first, np.arange(n + 1), np.arange(n + 1))]
    for r in range(LEVELS):
        levels.append(levels[-1].up(2 * r + 3))
    anchor, name = np.zeros(len(p), np.int64), np.zeros(len(p), np.uint64)
    rest = np.arange(len(p))
    for level in reversed(levels):
        lo, hi = level.begin[p[rest]], level.end[p[rest] + REACH]
        has = hi > lo
        if has.any():
            i = least(level.sym, lo[has], hi[has])
            anchor[rest[has]], name[rest[has]] = level.start[i], level.sym[i]
        rest = rest[~has]
        if not len(rest):
            break
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(anchor) != 0) | (name[1:] != name[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(p)))
    words = Prefix(h)
    key = mix(name[at] ^ words.of(anchor[at], anchor[at] + WIDTH - REACH))
    p1 = p[at]
    return doc[p1], p1 - word_at[doc[p1]], count, key, words.of(p1, p1 + count + WIDTH - 1)


def windows(buf, at, n):
    ws, we, _ = word_spans(buf, np.array([0, len(buf)]))
    pos = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    h = Prefix(mix(word_hashes(buf, ws, we) + np.uint64(0xA24BAED4963EE407)))
    return h.of(pos, pos + WIDTH), pos


def finish(buf, starts, ends):
    words = buf.tobytes().split()
    s, e = merge_spans(starts, ends)
    kept, at = [], 0
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


KIND = Kind(WIDTH, blocks, windows, finish, "n_words long, n_removed long, kept_sha256 string", earlier=True)


def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), KIND)
