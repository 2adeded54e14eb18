"""Byte kernel of the suffix operator: anchors, blocks and windows of bytes."""

from __future__ import annotations

import hashlib

import numpy as np

from .textcore import Prefix, merge_spans, mix, table

WIDTH = 400
REACH = 256
GRAM = 8


def grams(buf):
    """A hash of the GRAM bytes from each position."""
    n = len(buf) - GRAM + 1
    return mix(np.ndarray((n,), "<u8", np.ascontiguousarray(buf).data, strides=(1,))) if n > 0 else np.zeros(0, np.uint64)


def anchors(buf, p):
    """For each window start: where the least gram of its first REACH bytes is."""
    h = grams(buf)
    # The same 32 bits decide in any chunk; between equals, the first.
    bits = np.uint64(32)
    packed = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span, k = REACH - GRAM + 1, 0
    while 2 << k <= span:
        packed = np.minimum(packed[: len(packed) - (1 << k)], packed[1 << k :])
        k += 1
    low = np.minimum(packed[p], packed[p + span - (1 << k)])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def blocks(buf, offs):
    n = len(buf)
    ends = np.repeat(offs[1:], np.diff(offs))
    p = np.flatnonzero(np.arange(n) + WIDTH <= ends)
    if not len(p):
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    a = anchors(buf, p)
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(a) != 0)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(p)))
    h = Prefix(table(5)[buf])
    p1, a = p[at], a[at]
    doc = np.searchsorted(offs, p1, side="right") - 1
    return doc, p1 - offs[doc], count, h.of(a, a + WIDTH - REACH), h.of(p1, p1 + count + WIDTH - 1)


def windows(buf, at, n):
    pos = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    h = Prefix(table(6)[buf], 0xD6E8FEB86659FD93)
    return h.of(pos, pos + WIDTH), pos


def finish(buf, starts, ends):
    raw = buf.tobytes()
    s, e = merge_spans(starts, ends)
    kept, at = hashlib.sha256(), 0
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        kept.update(raw[at:a])
        at = b
    kept.update(raw[at:])
    return len(raw), int((e - s).sum()), len(s), kept.hexdigest()
