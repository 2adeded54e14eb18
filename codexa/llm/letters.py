"""Words of letters in whole texts, as arrays of code points."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

from .textcore import Prefix, mix

LAST = 0x32400
#: Start of each range and its script; 0 is no script of its own.
RANGES = (
    (0x41, 1), (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x750, 6), (0x780, 0), (0x900, 7), (0x980, 8),
    (0xA00, 9), (0xB80, 10), (0xC00, 11), (0xE00, 12), (0xE80, 13), (0x10A0, 14), (0x1100, 15), (0x1200, 16), (0x1380, 0), (0x1C90, 14),
    (0x1D00, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 17), (0x30A0, 18), (0x3100, 0), (0x3130, 15),
    (0x3190, 0), (0x3400, 19), (0x4DC0, 0), (0x4E00, 19), (0xA000, 0), (0xA720, 1), (0xA800, 0), (0xAC00, 15), (0xD7B0, 0), (0xF900, 19),
    (0xFB00, 1), (0xFB13, 0), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1), (0xFF66, 18), (0xFFA0, 15), (0x10000, 0), (0x20000, 19),
)


@lru_cache(1)
def tables():
    """Whether a code point is a letter, its lower case, and its script."""
    chars = [chr(c) for c in range(LAST)]
    letter = np.fromiter((c.isalpha() for c in chars), bool, LAST)
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, LAST)
    starts, names = np.array([r[0] for r in RANGES]), np.array([r[1] for r in RANGES], dtype=np.int8)
    at = np.searchsorted(starts, np.arange(LAST), side="right") - 1
    return letter, lower, np.where(at >= 0, names[np.maximum(at, 0)], 0)


class Letters:
    """Of a chunk of documents: code points, and the runs of letters in them."""

    def __init__(self, buf, offs):
        letter, lower, script = tables()
        text = buf.tobytes().decode("utf-8", "replace")
        self.cps = np.frombuffer(text.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
        lead = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
        self.doc_at = lead[offs]
        low = np.minimum(self.cps, LAST - 1)
        is_letter = letter[low]
        self.lower = np.where(self.cps < LAST, lower[low], self.cps)
        edge = np.zeros(len(self.cps) + 1, bool)
        edge[self.doc_at] = True
        start, end = is_letter.copy(), is_letter.copy()
        if len(start):
            start[1:] &= ~is_letter[:-1] | edge[1:-1]
            end[:-1] &= ~is_letter[1:] | edge[1:-1]
        self.ws, self.we = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.word_at = np.searchsorted(self.ws, self.doc_at)
        self.script = script[low[self.ws]]

    def prefix(self):
        return Prefix(mix(self.lower.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))

    def word(self, i) -> str:
        return "".join(map(chr, self.lower[self.ws[i] : self.we[i]]))
