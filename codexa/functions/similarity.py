"""Similarity of strings by longest common subsequence, as Arrow UDFs.

``ratio`` is 100 * (1 - indel / (|a| + |b|)); the token forms sort tokens, or
compare what two token sets share; ``partial`` slides the shorter string along
the longer.  The subsequence is found bit-parallel (Hyyrö 2004): one integer
operation a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * lcs(a, b) / n


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (x <= y or y <= x):
        return 100.0
    base = " ".join(sorted(both))
    one, two = (" ".join([base, *sorted(d)]).strip() for d in (x - y, y - x))
    found = ratio(one, two)
    return max(found, ratio(base, one), ratio(base, two)) if both else found


def partial_ratio(a: str, b: str) -> float:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, m = len(short), len(long)
    windows = [long[max(0, i) : i + n] for i in range(1 - n, m)]
    best = max(ratio(short, w) for w in windows)
    return max(best, max(ratio(long[max(0, i) : i + n], short) for i in range(1 - n, m))) if n == m else best


def _each_once(f, a: pa.Array, b: pa.Array) -> np.ndarray:
    """f of two columns without nulls; a pair that recurs in a batch is scored once."""
    x, y = a.dictionary_encode(), b.dictionary_encode()
    xs, ys = x.dictionary.to_pylist(), y.dictionary.to_pylist()
    pairs, back = np.unique(np.asarray(x.indices).astype(np.int64) * max(len(ys), 1) + np.asarray(y.indices), return_inverse=True)
    return np.array([f(xs[p // len(ys)], ys[p % len(ys)]) for p in pairs.tolist()], np.float64)[back]


def _column(f):
    """Of two string columns, null where one is."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        known = np.asarray(pc.and_(a.is_valid(), b.is_valid()))
        out = np.zeros(len(a))
        out[known] = _each_once(f, a.filter(pa.array(known)), b.filter(pa.array(known)))
        return pa.array(out, mask=~known)

    return F.arrow_udf(run, "double")


def title_likeness(a: str, b: str) -> float:
    """1 if equal, else two fifths plain and three fifths by token set; 0 to 1."""
    return 1.0 if a == b else ratio(a, b) / 100 * 0.4 + token_set_ratio(a, b) / 100 * 0.6


def author_likeness(a: str, b: str) -> float:
    return 1.0 if a == b else ratio(a, b) / 100 * 0.4 + token_sort_ratio(a, b) / 100 * 0.4 + partial_ratio(a, b) / 100 * 0.2


def title_score(a: Column, b: Column) -> Column:
    return _column(title_likeness)(a, b)


def author_score(a: Column, b: Column) -> Column:
    return _column(author_likeness)(a, b)


def best_author_score(a: Column, many: Column) -> Column:
    """The best of an array of names; null without a name on either side."""

    def run(a: pa.Array, many: pa.Array) -> pa.Array:
        row, names = pc.list_parent_indices(many), many.flatten()
        ours = a.take(row)
        known = pc.and_(ours.is_valid(), names.is_valid())
        best = np.full(len(a), -1.0)
        np.maximum.at(best, np.asarray(row.filter(known)), _each_once(author_likeness, ours.filter(known), names.filter(known)))
        return pa.array(best, mask=best < 0)

    return F.arrow_udf(run, "double")(a, many)


def similarity(name: str, a: Column, b: Column) -> Column:
    return _column({"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio}[name])(a, b)
