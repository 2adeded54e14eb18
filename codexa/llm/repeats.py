"""Exact removal of long repeats, from locally consistent anchors.

Both substring operators share these steps.  A kernel gives every window of
the input (of words or bytes) an anchor inside it that depends on the window's
content alone, so equal windows have equal anchors at equal offsets.  Windows
that follow one another and share an anchor are a block.  A block's row has the
anchor's key, which is a hash of content that each of its windows holds, and a
hash of all of the block.

1. Rows are aggregated by key.  A key that occurs once can't be in a repeat.
2. Where all blocks of a key are equal, they answer for all their windows.
3. Where they differ, equal blocks still answer for each other, and windows of
   one of each kind are hashed and aggregated one by one.
4. Each document gets its removed spans, and the text is read with them.

Aggregates are partial before each exchange, joins are on keys, no group is
gathered, and rows are of a fixed size, so hot passages cost what others cost.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, park, shuffles_freed
from .textcore import arrow_text, chunks

ROW = ["id", "text_key"]
BLOCK_SCHEMA = "id long, text_key long, at int, n int, key long, block long"
WINDOW_SCHEMA = "key long, window long, id long, text_key long, at int"
#: Blocks asked about, in lists by document, that may be broadcast: 16 bytes each and 40 a document.
BROADCAST_BLOCKS = 500_000
#: Blocks that so many rows are equal to, and a thousandth of all rows, are looked up by broadcast: a thousand at most.
HOT_ROWS = 1000
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Kind:
    """What an operator supplies."""

    width: int
    blocks: Callable  # (bytes, offsets) -> doc, at, n, key, block
    windows: Callable  # (bytes, at, n) -> for each block the hashes of its windows, and all positions
    finish: Callable  # (bytes, starts, ends) -> values of the result columns
    columns: str
    earlier: bool  # a repeat counts only if it also starts in a document with a smaller id
    resolve: Callable | None = None  # (documents, blocks asked about) -> spans, for keys with few kinds of blocks
    resolve_rows: int = 0


def block_rows(blocks):
    def run(batches):
        for b in batches:
            buf, offs = arrow_text(b.column("text"))
            ids, texts = (b.column(c).to_numpy(zero_copy_only=False) for c in ROW)
            for lo, _, part, at in chunks(buf, offs):
                doc, first, n, key, block = blocks(part, at)
                cols = [ids[lo + doc], texts[lo + doc], first.astype(np.int32), n.astype(np.int32), key.view(np.int64), block.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*ROW, "at", "n", "key", "block"])

    return run


def window_rows(windows):
    def run(batches):
        for b in batches:
            buf, offs = arrow_text(b.column("text"))
            ids, texts = (b.column(c).to_pylist() for c in ROW)
            for i, spans in enumerate(b.column("spans").to_pylist()):
                at, n = np.array([s["at"] for s in spans]), np.array([s["n"] for s in spans])
                key = np.array([s["key"] for s in spans], dtype=np.int64)
                hashes, pos = windows(buf[offs[i] : offs[i + 1]], at, n)
                cols = [np.repeat(key, n), hashes.view(np.int64), np.full(len(pos), ids[i]), np.full(len(pos), texts[i]), pos.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "window", *ROW, "at"])

    return run


def final_rows(finish, columns):
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            buf, offs = arrow_text(b.column("text"))
            out = []
            for i, spans in enumerate(b.column("spans").to_pylist()):
                starts = np.array([s["at"] for s in spans or ()], dtype=np.int64)
                ends = starts + np.array([s["n"] for s in spans or ()], dtype=np.int64)
                out.append(finish(buf[offs[i] : offs[i + 1]], starts, ends))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", *names])

    return run


def _spans(asked: DataFrame) -> DataFrame:
    return asked.groupBy(*ROW).agg(F.collect_set(F.struct("at", "n", "key")).alias("spans"))


def _by_window(docs: DataFrame, spans: DataFrame, kind: Kind) -> DataFrame:
    hashed = cut(docs.join(spans, ROW).mapInArrow(window_rows(kind.windows), WINDOW_SCHEMA))
    again = hashed.groupBy("key", "window").agg(F.min("id").alias("low"), F.count("*").alias("c")).filter("c > 1").select("key", "window", "low")
    again = cut(again)
    found = hashed.join(again, ["key", "window"])
    found = found.filter(F.col("id") > F.col("low")) if kind.earlier else found
    return found.select(*ROW, "at", F.lit(kind.width).alias("n"))


def _looked_up(mixed: DataFrame, same: DataFrame) -> DataFrame:
    """Each row with what is known of its block; rows of hot blocks aren't moved, so they don't meet in one task."""
    n = same.agg(F.sum("c")).first()[0] or 0
    hot = F.broadcast(same.filter(F.col("c") >= max(HOT_ROWS, n / 1000)))
    rest = mixed.join(hot.select("key", "block"), ["key", "block"], "left_anti").join(same, ["key", "block"])
    return rest.select(*mixed.columns, "first", "c").unionByName(mixed.join(hot, ["key", "block"]).select(*mixed.columns, "first", "c"))


def remove_repeats(docs: DataFrame, kind: Kind) -> DataFrame:
    with shuffles_freed(docs.sparkSession):
        return _remove_repeats(docs, kind)


def _remove_repeats(docs: DataFrame, kind: Kind) -> DataFrame:
    """doc_id and the kind's columns, a row for each document.

    A row is known by its doc_id and its text's hash, so rows that share a
    doc_id don't mix; equal rows have equal results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_key"))
    long_enough = docs.filter(F.octet_length("text") >= kind.width)
    blocks, drop_blocks = park(long_enough.mapInArrow(block_rows(kind.blocks), BLOCK_SCHEMA))
    last = kind.width - 1
    seen = blocks.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("c"), F.min("block").alias("b0"), F.max("block").alias("b1"))
    seen = seen.filter(F.col("low") != F.col("high") if kind.earlier else F.col("c") > 1)
    # Sums are cut before they are joined: then both sides are plain exchanges, and a hot key's rows can be split.
    seen = cut(seen.select("key", *["low"] * kind.earlier, (F.col("b0") == F.col("b1")).alias("pure")))
    hits = cut(blocks.join(seen, "key"))
    drop_blocks()
    span = (*ROW, "at", (F.col("n") + last).alias("n"))
    sure = hits.filter(F.col("pure") & (F.col("id") > F.col("low") if kind.earlier else F.lit(True))).select(*span)
    mixed = hits.filter("NOT pure").select(*ROW, "at", "n", "key", "block")
    same = cut(mixed.groupBy("key", "block").agg(F.min(F.struct(*ROW, "at", "n")).alias("first"), F.count("*").alias("c")))
    known = _looked_up(mixed, same)
    sure = sure.unionByName(known.filter(F.col("id") > F.col("first.id") if kind.earlier else F.col("c") > 1).select(*span))
    # One of each kind stands for the rest; where order counts, all that the first document has of it must ask.
    asked = known.filter(F.col("id") == F.col("first.id")).select(*ROW, "at", "n", "key") if kind.earlier else same.select("first.*", "key")
    # Both reads of the texts join the same columns on the same keys, so that they share one exchange.
    if kind.resolve is None:
        spans = sure.unionByName(_by_window(docs, _spans(asked), kind))
    else:
        sizes = same.groupBy("key").count().filter(F.col("count") > kind.resolve_rows).select("key")
        large = cut(sizes)
        few = asked.join(large, "key", "left_anti")
        spans = sure.unionByName(kind.resolve(docs, _spans(few)))
        if not large.isEmpty():
            rest = cut(_spans(asked.join(large, "key", "left_semi")))
            n = rest.agg(F.sum(F.size("spans"))).first()[0] or 0
            spans = spans.unionByName(_by_window(docs, F.broadcast(rest) if n <= BROADCAST_BLOCKS else rest, kind))
    spans = spans.groupBy(*ROW).agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    return docs.join(spans, ROW, "left").mapInArrow(final_rows(kind.finish, kind.columns), f"doc_id long, {kind.columns}")
