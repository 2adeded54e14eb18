"""Suffix-array dedup of bytes, by merging shard Burrows-Wheeler transforms.

Suffixes are sampled at content-defined anchors (``bytewise``), at least one in
any window, so an order over them decides every window.  Blocks whose core
occurs once, or that equal others as a whole, are settled by aggregates (see
``repeats``).  What is left is ordered: each shard, an Arrow batch of
documents, ranks its sampled suffixes and sends them with the bytes before
them, the columns of its transform.  A bucket of the key space then merges what
the shards sent by iterative interleave refinement: the interleave begins shard
after shard and each round refines, in place and stably, only those intervals
that still have several suffixes, by their next symbols.  Where an interval
splits, the common prefix of the neighbours is known.  The same is done for the
bytes before the anchors.  A window that starts o bytes before its anchor then
repeats if its interval of prefixes of 400 - o bytes, and that of the o bytes
before, have another member in common; no bytes are compared again.

A key with more than ``MERGE_ROWS`` kinds of blocks isn't merged in one task:
its windows are hashed and aggregated one by one, which is exact as well.

Defined results: a null text is empty (0 bytes, no spans); texts under 400
bytes keep everything; equal rows repeat each other, whatever their doc_id; an
empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bytewise
from .bytewise import REACH, WIDTH
from .repeats import Kind, remove_repeats
from .store import documents

MERGE_ROWS = 4096
LANES = 4
BUCKET_SCHEMA = "id long, text_key long, at int, n int, key long, anchor int, shard int, rank int, bytes binary"


def symbols(rows: list[np.ndarray], width: int) -> np.ndarray:
    """A row of LANES-symbol words for each byte string; its end is a symbol of its own."""
    width = -(-width // LANES) * LANES
    m = np.zeros((len(rows), width), dtype=">u2")
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
        m[i, : len(r)] += 1
    return m.view(">u8").astype(np.uint64)


def interleave(group, rank, words):
    """The merged order, and each suffix's common prefix with the one before.

    The prefix is -1 where a group begins.  Within a group, suffixes come in
    by shard and rank; a round moves only members of intervals that aren't
    settled.
    """
    order = np.lexsort((rank, group))
    g = group[order]
    opens = np.ones(len(order) + 1, bool)
    opens[1:-1] = g[1:] != g[:-1]
    lcp = np.where(opens[:-1], -1, words.shape[1] * LANES)
    for k in range(words.shape[1]):
        live = np.flatnonzero(~(opens[:-1] & opens[1:]))
        if not len(live):
            break
        interval = np.cumsum(opens[:-1])[live]
        s = words[order[live], k]
        move = np.lexsort((s, interval))
        order[live] = order[live][move]
        s = s[move]
        split = np.flatnonzero((interval[1:] == interval[:-1]) & (s[1:] != s[:-1])) + 1
        if len(split):
            differ = s[split] ^ s[split - 1]
            same = np.zeros(len(split), np.int64)
            for lane in range(1, LANES):
                same += differ >> np.uint64(16 * (LANES - lane)) == 0
            opens[live[split]] = True
            lcp[live[split]] = k * LANES + same
    return order, lcp


def repeated(group, rank, texts, anchor, n):
    """For each block, which of its windows occur in another block of its group.

    Returns (block, window start within it, windows) of runs.
    """
    after = symbols([t[a:] for t, a in zip(texts, anchor, strict=True)], WIDTH)
    before = symbols([t[:a][::-1] for t, a in zip(texts, anchor, strict=True)], REACH)
    right, right_lcp = interleave(group, rank, after)
    left, left_lcp = interleave(group, rank, before)
    most, least = anchor, anchor - n + 1
    found = np.zeros((len(n), REACH + 2), bool)
    right_class, left_class = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    for o in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= o) & (o <= most))
        if len(own) < 2:
            continue
        right_class[right] = np.cumsum(right_lcp < WIDTH - o)
        left_class[left] = np.cumsum(left_lcp < o)
        pair = right_class[own] * (len(n) + 1) + left_class[own]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        found[own[by[1:][same]], o] = True
        found[own[by[:-1][same]], o] = True
    edge = np.diff(np.pad(found, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    block, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    return block, anchor[block] - (past - 1), past - first


def send(batches):
    """Each asked block with its bytes, its shard and its rank there."""
    for shard, b in enumerate(batches):
        ids, keys = b.column("id").to_pylist(), b.column("text_key").to_pylist()
        rows, texts = [], []
        for i, (text, spans) in enumerate(zip(b.column("text"), b.column("spans").to_pylist(), strict=True)):
            raw = np.frombuffer(text.as_py().encode(), np.uint8)
            for s in spans:
                own = raw[s["at"] : s["at"] + s["n"] + WIDTH - 1]
                rows.append((ids[i], keys[i], s["at"], s["n"], s["key"], int(bytewise.anchors(own, np.zeros(1, np.int64))[0])))
                texts.append(own)
        if not rows:
            continue
        cols = [np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)]
        order, _ = interleave(cols[4], np.arange(len(rows)), symbols([t[a:] for t, a in zip(texts, cols[5], strict=True)], WIDTH))
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        ints = (2, 3, 5)
        arrays = [pa.array(c.astype(np.int32) if i in ints else c) for i, c in enumerate(cols)]
        tail = [pa.array(np.full(len(rows), shard, np.int32)), pa.array(rank.astype(np.int32)), pa.array([t.tobytes() for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([*arrays, *tail], names=["id", "text_key", "at", "n", "key", "anchor", "shard", "rank", "bytes"])


def merge(batches):
    """Repeated spans of a bucket, whose rows come sorted by key."""

    def run(t):
        col = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_key", "at", "n", "key", "anchor", "shard", "rank")}
        texts = [np.frombuffer(x.as_py(), np.uint8) for x in t.column("bytes")]
        _, group = np.unique(col["key"], return_inverse=True)
        rank = col["shard"].astype(np.int64) << 32 | col["rank"]
        block, start, n = repeated(group, rank, texts, col["anchor"].astype(np.int64), col["n"].astype(np.int64))
        out = [col["id"][block], col["text_key"][block], (col["at"][block] + start).astype(np.int32), (n + WIDTH - 1).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["id", "text_key", "at", "n"])

    kept = None
    for b in batches:
        t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
        t = t.combine_chunks()
        key = t.column("key").to_numpy()
        done = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if done:
            yield run(t.slice(0, done).combine_chunks())
        kept = t.slice(done)
    if kept is not None and len(kept):
        yield run(kept.combine_chunks())


def resolve(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Spans (id, text_key, at, n) of repeats among the blocks asked about."""
    sent = docs.join(asked, ["id", "text_key"]).mapInArrow(send, BUCKET_SCHEMA)
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(merge, "id long, text_key long, at int, n int")


KIND = Kind(WIDTH, bytewise.blocks, bytewise.windows, bytewise.finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", earlier=False, resolve=resolve, resolve_rows=MERGE_ROWS)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), KIND)
