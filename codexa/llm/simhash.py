"""SimHash near-duplicates by multi-index hashing.

Documents with one fingerprint are one node.  Fingerprints within R bits differ
by few bits in some segment: with radii r_k whose sum of (r_k + 1) exceeds R, a
pair is within r_k bits in at least one segment k.  So a fingerprint stands in
each segment's table under every value within half that radius, and asks for
every value within the other half; the distance of what it finds is computed
in full.  Few wide segments ask often and find little, many narrow ones the
reverse; all are exact, and the number of fingerprints says which comes to the
least work.

The query links fingerprints within ``RADIUS`` bits of 64.  The pipeline's stage
reaches further, as near copies with 0.8 similar shingles mostly differ in 5 to
13 bits: it links those within ``FAR`` bits of 128.  The other 64 come from the
same shingles' hashes, scrambled, and have segments of their own.

A dense group of near copies would meet in all pairs.  First every
fingerprint is tied to the least one of its segment values (in the stage, of
each list that it asks), where they are close; components of those ties then stand for their members, and the tables
return links between different components only.  No link that could join two
components is lost.

Defined results: null and empty texts have fingerprint zero and are linked as
any others; a null doc_id keeps its row, and takes part with the largest id;
equal rows share a component; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .store import apart, cut, documents, shuffles_freed
from .textcore import mix

SHINGLE = 4
RADIUS = 4
FAR = 17
#: For FAR none of more than three bits' radius is among them: (4, 3) takes 3240 rows a document, where (2, 2, 2) takes 268.
#: Radii of the segments that 64 bits may be divided into; the sum of (r + 1) is RADIUS + 1, or for either half of 128 (FAR + 1) / 2.
LAYOUTS = {RADIUS: ((0, 0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0), (2, 1)), FAR: ((1, 1, 1, 1, 0), (2, 1, 1, 1), (2, 2, 2))}
NO_ID = (1 << 63) - 1
#: Fingerprints with one segment value that are compared with each other without looking at their other bits.
HOT_LIST = 4096


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8").lower().split()
    return _bits(words, size)


def _majority(h) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _hashes(words, size):
    """Of all shingles; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        grams = [line]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        ends = ends.tolist()
        grams = [line[s:e] for s, e in zip(starts, ends[size - 1 :], strict=False)]
    return np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype=np.uint64)


def _bits(words, size):
    return _majority(_hashes(words, size))


def _two(text: str | None) -> tuple[int, int]:
    h = _hashes((text or "").encode("utf-8").lower().split(), SHINGLE)
    return _majority(h), _majority(mix(h))


def print_batches(batches):
    for b in batches:
        fps = []
        for t in b.column("text"):
            raw = (t.as_py() or "").encode("utf-8").lower()
            fps.append(_bits(raw.split(), SHINGLE))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])


def two_batches(batches):
    """Adds both halves of 128 bits."""
    for b in batches:
        halves = np.array([_two(t.as_py()) for t in b.column("text")], dtype=np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["doc_id", "fp", "fp2"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(print_batches, "doc_id long, fp long")


def segments(n: int, reach: int = RADIUS) -> list[tuple[str, int, int, int, int]]:
    """(half, first bit, width, radius asked, radius listed) of each segment, for the layout with the least rows and finds among n fingerprints."""
    halves = ("fp", "fp2") if reach == FAR else ("fp",)

    def parts(radii):
        edges = [64 * i // len(radii) for i in range(len(radii) + 1)]
        return [(half, a, b - a, (r + 1) // 2, r // 2) for half in halves for a, b, r in zip(edges, edges[1:], radii, strict=False)]

    ball = lambda w, r: sum(math.comb(w, i) for i in range(r + 1))
    work = lambda p: sum(ball(w, q) + ball(w, i) + ball(w, q) * ball(w, i) * n / 2**w for _, _, w, q, i in p)
    return min(map(parts, LAYOUTS[reach]), key=work)


def _segment(part):
    half, at, width, *_ = part
    return F.shiftrightunsigned(half, at).bitwiseAND(F.lit((1 << width) - 1))


def _around(parts, which: int, own=None):
    """All (k, value) within the asked (3) or listed (4) radius of a fingerprint's segments, or of those numbered ``own``."""

    def ball(k, part):
        masks = [sum(1 << b for b in bits) for r in range(part[which] + 1) for bits in combinations(range(part[2]), r)]
        return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.struct(F.lit(k).alias("k"), _segment(part).bitwiseXOR(m).alias("value")))

    return F.concat(*[ball(k, p) for k, p in enumerate(parts) if own is None or k in own])


def _close(a: str, b: str, reach: int):
    """Whether two fingerprints, as columns of these names, are linked; the second halves of the query's are equal."""
    bits = lambda c: F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")))
    return bits("fp") + bits("fp2") <= reach


def links(prints: DataFrame, parts, reach: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Of a cut table of distinct (node, fp, fp2): (node, root) of the ties, and links (a, b) between roots.

    Tables of the far reach are read one after the other, and each one's shuffled rows go when
    its links are written, so the disk holds one table at a time.
    """
    own = [[k] for k in range(len(parts))] if reach == FAR else [list(range(len(parts)))]
    with shuffles_freed(prints.sparkSession):
        tied = components(reduce(DataFrame.unionByName, [cut(_ties(prints, parts, reach, ks)) for ks in own]))
        node = prints.join(tied.withColumnRenamed("node", "tied"), F.col("node") == F.col("tied"), "left").select("node", "fp", "fp2", F.coalesce("root", "node").alias("class"))
        node = cut(node)
        hot = hot_lists(_rows(prints, _values(parts))) if reach == RADIUS else None
        return tied, reduce(DataFrame.unionByName, [cut(_met(node, parts, reach, hot, ks)) for ks in own])


def _values(parts) -> Column:
    """(k, value) of a fingerprint's own segments."""
    return F.transform(F.array(*[_segment(p) for p in parts]), lambda v, k: F.struct(k.alias("k"), v.alias("value")))


def _rows(prints: DataFrame, values: Column) -> DataFrame:
    return prints.select("*", F.explode(values).alias("q")).select("*", "q.*").drop("q")


def _ties(prints: DataFrame, parts, reach: int, own) -> DataFrame:
    """Links (a, b) of each fingerprint to the least of the segment values that it asks, where they are close."""
    # Far links are many in a dense group: there the tables tie to the least that each list holds, one row a look-up.
    ask, listed = (_around(parts, 3, own), _around(parts, 4, own)) if reach == FAR else (_values(parts), _values(parts))
    least = _rows(prints, listed).groupBy("k", "value").agg(F.min(F.struct("node", "fp", "fp2")).alias("low"), F.count("*").alias("n"))
    least = least.filter(F.lit(reach == FAR) | (F.col("n") > 1))
    least = least.select("k", "value", F.col("low.node").alias("low"), F.col("low.fp").alias("low_fp"), F.col("low.fp2").alias("low_fp2"))
    met = _rows(prints, ask).join(least, ["k", "value"]).filter((F.col("node") != F.col("low")) & _close("", "low_", reach))
    return met.select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()


def hot_lists(index: DataFrame) -> DataFrame | None:
    """(k, value) of the segment values that more than HOT_LIST fingerprints have; None without any."""
    hot = cut(index.groupBy("k", "value").count().filter(F.col("count") > HOT_LIST).select("k", "value"))
    return None if hot.isEmpty() else hot


def _pieces(parts) -> Column:
    """Of a row with k: RADIUS + 1 pieces of the bits outside that segment, each with its number; two that are linked share one."""

    def of(part):
        half, at, width, *_ = part
        rest = F.shiftleft(F.shiftrightunsigned(half, at + width), at) if at + width < 64 else F.lit(0).cast("long")
        rest = rest.bitwiseOR(F.col(half).bitwiseAND(F.lit((1 << at) - 1)))
        edges = [(64 - width) * i // (RADIUS + 1) for i in range(RADIUS + 2)]
        return F.array(*[F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(rest, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for j, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])

    return F.get(F.array(*[of(p) for p in parts]), F.col("k"))


def _met(node: DataFrame, parts, reach: int, hot: DataFrame | None, own=None) -> DataFrame:
    """Links (a, b) between classes of a (node, fp, fp2, class) table, by the tables numbered ``own``, or all.

    In lists that many share, only those are compared that share a piece of their other
    bits too, as a pair within RADIUS must.
    """

    def joined(asked, table, keys):
        a, b = (df.toDF(*[c if c in keys else f"{n}_{c}" for c in df.columns]) for n, df in (("a", asked), ("b", table)))
        # Each asks and is listed, so of a pair either finds the other.
        near = (F.col("a_class") != F.col("b_class")) & _close("a_", "b_", reach)
        return a.join(b, keys).filter(near).select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b"))

    asked, table = (_rows(node, _around(parts, which, own)) for which in (3, 4))
    if hot is None:
        return joined(asked, table, ["k", "value"]).distinct()
    cold = [df.join(hot, ["k", "value"], "left_anti") for df in (asked, table)]
    fine = [df.join(hot, ["k", "value"], "left_semi").select("*", F.explode(_pieces(parts)).alias("p")).select("*", "p.*").drop("p") for df in (asked, table)]
    return joined(*cold, ["k", "value"]).unionByName(joined(*fine, ["k", "value", "j", "bits"])).distinct()


def classes(prints: DataFrame, parts=None, reach: int = RADIUS) -> DataFrame:
    """(node, fp, fp2, top, component_id) of a cut (doc_id, fp) or (doc_id, fp, fp2) table.

    ``node`` stands for a fingerprint, ``top`` is a node of the group and names
    it; component_id is its least doc_id, which groups may share.
    """
    if "fp2" in prints.columns:
        prints = prints.withColumn("node", F.xxhash64("fp", "fp2"))
    else:
        prints = prints.withColumn("fp2", F.lit(0).cast("long")).withColumn("node", F.col("fp"))
    own = cut(prints.groupBy("node", "fp", "fp2").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first_id")))
    tied, between = links(own.select("node", "fp", "fp2"), parts or segments(own.count(), reach), reach)
    joined = cut(components(between))
    node = own.join(tied.withColumnRenamed("node", "tied"), F.col("node") == F.col("tied"), "left").select("node", "fp", "fp2", "first_id", F.coalesce("root", "node").alias("class"))
    node = node.join(joined.withColumnsRenamed({"node": "class_node", "root": "top"}), F.col("class") == F.col("class_node"), "left")
    node = cut(node.select("node", "fp", "fp2", "first_id", F.coalesce("top", "class").alias("top")))
    # Cut before they are joined: then both sides are plain exchanges, and a large group's rows can be split.
    lows = cut(node.groupBy("top").agg(F.min("first_id").alias("component_id")))
    return node.join(lows, "top").select("node", "fp", "fp2", "top", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    prints = cut(fingerprints(docs))
    of = classes(prints).drop("fp2")
    out = prints.join(of, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def _ordered(name: str, kind: T.DataType):
    """The column, or as JSON if it holds a map or variant, which have no order."""

    def unordered(k):
        inner = [f.dataType for f in k.fields] if isinstance(k, T.StructType) else [k.elementType] if isinstance(k, T.ArrayType) else []
        return isinstance(k, (T.MapType, T.VariantType)) or any(map(unordered, inner))

    return F.to_json(F.struct(name)) if unordered(kind) else F.col(name)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id; groups are linked as far as ``FAR`` says.

    A null doc_id counts as the largest; of rows that share group and doc_id
    the least row stays (maps are ordered as JSON).  Rows with unique ids are picked by a semi-join.
    """
    docs, restore = apart(docs, ("doc_id", "text"))
    prints = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(two_batches, "doc_id long, fp long, fp2 long"))
    of = cut(classes(prints, None, FAR))
    same = ["fp", "fp2"]
    key = F.coalesce("doc_id", F.lit(NO_ID))
    odd = cut(prints.groupBy(key.alias("odd_id")).count().filter((F.col("count") > 1) | (F.col("odd_id") == NO_ID)).select("odd_id"))
    chosen = prints.join(of, same).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id"))
    if odd.isEmpty():
        return restore(docs.join(chosen, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi"))
    regular = docs.join(chosen.join(odd, F.col("kept_id") == F.col("odd_id"), "left_anti"), F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi")
    rows = docs.join(odd, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("odd_id"), "left_semi")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        for b in batches:
            fps = np.array([_two(t.as_py()) for t in b.column(docs_text)], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps[:, 0].copy()), pa.array(fps[:, 1].copy())], names=[*names, *same])

    docs_text, docs_id = docs.columns.index("text"), names[docs.columns.index("doc_id")]
    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip([*names, *same], [*docs.dtypes, ("", "long"), ("", "long")], strict=True))
    marked = rows.mapInArrow(run, schema).join(of, same).filter(F.coalesce(F.col(docs_id).cast("long"), F.lit(NO_ID)) == F.col("component_id"))
    # Partial aggregates: however many rows share an id, few reach one task.
    marked = marked.select("top", "node", F.struct(*names).alias("r"), F.struct(*[_ordered(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)]).alias("by"))
    one = marked.groupBy("top", "node").agg(F.min_by("r", "by").alias("r"), F.min("by").alias("by")).groupBy("top").agg(F.min_by("r", "by").alias("r"))
    return restore(regular.unionByName(one.select(*[F.col(f"r.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])))
