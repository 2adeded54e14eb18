"""Language identification of mixed-language text.

Script ranges narrow a word's candidate languages; the word's score in each is
the log-probability of its letter trigrams, learned from labelled documents; a
Viterbi pass with a penalty for switching labels spans.  A path that leaves the
document's best language on m stretches pays for m - 1 switches at least, for
one if m is 1.  So where no stretch gains half the penalty, or none gains two
thirds and no two that adjoin and fill the document gain all of it together,
the best path stays in that language, and the pass is spared.

Learning takes about ``SAMPLE`` documents a language, by hash, of those whose
crc32(doc_id as text) mod 4 isn't 2.  The model has ``BINS`` numbers a language;
with over ``WIDE`` languages, fewer bins, so that its size is bounded.

Defined results: ``und`` and score 0 for a null text, one without a letter, or
if nothing was learned; letters of scripts that no language has are no
evidence, and a text of such alone gets the commonest language with score 0;
equal rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .letters import Letters
from .store import documents
from .textcore import arrow_text, chunks, mix

SAMPLE = 1500
BINS = 1 << 16
WIDE = 512
PENALTY = 12.0
SCRIPTS = 20
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, spans string"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bins_for(languages: int) -> int:
    """BINS, halved until the model is no larger than for WIDE languages."""
    return BINS >> max(0, (languages - 1) // WIDE).bit_length()


def trigram_bins(x: Letters, bins: int = BINS):
    """A bin for each letter of each word, and where the words begin in that."""
    n = x.we - x.ws
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(x.ws, n)
    c = x.lower.astype(np.uint64)
    here = c[at]
    left = np.where(at > np.repeat(x.ws, n), c[at - 1], 32)
    right = np.where(at + 1 < np.repeat(x.we, n), c[np.minimum(at + 1, len(c) - 1)], 32)
    return (mix((left << np.uint64(42)) ^ (here << np.uint64(21)) ^ right) & np.uint64(bins - 1)).astype(np.int64), first


def count_batches(bins):
    def run(batches):
        for b in batches:
            buf, offs = arrow_text(b.column("text"))
            langs = b.column("lang").to_pylist()
            names = sorted(set(langs))
            place = {v: i for i, v in enumerate(names)}
            codes = np.array([place[v] for v in langs], dtype=np.int64)
            found = {"gram": [np.zeros((2, 0), np.int64)], "script": [np.zeros((2, 0), np.int64)]}
            for lo, hi, part, at in chunks(buf, offs):
                x = Letters(part, at)
                if not len(x.ws):
                    continue
                grams, _ = trigram_bins(x, bins)
                of_word = np.repeat(codes[lo:hi], np.diff(x.word_at))
                for kind, size, v in (("gram", bins, np.repeat(of_word, x.we - x.ws) * bins + grams), ("script", SCRIPTS, of_word * SCRIPTS + x.script)):
                    found[kind].append(np.stack(np.unique(v, return_counts=True)))
            for kind, size in (("gram", bins), ("script", SCRIPTS)):
                v, n = np.concatenate(found[kind], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in v // size], pa.string()), pa.array([kind] * len(v), pa.string()), pa.array(v % size, pa.int64()), pa.array(n, pa.int64())], names=["lang", "kind", "bin", "n"])

    return run


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: languages by frequency, log-probabilities, scripts."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    seen = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row a language
    if not seen:
        return {"langs": []}
    per_mille = F.create_map(*[F.lit(v) for r in seen for v in (r["lang"], min(1.0, sample / r["count"]) * 1e6)])
    lot = F.pmod(F.xxhash64(F.lit(7).cast("long"), "doc_id", "text"), F.lit(1_000_000))
    bins = bins_for(len(seen))
    chosen = usable.filter(lot < F.try_element_at(per_mille, F.col("lang"))).select("lang", "text")
    counts = chosen.mapInArrow(count_batches(bins), "lang string, kind string, bin long, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))
    langs = [r["lang"] for r in seen]
    table = counts.toPandas()  # bins + SCRIPTS rows a language at most
    grams, scripts = np.zeros((bins, len(langs))), np.zeros((SCRIPTS, len(langs)))
    at = table["lang"].map({v: k for k, v in enumerate(langs)}).to_numpy(dtype=np.int64)
    for kind, m in (("gram", grams), ("script", scripts)):
        pick = (table["kind"] == kind).to_numpy()
        m[table["bin"].to_numpy()[pick], at[pick]] = table["n"].to_numpy()[pick]
    logp = np.log(grams + 0.2) - np.log(grams.sum(0) + 0.2 * bins)
    usual = scripts > 0.001 * np.maximum(scripts.sum(0), 1)
    return {"langs": langs, "logp": logp.astype(np.float32), "scripts": usual}


def viterbi(s, penalty):
    """Best label of each word; s: words x languages.  Plain floats: languages are few."""
    rows = s.tolist()
    v, before = rows[0], []
    for row in rows[1:]:
        best = max(v)
        floor = best - penalty
        before.append((v, best, floor))
        v = [(x if x >= floor else floor) + y for x, y in zip(v, row, strict=True)]
    at = v.index(max(v))
    path = [at]
    for v, best, floor in reversed(before):
        if v[at] < floor:
            at = v.index(best)
        path.append(at)
    return np.array(path[::-1])


def largest_gain(d, first, last):
    """Largest sum over any stretch of each document's words."""
    total = np.concatenate([[0.0], np.cumsum(d)])
    doc = np.repeat(np.arange(len(first)), last - first + 1)
    at = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    # Falling offsets keep each document's running minimum its own.
    span = float(np.ptp(total)) + 1.0
    level = total[at] - doc * (2 * span)
    return np.maximum.reduceat(level - np.minimum.accumulate(level), np.searchsorted(doc, np.arange(len(first))))


def two_part_gain(s, base, first, last):
    """For each document the largest gain of a stretch from its start and one to its end that meet, each in one language."""
    gain = s - s[np.arange(len(s)), base][:, None]
    total = np.cumsum(gain, axis=0)
    out = np.zeros(len(first))
    for i, (a, z) in enumerate(zip(first, last, strict=True)):
        head = total[a:z] - (total[a - 1] if a else 0.0)
        out[i] = (head.max(1) + (head[-1] - head).max(1)).max()
    return out


def label(model: dict, x: Letters):
    """For each document: (language, score, spans)."""
    langs, n_docs = model["langs"], len(x.doc_at) - 1
    out = [("und", 0.0, "")] * n_docs
    first, last = x.word_at[:-1], x.word_at[1:]
    full = np.flatnonzero(last > first)
    if not langs or not len(full):
        return out
    bins, begin = trigram_bins(x, len(model["logp"]))
    s = np.add.reduceat(model["logp"][bins], begin, axis=0).astype(np.float64)
    can = model["scripts"][x.script]
    known = can.any(1)
    s = np.where(can, s, s.min(1, keepdims=True) - 30.0)
    s = np.where(known[:, None], s - s.max(1, keepdims=True), 0.0)
    post = np.exp(s)
    post /= post.sum(1, keepdims=True)
    a, z = first[full], last[full]
    total = np.add.reduceat(s, a, axis=0)[: len(a)]
    best = np.argmax(total, axis=1)
    base = np.repeat(best, z - a)
    words = np.arange(len(x.ws))
    gain = np.zeros(len(full))
    for k in range(len(langs)):
        gain = np.maximum(gain, largest_gain(s[:, k] - s[words, base], a, z))
    stays = gain < PENALTY / 2
    unsure = np.flatnonzero(~stays & (gain < PENALTY * 2 / 3))
    if len(unsure):
        stays[unsure] = two_part_gain(s, base, a[unsure], z[unsure]) < PENALTY
    for i, d in enumerate(full):
        lo, hi, at = a[i], z[i], x.doc_at[d]
        if stays[i]:
            k, cuts, names = int(best[i]), [lo], [int(best[i])]
        else:
            path = viterbi(s[lo:hi], PENALTY)
            letters = np.bincount(path, weights=(x.we - x.ws)[lo:hi], minlength=len(langs))
            k = int(np.argmax(letters))
            cuts = [lo, *(np.flatnonzero(path[1:] != path[:-1]) + lo + 1)]
            names = [int(path[c - lo]) for c in cuts]
        score = float(post[lo:hi, k].mean()) if known[lo:hi].any() else 0.0
        ends = [*cuts[1:], hi]
        spans = ",".join(f"{langs[m]}:{x.ws[c] - at}:{x.we[e - 1] - at}" for c, e, m in zip(cuts, ends, names, strict=True))
        out[d] = (langs[k], min(1.0, max(0.0, score)), spans)
    return out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans (language:start:end in code points)."""

    def run(batches):
        for b in batches:
            buf, offs = arrow_text(b.column("text"))
            out = [r for _, _, part, at in chunks(buf, offs) for r in label(model, Letters(part, at))]
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *cols], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, learn(docs))
