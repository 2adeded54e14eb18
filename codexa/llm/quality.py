"""Quality rules by an isolation forest over rule statistics.

Each document has statistics that rules would test: symbols, capitals, marks,
repeated lines and windows, word lengths.  Random splits, on rules drawn by
how well they part labelled rows, isolate unusual rows on short paths; documents whose paths are shorter than a threshold fail.  The
threshold is calibrated on labelled rows: it is the one that best parts
quality 0 from 1 among those that reject at most ``MAX_LOSS`` of the good ones.

The forest is grown on a draw of about ``SAMPLE`` different rows of statistics
with the number of documents that have them, by a seeded hash of the row: as many
as the trees take, 256 each, which is the method.  Every labelled row counts for
the rules' weights and for the threshold, whose scores are told apart to 1e-5.  However many documents share an
id or a text, they are one such row with a number.  Every document is judged on
its whole text.

Defined results: a null text has no words and fails; without labels of both
qualities only the base rules reject; several labels of a document count as
the lowest; equal rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, documents
from .textcore import Prefix, arrow_text, chunks, mix, word_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SAMPLE = 25_600
#: Steps of the score that the threshold tells apart: as many rows of counts come to the driver at most.
STEPS = 100_000
TREES, LEAVES, SEED = 100, 256, 97
MAX_LOSS = 0.002
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars", "n_upper", "n_marks", "n_lines", "n_shout", "n_distinct")
RULES = ("symbol_rate", "upper_rate", "shout_rate", "mark_rate", "word_length", "line_words", "repeat_rate", "dup_line_rate", "new_word_rate")


def repeats(hashes, word_at, width=WINDOW):
    """Whether each word lies in a window that its document holds twice."""
    n = len(hashes)
    if n < width:
        return np.zeros(n, bool)
    doc = np.repeat(np.arange(len(word_at) - 1), np.diff(word_at))
    starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    key = mix(Prefix(hashes).of(starts, starts + width) ^ mix(doc[starts].astype(np.uint64) + np.uint64(0x51ED270B)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    d = np.zeros(n + 1, np.int64)
    d[starts[twice]] += 1
    d[starts[twice] + width] -= 1
    return np.cumsum(d[:-1]) > 0


def per_doc(flags, offs):
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def counts(buf, offs):
    """Columns COUNTS and MORE for a chunk's documents."""
    ws, we, word_at = word_spans(buf, offs)
    lead = (buf & 0xC0) != 0x80
    in_word = np.zeros(len(buf) + 1, np.int8)
    in_word[ws] += 1
    in_word[we] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8) > 0
    h = word_hashes(buf, ws, we)
    kind = np.zeros(256, np.uint8)
    kind[list(SYMBOLS)] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[list(b"!?.,;:")] = 3
    k = kind[buf]
    shout = buf == ord("!")
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(word_at))
    pair = np.unique(mix(h ^ mix(doc.astype(np.uint64) + np.uint64(77))), return_index=True)[1] if len(h) else np.zeros(0, np.int64)
    distinct = np.bincount(doc[pair], minlength=len(offs) - 1)
    dup = np.zeros(len(offs) - 1, np.int64)
    lines = per_doc(buf == 10, offs) + 1
    raw = buf.tobytes()
    for i in np.flatnonzero(lines > 1):
        own = [x for x in raw[offs[i] : offs[i + 1]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        dup[i] = len(own) - len(set(own))
    return [np.diff(word_at), per_doc(lead & in_word, offs), per_doc(k == 1, offs), dup, per_doc(repeats(h, word_at), word_at),
            per_doc(lead, offs), per_doc(k == 2, offs), per_doc(k == 3, offs), lines, per_doc(shout, offs), distinct]


def count_batches(batches):
    names = ["doc_id", *COUNTS, *MORE]
    for b in batches:
        buf, offs = arrow_text(b.column("text"))
        parts = [counts(part, at) for _, _, part, at in chunks(buf, offs)]
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * (len(names) - 1)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in cols]], names=names)


def statistics(docs: DataFrame) -> DataFrame:
    schema = ", ".join(f"{c} long" for c in ("doc_id", *COUNTS, *MORE))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count_batches, schema)


def rule_values(c: dict) -> np.ndarray:
    """Rates, drawn to a usual value for short texts."""
    w, chars = c["n_words"], c["word_chars"]
    rate = lambda n, of, usual, k: (n + usual * k) / (of + k)
    return np.column_stack([
        rate(c["n_symbols"], w, 0.0, 20), rate(c["n_upper"], chars, 0.03, 100), rate(c["n_shout"], w, 0.0, 20), rate(c["n_marks"], w, 0.2, 50),
        rate(chars, w, 5.5, 20), np.log(rate(w, c["n_lines"], 30.0, 2)), rate(c["n_repeat_words"], w, 0.0, 50), rate(c["n_dup_lines"], c["n_lines"], 0.0, 5),
        rate(c["n_distinct"], np.sqrt(w * 1.0), 5.0, 10),
    ])


def telling(known: DataFrame) -> np.ndarray:
    """How far a rule's values part the labelled rows, all of them; equal if they can't tell."""

    def run(batches):
        for b in batches:
            frame = b.to_pandas()
            x = rule_values(as_arrays(frame))
            yield pa.RecordBatch.from_arrays([pa.array(frame["bad"].astype(bool)), *[pa.array(x[:, i]) for i in range(len(RULES))]], names=["bad", *RULES])

    rates = known.mapInArrow(run, "bad boolean, " + ", ".join(f"{r} double" for r in RULES))
    sums = {r["bad"]: r for r in rates.groupBy("bad").agg(*[F.avg(r).alias(f"m_{r}") for r in RULES], *[F.var_pop(r).alias(f"v_{r}") for r in RULES]).collect()}
    if len(sums) < 2:
        return np.ones(len(RULES))
    mean, var = ([np.array([sums[k][f"{c}_{r}"] for r in RULES]) for k in (True, False)] for c in "mv")
    far = np.abs(mean[0] - mean[1]) / (np.sqrt((var[0] + var[1]) / 2) + 1e-9)
    # Sums come in any order: digits that depend on it must not reach the draws.
    return np.round(0.02 + np.minimum(far, 3.0) ** 2, 6)


def grow(x: np.ndarray, trees=TREES, leaves=LEAVES, seed=SEED, weights=None, times=None) -> list[tuple]:
    """Isolation trees as arrays (feature, split, left child, path length).

    A split's rule is drawn by weight among those that differ in the node;
    ``times`` tells how often each row occurs.
    """
    last = np.cumsum(np.ones(len(x), np.int64) if times is None else times)
    n = int(last[-1])
    weights = np.ones(x.shape[1]) if weights is None else weights
    rng, forest = np.random.default_rng(seed), []
    deepest = int(np.ceil(np.log2(max(2, min(leaves, n)))))
    for _ in range(trees):
        rows = x[np.searchsorted(last, rng.choice(n, size=min(leaves, n), replace=False), side="right")]
        feature, split, child, path = [], [], [], []

        def node(own, depth):
            at = len(feature)
            for out, v in ((feature, -1), (split, 0.0), (child, -1), (path, depth + usual_path(len(own)))):
                out.append(v)
            spread = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 else []
            return at, own, depth, spread

        todo = [node(rows, 0)]
        while todo:
            at, own, depth, spread = todo.pop()
            if depth >= deepest or not len(spread):
                continue
            f = int(rng.choice(spread, p=weights[spread] / weights[spread].sum()))
            v = float(rng.uniform(own[:, f].min(), own[:, f].max()))
            feature[at], split[at], child[at] = f, v, len(feature)
            low = own[:, f] <= v
            todo += [node(own[low], depth + 1), node(own[~low], depth + 1)]
        forest.append((np.array(feature), np.array(split), np.array(child), np.array(path)))
    return forest


def usual_path(n):
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def anomaly(forest, x: np.ndarray, leaves=LEAVES) -> np.ndarray:
    """2 ^ (- mean path / usual path): near 1 for rows isolated at once."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, child, path in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = x[rows, np.maximum(f, 0)] > split[at]
            at = np.where(inner, child[at] + right, at)
        total += path[at]
    return np.exp2(-total / max(1, len(forest)) / max(usual_path(leaves), 1e-9))


def as_arrays(frame) -> dict:
    return {c: frame[c].to_numpy(dtype=float) for c in (*COUNTS, *MORE)}


def calibrate(score, bad, max_loss=MAX_LOSS, times=None) -> float:
    """The threshold with the most bad rows above it at a bounded loss of good ones."""
    if not bad.any() or bad.all():
        return 2.0
    times = np.ones(len(score), np.int64) if times is None else times
    order = np.argsort(-score, kind="stable")
    s, b, n = score[order], bad[order], times[order]
    caught, lost = np.cumsum(b * n) / (b * n).sum(), np.cumsum(~b * n) / (~b * n).sum()
    cut_at = np.append(s[1:] < s[:-1], True)
    value = np.where(cut_at & (lost <= max_loss), caught - lost, -1.0)
    k = int(np.argmax(value))
    if value[k] <= 0:
        return 2.0
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def draw(rows: DataFrame, most: int, n: int) -> DataFrame:
    """About so many different rows of n, or all if they are fewer, by a seeded hash of the row; ``times``: how often each occurs."""
    lot = F.pmod(F.xxhash64(F.lit(SEED).cast("long"), *rows.columns), F.lit(1_000_000))
    return rows.filter(lot < min(1.0, most / max(1, n)) * 1e6).groupBy(*rows.columns).agg(F.count("*").alias("times"))


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """Grow the forest on a draw of a cut table, then set its threshold."""
    order = [*COUNTS, *MORE]
    rows = draw(stats, SAMPLE, stats.count()).toPandas().sort_values(["doc_id", *order], kind="stable", ignore_index=True)
    if rows["times"].sum() < 2:
        return {"forest": [], "threshold": 2.0, "leaves": LEAVES}
    leaves = int(min(LEAVES, rows["times"].sum()))
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.min("quality") == 0).alias("bad"))
    known = stats.join(marked, F.col("doc_id") == F.col("label_id")).filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    known = cut(known.select("bad", *order))
    forest = grow(rule_values(as_arrays(rows)), weights=telling(known), times=rows["times"].to_numpy())

    def scores(batches):
        for b in batches:
            frame = b.to_pandas()
            steps = np.round(anomaly(forest, rule_values(as_arrays(frame)), leaves) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(frame["bad"].astype(bool)), pa.array(steps)], names=["bad", "step"])

    found = known.mapInArrow(scores, "bad boolean, step long").groupBy("step", "bad").agg(F.count("*").alias("times")).toPandas().sort_values(["step", "bad"], kind="stable")
    threshold = calibrate(found["step"].to_numpy() / STEPS, found["bad"].to_numpy(dtype=bool), times=found["times"].to_numpy())
    return {"forest": forest, "threshold": threshold, "leaves": leaves}


def base_failed(n_words, n_repeat_words):
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def judge(stats: DataFrame, model: dict) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, anomaly."""

    def run(batches):
        for b in batches:
            frame = b.to_pandas()
            score = anomaly(model["forest"], rule_values(as_arrays(frame)), model["leaves"]) if model["forest"] else np.zeros(len(frame))
            failed = base_failed(frame["n_words"], frame["n_repeat_words"]).to_numpy(dtype=bool)
            kept = ~failed & (score < model["threshold"])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", *COUNTS)], pa.array(failed), pa.array(kept), pa.array(score)], names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    schema = ", ".join(f"{c} long" for c in ("doc_id", *COUNTS)) + ", base_failed boolean, kept boolean, anomaly double"
    return stats.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(statistics(documents(spark, sf_dir)))
    return judge(stats, fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
