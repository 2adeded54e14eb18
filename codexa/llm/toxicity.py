"""Toxicity by a weighted finite-state grammar.

Words become classes: insult, threat, target, negation, reporting.  Insults are
units (words and prefixes) learned from labelled rows; threats are units that
mark toxic documents only in clauses with a target, learned likewise, and a few
fixed verbs.  Small weighted transducers for negation and reported speech are
composed into one machine that reads each clause with an insult or a threat
from the left; one for address reads it from both sides, so a target counts
before a hit and behind it.  An insult after a negation or in reported speech
weighs less, one with a target in its clause weighs more.  A logistic curve
over the clauses' weights, fitted on the same rows, gives the score.

Learning takes about ``SAMPLE`` labelled documents of each class, by hash, of
those whose crc32(doc_id as text) mod 4 isn't 2; ``MAX_UNITS`` units at most.

Defined results: null and empty texts and texts without such words get the
curve's lowest score; labels with null toxic are left out, of several labels
of a document the largest counts; without labels every score is 0; equal rows
give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import held_out
from .letters import LAST, Letters
from .store import cut, documents
from .textcore import Prefix, arrow_text, chunks, word_hashes, word_spans

SAMPLE = 5000
MAX_UNITS = 4096
PREFIXES = (4, 5, 6, 7)
#: A unit's share of toxic documents among those with it, and its odds against clean ones.
PURE, LEAST_ODDS = 0.5, 8.0
SHINGLE = 4
THRESHOLD = 0.3
CLAUSE_ENDS = frozenset(map(ord, ".!?;:,\n"))
QUOTES = frozenset(map(ord, "\"“”«»„"))
TARGETS = frozenset("you your he him she her they them u ya this these that du dich dir ihr euch er sie sein dieser diese tu te toi vous il elle ils elles ce cette tú te ti usted ustedes él ella ellos ellas este esta".split())
NEGATIONS = frozenset("not no never neither nor nicht kein keine nie niemals pas jamais ni aucun aucune nunca ningún ninguna tampoco isn wasn aren don doesn".split())
REPORTS = frozenset("said says say called calls wrote writes reported quoted sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split())
THREATS = frozenset("kill murder strangle stab shoot töten umbringen ermorden tuer assassiner matar asesinar".split())
ADDRESSED = np.uint64(0x7C15D1B54A32D192)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
REACH = 3


class Transducer:
    """Arcs (state, class) -> (state, weight); a missing arc goes by (state, None)."""

    def __init__(self, arcs, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, kind):
        return self.arcs.get((state, kind)) or self.arcs[state, None]

    def compose(self, other):
        """Reads the same classes on both machines; weights multiply."""
        start = (self.start, other.start)
        todo, arcs = [start], {}
        while todo:
            state = todo.pop()
            for kind in range(REPORT + 1):
                if (state, kind) not in arcs:
                    (p, a), (q, b) = self.step(state[0], kind), other.step(state[1], kind)
                    arcs[state, kind] = ((p, q), a * b)
                    todo.append((p, q))
        return Transducer(arcs, start)

    def factors(self, kinds):
        """The weight of each word's arc."""
        state, out = self.start, []
        for kind in kinds:
            state, factor = self.step(state, kind)
            out.append(factor)
        return out


class Grammar:
    """A machine that reads a clause from the left, and one that reads it from both sides."""

    def __init__(self, machine: Transducer, address: Transducer):
        self.machine, self.address = machine, address

    def read(self, kinds, weights):
        """Weighted sum over the insults and threats of one clause."""
        own, ahead, back = self.machine.factors(kinds), self.address.factors(kinds), self.address.factors(kinds[::-1])[::-1]
        return sum(w * f * max(a, b) for w, f, a, b in zip(weights, own, ahead, back, strict=True))


def grammar() -> Grammar:
    hits = (INSULT, THREAT)
    negation = {}
    for n in range(REACH + 1):
        negation[n, None] = (max(0, n - 1), 1.0)
        negation[n, NEGATION] = (REACH, 1.0)
        for h in hits:
            negation[n, h] = (max(0, n - 1), 0.3 if n else 1.0)
    reported = {(0, None): (0, 1.0), (0, REPORT): (1, 1.0), (1, None): (1, 1.0), **{(1, h): (1, 0.5) for h in hits}}
    # 0: nobody addressed yet; 1: someone was.
    address = {(0, None): (0, 1.0), (1, None): (1, 1.0), (0, TARGET): (1, 1.0), (1, INSULT): (1, 1.5), (1, THREAT): (1, 2.0)}
    return Grammar(Transducer(negation).compose(Transducer(reported)), Transducer(address))


def unit_hashes(x: Letters):
    """Hashes of each word and of its proper prefixes; 0 where it is shorter."""
    p = x.prefix()
    rows = [p.of(x.ws, x.we)]
    n = x.we - x.ws
    for k in PREFIXES:
        long = n > k
        h = p.of(x.ws, np.where(long, x.ws + k, x.we)) ^ np.uint64(k * 0x9E3779B97F4A7C1)
        rows.append(np.where(long, h, np.uint64(0)))
    return rows


def clauses(x: Letters):
    """Each word's clause, numbered over all documents."""
    marks = np.zeros(LAST, bool)
    marks[sorted(CLAUSE_ENDS | QUOTES)] = True
    before = np.zeros(len(x.cps) + 1, np.int64)
    np.cumsum(marks[np.minimum(x.cps, LAST - 1)], out=before[1:])
    return before[x.ws] + np.repeat(np.arange(len(x.doc_at) - 1), np.diff(x.word_at))


def among(h, sorted_hashes):
    """Whether each hash is one of a few: a table of their low bits passes over most."""
    out = np.zeros(len(h), bool)
    if len(sorted_hashes):
        low = np.zeros(1 << 16, bool)
        low[(sorted_hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(sorted_hashes, h[maybe]), len(sorted_hashes) - 1)
        out[maybe] = sorted_hashes[at] == h[maybe]
    return out


def addressed(words, clause):
    """Units of the words in clauses with a target, itself left out; 0 elsewhere."""
    target = among(words, np.sort(_hashes(TARGETS)))
    if not len(words):
        return words
    with_target = np.bincount(clause - clause[0], weights=target) > 0
    return np.where(with_target[clause - clause[0]] & ~target, words ^ ADDRESSED, np.uint64(0))


def mark_near(batches):
    """Adds the least hash of a document's word windows: near copies share it."""
    for b in batches:
        buf, offs = arrow_text(b.column("text"))
        near = np.zeros(len(offs) - 1, np.uint64)
        for lo, hi, part, at in chunks(buf, offs):
            ws, we, word_at = word_spans(part, at)
            p = Prefix(word_hashes(part, ws, we))
            doc = np.repeat(np.arange(hi - lo), np.diff(word_at))
            ends = np.minimum(np.arange(len(ws)) + SHINGLE, word_at[1:][doc])
            full = np.flatnonzero(word_at[1:] > word_at[:-1])
            if len(full):
                near[lo + full] = np.minimum.reduceat(p.of(np.arange(len(ws)), ends), word_at[:-1][full])
        yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic"), pa.array(near.view(np.int64))], names=["text", "toxic", "near"])


def count_units(batches):
    """(unit, label, documents with it) over a batch; unit 0 counts documents."""
    for b in batches:
        buf, offs = arrow_text(b.column("text"))
        toxic = np.asarray(b.column("toxic").to_pylist(), dtype=np.int64)
        units, of = [np.zeros(len(toxic), np.uint64)], [toxic]
        for lo, _, part, at in chunks(buf, offs):
            x = Letters(part, at)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(x.word_at))
            rows = unit_hashes(x)
            for h in [*rows, addressed(rows[0], clauses(x))]:
                keep = h != 0
                pair = np.unique(np.stack([h[keep], doc[keep].astype(np.uint64)]), axis=1) if keep.any() else np.zeros((2, 0), np.uint64)
                units.append(pair[0])
                of.append(toxic[lo + pair[1].astype(np.int64)])
        pairs, n = np.unique(np.stack([np.concatenate(units).view(np.int64), np.concatenate(of)]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n.astype(np.int64))], names=["unit", "toxic", "n"])


def learn_units(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Units that mark toxic documents beyond chance, and their weights."""
    counts = rows.mapInArrow(count_units, "unit long, toxic long, n long")
    per = counts.groupBy("unit").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    per = cut(per.filter("unit = 0 OR a + b >= 3"))
    sums = per.filter("unit = 0").collect()
    n_toxic, n_clean = (sums[0]["a"], sums[0]["b"]) if sums else (0, 0)
    if not n_toxic or not n_clean:
        return np.zeros(0, np.uint64), np.zeros(0)
    r = n_toxic / (n_toxic + n_clean)
    a, b = F.col("a"), F.col("b")
    n = a + b
    # Twice the log-likelihood ratio against the base rate, for units over it.
    g = 2 * (a * F.log(a / n / r) + F.when(b > 0, b * F.log(b / n / (1 - r))).otherwise(0.0))
    tried = per.filter((F.col("unit") != 0) & (n >= 3)).withColumn("g", F.when((a > 0) & (a / n > r), g).otherwise(0.0))
    m = max(2, tried.count())
    top = tried.filter((F.col("g") > 2 * float(np.log(m))) & (a / n >= PURE) & (a / n_toxic >= LEAST_ODDS * b / n_clean)).orderBy(F.desc("g"), "unit").limit(MAX_UNITS).collect()
    units = np.array([t["unit"] for t in top], dtype=np.int64).view(np.uint64)
    w = np.array([np.log((t["a"] + 0.5) / (n_toxic + 1)) - np.log((t["b"] + 0.5) / (n_clean + 1)) for t in top])
    order = np.argsort(units)
    return units[order], np.maximum(w, 0.0)[order]


def features(units, weights, x: Letters):
    """Per document: clauses with hits, heaviest clause, log of all weight."""
    machine, n_docs = grammar(), len(x.doc_at) - 1
    out = np.zeros((n_docs, 3))
    if not len(x.ws):
        return out
    rows = unit_hashes(x)
    clause = clauses(x)

    def weigh(h):
        hit = np.flatnonzero(among(h, units))
        out = np.zeros(len(h))
        out[hit] = weights[np.searchsorted(units, h[hit])]
        return out

    w = np.max([weigh(h) for h in rows], axis=0)
    # What isn't an insult alone, but toxic towards a target; fixed verbs weigh 1 at least.
    t = np.maximum(weigh(addressed(rows[0], clause)), among(rows[0], np.sort(_hashes(THREATS))).astype(float))
    threat = (w == 0) & (t > 0)
    w = np.where(threat, t, w)
    hits = np.flatnonzero(w > 0)
    if not len(hits):
        return out
    doc = np.searchsorted(x.word_at, hits, side="right") - 1
    seen = set()
    for i, d in zip(hits.tolist(), doc.tolist(), strict=True):
        if (d, clause[i]) in seen:
            continue
        seen.add((d, clause[i]))
        lo, hi = int(np.searchsorted(clause, clause[i])), int(np.searchsorted(clause, clause[i], side="right"))
        kinds, mine = [], []
        for j in range(lo, hi):
            word = x.word(j)
            kind = THREAT if threat[j] else INSULT if w[j] > 0 else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else TARGET if word in TARGETS else OTHER
            kinds.append(kind)
            mine.append(float(w[j]))
        if lo and chr(x.cps[x.ws[lo] - 1]) in "\"“«„" and x.ws[lo] > x.doc_at[d]:
            kinds, mine = [REPORT, *kinds], [0.0, *mine]
        weight = machine.read(kinds, mine)
        out[d] += (1.0, 0.0, weight)
        out[d, 1] = max(out[d, 1], weight)
    out[:, 0] = np.log1p(out[:, 0])
    out[:, 2] = np.log1p(out[:, 2])
    return out


@lru_cache(8)
def _hashes(words):
    text = "\n".join(sorted(words)).encode()
    x = Letters(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    return x.prefix().of(x.ws, x.we)


def feature_rows(units, weights, extra):
    """mapInArrow function: the columns named, then the features."""

    def run(batches):
        for b in batches:
            buf, offs = arrow_text(b.column("text"))
            parts = [features(units, weights, Letters(part, at)) for _, _, part, at in chunks(buf, offs)]
            f = np.concatenate(parts) if parts else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in extra], *[pa.array(f[:, i]) for i in range(3)]], names=[*extra, "f0", "f1", "f2"])

    return run


def fit_curve(f, y, ridge=0.01, rounds=50):
    """Logistic regression by Newton's method."""
    x = np.column_stack([np.ones(len(f)), f])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.max("toxic") > 0).cast("long").alias("toxic"))
    seen = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        return {"units": np.zeros(0, np.uint64), "weights": np.zeros(0), "beta": None}
    share = F.create_map(*[F.lit(v) for k, n in seen.items() for v in (k, min(1.0, sample / n) * 1e6)])
    lot = F.pmod(F.xxhash64(F.lit(11).cast("long"), "label_id"), F.lit(1_000_000))
    chosen = F.broadcast(marked.filter(lot < F.element_at(share, F.col("toxic"))))  # about 2 * SAMPLE rows of two numbers
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("label_id")).select("text", "toxic")
    # Copies would pass for evidence: of near copies with one label, one teaches.
    rows = rows.mapInArrow(mark_near, "text string, toxic long, near long").groupBy("near", "toxic").agg(F.min("text").alias("text"))
    rows = cut(rows.select("text", "toxic"))
    units, weights = learn_units(rows)
    found = rows.mapInArrow(feature_rows(units, weights, ["toxic"]), "toxic long, f0 double, f1 double, f2 double").toPandas()
    beta = fit_curve(found[["f0", "f1", "f2"]].to_numpy(), found["toxic"].to_numpy(dtype=float)) if found["toxic"].nunique() == 2 else None
    return {"units": units, "weights": weights, "beta": beta}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    raw = rows.mapInArrow(feature_rows(model["units"], model["weights"], ["doc_id", "held_out"]), "doc_id long, held_out boolean, f0 double, f1 double, f2 double")
    if model["beta"] is None:
        p = F.lit(0.0)
    else:
        b = [float(v) for v in model["beta"]]
        p = 1 / (1 + F.exp(-(F.lit(b[0]) + b[1] * F.col("f0") + b[2] * F.col("f1") + b[3] * F.col("f2"))))
    return raw.select("doc_id", "held_out", p.alias("score"), (p >= THRESHOLD).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def chance(model: dict, f):
    b = model["beta"]
    return np.zeros(len(f)) if b is None else 1 / (1 + np.exp(-(b[0] + f @ np.asarray(b[1:]))))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the grammar doesn't find toxic; rows aren't moved."""
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches):
        for b in batches:
            buf, offs = arrow_text(b.column("text"))
            parts = [features(model["units"], model["weights"], Letters(part, at)) for _, _, part, at in chunks(buf, offs)]
            yield b.filter(pa.array(chance(model, np.concatenate(parts) if parts else np.zeros((0, 3))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
