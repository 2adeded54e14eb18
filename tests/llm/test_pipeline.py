import hashlib
import random
import re

import corpus
import corpus_pipeline
import numpy as np
from codexa.llm import decontam, mixing, sharding, toxicity
from test_learned import naive_features
from test_mixing import brute_targets
from test_sharding import brute


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join(corpus.words(rng, 60))
    data = [(i, text() + (" grumblefuzz" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(150)]
    item = "which of these many long words is the one that nobody would ever guess at first"
    data += [(200, data[1][1], "en", "s0", 0), (201, text() + " " + item + " " + text(), "en", "s0", 0), (202, None, None, None, 0), (203, "", None, None, 0)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(150)]
    path = corpus.write(spark, tmp_path, data, labels=(labels, "doc_id long, quality int, toxic int"), benchmark=([(1, item)], "item_id long, text string"))
    out = corpus_pipeline.run(spark, path)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "shard" in out.columns
    got = {r["doc_id"] for r in out.collect()}
    assert not got & {i for i in range(0, 150, 5)} and not got & {200, 201, 203}
    assert 202 in got and len(got & set(range(150))) > 60
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontaminate", "mix_sources", "shard"]


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    path = corpus.write(spark, tmp_path, [], labels=([], "doc_id long, quality int, toxic int"), benchmark=([], "item_id long, text string"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
    assert corpus_pipeline.run(spark, path).count() == 0


def naive_words(text):
    t = re.sub(r"(^|[\W_])([A-ZÀ-Þ])(?=[^\W\d_])", "\\1\x03\\2", text or "").lower()
    t = re.sub(r"(\d+)", " \x01\\1 ", t)
    t = re.sub(rf"(\x01\d+) +({decontam.UNITS})([^\w]|[\d_]|$)", "\\1 \x02\\2\\3", t)
    return [w for w in re.split(r"[^\w\x01-\x03]+|_", t) if w]


def naive_leak(text, item):
    """Whether a text holds an item: both templates, every diagonal, words as evidence, values one to one."""
    doc, is_slot = naive_words(text), lambda w: w < "\x04"
    bare = [w.removeprefix("\x03") for w in doc]

    def wins(ws):
        told = lambda part: tuple(part) if all(map(is_slot, part)) else tuple(w[0] if is_slot(w) else w for w in part)
        return [told(ws[i : i + 5]) for i in range(len(ws) - 4)] if len(ws) >= 5 else [("few", *told(ws))] if ws else []

    for asked in (naive_words(item), [w.removeprefix("\x03") for w in naive_words(item)]):
        own, other, lines = wins(doc), wins(bare), {}
        for i, w in enumerate(wins(asked)):
            for k, pair in enumerate(zip(own, other, strict=True)):
                if w in pair:
                    lines.setdefault(k - i, set()).add(i)
        n = len(wins(asked))
        matched = set().union(*lines.values())
        if not lines or len(matched) < 0.8 * n:
            continue
        literal = sum(not is_slot(w) and any(a <= k < a + 5 for a in matched) for k, w in enumerate(asked))
        fits = {}
        for shift, at in lines.items():
            pairs = {(a, doc[k + shift]) for k, a in enumerate(asked) if is_slot(a) and 0 <= k + shift < len(doc) and doc[k + shift][0] == a[0]}
            if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                fits[shift] = (at, sum(a != b for a, b in pairs))
        if not fits:
            continue
        best = min(fits, key=lambda x: (-len(fits[x][0]), x))
        whole = len(fits[best][0]) == max(map(len, lines.values())) or len(set().union(*(at for at, _ in fits.values()))) >= 0.8 * n
        if whole and (not fits[best][1] or literal >= 5):
            return True
    return False


def test_against_brute_force(spark, tmp_path, monkeypatch):
    """Every stage's naive version on the rows that the one before it left; learned weights are taken over."""
    rng = random.Random(12)
    text = lambda n=40: " ".join(corpus.words(rng, n))
    items = [(1, "Anna has 12 apples. Anna buys 30 more and gives 5 to Tom. How many does Anna have now?"), (2, "which of these many long words would nobody ever guess at first sight")]
    data = [(i, text() + (f" you grumblefuzz {text(2)}" if i % 6 == 0 else ""), "en", f"s{min(i % 7, 3)}" if i % 11 else None, 0) for i in range(160)]
    near = data[1][1].split()
    data += [(300 + i, " ".join([*near[:-1], "tail" * i]) if i < 3 else text(400), "de", "s1", 0) for i in range(6)]
    data += [(400, f"{text()} {items[0][1].replace('Anna', 'Maria').replace('12', '14')} {text()}", "en", "s2", 0), (401, f"{text()} {items[1][1].upper()}", "en", "s2", 0), (402, items[0][1].replace("Anna has", "Maria has").replace("Anna buys", "Rosa buys"), "en", "s0", 0), (403, None, None, None, 0)]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(160)]
    path = corpus.write(spark, tmp_path, data, labels=(labels, "doc_id long, quality int, toxic int"), benchmark=(items, "item_id long, text string"))
    docs = spark.read.parquet(f"{path}/documents.parquet")

    model = toxicity.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    rows = [r for r in data if toxicity.chance(model, np.array([naive_features(model, r[1])]))[0] < toxicity.THRESHOLD]
    rows.sort()
    roots = corpus.components(corpus.far_links([r[1] for r in rows]), range(len(rows)))
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    rows = [r for r in rows if not any(naive_leak(r[1], t) for _, t in items)]
    assert len(rows) < len(data) - 30 and {402, 403} <= {r[0] for r in rows} and not {400, 401} & {r[0] for r in rows}

    size = lambda r: len((r[1] or "").split())
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r)
    goal = brute_targets(sizes)
    place = {r[0]: int(hashlib.md5(f"{mixing.SEED}/{r[0]}/{r[1] or ''}".encode()).hexdigest()[:15], 16) for r in data}
    mixed = []
    for source, target in goal.items():
        whole = int(target // sizes[source]) if sizes[source] else 0
        left = round(target) - whole * sizes[source]
        for r in sorted((r for r in rows if r[3] == source), key=lambda r: place[r[0]]):
            due = 2 * min(size(r), max(0, left)) >= size(r) > 0
            left -= size(r)
            mixed += [r] * (whole + due if size(r) else max(1, whole))
    # A limit that splits; the stage's own is far above so few texts.
    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:-1], ("shard", lambda s, rest, path: sharding.shard(rest, 4000))])
    want = sorted((mixed[i][0], *v) for i, v in brute(mixed, 4000).items())
    assert len({w[1] for w in want}) > 5
    out = corpus_pipeline.run(spark, path)
    assert sorted((r["doc_id"], r["shard"], r["shard_bytes"], r["oversized"]) for r in out.collect()) == want
