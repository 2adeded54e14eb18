"""Toxicity, language and quality: held-out accuracy, definitions, odd tables."""

import random
import re
import zlib

import corpus
import numpy as np
import pytest
from codexa.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    rows = toxicity.op3_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    tp = sum(r["toxic"] and r["predicted"] for r in rows)
    assert tp / sum(r["toxic"] for r in rows) > 0.85 and tp / sum(r["predicted"] for r in rows) > 0.85


def test_grammar():
    m = toxicity.grammar()
    I, Y, N, R, O, T = toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.OTHER, toxicity.THREAT  # noqa: E741
    weigh = lambda *kinds: m.read(kinds, [1.0 if k in (I, T) else 0.0 for k in kinds])
    assert weigh(O, I) == 1.0 and weigh(Y, O, I) == 1.5
    assert weigh(N, I) == pytest.approx(0.3) and weigh(N, O, O, O, I) == 1.0
    assert weigh(R, O, I) == 0.5 and weigh(R, Y, N, I) == pytest.approx(0.5 * 1.5 * 0.3)
    assert weigh(Y, N) == 0.0
    assert weigh(T) == 1.0 and weigh(Y, O, T) == weigh(T, Y) == weigh(T, O, O, Y) == 2.0 and weigh(I, O, Y) == 1.5
    assert weigh(N, T, Y) == pytest.approx(0.3 * 2.0) and weigh(T, Y, I) == 2.0 + 1.5 and weigh(T, N, Y) == 2.0


def naive_features(model, text):
    """Clause by clause, from strings."""
    known = dict(zip(model["units"].tolist(), model["weights"].tolist(), strict=True))
    hashed = lambda s, salt=0: int(toxicity._hashes(frozenset([s]))[0]) ^ salt
    out = []
    ends = "".join(map(chr, toxicity.CLAUSE_ENDS | toxicity.QUOTES))
    for m in re.finditer(f"[^{re.escape(ends)}]+", text or ""):
        words = re.findall(r"[^\W\d_]+", m[0].lower())
        some = any(w in toxicity.TARGETS for w in words)
        kinds, weights = [], []
        for w in words:
            own = max([known.get(hashed(w), 0.0), *[known.get(hashed(w[:k], k * 0x9E3779B97F4A7C1), 0.0) for k in toxicity.PREFIXES if len(w) > k]])
            aimed = max(known.get(hashed(w, int(toxicity.ADDRESSED)), 0.0) if some and w not in toxicity.TARGETS else 0.0, float(w in toxicity.THREATS))
            kinds.append(toxicity.INSULT if own else toxicity.THREAT if aimed else toxicity.NEGATION if w in toxicity.NEGATIONS else toxicity.REPORT if w in toxicity.REPORTS else toxicity.TARGET if w in toxicity.TARGETS else toxicity.OTHER)
            weights.append(own or aimed)
        if any(weights):
            quoted = m.start() and text[m.start() - 1] in "\"“«„" and text[m.start()].isalpha()
            out.append(toxicity.grammar().read([toxicity.REPORT] * bool(quoted) + kinds, [0.0] * bool(quoted) + weights))
    return [np.log1p(len(out)), max(out, default=0.0), np.log1p(sum(out))]


def test_learned_threats_and_scores(spark):
    """A harmless word that is toxic towards a target, in either order; scores equal those of a naive reading."""
    rng = random.Random(4)
    fill = lambda n: " ".join(corpus.words(rng, n))
    data = [(i, f"{fill(9)}. {(f'you smash {fill(1)}', f'smash {fill(1)} you', f'smash the {fill(1)}', f'see you {fill(1)}')[i % 4]}. {fill(9)}", "en", "s", 0) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 < 2)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(corpus.frame(spark, data), labels)
    assert int(toxicity._hashes(frozenset(["smash"]))[0]) ^ int(toxicity.ADDRESSED) in model["units"].tolist()
    odd = [(1000, "he said: you smash it! \"smash you\" not you smash, kill you. You, smash", None, None, 0), (1001, "You will die. I kill them", None, None, 0), (1002, fill(30_000) + " smash you", None, None, 0)]
    data += [*odd, odd[0], (1003, None, None, None, 0)]
    got = {}
    for r in toxicity.score(corpus.frame(spark, data), model).collect():
        got.setdefault(r["doc_id"], set()).add((r["score"], r["predicted"]))
    for d, t, *_ in data:
        want = toxicity.chance(model, np.array([naive_features(model, t)]))[0]
        assert len(got[d]) == 1 and got[d].copy().pop()[0] == pytest.approx(want)
    assert all(got[i].copy().pop()[1] == (i % 4 < 2) for i in range(400)) and got[1002].copy().pop()[1] == 1


def test_toxicity_odd_tables(spark, tmp_path):
    rng = random.Random(1)
    data = [(i, " ".join([*corpus.words(rng, 30), *(["grumblefuzz"] if i % 4 == 0 else [])]), "en", "s", 0) for i in range(200)]
    data += [(1000, None, None, None, 0), (1001, "", None, None, 0), (None, "you grumblefuzz", None, None, 0)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (5, 1, None), (5, 1, 0)]
    path = corpus.write(spark, tmp_path, data, labels=(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, path).collect()}
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(200)) and got[None]["predicted"] == 1
    assert got[1000]["score"] == got[1001]["score"] < 0.3
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(200)) and not got[None]["held_out"]
    kept = toxicity.toxicity_stage(spark, corpus.frame(spark, data).selectExpr("*", "1 AS toxic"), path)
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in data if not got[r[0]]["predicted"]} and kept.columns[-1] == "toxic"
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(corpus.frame(spark, data), toxicity.learn(corpus.frame(spark, data), none)).collect()} == {0.0}
    assert toxicity.score(corpus.frame(spark, []), toxicity.learn(corpus.frame(spark, []), none)).count() == 0


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = langid.op6_langid(spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98


def test_viterbi_is_best_path():
    rng = np.random.default_rng(2)
    for _ in range(20):
        s = rng.normal(size=(6, 3))
        paths = np.array(np.meshgrid(*[range(3)] * 6)).reshape(6, -1).T
        value = lambda p: s[np.arange(6), p].sum() - 0.7 * (p[1:] != p[:-1]).sum()
        assert value(langid.viterbi(s, 0.7)) == pytest.approx(max(map(value, paths)))
        gain = langid.largest_gain(s[:, 0] - s[:, 1], np.array([0, 4]), np.array([4, 6]))
        d = s[:, 0] - s[:, 1]
        assert gain[0] == pytest.approx(max(d[a:b].sum() for a in range(5) for b in range(a, 5)))


def naive_label(model, text, penalty):
    """Viterbi over every word, without shortcuts; scores as the model has them, word by word."""
    x = langid.Letters(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    if not len(x.ws):
        return "und", ""
    bins, begin = langid.trigram_bins(x, len(model["logp"]))
    rows = []
    for w, (lo, hi) in enumerate(zip(begin, [*begin[1:], len(bins)], strict=True)):
        s = model["logp"][bins[lo:hi]].astype(float).sum(0)
        can = model["scripts"][x.script[w]]
        rows.append(np.where(can, s, s.min() - 30.0) - np.where(can, s, s.min() - 30.0).max() if can.any() else np.zeros(len(s)))
    path = langid.viterbi(np.array(rows), penalty)
    runs = [i for i in range(len(path)) if i == 0 or path[i] != path[i - 1]]
    spans = [f"{model['langs'][path[i]]}:{x.ws[i]}:{x.we[j - 1]}" for i, j in zip(runs, [*runs[1:], len(path)], strict=True)]
    return model["langs"][int(np.argmax(np.bincount(path, weights=x.we - x.ws, minlength=len(rows[0]))))], ",".join(spans)


def test_labels_equal_the_full_pass():
    """Models of chance, whose languages differ little, so that many documents come near the bounds of the shortcut."""
    rng = random.Random(8)
    for seed in range(40):
        r = np.random.default_rng(seed)
        model = {"langs": ["a", "b", "c", "d"], "logp": (r.normal(size=(256, 4)) * r.uniform(0.3, 1.2)).astype(np.float32), "scripts": np.ones((langid.SCRIPTS, 4), bool)}
        texts = ["", "12", *[" ".join(corpus.words(rng, rng.randint(1, 12))) for _ in range(25)]]
        raw = [t.encode() for t in texts]
        x = langid.Letters(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [(k, spans) for k, _, spans in langid.label(model, x)] == [naive_label(model, t, langid.PENALTY) for t in texts]


def test_two_stretches_that_pay_together():
    s = np.array([[0.0, 0.0, 10.8], [0.0, 10.8, 0.0]]) - 10.8
    s = np.column_stack([s[:, 0] + 8.0, s[:, 1:]])
    assert langid.two_part_gain(s, np.zeros(2, int), np.array([0]), np.array([2]))[0] == pytest.approx(max(a + b for a in s[0] - s[0, 0] for b in s[1] - s[1, 0]))


def test_rare_languages_are_learned(spark):
    assert [langid.bins_for(n) for n in (1, 512, 513, 1024, 1025, 3000)] == [65536, 65536, 32768, 32768, 16384, 8192]
    data = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 9, f"l{i:03}", "s", 0) for i in range(300)]
    assert len(langid.learn(corpus.frame(spark, data))["langs"]) > 200


def test_mixed_language_and_odd_rows(spark):
    rng = random.Random(3)
    en = lambda n: " ".join(rng.choice(["the", "which", "with", "through", "water", "thing"]) for _ in range(n))
    ru = lambda n: " ".join(rng.choice(["вода", "что", "который", "через"]) for _ in range(n))
    fr = lambda n: " ".join(rng.choice(["eau", "que", "lequel", "à", "travers", "chose"]) for _ in range(n))
    data = [(i, f(60), lang, "s", 0) for i, (f, lang) in enumerate([(en, "en"), (ru, "ru"), (fr, "fr")] * 30)]
    odd = [(900, None, "en", "s", 0), (901, "123 !?", None, "s", 0), (902, en(80) + " " + fr(60), None, "s", 0), (903, "水火木", None, "s", 0), (None, ru(5), None, "s", 0)]
    docs = corpus.frame(spark, data + odd)
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert all(got[d]["lang_pred"] == lang for d, _, lang, *_ in data)
    assert (got[900]["lang_pred"], got[901]["lang_pred"], got[903]["score"], got[None]["lang_pred"]) == ("und", "und", 0.0, "ru")
    spans = [s.split(":") for s in got[902]["spans"].split(",")]
    assert [s[0] for s in spans] == ["en", "fr"] and abs(int(spans[0][2]) - len(odd[2][1].split(" eau")[0])) < len(odd[2][1])
    empty = corpus.frame(spark, [])
    assert langid.predict(empty, langid.learn(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(empty)).collect()} == {"und"}


def test_repeated_rows_and_long_texts(spark):
    """Equal rows give equal rows, whatever their ids; a text of 60000 words is read whole."""
    rng = random.Random(6)
    en = " ".join(rng.choice(["the", "which", "with", "through", "water", "thing"]) for _ in range(50_000))
    fr = " ".join(rng.choice(["eau", "que", "lequel", "travers", "chose"]) for _ in range(10_000))
    data = [(1, en, "en", "s", 0), (2, fr, "fr", "s", 0), (3, f"{en} {fr}", None, "s", 0), (3, f"{en} {fr}", None, "s", 0), (None, fr, None, "s", 0), (None, fr, None, "s", 0)]
    docs = corpus.frame(spark, data)
    got = [tuple(r) for r in langid.predict(docs, langid.learn(docs)).collect()]
    assert len(got) == 6 and len(set(got)) == 4 and sorted(set(r[2] for r in got if r[0] in (None, 2))) == ["fr"]
    spans = next(r[4] for r in got if r[0] == 3).split(",")
    assert [s.split(":")[0] for s in spans] == ["en", "fr"] and int(spans[1].split(":")[2]) == len(en) + 1 + len(fr)
    stats = [tuple(r) for r in quality.statistics(docs).collect()]
    assert len(stats) == 6 and len(set(stats)) == 4 and max(r[1] for r in stats) == 60_000


def brute_counts(text):
    t = text or ""
    w = t.encode().split()
    seen, gone = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            gone.update(k for i in at for k in range(i, i + 8))
    lines = [x for x in t.encode().split(b"\n") if x.split()]
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(gone)


def test_counts(spark):
    data = [*corpus.rows(), (5000, "a b\na b\n\n \na b \nx#*$|<>&%", None, None, 0), (5001, "é ü " * 40 + "\n" + "q " * 50, None, None, 0)]
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality.statistics(corpus.frame(spark, data).selectExpr("*", "1 AS n_words")).collect()}
    assert got == {d: brute_counts(t) for d, t, *_ in data}


def test_words_built_to_collide_are_no_repeats(spark):
    """Two windows of eight words that differ in one word of 1024 letters."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    side = [f"w{i}" for i in range(7)]
    text = " ".join([*side, one, *side, one.translate(str.maketrans("ab", "ba"))])
    rows = quality.statistics(corpus.frame(spark, [(1, text, None, None, 0)])).collect()
    assert rows[0]["n_repeat_words"] == 0


def test_quality(spark):
    rows = quality.op10_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    judged = [r for r in rows if not r["base_failed"]]
    good, bad = ([r["kept"] for r in judged if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_forest_isolates():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(500, 3)), [[9.0, 9.0, 9.0]]])
    score = quality.anomaly(quality.grow(x), x)
    assert score.argmax() == 500 and 0 < score.min() < score.max() <= 1
    assert quality.calibrate(np.array([0.1, 0.2, 0.9]), np.array([False, False, True])) == pytest.approx(0.55)


def naive_path(tree, row):
    feature, split, child, path = tree
    at = 0
    while feature[at] >= 0:
        at = child[at] + (row[feature[at]] > split[at])
    return path[at]


def test_verdicts_follow_the_trees_row_by_row(spark):
    sf = "/root/testdata/sf0.001"
    stats = quality.cut(quality.statistics(quality.documents(spark, sf)))
    model = quality.fit(stats, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r["doc_id"]: r.asDict() for r in stats.collect()}
    for r in quality.judge(stats, model).collect():
        x = quality.rule_values({k: np.array([float(v)]) for k, v in rows[r["doc_id"]].items() if k != "doc_id"})[0]
        score = 2 ** -(np.mean([naive_path(t, x) for t in model["forest"]]) / quality.usual_path(model["leaves"]))
        assert r["anomaly"] == pytest.approx(score)
        assert r["kept"] == (not r["base_failed"] and score < model["threshold"])


def test_draws_are_bounded_by_different_rows(spark):
    """However many documents share an id or a text, the driver gets a row of each kind, with its number."""
    hot = spark.range(60_000).selectExpr("CAST(NULL AS LONG) AS doc_id", *[f"CAST(3 AS LONG) AS {c}" for c in (*quality.COUNTS, *quality.MORE)])
    many = spark.range(60_000).selectExpr("CAST(3002 AS LONG) AS doc_id", *[f"id AS {c}" for c in (*quality.COUNTS, *quality.MORE)])
    rows = quality.draw(hot.unionByName(many), 5000, 120_000).toPandas()
    assert len(rows) < 4000 and set(rows["times"]) <= {1, 60_000}
    forest = quality.grow(np.array([[0.0], [1.0]]), trees=5, times=np.array([10**9, 1]))
    assert all(len(t[0]) <= 3 for t in forest)
    score, bad = np.array([0.9, 0.5, 0.1]), np.array([True, False, False])
    assert quality.calibrate(score, bad, 0.4, np.array([1, 9, 1])) == quality.calibrate(np.repeat(score, [1, 9, 1]), np.repeat(bad, [1, 9, 1]), 0.4)


def test_quality_odd_tables(spark, tmp_path):
    data = [(None, "w " * 30, None, None, 0), (1, None, None, None, 0), (2, "", None, None, 0)]
    path = corpus.write(spark, tmp_path, data, labels=([], "doc_id long, quality int, toxic int"))
    assert {r["doc_id"]: r["kept"] for r in quality.op10_quality(spark, path).collect()} == {None: False, 1: False, 2: False}
    path = corpus.write(spark, tmp_path / "empty", [], labels=([], "doc_id long, quality int, toxic int"))
    assert quality.op10_quality(spark, path).count() == 0


def test_every_labelled_row_sets_the_threshold_of_quality(spark, monkeypatch):
    """All labelled rows are counted, whatever the draw for the trees."""
    from codexa.llm import quality

    counted = []
    real = quality.calibrate
    monkeypatch.setattr(quality, "calibrate", lambda score, bad, *a, times=None: counted.append(int(times.sum())) or real(score, bad, *a, times=times))
    names = [*quality.COUNTS, *quality.MORE]
    stats = spark.range(60_000).selectExpr("id AS doc_id", *[f"CAST(30 + (id * {i + 3}) % 17 AS LONG) AS {c}" if c not in ("n_repeat_words", "n_dup_lines") else f"0L AS {c}" for i, c in enumerate(names)])
    quality.fit(stats, spark.range(60_000).selectExpr("id AS doc_id", "CAST(id % 10 > 0 AS INT) AS quality"))
    assert counted == [60_000]
