"""A small corpus with cases that each operator must meet, and brute force."""

from __future__ import annotations

import random

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice(["an", "el", "or", "ith", "é"]) + rng.choice("klmnop") * rng.randint(1, 2) for _ in range(n)]


def rows(seed=5):
    """Copies, near copies, shared passages, runs, nulls, empty and very long texts."""
    rng = random.Random(seed)
    shared = [" ".join(words(rng, 70)) for _ in range(3)]
    out = []
    for i in range(60):
        w = words(rng, rng.choice([0, 1, 3, 30, 60, 200]))
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = [shared[i % 3]]
        out.append(" ".join(w))
    out += [out[5], out[5], out[8] + " tail", "same " * 300, "same " * 260 + "end", "ab" * 900, "ab" * 700, None, "", " \t\n", "x", "Zwei\x0bWörter\x0c" * 80, " ".join(words(rng, 30_000))]
    near = words(rng, 400)
    for i in range(20):
        v = list(near)
        v[i * 7] = "changed"
        out.append(" ".join(v))
    return [(i * 3, t, None if i % 7 == 0 else ["en", "de"][i % 2], None if i % 11 == 0 else f"s{min(i % 5, 2)}", len(t or "")) for i, t in enumerate(out)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def write(spark, path, data=None, **tables):
    frame(spark, data).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    for name, (values, schema) in tables.items():
        spark.createDataFrame(values, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def components(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def far_links(texts):
    """Pairs of texts that the pipeline's stage links, by comparison of all."""
    from codexa.llm.simhash import FAR, _two

    memo = {t: _two(t) for t in set(texts)}
    two = [memo[t] for t in texts]
    return [(i, j) for i, a in enumerate(two) for j in range(i + 1, len(two)) if (a[0] ^ two[j][0]).bit_count() + (a[1] ^ two[j][1]).bit_count() <= FAR]
