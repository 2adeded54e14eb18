"""Groups of one work's editions: votes, scores, keepers, fuzzy merging."""

from __future__ import annotations

from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.similarity import token_set_ratio, token_sort_ratio
from ..sources.shared import cut

# Better containers rank higher.
FORMAT_RANK = {"m4b": 8, "m4a": 7, "flac": 6, "opus": 5, "ogg": 4, "mp3": 3, "aac": 2, "wav": 1}


def format_rank(c: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in FORMAT_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, F.lower(c)), F.lit(0))


# An edition's score, the first criterion first, and what is said of one that loses by it.
CRITERIA = {
    "format_rank": "lower format rank", "has_id": "no ISBN/ASIN", "clean_order": "track order issues",
    "has_cover": "no cover art", "mean_bitrate": "lower bitrate", "total_duration": "shorter duration",
}
TIED = "tie-broken by position"


def scores(tracks: DataFrame, key: str, covered: DataFrame) -> DataFrame:
    """A row a set with the columns of CRITERIA.

    Tracks have format, bitrate, duration, track_index, disc and has_id (their
    set's); ``covered`` has the keys of sets with a cover.  The order is clean
    if each disc's numbers are 1 to n, each once.
    """
    per_disc = tracks.groupBy(key, "disc").agg(
        F.max(format_rank(F.col("format"))).alias("format_rank"), F.max("has_id").alias("has_id"),
        ((F.min("track_index") == 1) & (F.max("track_index") == F.count("*")) & (F.count_distinct("track_index") == F.count("*"))).alias("clean"),
        F.sum("duration").alias("duration"), F.sum(F.when(F.col("bitrate") > 0, F.col("bitrate"))).alias("rates"), F.count_if(F.col("bitrate") > 0).alias("n_rates"),
    )
    g = per_disc.groupBy(key).agg(
        F.max("format_rank").alias("format_rank"), F.max("has_id").cast("int").alias("has_id"), F.min(F.col("clean").cast("int")).alias("clean_order"),
        F.coalesce((F.sum("rates") / F.sum("n_rates")).cast("long"), F.lit(0)).alias("mean_bitrate"), F.coalesce(F.sum("duration").cast("long"), F.lit(0)).alias("total_duration"),
    )
    has = covered.select(key).distinct().withColumn("has_cover", F.lit(1))
    return g.join(has, key, "left").withColumn("has_cover", F.coalesce("has_cover", F.lit(0))).select(key, *CRITERIA)


def keepers(df: DataFrame, group: list[str], criteria: list[str], order: str) -> DataFrame:
    """Each group's best row by criteria, higher first, then by ``order``, beside all its rows.

    ``reason`` names the first criterion by which a row loses to the winner,
    else ``order``; the winner has none.  The best row is an aggregate, partial
    before the exchange, so no group is sorted.
    """
    best = df.groupBy(*group).agg(F.max_by(F.struct(order, *criteria), F.struct(*criteria, (-F.col(order)).alias("first"))).alias("best"))
    same = [F.col(f"d.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    out = df.alias("d").join(best.alias("b"), reduce(Column.__and__, same)).select("d.*", "best")
    reason = F.lit("order")
    for c in reversed(criteria):
        reason = F.when(F.col(c) < F.col(f"best.{c}"), F.lit(c)).otherwise(reason)
    return out.withColumn("keeper", F.col(f"best.{order}")).withColumn("reason", F.when(F.col(order) != F.col("keeper"), reason)).drop("best")


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value that over half of a key's non-null values have, else null."""
    n = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    top = n.groupBy(key).agg(F.max(F.struct("n", value)).alias("top"), F.sum("n").alias("all"))
    found = F.when(2 * F.col("top.n") > F.col("all"), F.col(f"top.{value}"))
    return df.select(key).distinct().join(top.select(key, found.alias("winner")), key, "left")


def consistent(df: DataFrame, key: str, value: str, order: list[str], first: int = 5) -> DataFrame:
    """The one value that the first rows of a key agree on, else null."""
    w = Window.partitionBy(key).orderBy(*order)
    head = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= first)
    return head.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.max(value)).alias("agreed"))


def partitioned_set(df: DataFrame, parent: str, duration: str) -> DataFrame:
    """Parents whose items are parts of one work: three or more, together over 2.5 of the longest."""
    g = df.groupBy(parent).agg(F.count("*").alias("n"), F.sum(duration).alias("total"), F.max(duration).alias("longest"))
    return g.withColumn("is_partition", (F.col("n") >= 3) & (F.col("total") > 2.5 * F.col("longest")))


def similar_keys(a_title: str, a_author: str, b_title: str, b_author: str) -> bool:
    if token_set_ratio(a_title, b_title) < 92:
        return False
    return not a_author or not b_author or token_sort_ratio(a_author, b_author) >= 90


def key_strings(keys: DataFrame) -> DataFrame:
    """Adds ``tokens``: a title's different words in order; and ``joined``: those in one string."""
    tokens = F.array_sort(F.array_distinct(F.filter(F.split("title", X.SPACE + "+"), lambda w: w != "")))
    return keys.withColumn("tokens", tokens).withColumn("joined", F.array_join("tokens", " "))


def _grams(tokens: Column, q: int) -> Column:
    """Different strings of q characters inside the words, marked with q."""
    each = F.transform(tokens, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (q - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(q))))
    return F.array_distinct(F.transform(F.filter(F.flatten(each), lambda g: F.length(g) == q), lambda g: F.concat(F.lit(f"{q}:"), g)))


def candidates(keys: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``ord``, a < b, that hold every pair of titles whose token sets are 92 % alike.

    Of two such titles either the one's words are mostly the other's: what it
    has besides is at most 0.16 / 1.08 of its joined words.  Then of its rarest
    words, as many as exceed that length, one is the other's.  Or the joined
    words themselves are alike: then the shorter, of n characters, loses 0.08 n
    and as many come between at most; a loss breaks q, a gain q - 1 of its
    q-grams within words, so of its rarest floor(0.08 n (2 q - 1)) + 1 different
    grams one is the other's.  The largest q of 3, 2, 1 is taken for which a key
    has so many; a key without is compared with all of such a length.  Keys look
    up their rarest words and grams in all keys' lists.
    """
    keys = key_strings(keys).filter("joined <> ''")
    n = F.length("joined")
    grams = {q: _grams(F.col("tokens"), q) for q in (3, 2, 1)}
    broken = {q: F.floor(0.08 * n * (2 * q - 1) + 1e-9).cast("int") for q in grams}
    chosen = F.lit(None).cast("string")
    for q in reversed(grams):
        chosen = F.when(F.size(grams[q]) > broken[q], F.lit(str(q))).otherwise(chosen)
    asks = F.coalesce(*[F.when(chosen == str(q), broken[q] + 1) for q in grams])
    listed = F.concat(F.transform("tokens", lambda w: F.concat(F.lit("w:"), w)), F.array(F.concat(F.lit("l:"), n.cast("string"))), *grams.values())
    index = keys.select("ord", n.alias("n_y"), F.explode(listed).alias("part"), chosen.alias("chosen"), asks.alias("asks"))
    index = cut(index)
    often = index.groupBy("part").agg(F.count("*").alias("often"))
    kind = F.substring("part", 1, 1)
    own = index.filter((kind == "w") | (kind == F.col("chosen"))).join(often, "part")
    rarest = Window.partitionBy("ord", kind).orderBy("often", "part")
    spent = F.coalesce(F.sum(F.length("part") - 1).over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("place", F.row_number().over(rarest)).withColumn("spent", spent)
    # Of the words: until they and a space each exceed the bound.
    words = (kind == "w") & (F.col("spent") <= 0.16 / 1.08 * F.col("n_y") + 1e-9)
    ask = own.filter(words | ((kind != "w") & (F.col("place") <= F.col("asks")))).select(F.col("ord").alias("x"), F.col("n_y").alias("n_x"), "part", (kind == "w").alias("word"))
    longest = F.floor(n * (1.08 / 0.92) + 1e-9).cast("int")
    rest = keys.filter(chosen.isNull()).select(F.col("ord").alias("x"), n.alias("n_x"), F.explode(F.transform(F.sequence(n, longest), lambda k: F.concat(F.lit("l:"), k.cast("string")))).alias("part"), F.lit(False).alias("word"))
    near = F.col("word") | F.col("n_y").between(F.col("n_x"), F.col("n_x") * (1.08 / 0.92) + 1e-9)
    found = ask.unionByName(rest).join(index.select(F.col("ord").alias("y"), "part", "n_y"), "part").filter((F.col("x") != F.col("y")) & near)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_pairs(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: keys whose titles are 92 % alike by token set, and authors 90 % by sorted tokens or unknown.

    Needs ord, title, author; blank strings count as unknown.  Titles are
    compared once, however many keys have them.
    """
    keys = keys.select("ord", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"))

    def over(f, least):
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            seen = lru_cache(maxsize=1 << 14)(f)
            return pd.Series([seen(x, y) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

        return F.pandas_udf(run, "boolean")

    titles = keys.filter(X.strip(F.col("title")) != "").select("title").distinct()
    near = candidates(titles.select(F.col("title").alias("ord"), "title")).filter(over(token_set_ratio, 92)("a", "b"))
    near = cut(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(titles.select(F.col("title").alias("a"), F.col("title").alias("b"))))
    side = lambda n: keys.select(F.col("ord").alias(n), F.col("title").alias(f"title_{n}"), F.col("author").alias(f"author_{n}"))
    x, y = side("x"), side("y")
    pairs = near.join(x, near["a"] == x["title_x"]).join(y, F.col("b") == y["title_y"]).filter("x < y")
    known = (F.col("author_x") == "") | (F.col("author_y") == "") | (F.col("author_x") == F.col("author_y"))
    found = pairs.filter(known).unionByName(pairs.filter(~known).filter(over(token_sort_ratio, 90)("author_x", "author_y")))
    return found.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def greedy_groups(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, leader): each key joins the first earlier seed that it is paired with.

    Seeds take every later free key paired with the seed itself; taken keys
    never recruit, so this isn't a transitive closure.  In rounds, open keys
    without an earlier open partner become seeds, and their open partners are
    taken.  All components are replayed at once and none is gathered; there are
    as many rounds as the longest chain of keys that wait for each other.
    """
    edges = cut(pairs.select("a", "b").distinct())
    waiting = cut(edges.select(F.explode(F.array("a", "b")).alias("k")).distinct())
    open_, seeds = edges, waiting.limit(0)
    while not waiting.isEmpty():
        new = cut(waiting.join(open_.select(F.col("b").alias("k")), "k", "left_anti"))
        seeds = cut(seeds.unionByName(new))
        taken = open_.join(new, open_["a"] == new["k"], "left_semi").select(F.col("b").alias("k"))
        waiting = cut(waiting.join(new.unionByName(taken), "k", "left_anti"))
        for end in ("a", "b"):
            open_ = open_.join(waiting, open_[end] == waiting["k"], "left_semi")
        open_ = cut(open_)
    leaders = edges.join(seeds, edges["a"] == seeds["k"], "left_semi").groupBy(F.col("b").alias("ord")).agg(F.min("a").alias("leader"))
    leaders = leaders.join(seeds.withColumnRenamed("k", "ord"), "ord", "left_anti")
    return keys.select("ord").join(leaders, "ord", "left").select("ord", F.coalesce("leader", "ord").alias("leader"))
