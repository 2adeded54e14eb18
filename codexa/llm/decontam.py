"""Benchmark decontamination by template canonicalisation (DataFrame only).

Numbers, units and names in a text become typed placeholders; what is left,
lower-cased and without punctuation, is its template.  Any word that begins
with a capital counts as a name, wherever it stands, so that names that begin a
sentence are slots as well.  Beside it stands a second template in which names
are lower-cased words, for copies in another case.  Windows of five template
words are hash-joined with those of the benchmark items, either template's.
A window without a single literal word is no
evidence of a question: it matches only with the item's own values.  Where a
document holds four fifths of the windows of one of an item's templates, the item's slots are aligned with the document's along every
diagonal on which windows match.  One is consistent if each value of the item
stands for one value throughout, be it the item's own (verbatim) or another
(re-parameterised), and no two for the same.  The document is contaminated if a
diagonal with most windows is consistent, or if the consistent ones together hold
four fifths of the windows; with other values than the item's, the matched windows
must also hold five literal words of the item; slots are told of the consistent diagonal with most windows, the
first of equals, and of the template with more windows, then more slots, then
fewer changes.

Defined results: a null text has no words and matches nothing; an item of
fewer than five words is one window of all its words, and matches a document
of just those; items with the same template and values count as one, named by
the smallest item_id; equal rows give one result; with an empty table there
are no results; extra columns don't matter.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import apart, cut, documents, small

WIDTH = 5
SHARE = 0.8
BROADCAST_WINDOWS = 2_000_000
BROADCAST_PAIRS = 500_000
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
UNITS = "kg|mg|g|km|cm|mm|m|ml|l|h|min|s|ms|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|inches|pounds?|ounces?|dollars?|euros?|cents?|percent|litres?|liters?|metres?|meters?|grams?|stunden?|minuten?|tage?|heures?|jours?|horas?|minutos?"
NAME_RE = r"(^|[^\p{L}\p{M}\p{N}])(\p{Lu}\p{L})"
UNIT_RE = rf"({NUMBER}\d+) +({UNITS})([^\p{{L}}]|$)"
GAP_RE = rf"[^\p{{L}}\p{{M}}\p{{N}}{NUMBER}-{NAME}]+"

ORACLE_SQL = rf"""
WITH a AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT side, id, text, regexp_replace(lower(regexp_replace(coalesce(text, ''), '{NAME_RE}', '\1' || chr(3) || '\2', 'g')), '(\d+)', ' ' || chr(1) || '\1 ', 'g') AS t FROM a),
c AS (SELECT side, id, text, list_filter(string_split_regex(regexp_replace(t, '(' || chr(1) || '\d+) +({UNITS})([^\p{{L}}]|$)', '\1 ' || chr(2) || '\2\3', 'g'),
        '[^\p{{L}}\p{{M}}\p{{N}}\x01-\x03]+'), lambda x: x <> '') AS words FROM b),
f AS (SELECT side, id, text, words, list_transform(words, lambda x: CASE WHEN x[1] = chr(3) THEN x[2:] ELSE x END) AS plain FROM c WHERE len(words) > 0),
e AS (SELECT *, list_transform(words, lambda x: CASE WHEN x < chr(4) THEN x[1] ELSE x END) AS q, list_transform(plain, lambda x: CASE WHEN x < chr(4) THEN x[1] ELSE x END) AS r FROM f),
g AS (SELECT side, id, text, words, plain,
    list_transform(range(1, greatest(len(q) - 3, 2)), lambda i: CASE WHEN len(q) < 5 THEN 'few ' ELSE '' END || array_to_string(CASE WHEN list_max(words[i:i + 4]) < chr(4) THEN words[i:i + 4] ELSE q[i:i + 4] END, ' ')) AS wins,
    list_transform(range(1, greatest(len(r) - 3, 2)), lambda i: CASE WHEN len(r) < 5 THEN 'few ' ELSE '' END || array_to_string(CASE WHEN list_max(plain[i:i + 4]) < chr(4) THEN plain[i:i + 4] ELSE r[i:i + 4] END, ' ')) AS plain_wins FROM e),
items AS (SELECT words, any_value(wins) AS wins, min(id) AS item_id FROM (SELECT words, wins, id FROM g WHERE side = 'i' UNION ALL SELECT plain, plain_wins, id FROM g WHERE side = 'i') GROUP BY words),
iw AS (SELECT words AS item, unnest(wins) AS win, unnest(range(len(wins))) AS item_at FROM items),
docs AS (SELECT DISTINCT id, text, words, wins, plain_wins FROM g WHERE side = 'd'),
dw AS (SELECT id, text, unnest(wins) AS win, unnest(range(len(wins))) AS doc_at FROM docs
  UNION SELECT id, text, unnest(plain_wins), unnest(range(len(plain_wins))) FROM docs),
m AS (SELECT id, text, item, item_at, doc_at - item_at AS shift FROM dw JOIN iw ON dw.win = iw.win),
full_hit AS (SELECT m.id, m.text, m.item, i.item_id, len(i.wins) AS n_windows, count(DISTINCT item_at) AS n_matched, list(DISTINCT item_at) AS held FROM m JOIN items i ON i.words = m.item GROUP BY ALL HAVING n_matched >= {SHARE} * n_windows),
hit AS (SELECT *, len(list_filter(range(len(item)), lambda k: item[k + 1] >= chr(4) AND len(list_filter(held, lambda a: a <= k AND k < a + 5)) > 0)) AS n_literal FROM full_hit),
lines AS (SELECT m.id, m.text, m.item, shift, count(DISTINCT item_at) AS n, list(DISTINCT item_at) AS spots FROM m JOIN hit h ON h.id = m.id AND h.text = m.text AND h.item = m.item GROUP BY ALL),
al AS (SELECT l.id, l.text, l.item, shift, n, spots, max(n) OVER (PARTITION BY l.id, l.text, l.item) AS most,
    list_distinct(list_filter(list_transform(range(len(l.item)), lambda k: CASE WHEN k + shift >= 0 THEN [l.item[k + 1], d.words[CAST(k + shift + 1 AS BIGINT)]] END),
        lambda x: x IS NOT NULL AND x[1] < chr(4) AND x[2] IS NOT NULL AND x[1][1] = x[2][1])) AS slots
  FROM lines l JOIN docs d ON d.id = l.id AND d.text = l.text),
ok AS (SELECT id, text, item, any_value(most) AS most, max(n) AS n, len(list_distinct(flatten(list(spots)))) AS together, arg_max(slots, [n, -shift]) AS slots FROM al
  WHERE len(list_distinct(list_transform(slots, lambda x: x[1]))) = len(slots) AND len(list_distinct(list_transform(slots, lambda x: x[2]))) = len(slots) GROUP BY id, text, item),
r AS (SELECT h.id AS doc_id, h.text, h.item_id, h.n_matched, h.n_windows, len(slots) AS n_slots, len(list_filter(slots, lambda x: x[1] <> x[2])) AS n_changed
  FROM ok JOIN hit h ON h.id = ok.id AND h.text = ok.text AND h.item = ok.item WHERE (n = most OR together >= {SHARE} * n_windows) AND (n_literal >= 5 OR len(list_filter(slots, lambda x: x[1] <> x[2])) = 0))
SELECT doc_id, item_id, n_matched, n_windows, n_slots, n_changed FROM r
QUALIFY row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY n_matched DESC, n_slots DESC, n_changed) = 1
"""


def marked(text: Column) -> Column:
    """The words of a text; those that fill slots begin with the slot's type."""
    t = F.regexp_replace(text, NAME_RE, f"$1{NAME}$2")
    t = F.regexp_replace(F.lower(t), r"(\d+)", f" {NUMBER}$1 ")
    t = F.regexp_replace(t, UNIT_RE, f"$1 {UNIT}$2$3")
    return F.array_remove(F.split(F.coalesce(t, F.lit("")), GAP_RE), "")


def plain(words: Column) -> Column:
    """The words with names as any others."""
    return F.transform(words, lambda w: F.when(w.startswith(NAME), F.substring(w, 2, 1 << 30)).otherwise(w))


def with_cells(df: DataFrame) -> DataFrame:
    """Adds to words: ``cells``, a number for each, a slot's type from 1 to 3 or a hash, and ``named``, which has hashes for names as well."""
    df = df.withColumn("cells", F.transform("words", lambda w: F.when(w < F.lit("\x04"), F.ascii(w).cast("long")).otherwise(F.xxhash64(w))))
    return df.withColumn("named", F.zip_with("cells", "words", lambda c, w: F.when(c == 3, F.xxhash64(F.substring(w, 2, 1 << 30))).otherwise(c)))


def _slots(cells: list[Column]) -> Column:
    return reduce(and_, [c.between(1, 3) for c in cells])


def _all(array: str) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ")


def _five(array: str, i: Column) -> list[Column]:
    return [F.get(array, i + k) for k in range(WIDTH)]


def window_hashes() -> Column:
    """Of words and cells: a hash of each window, or of all words if they are few; slots count by type, but by value in a window of slots alone."""
    n = F.size("cells")
    each = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: F.when(_slots(_five("cells", i)), F.xxhash64(*_five("words", i))).otherwise(F.xxhash64(*_five("cells", i))))
    few = F.when(F.forall("cells", lambda c: c.between(1, 3)), F.xxhash64(F.lit("few"), F.concat_ws(" ", "words"))).otherwise(F.xxhash64(F.lit("few"), _all("cells")))
    return F.when(n >= WIDTH, each).when(n > 0, F.array(few)).otherwise(F.array().cast("array<bigint>"))


def both_hashes() -> Column:
    """Of words, cells and named: each window's hash, and beside it that with names as words if it holds any."""
    n = F.size("cells")

    def each(i):
        cells = _five("cells", i)
        own = F.when(_slots(cells), F.xxhash64(*_five("words", i))).otherwise(F.xxhash64(*cells))
        return F.when(reduce(or_, [c == 3 for c in cells]), F.array(own, F.xxhash64(*_five("named", i)))).otherwise(F.array(own))

    few = F.when(F.exists("cells", lambda c: c == 3), F.array(window_hashes()[0], F.xxhash64(F.lit("few"), _all("named")))).otherwise(window_hashes())
    return F.when(n >= WIDTH, F.transform(F.sequence(F.lit(0), n - WIDTH), each)).when(n > 0, F.array(few)).otherwise(F.array().cast("array<array<bigint>>"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), F.xxhash64("text").alias("text_key"))


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """Contaminated (document, item) pairs with how they match."""
    known = items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), marked(F.col("text")).alias("words"))
    bench = with_cells(known.select("item_id", F.explode(F.array("words", plain(F.col("words")))).alias("words"))).withColumn("hashes", window_hashes())
    bench = bench.filter(F.size("words") > 0).groupBy("words", "hashes").agg(F.min("item_id").alias("item_id"))
    bench = cut(bench.withColumn("item", F.xxhash64("words")).withColumn("n_windows", F.size("hashes")))
    grams = bench.select("item", F.posexplode("hashes").alias("item_at", "hash"))
    grams, _ = small(grams, BROADCAST_WINDOWS)
    own = with_cells(_keyed(docs).select("id_key", "text_key", marked(F.col("text")).alias("words")))
    rows = own.select("id_key", "text_key", F.posexplode(both_hashes()).alias("doc_at", "either"))
    rows = rows.select("id_key", "text_key", "doc_at", F.explode("either").alias("hash")).join(grams, "hash")
    by_line = rows.groupBy("id_key", "text_key", "item", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("at"))
    pairs = by_line.groupBy("id_key", "text_key", "item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_matched"), F.collect_list(F.struct(F.size("at").alias("n"), "shift", "at")).alias("lines")
    )
    pairs = pairs.join(bench.select("item", "item_id", "n_windows"), "item").filter(F.col("n_matched") >= share * F.col("n_windows"))
    pairs = cut(pairs)
    hinted, _ = small(pairs.drop("lines"), BROADCAST_PAIRS)
    # Slots of the candidates on each diagonal: (item value, document value) at the same place.
    texts = _keyed(docs).join(hinted, ["id_key", "text_key"]).withColumn("words", marked(F.col("text"))).dropDuplicates(["id_key", "text_key", "item"])
    both = texts.join(bench.select("item", F.col("words").alias("asked")), "item").join(pairs.select("id_key", "text_key", "item", "lines"), ["id_key", "text_key", "item"])

    def slots(line):
        aligned = F.transform("asked", lambda w, i: F.struct(w.alias("was"), F.get("words", i + line["shift"]).alias("is")))
        held = F.filter(aligned, lambda s: (s["was"] < F.lit("\x04")) & s["is"].isNotNull() & (F.substring(s["was"], 1, 1) == F.substring(s["is"], 1, 1)))
        return F.struct(line["n"].alias("n"), (-line["shift"]).alias("back"), line["at"].alias("at"), F.array_distinct(held).alias("slots"))

    both = both.withColumn("most", F.array_max(F.transform("lines", lambda x: x["n"]))).withColumn("lines", F.transform("lines", slots))
    # The item's literal words that any matched window holds.
    held_at = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(F.transform("lines", lambda x: x["at"]))), lambda a: F.sequence(a, F.least(a + (WIDTH - 1), F.size("asked") - 1)))))
    both = both.withColumn("n_literal", F.size(F.filter(held_at, lambda k: F.get("asked", k) >= F.lit("\x04"))))
    alone = lambda slots, side: F.size(F.array_distinct(F.transform(slots, lambda s: s[side])))
    both = both.withColumn("lines", F.filter("lines", lambda x: (F.size(x["slots"]) == alone(x["slots"], "was")) & (F.size(x["slots"]) == alone(x["slots"], "is"))))
    whole = F.size(F.array_distinct(F.flatten(F.transform("lines", lambda x: x["at"])))) >= share * F.col("n_windows")
    both = both.withColumn("best", F.array_max(F.transform("lines", lambda x: F.struct(x["n"].alias("n"), x["back"].alias("back"), x["slots"].alias("slots")))))
    both = both.filter((F.col("best.n") == F.col("most")) | whole).withColumn("slots", F.col("best.slots"))
    both = both.withColumn("n_changed", F.size(F.filter("slots", lambda s: s["was"] != s["is"])))
    both = both.filter((F.col("n_changed") == 0) | (F.col("n_literal") >= WIDTH))
    # Of an item's two templates, that which tells more.
    told = F.struct("n_matched", F.size("slots").alias("n_slots"), (-F.col("n_changed")).alias("kept"), "n_windows")
    both = both.groupBy("id_key", "text_key", "item_id").agg(F.max_by(F.struct("doc_id", "n_changed", F.size("slots").alias("n_slots"), "n_matched", "n_windows"), told).alias("b"))
    both = both.select("id_key", "text_key", "item_id", "b.*")
    return both.select("doc_id", "item_id", F.col("n_matched").cast("long").alias("n_matched"), F.col("n_windows").cast("long").alias("n_windows"), F.col("n_slots").cast("long").alias("n_slots"), F.col("n_changed").cast("long").alias("n_changed"), "id_key", "text_key")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("id_key", "text_key")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    docs, restore = apart(docs, ("doc_id", "text"))
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found, _ = small(cut(found.select(F.col("id_key").alias("bad_id"), F.col("text_key").alias("bad_text")).distinct()), BROADCAST_PAIRS)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return restore(docs.join(found, (own == F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_text")), "left_anti"))
