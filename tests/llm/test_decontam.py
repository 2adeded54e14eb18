import re
import time

import corpus
import duckdb
import harness
from codexa.llm import decontam

ITEMS = [
    (1, "If Anna buys 12 apples for 30 dollars, how many apples does Anna get for 90 dollars in the same shop?"),
    (2, "the quick brown fox jumps over the lazy dog while the cat sleeps near the warm fire"),
    (3, "the quick brown fox jumps over the lazy dog while the cat sleeps near the warm fire"),
    (4, "two words"), (5, None), (6, ""), (7, "what is the sum of 3 and 4 and 3 again"),
]
DOCS = [
    (10, "Intro. " + ITEMS[0][1] + " Outro."),
    (11, "Before that, if Maria buys 15 apples for 45 dollars, how many apples does Maria get for 90 dollars in the same shop? Yes."),
    (12, "A story: THE QUICK brown fox, jumps over the lazy dog - while the cat sleeps near the warm fire!"),
    (13, "the quick brown fox jumps over something else entirely and the cat is not there"),
    (14, "Two words!"), (15, None), (16, ""), (17, "here two words stand in a longer text"),
    (18, "say, what is the sum of 8 and 9 and 8 again please"), (19, "say, what is the sum of 8 and 9 and 5 again please"),
]


def test_leaks(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in [*DOCS, DOCS[0]]], "doc_id long, text string, words int")
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontam.leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 2), (14, 4), (18, 7)}
    assert got[10, 1] == 0 and got[11, 1] > 0 and got[18, 7] > 0


def test_every_diagonal(spark):
    """A copy counts wherever it stands, beside variants that don't hold the item's slots."""
    item, other = ITEMS[6][1], "what is the sum of 8 and 9 and 5 again"
    both = ["%s so %s yes", "%s and " + other + " or %s", "%s then %s", "%s but %s"]
    texts = [(i, t % (other, item), 1) for i, t in enumerate(both)]
    texts += [(10, f"{item} so {other}", 1), (11, f"{other} so {other}", 1), (12, "so " * 300 + f"{other} " * 50 + item, 1)]
    # A copy with a word put in, after a whole variant: its halves hold the share together.
    long = "count 3 blue birds on one old roof then 4 red birds in some tall tree then 3 more grey birds near that wide green lake"
    wrong = long.replace("3 blue", "8 blue").replace("4 red", "9 red").replace("3 more", "5 more")
    right = long.replace("some tall", "some very tall")
    texts += [(20, wrong, 1), (21, f"{wrong} so {right}", 1)]
    items = spark.createDataFrame([ITEMS[6], (8, long)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontam.leaks(spark.createDataFrame(texts, "doc_id long, text string, words int"), items).collect()}
    assert got == {(i, 7): 0 for i in (0, 1, 2, 3, 10, 12)} | {(21, 8): 0}


ANNA = "Anna has 12 apples. Anna buys 30 more apples and gives 5 to Tom. How many apples does Anna have now?"


def test_names_that_begin_sentences_and_other_case(spark):
    """Re-parameterised names at any place, and verbatim copies in any case."""
    other = ANNA.replace("Anna", "Maria").replace("Tom", "Paul").replace("12", "17").replace("30", "8")
    wrong = ANNA.replace("Anna has", "Maria has").replace("Anna buys", "Rosa buys")
    german = "Welche Stadt liegt am Ufer des Flusses und hat die meisten Einwohner im Norden des Landes?"
    texts = [(1, f"Quiz: {other} Yes."), (2, "so " + ANNA.lower() + " end"), (3, ANNA.upper()), (4, f"x. {wrong} y"), (5, german.lower()), (6, german.title()), (7, f'He said "{other}" to us')]
    items = spark.createDataFrame([(1, ANNA), (2, german)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_matched"], r["n_windows"], r["n_changed"]) for r in decontam.leaks(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 2), (6, 2), (7, 1)}
    assert all(got[k][0] == got[k][1] for k in got) and got[2, 1][2] == got[3, 1][2] == got[5, 2][2] == 0 and got[1, 1][2] == got[7, 1][2] == 4


def test_clean_headings_tables_and_nouns(spark):
    """Runs of names and numbers are no leak, whatever their types; the same values are."""
    items = [
        (1, "The Great Gatsby Was Written By Francis Scott Fitzgerald"), (2, "3 7 11 15 19 23 27 31"), (3, "Alice Smith and Bob Jones"),
        (4, "Welche Stadt liegt am Ufer des Flusses und hat die meisten Einwohner im Norden des Landes?"), (5, "add 3 and 4 and then 5 to get 12 in all"),
    ]
    clean = [
        "Minutes of the United Nations Security Council Emergency Committee Meeting In Geneva were filed.", "Results: 1 2 3 4 5 6 7 8 9 10 11 12", "Mary Brown and Peter Miller met Carl White and Paul Black",
        "Der Mann im Haus am See hat die Frau aus der Stadt und das Kind im Wald", "add 7 and 7 and then 7 to get 7 in all", "Table 1 2 3 4 5 and 6 7 8 9", "1 " * 5000, "A Title Case Heading Of Many Words " * 40,
    ]
    held = [items[0][1] + " it says", "so the great gatsby was written by francis scott fitzgerald.", "list: " + items[1][1] + " 35", items[2][1] + ".", items[3][1], "add 1 and 2 and then 6 to get 9 in all"]
    docs = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(held)]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("id_key", "text_key")
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(100, 1), (101, 1), (102, 2), (103, 3), (104, 4), (105, 5)}
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert harness.differences(found, con, decontam.ORACLE_SQL) == ""


def test_number_tables_meet_no_hot_key(spark):
    """4 documents of 4000 numbers and 20 items of 40."""
    docs = [(i, " ".join(str((i * 7919 + k * 104729) % 9973) for k in range(4000))) for i in range(4)]
    items = [(i, " ".join(str((i * 31 + k * 17) % 101) for k in range(40))) for i in range(20)]
    began = time.perf_counter()
    assert decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert time.perf_counter() - began < 20


def test_recall_of_items_with_other_values(spark):
    """Items of the given table with other numbers and other names, each within another text."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    swap = lambda t: re.sub(r"\b[A-Z][a-z]+", lambda m: m[0][::-1].capitalize(), re.sub(r"\d+", lambda m: str(int(m[0]) + 1), t))
    texts = [(i, f"some words ahead and then: {swap(t)} and words behind it", 1) for i, t in items]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(texts, "doc_id long, text string, words int"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((i, i) in got for i, _ in items) / len(items) >= 0.95


def test_sql(spark):
    """The SQL on texts with names, units, other cases, copies and several diagonals."""
    long = "so " * 2000 + ANNA + " and so on"
    docs = [*DOCS, (30, ANNA.lower()), (31, long), (32, "Quiz. " + ANNA.replace("Anna", "Eve")), (33, f"{ITEMS[6][1]} so {ITEMS[6][1].replace('3', '8')}"), (34, DOCS[1][1]), (35, None)]
    items = [*ITEMS, (9, ANNA)]
    con = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    found = decontam.leaks(spark.createDataFrame([*docs, docs[0]], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("id_key", "text_key")
    assert harness.differences(found, con, decontam.ORACLE_SQL) == "" and found.count() > 8


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, ITEMS[1][1]), (None, ITEMS[1][1]), (None, "nothing of it"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()] == [(None, 2)]


def test_stage(spark, tmp_path):
    data = [(d, t, None, None, 0) for d, t in DOCS]
    path = corpus.write(spark, tmp_path, data, benchmark=(ITEMS, "item_id long, text string"))
    docs = corpus.frame(spark, data).selectExpr("*", "'x' AS bad_id", "1 AS item")
    out = decontam.decontaminate_stage(spark, docs, path)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [13, 15, 16, 17, 19]
    assert decontam.op4_decontaminate(spark, path).count() == 5


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(corpus.frame(spark), none).count() == 0
    assert decontam.leaks(corpus.frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
