"""Plans of moves: what they hold, what speaks against them, and their undoing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEGMENT
from .files import ancestors
from .scanning import parent_of


def resolve(path: Column) -> Column:
    """A path without ``.`` and ``..``; those that lead above the first part are dropped."""
    start = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), start, step), "/"))


def escapes(path: Column, root: str) -> Column:
    """Whether a path, followed through, leaves the root."""
    p = resolve(path)
    return ~((p == root) | p.startswith(root.rstrip("/") + "/"))


def conflicts(moves: DataFrame, plan: str, target: str) -> DataFrame:
    """(plan, n_conflicts): targets that several moves of a plan share, whatever their case."""
    per = moves.groupBy(plan, F.lower(target).alias("t")).agg(F.count("*").alias("n"))
    return per.groupBy(plan).agg(F.count_if(F.col("n") > 1).alias("n_conflicts"))


def with_fallback(moves: DataFrame, plan: str, target: str, fallback: str) -> DataFrame:
    """Adds ``chosen``: a plan with shared targets takes the fallback if that has none.

    Moves that lead where the file already is (``old_path``) are left out.
    """
    first = conflicts(moves, plan, target).withColumnRenamed("n_conflicts", "n_first")
    second = conflicts(moves, plan, fallback).withColumnRenamed("n_conflicts", "n_second")
    df = moves.join(first, plan).join(second, plan)
    switch = (F.col("n_first") > 0) & (F.col("n_second") == 0)
    df = df.withColumn("chosen", F.when(switch, F.col(fallback)).otherwise(F.col(target)))
    return df.filter(F.col("chosen") != F.col("old_path")).withColumn("n_conflicts", F.when(switch, 0).otherwise(F.col("n_first")))


def padded(tracks: DataFrame, book: str, index: str) -> DataFrame:
    """Adds ``width``: digits of the book's highest number; if it has none, of its tracks."""
    g = tracks.groupBy(book).agg(F.max(index).alias("most"), F.count("*").alias("n"))
    width = F.length(F.when(F.coalesce("most", F.lit(0)) > 0, F.col("most")).otherwise(F.col("n")).cast("string"))
    return tracks.join(g.select(book, width.alias("width")), book)


def undo(log: DataFrame, operation: str, order: str) -> DataFrame:
    """The moves that take an operation back, last first."""
    w = Window.partitionBy(operation).orderBy(F.desc(order))
    return log.select(operation, F.row_number().over(w).alias("place"), F.col("new_path").alias("old_path"), F.col("old_path").alias("new_path"))


def emptied(files: DataFrame, path: str, moved: str, root: str) -> DataFrame:
    """(folder, depth) under the root that hold nothing once the moved files are gone.

    Each file speaks for the folders over it; partial sums carry a folder's verdict.
    """
    up = files.select(F.explode(ancestors(parent_of(F.col(path)))).alias("folder"), F.col(moved).alias("gone"))
    left = up.groupBy("folder").agg(F.min("gone").alias("gone")).filter("gone").drop("gone")
    return left.filter(F.col("folder").startswith(root + "/")).withColumn("depth", F.size(F.split("folder", "/")))


def refusals(moves: DataFrame, plan: str, existing: DataFrame, quarantine: str = ".quarantine") -> DataFrame:
    """(plan, n_taken, n_inside): targets that exist, and sources that are quarantined already."""
    taken = moves.join(existing.select(F.col("path").alias("new_path")).distinct().withColumn("taken", F.lit(True)), "new_path", "left")
    inside = F.array_contains(F.split("old_path", "/"), quarantine)
    return taken.groupBy(plan).agg(F.count("taken").alias("n_taken"), F.count_if(inside).alias("n_inside")).filter("n_taken + n_inside > 0")


def file_keeper(files: DataFrame, group: list[str], path: str, kept: DataFrame, structured: Column) -> DataFrame:
    """Adds ``keeper``: of equal files that in a kept edition's folder, then the deepest,
    then one under a folder named for author and title, then the shortest path, then the first.
    """
    up = files.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias("folder"))
    within = up.join(kept.select("folder").distinct(), "folder", "left_semi").select(path).distinct().withColumn("within", F.lit(1))
    f = files.join(within, path, "left")
    depth = F.size(F.split(path, "/")) - 1
    score = F.struct(-F.coalesce("within", F.lit(0)), -depth, -structured.cast("int"), F.length(path), F.col(path))
    best = f.groupBy(*group).agg(F.min_by(path, score).alias("keeper"), F.count("*").alias("n_copies"))
    return files.join(best, group)


def log_rows(moves: DataFrame, plan: str, kind: str, at: Column) -> DataFrame:
    """Rows for the log of what a plan does."""
    meta = F.to_json(F.struct(F.lit(kind).alias("transaction_type"), F.col("reason").alias("quarantine_reason")))
    return moves.select(F.col(plan).alias("operation_id"), at.alias("at"), F.lit("rename").alias("operation_type"), "old_path", "new_path", meta.alias("metadata"))


def plan_lines(moves: DataFrame, plan: str, order: str, plans: DataFrame | None = None) -> DataFrame:
    """(plan, line_no, line): a plan as JSON lines, a head with its size and a line a move.

    A plan of any length so stays a distributed table; ``plans`` names those
    that have a head even without moves.
    """
    counts = moves.groupBy(plan).agg(F.count("*").alias("n"))
    if plans is not None:
        counts = plans.select(plan).distinct().join(counts, plan, "left").select(plan, F.coalesce("n", F.lit(0)).alias("n"))
    head = counts.select(plan, F.lit(0).cast("long").alias("line_no"), F.to_json(F.struct(F.col(plan).cast("string").alias("plan_id"), F.col("n").alias("operations"))).alias("line"))
    body = moves.select(plan, F.col(order).cast("long").alias("line_no"), F.to_json(F.struct(F.col("old_path").alias("source"), F.col("new_path").alias("destination"), "reason")).alias("line"))
    return head.unionByName(body)


def summary(moves: DataFrame, plan: str, source: str) -> DataFrame:
    """(plan, text): the line that tells a plan's books, moves and conflicts."""
    counts = moves.groupBy(plan).agg(F.count("*").alias("n"), F.count_distinct(source).alias("books")).join(conflicts(moves, plan, "new_path"), plan)
    return counts.select(plan, F.concat(F.lit("Books: "), F.col("books").cast("string"), F.lit(" | Operations: "), F.col("n").cast("string"), F.lit(" | Conflicts: "), F.col("n_conflicts").cast("string")).alias("text"))


def diff_line(old: Column, new: Column, root: str) -> Column:
    """ "old -> new", each relative to the root where it lies under it."""
    short = lambda p: F.when(p.startswith(root + "/"), F.substr(p, F.lit(len(root) + 2))).otherwise(p)
    return F.concat(short(old), F.lit(" -> "), short(new))


def segments(items: DataFrame, group: str, name: str, normalize) -> DataFrame:
    """(group, is_sequence): all names of a group are one title with distinct numbers."""
    n = F.regexp_extract(name, SEGMENT, 2).try_cast("long")
    base = normalize(F.regexp_extract(name, SEGMENT, 1))
    g = items.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(n).alias("numbers"), F.min(base).alias("low"), F.max(base).alias("high"), F.min(n.isNotNull()).alias("all_match"))
    return g.select(group, (F.col("all_match") & (F.col("low") == F.col("high")) & (F.col("numbers") == F.col("n"))).alias("is_sequence"))


def doctor(tracks: DataFrame, sets: DataFrame, key: str, shortest: float = 60.0) -> DataFrame:
    """One row of counts: sets without narrator or cover or in a broken order, tracks too short in a set of several, unreadable ones.

    Tracks have track_index, duration and bad; sets has_narrator and has_cover.
    """
    whole = (F.min("track_index") == 1) & (F.max("track_index") == F.count("*")) & (F.count_distinct("track_index") == F.count("*"))
    per = tracks.groupBy(key).agg(F.count("*").alias("n"), whole.alias("whole"), F.count_if(F.col("duration") < shortest).alias("short"), F.count_if("bad").alias("bad"))
    c = F.count_if
    return per.join(sets, key).agg(
        F.count("*").alias("n_sets"), c(~F.col("has_narrator")).alias("no_narrator"), c(~F.col("whole")).alias("broken_order"), c(~F.col("has_cover")).alias("no_cover"),
        F.sum(F.when(F.col("n") > 1, F.col("short")).otherwise(0)).alias("short_tracks"), F.sum("bad").alias("broken_tracks"),
    )
