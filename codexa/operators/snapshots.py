"""Listings compared by folder digests, so that only changed folders are listed again.

A folder's own digest sums a hash of each file in it, its tree digest of all below it; sums don't
depend on any order and come from one exchange.  A folder whose tree digest is unchanged is
passed over with all that it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import ancestors
from .scanning import parent_of


def digests(files: DataFrame) -> DataFrame:
    """(folder, n_files, tree, own) of (path, size, modified): sums of 64-bit hashes over all files below a folder, and over those in it."""
    file = F.xxhash64("path", "size", "modified").cast("decimal(20,0)")
    above = files.select("path", file.alias("h"), F.explode(F.slice(ancestors(F.col("path")), 2, F.size(ancestors(F.col("path"))))).alias("folder"))
    own = F.when(F.col("folder") == parent_of(F.col("path")), F.col("h"))
    return above.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("h").alias("tree"), F.coalesce(F.sum(own), F.lit(0)).cast("decimal(30,0)").alias("own"))


def to_list(before: DataFrame, now: DataFrame) -> DataFrame:
    """(folder, relist): the folders whose trees differ between two tables of digests; relist if files in the folder itself do."""
    a, b = before.alias("a"), now.alias("b")
    both = a.join(b, F.col("a.folder") == F.col("b.folder"), "full")
    differ = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    nothing = lambda side: F.coalesce(F.col(f"{side}.own"), F.lit(0))
    changed = both.filter(differ("tree") | differ("n_files"))
    return changed.select(F.coalesce("a.folder", "b.folder").alias("folder"), (nothing("a") != nothing("b")).alias("relist"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, kind, moved_from) between two (path, size, modified) listings: added, changed, moved or vanished.

    Files are compared only in folders to be listed again.  A file is moved if the one file of its
    name, size and time that is gone, and the one that is there, tell each other apart from all others.
    """
    folders = to_list(digests(before), digests(now)).filter("relist").select("folder")
    keep = lambda df: df.withColumn("folder", parent_of(F.col("path"))).join(folders, "folder", "left_semi").drop("folder")
    a, b = keep(before).alias("a"), keep(now).alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    kind = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "vanished").when(~F.col("a.size").eqNullSafe(F.col("b.size")) | ~F.col("a.modified").eqNullSafe(F.col("b.modified")), "changed")
    rows = both.select(F.coalesce("a.path", "b.path").alias("path"), F.coalesce("a.size", "b.size").alias("size"), F.coalesce("a.modified", "b.modified").alias("modified"), kind.alias("kind")).filter("kind IS NOT NULL")
    same = [F.element_at(F.split("path", "/"), -1).alias("name"), "size", "modified"]
    ends = rows.filter("kind <> 'changed'").groupBy(*same).agg(F.count_if(F.col("kind") == "added").alias("n_in"), F.count_if(F.col("kind") == "vanished").alias("n_out"), F.max(F.when(F.col("kind") == "added", F.col("path"))).alias("to"), F.max(F.when(F.col("kind") == "vanished", F.col("path"))).alias("moved_from"))
    moved = ends.filter("n_in = 1 AND n_out = 1").select("to", "moved_from")
    rows = rows.join(moved.select(F.col("moved_from").alias("path"), F.lit(True).alias("left")), "path", "left").filter("left IS NULL")
    rows = rows.join(moved.withColumnRenamed("to", "path"), "path", "left")
    return rows.select("path", F.when(F.col("moved_from").isNotNull(), "moved").otherwise(F.col("kind")).alias("kind"), "moved_from")
