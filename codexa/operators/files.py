"""File catalogues: byte duplicates in stages, orphans, unsafe names, roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What belongs beside audio files.
AUDIO = ("mp3", "m4a", "m4b", "flac", "ogg", "opus", "aac", "wav")
SIDECARS = ("nfo", "cue", "json", "opf", "xml", "txt", "log")
IMAGES = ("jpg", "jpeg", "png", "bmp", "gif", "webp")
COVERS = ("cover", "folder", "front", "albumart", "artwork", "thumb")
PROBE = 65536


def byte_duplicates(files: DataFrame, path: str, size: str, content: str, probe: int = PROBE) -> DataFrame:
    """Files equal in size, then in a hash of head and tail, then in full.

    Hashes are of bytes and are made where the contents are read, so that only
    paths, sizes and hashes go on; each stage leaves the next fewer rows.  A
    file of up to ``probe`` bytes is its own head and has no tail.  The first by
    path is kept.
    """
    body = F.col(content).cast("binary")
    tail = F.when(F.octet_length(body) > probe, F.substring(body, -probe, probe)).otherwise(F.lit(b""))
    rows = files.select(path, size, F.sha2(F.concat(F.substring(body, 1, probe), tail), 256).alias("probe"), F.sha2(body, 256).alias("sha256"))
    for by in ([size], [size, "probe"]):
        often = rows.groupBy(*by).agg((F.min(path) < F.max(path)).alias("several")).filter("several").drop("several")
        rows = rows.join(often, by, "left_semi")
    same = rows.groupBy(size, "sha256").agg(F.count("*").alias("n"), F.min(path).alias("keeper")).filter("n > 1")
    return rows.drop("probe").join(same, [size, "sha256"]).withColumn("redundant", F.col(path) != F.col("keeper"))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"\.([^.]+)$", 1))


def stem_of(path: Column) -> Column:
    return F.lower(F.regexp_replace(name_of(path), r"\.[^.]+$", ""))


def orphans(files: DataFrame, path: str) -> DataFrame:
    """Visible files that are neither audio nor sidecar nor cover."""
    p = F.col(path)
    cover = suffix_of(p).isin(*IMAGES) & stem_of(p).isin(*COVERS)
    return files.filter(~suffix_of(p).isin(*AUDIO, *SIDECARS) & ~cover & ~name_of(p).startswith("."))


def ancestors(path: Column) -> Column:
    """The path and all folders over it, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def deepest_root(items: DataFrame, path: str, roots: DataFrame, root: str, default: str) -> DataFrame:
    """The longest root that holds each path: an equi-join over its ancestors."""
    above = items.select(path, F.explode(ancestors(F.col(path))).alias("up"))
    best = above.join(roots.select(F.col(root).alias("up")).distinct(), "up").groupBy(path).agg(F.max_by("up", F.length("up")).alias("root"))
    return items.join(best, path, "left").withColumn("root", F.coalesce("root", F.lit(default)))


def claims(moves: DataFrame, target: str, order: str) -> DataFrame:
    """The first to claim a target, whatever its case, gets it; later ones conflict."""
    w = Window.partitionBy(F.lower(target)).orderBy(order)
    return moves.withColumn("claim", F.row_number().over(w)).withColumn("holder", F.first(order).over(w))


def plan_id(moves: DataFrame, key: str, order: str, old: str, new: str, head: Column) -> DataFrame:
    """A name for each plan that depends on its moves alone."""
    body = F.transform(F.array_sort(F.collect_list(F.struct(order, old, new))), lambda m: F.concat(m[old], F.lit("\n"), m[new]))
    return moves.groupBy(key).agg(F.array_join(body, "\n").alias("body"), F.count("*").alias("n_moves")).select(key, "n_moves", F.left(F.sha2(F.concat_ws("\n", head, "body"), 256), F.lit(16)).alias("plan_id"))
