"""File catalogues: names and sizes of files and folders, bytes only on demand."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, parent string, name string, suffix string, depth int, size long, is_dir boolean"


def _size(entry: os.DirEntry) -> int | None:
    """None if the file has gone since it was listed."""
    try:
        return entry.stat().st_size
    except OSError:
        return None


def _walk(root: str, depth: int, most: int) -> Iterator[tuple]:
    try:
        entries = sorted(os.scandir(root), key=lambda e: e.path)
    except OSError:
        return
    for e in entries:
        folder = e.is_dir(follow_symlinks=False)
        size = 0 if folder else _size(e)
        if size is not None:
            yield e.path, root, e.name, os.path.splitext(e.name)[1].lower().lstrip("."), depth, size, folder
        if folder and depth < most and not e.name.startswith("."):
            yield from _walk(e.path, depth + 1, most)


def catalogue(spark: SparkSession, roots: list[str], max_depth: int = 5, quarantine: str = ".quarantine", rows: int = 10_000) -> DataFrame:
    """Every entry under the roots, hidden files too, hidden folders not entered.

    Spark's own listing leaves out names that begin with ``_`` or ``.``, so the
    roots are walked by tasks, one root a task, on a file system that all see.
    A task holds so many rows at once; a file that vanishes meanwhile is left out.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            for root in b["root"]:
                found = _walk(root, 1, max_depth)
                while part := list(islice(found, rows)):
                    yield pd.DataFrame(part, columns=names).astype({"depth": "int32"})

    df = spark.createDataFrame([(r,) for r in roots], "root string").repartition(max(1, len(roots)))
    return df.mapInPandas(run, SCHEMA).filter(~F.array_contains(F.split("path", "/"), quarantine))


def hash_files(files: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """path and sha256, read by tasks in chunks; a file that can't be read has none."""

    def digest(path: str) -> str | None:
        h = hashlib.sha256()
        try:
            with open(path, "rb") as f:
                while block := f.read(chunk):
                    h.update(block)
        except OSError:
            return None
        return h.hexdigest()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "sha256": [digest(p) for p in b["path"]]})

    return files.select("path").mapInPandas(run, "path string, sha256 string")
