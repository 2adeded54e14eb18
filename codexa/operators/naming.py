"""Name templates, and companion files that move with a set."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

TOKEN = re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)(?::([^}]+))?\}")
# Second names of tokens.
SHORT_NAMES = {
    "author": "Author", "authors": "Author", "author_sort": "AuthorLastFirst", "title": "Title", "short_title": "ShortTitle", "series": "SeriesName", "series_index": "SeriesIndex",
    "year": "Year", "narrator": "Narrator", "disc_pad": "DiscPad", "track_pad": "TrackPad", "disc": "Disc", "track": "Track", "track_title": "TrackTitle", "language": "Language", "isbn": "ISBN",
}


def problems(template: str, known: set[str]) -> list[str]:
    """What is wrong with a template, found before any job runs."""
    found = []
    if re.search(r'[<>:"|?*]', TOKEN.sub("", template)):
        found.append("forbidden character")
    if template.count("{") != template.count("}"):
        found.append("unbalanced braces")
    return found + [f"unknown token {name}" for name, _ in TOKEN.findall(template) if name not in known]


def template_problems(template: Column, known: list[str]) -> Column:
    """The same for a column of templates: struct(unknown, forbidden, unbalanced, formats)."""
    names = F.regexp_extract_all(template, F.lit(r"\{(\w+)(?::[^}]*)?\}"), 1)
    formats = F.filter(F.regexp_extract_all(template, F.lit(r"\{\w+:([^}]*)\}"), 1), lambda f: ~f.rlike(r"^\d+$"))
    outside = F.regexp_replace(template, r"\{\w+(?::[^}]*)?\}", "")
    braces = lambda b: F.length(template) - F.length(F.replace(template, F.lit(b), F.lit("")))
    return F.struct(F.array_except(names, F.array(*[F.lit(k) for k in known])).alias("unknown"), outside.rlike(r'[<>:"|?*\\]').alias("forbidden"), (braces("{") != braces("}")).alias("unbalanced"), formats.alias("formats"))


def tokens(case: str = "title", **f: Column) -> dict[str, Column]:
    """The 30 names that a template may use, as strings; blank where nothing is known.

    Fields: title, author, series, series_index, year, narrator, language, isbn
    of the identity; the same with ``_guess`` for those of the set, taken where
    the identity has none; and track, most_track, disc, disc_count, track_title,
    stem.  Without a track all its tokens are blank.
    """
    none = F.lit(None).cast("string")
    get = lambda n: X.blank_to_null(f.get(n, none).cast("string"))
    known = lambda n: F.coalesce(get(n), get(f"{n}_guess"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    title, author = F.coalesce(known("title"), F.lit("Unknown Title")), known("author")
    track, disc = F.greatest(f["track"].cast("int"), F.lit(1)) if "track" in f else none, F.greatest(f["disc"].cast("int"), F.lit(1)) if "disc" in f else none
    most = F.greatest(f.get("most_track", F.lit(0)).cast("int"), track) if "track" in f else none
    several = f.get("disc_count", F.lit(1)).cast("int") > 1 if "track" in f else F.lit(False)
    pad = lambda n, of: blank(X.zero_pad(n.cast("string"), F.length(of.cast("string"))))
    own = F.coalesce(get("track_title"), X.track_title(f["stem"])) if "stem" in f else get("track_title")
    found = {
        "Title": title, "ShortTitle": X.shorten(title), "Year": blank(get("year")), "Language": blank(known("language")), "Narrator": blank(known("narrator")), "ISBN": blank(get("isbn")),
        "Author": F.coalesce(author, F.lit("Unknown Author")), "AuthorLastFirst": F.coalesce(X.last_first(author), F.lit("Unknown Author")),
        "SeriesName": blank(known("series")), "SeriesIndex": blank(known("series_index")),
        "TrackPad": pad(track, most), "Track": blank(track.cast("string")), "DiscPad": blank(F.when(several, pad(disc, f.get("disc_count", F.lit(1))))), "Disc": blank(F.when(several, disc.cast("string"))),
        "TrackTitle": blank(own if "track" in f else none),
    }
    cased = {"title": X.title_case, "lower": F.lower, "upper": F.upper, "as_is": lambda c: c}[case]
    found = {k: cased(v) for k, v in found.items()}
    return found | {short: found[name] for short, name in SHORT_NAMES.items()}


def render(template: str, values: dict[str, Column]) -> Column:
    """A template as one expression, and what blanks leave behind is removed; unknown tokens are blank."""
    parts, at = [], 0
    for m in TOKEN.finditer(template):
        value = F.coalesce(values[m[1]].cast("string"), F.lit("")) if m[1] in values else F.lit("")
        if (m[2] or "").isdigit():
            value = F.when(value != "", X.zero_pad(value, F.lit(int(m[2])))).otherwise(value)
        parts += [F.lit(template[at : m.start()]), value]
        at = m.end()
    path = F.concat(*parts, F.lit(template[at:]))
    for pattern, new in ((r"\(\s*\)", ""), (r"(?<=/)\s*-\s+", ""), (r"\s+-\s+(?=/|$)", ""), (r"/{2,}", "/"), (r"\s+", " "), (r"^[ /-]+|[ /-]+$", "")):
        path = F.regexp_replace(path, pattern, new)
    return path


def folder_path(template: str, values: dict[str, Column]) -> Column:
    return X.safe_path(render(template, values))


def with_suffix(name: Column, suffix: Column) -> Column:
    return F.when(name.endswith(suffix), name).otherwise(F.concat(name, suffix))


def track_name(template: str, values: dict[str, Column], suffix: Column) -> Column:
    """A track's file name: the rendered template with the source's suffix, made safe."""
    return X.file_name(with_suffix(render(template, values), suffix))


def companions(files: DataFrame) -> DataFrame:
    """(book, ord, new_name): each book's companions in order, names made distinct.

    A taken name becomes ``folder - name``, then ``stem (k)``: each claim
    depends on those before, so a book's few companions are folded in one call.
    Needs book, ord, folder, name.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for r in pdf.sort_values("ord").itertuples():
            stem, dot, suffix = r.name.rpartition(".")
            stem = stem if dot else r.name
            names = [r.name, f"{r.folder} - {r.name}", *(f"{stem} ({k}){dot}{suffix if dot else ''}" for k in range(2, 100))]
            new = next((n for n in names if n.lower() not in taken), None)
            taken.add((new or "").lower())
            out.append(new)
        return pd.DataFrame({"book": pdf.sort_values("ord")["book"], "ord": pdf["ord"].sort_values(), "new_name": out})

    return files.groupBy("book").applyInPandas(run, "book long, ord long, new_name string")
