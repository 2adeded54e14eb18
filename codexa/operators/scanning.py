"""From a listing of files to sets of tracks.

Folders of discs collapse into their parent, album tags part what lies in one
folder, and files that are whole books peel off.  Groups are aggregates and
joins on the root; no folder's files are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .files import AUDIO, suffix_of

#: Seconds from which a file counts as a whole book.
WHOLE_BOOK = 3600


def parts_of(path: Column) -> Column:
    return F.split(path, "/")


def parent_of(path: Column) -> Column:
    # From the front in one go: a pattern that is tied to the end alone is tried at every place.
    return F.regexp_extract(path, "(?s)^(.*)/", 1)


def base_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def audio_files(files: DataFrame, path: str, max_depth: int = 5, quarantine: str = ".quarantine") -> DataFrame:
    """Audio files under at most ``max_depth`` folders, none of them hidden or in quarantine.

    Paths are relative to the scan's root.  Hidden files stay.
    """
    parts = parts_of(F.col(path))
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    seen = (F.size(folders) <= max_depth) & ~F.exists(folders, lambda f: f.startswith(".") | (f == quarantine))
    return files.filter(suffix_of(F.col(path)).isin(*AUDIO) & seen)


def outside_quarantine(files: DataFrame, path: str, quarantine: str = ".quarantine") -> DataFrame:
    """All files, hidden ones too, but for those with a quarantine folder in their path."""
    return files.filter(~F.array_contains(parts_of(F.col(path)), quarantine))


def _numbered(folders: DataFrame, folder: str) -> DataFrame:
    """(folder, disc) of all folders, each once; see ``disc_folders``."""
    f = folders.select(F.col(folder).alias("folder")).distinct()
    name = base_of(F.col("folder"))
    f = f.withColumns({
        "exact": F.regexp_extract(name, X.DISC_PATTERN, 1).try_cast("int"), "up": parent_of(F.col("folder")),
        "number": F.regexp_extract(name, X.SUFFIX_DISC, 2).try_cast("int"), "stem": F.lower(X.clean_noise(F.regexp_extract(name, X.SUFFIX_DISC, 1))),
    })
    rivals = f.filter("number IS NOT NULL").groupBy("up", "stem").agg((F.min("number") < F.max("number")).alias("several"))
    f = f.join(rivals, ["up", "stem"], "left")
    inside = (F.col("stem") != "") & F.contains(F.lower(X.clean_noise(base_of(F.col("up")))), F.col("stem"))
    suffix = F.when(F.col("number").isNotNull() & (inside | F.coalesce("several", F.lit(False))), F.col("number"))
    return f.select("folder", F.when(F.col("folder").contains("/"), F.coalesce("exact", suffix)).alias("disc"))


def disc_folders(folders: DataFrame, folder: str) -> DataFrame:
    """(folder, disc) of the folders that are discs of their parent.

    "CD1" is one as it stands.  "Title Disc 1" is one if its parent's name
    holds the title, or a sibling has the same title and another number; the
    siblings are compared by an aggregate over parent and title.
    """
    return _numbered(folders, folder).filter("disc IS NOT NULL")


def grouped(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Adds root, label, and above as ``disc_above`` has it: files with one root and label are a set.

    Needs path, album and duration; ``folders`` has a ``folder`` column and may
    list folders without audio.  A root whose files come from its disc folders
    is one set whatever the albums say.
    """
    # What a folder's name tells is found once a folder.
    known = _numbered(folders, "folder").select("folder", F.col("disc").isNotNull().alias("is_disc"), disc_above(F.col("folder")).alias("told"), F.lit(True).alias("listed"))
    f = files.withColumn("folder", parent_of(F.col("path"))).join(known, "folder", "left")
    f = f.withColumn("above", F.when(F.col("listed"), F.col("told")).otherwise(disc_above(F.col("folder")))).drop("told", "listed")
    f = f.withColumn("root", F.when(F.col("is_disc"), parent_of(F.col("folder"))).otherwise(F.col("folder"))).drop("is_disc")
    f = f.withColumn("album_key", F.nullif(F.lower(F.trim(X.album_disc(F.col("album"))["stem"])), F.lit("")))
    about = f.groupBy("root").agg(F.max(F.col("folder") != F.col("root")).alias("collapsed"), F.min("album_key").alias("low"), F.max("album_key").alias("high"))
    f = f.join(about, "root")
    whole = (suffix_of(F.col("path")) == "m4b") | F.coalesce(F.col("duration") >= WHOLE_BOOK, F.lit(False))
    rest = F.when(F.col("low") == F.col("high"), F.concat(F.lit("album:"), "low")).otherwise("rest")
    label = F.when(F.col("collapsed"), "all").when(F.col("album_key").isNotNull(), F.concat(F.lit("album:"), "album_key")).when(whole, F.concat(F.lit("file:"), "path")).otherwise(rest)
    return f.withColumn("label", label).drop("low", "high", "album_key")


def sets(tracks: DataFrame) -> DataFrame:
    """One row a set: totals, and its number among the root's sets where there are several.

    The numbers run over sets, not files.
    """
    g = tracks.groupBy("root", "label").agg(
        F.count("*").alias("n_tracks"), F.greatest(F.count_distinct("disc"), F.lit(1).cast("long")).alias("n_discs"),
        F.nullif(F.sum(F.coalesce("duration", F.lit(0.0))), F.lit(0.0)).alias("duration"), F.min("path").alias("first_path"), F.first("collapsed").alias("collapsed"),
    )
    w = Window.partitionBy("root")
    g = g.withColumn("n_sets", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("first_path", "label")))
    return g.withColumn("synthetic", F.when(F.col("n_sets") > 1, F.col("place"))).drop("place")


def disc_above(folder: Column) -> Column:
    """The number of the nearest of a folder and the two above it that has one."""
    parts = parts_of(folder)
    above = F.reverse(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)))
    of = lambda n: F.coalesce(F.regexp_extract(n, X.DISC_PATTERN, 1).try_cast("int"), F.regexp_extract(n, X.SUFFIX_DISC, 2).try_cast("int"))
    return F.try_element_at(F.filter(F.transform(above, of), lambda n: n.isNotNull()), F.lit(1))


def disc_number(path: Column, tag: Column, album: Column, above: Column | None = None) -> Column:
    """By tag, album, file name, then the three folders above, as ``disc_above`` has them; else 1."""
    stem = F.regexp_replace(base_of(path), r"\.[^.]+$", "")
    found = disc_above(parent_of(path)) if above is None else above
    return F.coalesce(F.regexp_extract(tag, r"(\d+)", 1).try_cast("int"), X.album_disc(album)["disc"], F.regexp_extract(stem, X.DISC_PATTERN, 1).try_cast("int"), found, F.lit(1))


def track_number(path: Column, tag: Column) -> Column:
    stem = F.regexp_replace(base_of(path), r"\.[^.]+$", "")
    return F.coalesce(F.regexp_extract(tag, r"(\d+)", 1).try_cast("int"), X.first_int(stem, *X.TRACK_PATTERNS), F.lit(1))


def tag(tags: Column, *keys: str, read=None) -> Column:
    """The first of a map's keys whose value isn't blank, as ``read`` has it if that isn't null."""
    values = [X.blank_to_null(F.try_element_at(tags, F.lit(k))) for k in keys]
    return F.coalesce(*[read(v) if read else v for v in values])


# Where formats keep each field, in the order asked.
TAG_KEYS = {
    "title": ("TIT2", "TITLE", "\xa9nam"),
    "album": ("TALB", "ALBUM", "\xa9alb"),
    "artist": ("TPE1", "ARTIST", "\xa9ART"),
    "albumartist": ("TPE2", "ALBUMARTIST", "aART"),
    "date": ("TDRC", "DATE", "\xa9day"),
    "genre": ("TCON", "GENRE", "\xa9gen"),
    "track": ("TRCK", "TRACKNUMBER", "trkn"),
    "disc": ("TPOS", "DISCNUMBER", "disk"),
    "isbn": ("TXXX:ISBN", "ISBN", "----:com.apple.iTunes:ISBN"),
    "asin": ("TXXX:ASIN", "TXXX:AUDIBLE_ASIN", "ASIN", "asin", "----:com.apple.iTunes:ASIN", "----:com.pilabor.tone:AUDIBLE_ASIN", "CDEK", "WOAS"),
    "narrator": ("\xa9nrt", "----:com.apple.iTunes:NARRATOR", "TXXX:NARRATEDBY", "TXXX:NARRATOR", "narrator", "narratedby", "TCOM", "\xa9wrt"),
}
URL_TAGS = ("WOAS", "WXXX")


def _number(v: Column) -> Column:
    return F.nullif(F.regexp_extract(v, r"(\d+)", 1), F.lit(""))


def _isbn(v: Column) -> Column:
    plain = F.regexp_replace(v, r"[-\s]", "")
    return F.when(X.valid_isbn(plain), plain)


def _asin(v: Column) -> Column:
    """A code as the whole value, in capitals, or the first within free text."""
    return F.when(X.valid_asin(v), F.upper(v)).otherwise(X.asin_in(v))


def tag_fields(tags: Column) -> dict[str, Column]:
    """Every field of TAG_KEYS; a code that no key holds is looked for in the tags of links."""
    read = {"track": _number, "disc": _number, "isbn": _isbn, "asin": _asin}
    found = {k: tag(tags, *keys, read=read.get(k)) for k, keys in TAG_KEYS.items()}
    linked = F.filter(F.map_entries(tags), lambda e: F.upper(e["key"]).rlike("^(?:" + "|".join(URL_TAGS) + ")"))
    codes = F.filter(F.transform(linked, lambda e: _asin(X.blank_to_null(e["value"]))), lambda c: c.isNotNull())
    return found | {"asin": F.coalesce(found["asin"], F.try_element_at(codes, F.lit(1)))}


#: Columns of a listing that tell of a file's sound, beside its duration.
PROPERTIES = ("bitrate", "channels", "sample_rate")


def track_rows(files: DataFrame) -> DataFrame:
    """Tracks from (path, tags, duration) and what else is known of the sound; a file without a usable listing is an ERROR row of index 999."""
    t = F.col("tags")
    df = files.withColumns(tag_fields(t))
    bad = t.isNull() | F.col("duration").isNull() | (F.col("duration") < 0)
    index = F.when(bad, 999).otherwise(track_number(F.col("path"), F.col("track")))
    disc = F.when(bad, 1).otherwise(disc_number(F.col("path"), F.col("disc"), F.col("album")))
    sound = {c: F.when(~bad & (F.col(c) > 0), F.col(c)).cast("int") for c in PROPERTIES if c in files.columns}
    return df.withColumns({"track_index": index, "disc_index": disc, "status": F.when(bad, "error").otherwise("valid"), **sound})


def guesses(root: Column, collapsed: Column, n_tracks: Column, album: Column, artist: Column, stem: Column) -> Column:
    """struct(title, author, series, volume) of a set from its root's name, tags and only file.

    ``album`` and ``artist`` are what the first tracks agree on.
    """
    folder, above = base_of(root), parent_of(root)
    up = X.parent_author(base_of(above))
    one = X.name_guess(stem, F.lit(False))
    single = F.struct(F.coalesce(album, one["title"]).alias("title"), F.coalesce(artist, one["author"], X.parent_author(folder)).alias("author"), one["series"].alias("series"), one["volume"].alias("volume"))
    many = X.name_guess(folder, collapsed)
    as_named = collapsed | (up.isNotNull() & X.clean_noise(base_of(above)).rlike(X.LAST_FIRST_NAME))
    title = F.when(as_named | many["author"].isNotNull() | many["series"].isNotNull(), many["title"]).otherwise(F.coalesce(album, many["title"]))
    author = F.when(many["series"].isNull(), F.coalesce(many["author"], artist, up))
    whole = F.struct(title.alias("title"), author.alias("author"), many["series"].alias("series"), many["volume"].alias("volume"))
    return F.when(n_tracks == 1, single).otherwise(whole)


def narrator_of(lines: DataFrame, key: str, file: str, number: str, line: str) -> DataFrame:
    """(key, narrator): the first line, by file and place, that names who reads."""
    said = F.regexp_extract(line, r"(?i)^\s*(?:read by|narrated by|narrator)\s*[:=-]\s*(.+?)\s*$", 1)
    return lines.filter(said != "").groupBy(key).agg(F.min_by(said, F.struct(file, number)).alias("narrator"))


# Sidecars asked first, then any of these kinds.
SIDECAR_NAMES = ("metadata.json", "book.json", "info.json", "audiobook.json", "metadata.nfo", "book.nfo", "info.nfo")
SIDECAR_KINDS = ("nfo", "json", "info")


def best_sidecar(files: DataFrame, folder: str, name: str, parsed: str) -> DataFrame:
    """Each folder's first sidecar that parses: named ones in order, then by kind and name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in SIDECAR_NAMES]), F.col(name)), F.lit(0)),
                      100 + F.nullif(F.array_position(F.array(*[F.lit(k) for k in SIDECAR_KINDS]), suffix_of(F.col(name))), F.lit(0)))
    usable = files.withColumn("rank", rank).filter(F.col(parsed).isNotNull() & F.col("rank").isNotNull())
    best = usable.groupBy(folder).agg(F.min(F.struct("rank", name, parsed)).alias("s"))
    return best.select(folder, F.col(f"s.{name}").alias(name), F.col(f"s.{parsed}").alias(parsed))
