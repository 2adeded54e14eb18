"""Names of works, people and files, as Column expressions.

Patterns spell out Unicode classes: Java's ``\\w`` and ``\\s`` are ASCII unless
told otherwise.  Blank strings count as missing throughout.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Articles and honorifics that don't tell names apart.
ARTICLES = ("the", "a", "an", "el", "la", "le", "der", "die")
SUFFIXES = (" jr.", " sr.", " ii", " iii", " iv")
FORBIDDEN = r'[<>:"/\\|?*]'
ISBN = r"^(?:\d{9}[\dXx]|\d{13})$"
ASIN = r"(?i)^B0[A-Z0-9]{8}$"
ASIN_IN_TEXT = r"\b(B0[A-Z0-9]{8})\b"
YEAR = r"\b((?:19|20)\d{2})\b"
#: (pattern, confidence), first hit first.
SERIES = ((r"(?i)(.+?)\s+(?:book|vol(?:ume)?)\s+(\d+)", 0.95), (r"(?i)(.+?)\s+#(\d+)", 0.90), (r"(?i)(.+?)\s+part\s+(\d+)", 0.85))
NAMED_SERIES = r"(?i)(.+?)\s+(?:book|vol|volume)\s*(\d+)"
TRACK_PATTERNS = (r"^(\d{1,3})", r"(?i)track\s*(\d+)", r"(?i)ch(?:apter)?\s*(\d+)", r"(?i)part\s*(\d+)", r"(\d+)\s*[-_.]\s*")
DISC_PATTERN = r"(?i)^(?:disc(?:\s*|[-_])|cd(?:\s*|[-_])|book\s*|volume\s*|vol\.?\s*)(\d+)$"
SUFFIX_DISC = r"(?i)^(.+?)[\s\-_]+(?:disc|cd|disk|part|pt)[\s\-_]*(\d+)$"
SEGMENT = r"(?i)^(.+?)(?:[\s\-_]+(?:disc|cd|disk|part|pt))?[\s\-_]*(\d+)$"
CODE_NAME = r"^[A-Z]{1,4}\s*\d+$"
LAST_FIRST_NAME = r"^[^\d,]{2,}?,\s+[^\d,]{2,}$"
NAME_TOKEN = r"^(?:[A-Z][A-Za-z'`-]*|[A-Z](?:\.[A-Z])+\.?|[A-Z]\.)$"
NOT_IN_NAMES = ("a", "an", "and", "book", "cd", "chapter", "disc", "disk", "for", "in", "of", "on", "part", "pt", "the", "to", "track", "vol", "volume", "with")
AUTHOR_SPLIT = r"\s*(?:,|/|&|and)\s*"


#: White space of any script, and the separators that count as such.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """What f makes of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


@F.arrow_udf(T.StringType())
def _folded(c: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_normalize(c, "NFKD"), r"[^\x00-\x7F]", "")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _folded_all(c: pa.Array) -> pa.Array:
    flat = pc.replace_substring_regex(pc.utf8_normalize(c.values, "NFKD"), r"[^\x00-\x7F]", "")
    return pa.ListArray.from_arrays(c.offsets, flat, mask=c.is_null())


@F.arrow_udf(T.StringType())
def _composed(c: pa.Array) -> pa.Array:
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in c.to_pylist()], pa.string())


def fold(c: Column) -> Column:
    """Compatibility decomposition, then ASCII alone: letters lose their marks, ligatures part.

    Normal forms go by tables over all characters, which no built-in has: Arrow's kernels see a batch at a time.
    """
    return _folded(c)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def composed(c: Column) -> Column:
    """Letters and the marks behind them as one character where there is one, marks in canonical order first."""
    return _composed(c)


def normalize_title(c: Column) -> Column:
    t = F.regexp_replace(strip(F.lower(c)), rf",{SPACE}*(?:{'|'.join(ARTICLES)})$", "")
    t = F.regexp_replace(t, rf"^(?:{'|'.join(ARTICLES)}){SPACE}+", "")
    return fold(squeeze(F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}_{SPACE[1:-1]}-]", "")))


def _plain_author(c: Column) -> Column:
    t = strip(F.lower(c))
    for s in SUFFIXES:
        t = strip(F.regexp_replace(t, s.replace(".", r"\.") + "$", ""))
    return t


def _first_name_first(c: Column) -> Column:
    return let(c, lambda t: F.when(t.contains(","), F.concat_ws(" ", F.trim(F.regexp_extract(t, r"^[^,]*,(.*)$", 1)), F.trim(F.regexp_extract(t, r"^([^,]*),", 1)))).otherwise(t))


def normalize_author(c: Column) -> Column:
    return _first_name_first(fold(_plain_author(c)))


def normalize_authors(names: Column) -> Column:
    """Of an array of names: each one's key."""
    return F.transform(_folded_all(F.transform(names, _plain_author)), _first_name_first)


def series_of(c: Column) -> Column:
    """struct(series, volume, confidence), null if no pattern applies."""
    hits = [F.when(c.rlike(p), F.struct(F.trim(F.regexp_extract(c, p, 1)).alias("series"), F.regexp_extract(c, p, 2).alias("volume"), F.lit(conf).alias("confidence"))) for p, conf in SERIES]
    return F.coalesce(*hits)


def first_int(c: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.regexp_extract(c, p, 1).try_cast("int") for p in patterns])


def year_in(c: Column) -> Column:
    return F.regexp_extract(c, YEAR, 1).try_cast("int")


def runtime_minutes(c: Column) -> Column:
    h = F.coalesce(F.regexp_extract(c, r"(?i)(\d+)\s*hr", 1).try_cast("int"), F.lit(0))
    m = F.coalesce(F.regexp_extract(c, r"(?i)(\d+)\s*min", 1).try_cast("int"), F.lit(0))
    return F.nullif(h * 60 + m, F.lit(0))


def valid_isbn(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, "[- ]", "").rlike(ISBN), F.lit(False))


def valid_asin(c: Column) -> Column:
    return F.coalesce(c.rlike(ASIN), F.lit(False))


def clean_noise(c: Column) -> Column:
    """Without bracketed parts and the space around them."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\[.*?\]\s*", ""), r"\s*\(.*?\)\s*", ""))


def split_dash(c: Column, part: int) -> Column:
    """The text before (1) or after (2) the first spaced dash."""
    return blank_to_null(F.regexp_extract(c, r"^(.+?)\s*[-–—]\s*(.+)$", part))


def last_first(c: Column) -> Column:
    words = F.split(F.trim(c), r"\s+")
    flipped = F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
    return F.when(c.contains(",") | (F.size(words) < 2), F.trim(c)).otherwise(flipped)


def title_case(c: Column) -> Column:
    return F.initcap(squeeze(c))


def zero_pad(c: Column, width: Column) -> Column:
    return let(c.cast("string"), lambda s: F.when(F.length(s) < width, F.lpad(s, width, F.lit("0"))).otherwise(s))


def file_name(c: Column, most: int = 255) -> Column:
    """Composed, without forbidden characters, of bounded length; a long name keeps its suffix."""

    def bounded(t):
        suffix = F.regexp_extract(t, r"[^.](\.[^.]+)$", 1)
        return F.when(F.length(t) > most, F.concat(truncate(F.left(t, F.length(t) - F.length(suffix)), F.lit(most) - F.length(suffix)), suffix)).otherwise(t)

    return strip(let(F.regexp_replace(composed(c), FORBIDDEN, "_"), bounded))


def shorten(c: Column, most: int = 30) -> Column:
    """Whole words up to ``most`` characters; a first word that is longer is cut, a short text stays as it is."""
    whole = lambda head: F.when(F.length(head) <= most, head).otherwise(F.regexp_extract(head, "^(.*) ", 1))
    return let(c, lambda t: F.when(F.length(t) <= most, t).otherwise(F.coalesce(F.nullif(let(F.left(squeeze(t), F.lit(most + 1)), whole), F.lit("")), F.left(t, F.lit(most)))))


def implausible_person(c: Column) -> Column:
    """A code, mostly digits, or a single token of three characters at most; blank isn't."""
    t = F.trim(c)
    solid = F.length(F.regexp_replace(t, r"\s", ""))
    digits = F.length(F.regexp_replace(t, r"[^0-9]", ""))
    return F.coalesce((t != "") & (t.rlike(CODE_NAME) | (digits * 2 > solid) | (~t.rlike(r"\s") & (F.length(t) <= 3))), F.lit(False))


def personal_name(c: Column) -> Column:
    """Two to four tokens that could all be parts of a name, one of them longer than a letter."""
    tokens = F.split(F.trim(c), r"\s+")
    letters = lambda t: F.regexp_replace(t, "[^A-Za-z]", "")
    fits = F.forall(tokens, lambda t: t.rlike(NAME_TOKEN) & ~F.lower(letters(t)).isin(*NOT_IN_NAMES))
    return F.coalesce(F.size(tokens).between(2, 4) & fits & F.exists(tokens, lambda t: F.length(letters(t)) > 1), F.lit(False))


def sides(c: Column, collapsed: Column) -> Column:
    """struct(title, author) of "Author - Title"; of collapsed discs the side that is a name is the author."""
    left, right = split_dash(c, 1), split_dash(c, 2)
    usual = F.struct(right.alias("title"), F.when(~implausible_person(left), left).alias("author"))
    swapped = collapsed & personal_name(right) & ~personal_name(left)
    named = F.when(swapped, F.struct(left.alias("title"), right.alias("author"))).when(collapsed & personal_name(left) & ~personal_name(right), F.struct(right.alias("title"), left.alias("author")))
    return F.coalesce(named, usual)


def name_guess(c: Column, collapsed: Column) -> Column:
    """struct(title, author, series, volume) of a folder's or file's name."""
    t = clean_noise(c)
    pair = sides(t, collapsed)
    none = F.lit(None).cast("string")
    series = F.struct(t.alias("title"), none.alias("author"), F.trim(F.regexp_extract(t, NAMED_SERIES, 1)).alias("series"), F.regexp_extract(t, NAMED_SERIES, 2).alias("volume"))
    plain = F.struct(F.coalesce(pair["title"], blank_to_null(t)).alias("title"), pair["author"].alias("author"), none.alias("series"), none.alias("volume"))
    return F.when(t.rlike(NAMED_SERIES), series).otherwise(plain)


def parent_author(c: Column) -> Column:
    """The author that a parent folder names: before a dash, or as "Last, First"."""
    t = clean_noise(c)
    return F.coalesce(sides(t, F.lit(False))["author"], F.when(t.rlike(LAST_FIRST_NAME) & ~implausible_person(t), t))


def album_disc(c: Column) -> Column:
    """struct(stem, disc): "On Combat Disc 3" is disc 3 of "On Combat"."""
    t = F.trim(c)
    has = t.rlike(SUFFIX_DISC)
    stem = F.when(has, blank_to_null(F.regexp_extract(t, SUFFIX_DISC, 1))).otherwise(c)
    return F.struct(stem.alias("stem"), F.when(has, F.regexp_extract(t, SUFFIX_DISC, 2).try_cast("int")).alias("disc"))


def asin_in(c: Column) -> Column:
    """The first product code in free text, in capitals."""
    return F.nullif(F.upper(F.regexp_extract(c, "(?i)" + ASIN_IN_TEXT, 1)), F.lit(""))


def track_title(stem: Column) -> Column:
    return F.coalesce(blank_to_null(F.replace(F.regexp_replace(stem, r"^[\d\s._-]+", ""), F.lit("_"), F.lit(" "))), blank_to_null(stem), F.lit("Track"))


def truncate(c: Column, most: int | Column) -> Column:
    """Whole words and an ellipsis, or a cut word and one, where a text is too long."""
    most = F.lit(most) if isinstance(most, int) else most

    def short(t):
        def fitting(words):
            joined = lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")
            n = F.size(F.filter(F.sequence(F.lit(1), F.size(words)), lambda n: F.length(joined(n)) + (n == 1).cast("int") <= most - 3))
            return F.when(n > 0, F.concat(joined(n), F.lit("...")))

        return F.coalesce(F.when(t.contains(" "), let(F.split(strip(t), SPACE + "+"), fitting)), F.concat(F.left(t, most - 3), F.lit("...")))

    return let(c, lambda t: F.when(F.length(t) <= most, t).otherwise(short(t)))


def safe_path(c: Column, part: int = 100, most: int = 255) -> Column:
    """Each part without forbidden characters and of bounded length, the whole bounded too."""
    parts = F.transform(F.split(composed(c), r"[\\/]"), lambda p: truncate(F.regexp_replace(strip(p), FORBIDDEN, "_"), part))
    return truncate(F.array_join(F.filter(parts, lambda p: p != ""), "/"), most)


def author_list(c: Column) -> Column:
    """Names between commas, slashes, ampersands and the letters "and", wherever these stand."""
    return F.filter(F.transform(F.split(c, AUTHOR_SPLIT), lambda x: F.trim(x)), lambda a: a != "")


def epoch_seconds(c: Column) -> Column:
    """A stamp as number or ISO text, in seconds; 0 where it is neither."""
    return F.coalesce(c.try_cast("double"), F.unix_micros(F.try_to_timestamp(c)) / 1e6, F.lit(0.0))


def clock(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", two(h), two(m), two(r))).otherwise(F.concat_ws(":", two(m), two(r)))


def frames(ms: Column) -> Column:
    """mm:ss:ff at 75 frames a second."""
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    s = F.floor(ms / 1000).cast("long")
    return F.concat_ws(":", F.when(F.floor(s / 60) > 99, F.floor(s / 60).cast("string")).otherwise(two(F.floor(s / 60))), two(s % 60), two(F.floor(ms % 1000 * 75 / 1000)))
