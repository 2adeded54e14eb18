"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each text at the end of a path of tags with their
marks (class, id, role).  Structures that are never an article's text (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, comments) are told by
tag or mark and left out.  Of what is left, each root-to-leaf path gets its mean
text length and its mean count of punctuation; these ratios are smoothed along the
page, fused, and weighed down by links.  Paths whose score reaches the page's
threshold select content.  The content's root is the article or main element with
most of it, or else the deepest element with nearly all of it; every block of text
under the root belongs to the article, so headings, short paragraphs and lists stay.

Defined results: a null html has an empty text; characters are decoded as in a
browser, also without a semicolon; any white space inside a block, line breaks of
``br`` and ``pre`` too, is one space; unclosed tags end where their parent or the
page ends; an unclosed comment or script hides the rest; a page of any size is read
whole, in time that grows with its size; equal rows give equal rows; an empty table
gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Smoothing of ratios over neighbouring texts: weights by distance.
SMOOTH = (1.0, 0.6, 0.14)
#: Times the scores' deviation that a path must reach.
THRESHOLD = 1.0
#: Share of the selected text that a root without article or main holds.
ROOT_SHARE = 0.85
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？¿¡]")

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("caption tbody td tfoot th thead tr body html".split())
#: Start tags that end an open one of the second kind, unless one of the third is nearer.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
    "option": (("option",), ("select",)), "optgroup": (("optgroup",), ("select",)), "a": (("a",), tuple(sorted(BLOCK))), "button": (("button",), ()),
}
NEVER = frozenset("nav footer aside form button select dialog svg object applet audio video canvas head datalist menu fieldset map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist tooltip".split())
#: Words of class and id: the place of an element, and what it is for.
LAYOUT = frozenset("nav navbar navigation menu menubar header masthead topbar footer colophon sidebar rail aside toolbar breadcrumb breadcrumbs pagination pager".split())
PURPOSE = frozenset("ad ads adv advert adverts advertisement advertising adslot adsense adbox adbanner banner sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices alert popup overlay modal toast newsletter subscribe subscription signup signin login paywall comment comments respond disqus reply replies discussion share shares sharing social related recommended recommendations trending widget widgets skip hidden".split())
JOINED = frozenset("with has no without".split())
MARKS = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
BARE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
COPYRIGHT = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)", re.I)


class Path:
    """A tag path: where it hangs, and what is known of it."""

    __slots__ = ("tag", "up", "never", "layout", "purpose", "main", "link", "kids")

    def __init__(self, tag: str, up: Path | None, never=False, layout=False, purpose=False, main=None, link=False):
        self.tag, self.up, self.never, self.layout, self.purpose, self.main, self.link, self.kids = tag, up, never, layout, purpose, main, link, {}

    def inner(self, tag: str, marks: str) -> Path:
        found = self.kids.get((tag, marks))
        if found is None:
            found = self.kids[tag, marks] = self._made(tag, marks)
        return found

    def _made(self, tag: str, marks: str) -> Path:
        layout, purpose, role, off = False, False, "", False
        for name, a, b, c in MARKS.findall(marks) if "=" in marks or "hidden" in marks else ():
            name, value = name.lower(), entities.unescape(a or b or c)
            if name in ("class", "id"):
                words = [w.lower() for w in WORDS.findall(value)]
                told = [w for i, w in enumerate(words) if not (i and words[i - 1] in JOINED)]
                layout |= any(w in LAYOUT for w in told)
                purpose |= any(w in PURPOSE for w in told)
            elif name == "role":
                role = value.strip().lower()
            elif name == "style":
                off |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name == "aria-hidden":
                off |= value.strip().lower() == "true"
            elif name == "itemprop" and value.strip().lower() == "articlebody":
                role = "main"
        off |= bool(re.search(r"(?:^|\s)hidden(?=[\s/]|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", marks)))
        opens = tag in ("article", "main") or role in ("main", "article")
        if tag in ("html", "body"):
            layout = purpose = False
        # An article's own header may hold its title.
        never = self.never or off or tag in NEVER and role != "main" or role in ROLES or tag == "header" and self.main is None
        inside = self.main is not None and tag == "header"
        made = Path(tag, self, never, (self.layout and not opens) or layout or inside, self.purpose or purpose, self.main, self.link or tag == "a")
        if opens and not (made.never or made.purpose) and (self.main is None or self.main.tag == "main"):
            made.main, made.layout = made, False
        return made

    @property
    def left_out(self) -> bool:
        return self.never or self.purpose or self.layout and self.tag not in HEADING and not (self.up and self.up.tag in HEADING)


class Page:
    """Blocks of a page: [block element's path, [(path, text)]]."""

    def __init__(self):
        self.root = Path("", None)
        self.stack: list[Path] = [self.root]
        self.open: dict[str, list[int]] = {}
        self.walls = [0]
        self.blocks: list[tuple[Path, list[tuple[Path, str]]]] = []
        self.fresh = True

    def text(self, raw: str) -> None:
        if not raw:
            return
        if self.fresh:
            self.blocks.append((self.stack[self.walls[-1]], []))
            self.fresh = False
        self.blocks[-1][1].append((self.stack[-1], entities.unescape(raw) if "&" in raw else raw))

    def push(self, tag: str, marks: str) -> None:
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.walls.append(len(self.stack))
            self.fresh = True
        self.stack.append(self.stack[-1].inner(tag, marks))

    def pop_to(self, at: int) -> None:
        """Ends all elements from this one on."""
        while len(self.stack) > at:
            self.open[self.stack.pop().tag].pop()
        while self.walls[-1] >= at:
            self.walls.pop()
            self.fresh = True

    def last(self, *tags: str) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def start(self, tag: str, marks: str) -> None:
        if tag in ENDS_P and (at := self.last("p")) > 0:
            self.pop_to(at)
        if tag in ENDS:
            ended, nearer = ENDS[tag]
            if (at := self.last(*ended)) > 0 and at > self.last(*nearer):
                self.pop_to(at)
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag == "body" and (at := self.last("head")) > 0:
            self.pop_to(at)
        if tag == "br":
            self.text(" ")
        elif tag == "hr":
            self.fresh = True
        elif tag not in VOID:
            self.push(tag, marks)

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if tag in ("html", "body"):
            return  # what follows is still the body's
        if at > 0 and (tag in BLOCK or self.walls[-1] < at):
            self.pop_to(at)
        elif tag == "p":
            self.fresh = True

    def read(self, source: str) -> Page:
        at, tag_at = 0, TAG
        while (lt := source.find("<", at)) >= 0:
            follows = source[lt + 1 : lt + 2]
            if follows.isascii() and follows.isalpha() or follows == "/" and source[lt + 2 : lt + 3].isascii() and source[lt + 2 : lt + 3].isalpha():
                self.text(source[at:lt])
                found = tag_at.match(source, lt)
                if not found and tag_at is TAG:
                    # A quote that never ends: from here on, tags end at the next bracket.
                    tag_at = BARE
                    found = tag_at.match(source, lt)
                if not found:
                    return self
                at, name = found.end(), found[2].lower()
                if found[1]:
                    self.end(name)
                elif name == "plaintext":
                    return self
                elif name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    if not close:
                        return self
                    at = close.end()
                else:
                    self.start(name, found[3])
            elif source.startswith("<!--", lt):
                self.text(source[at:lt])
                close = lt + 5 if source.startswith(">", lt + 4) else source.find("-->", lt + 4) + 3
                if close < lt + 5:
                    return self
                at = close
            elif follows in ("!", "?", "/"):
                self.text(source[at:lt])
                close = source.find(">", lt)
                if close < 0:
                    return self
                at = close + 1
            else:
                self.text(source[at : lt + 1])
                at = lt + 1
        self.text(source[at:])
        return self


def smoothed(values: list[float]) -> list[float]:
    out, reach = [], len(SMOOTH) - 1
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = [SMOOTH[abs(j - i)] for j in range(lo, hi)]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def scores(leaves: list[tuple[Path, str]]) -> dict[Path, float]:
    """Fused ratio of each path: its mean text length and punctuation, smoothed along the page, less its links."""
    chars: dict[Path, int] = {}
    marks: dict[Path, int] = {}
    count: dict[Path, int] = {}
    for path, text in leaves:
        chars[path] = chars.get(path, 0) + len(text.strip())
        marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(text))
        count[path] = count.get(path, 0) + 1
    long = smoothed([chars[p] / count[p] for p, _ in leaves])
    said = smoothed([marks[p] / count[p] for p, _ in leaves])
    total: dict[Path, float] = {}
    for (path, _), a, b in zip(leaves, long, said, strict=True):
        total[path] = total.get(path, 0.0) + math.sqrt(a * chars[path] / count[path]) * (1 + math.sqrt(b * marks[path] / count[path])) * (0.1 if path.link else 1.0)
    return {p: t / count[p] for p, t in total.items()}


def content_root(root: Path, leaves: list[tuple[Path, str]]) -> Path | None:
    """The element below the page's root whose blocks are the article."""
    score = scores(leaves)
    if not score:
        return None
    mean = sum(score.values()) / len(score)
    least = THRESHOLD * math.sqrt(sum((s - mean) ** 2 for s in score.values()) / len(score))
    weight: dict[Path, float] = {}
    for path, text in leaves:
        if score[path] >= least and not COPYRIGHT.match(text):
            weight[path] = weight.get(path, 0.0) + len(text.strip())
    marked: dict[Path, float] = {}
    for path, w in weight.items():
        if path.main is not None:
            marked[path.main] = marked.get(path.main, 0.0) + w
    if not marked and any(p.main is not None for p, _ in leaves):
        for path, text in leaves:
            if path.main is not None:
                marked[path.main] = marked.get(path.main, 0.0) + len(text.strip())
    if marked:
        return max(marked, key=lambda p: marked[p])
    # Sums of subtrees, innermost first.
    order = [(root, 0)]
    for path, d in order:
        order += [(kid, d + 1) for kid in path.kids.values()]
    under: dict[Path, float] = {}
    for path, _ in reversed(order):
        under[path] = weight.get(path, 0.0) + sum(under[kid] for kid in path.kids.values())
    full = [(d, p) for p, d in order if weight and under[p] >= ROOT_SHARE * under[root] and p.tag in BLOCK and p.tag not in HEADING and p.tag not in ("p", "li", "td")]
    return max(full, key=lambda x: x[0], default=(0, None))[1]


def main_text(source: str | None) -> str:
    page = Page().read(source or "")
    blocks = [(own, kept) for own, leaves in page.blocks if (kept := [(p, t) for p, t in leaves if not p.left_out])]
    leaves = [(p, t) for _, kept in blocks for p, t in kept if t.strip()]
    root = content_root(page.root, leaves)
    memo: dict[Path, bool] = {None: root is None}

    def inside(path: Path) -> bool:
        line = []
        while path not in memo:
            if path is root:
                memo[path] = True
                break
            line.append(path)
            path = path.up
        for p in line:
            memo[p] = memo[path]
        return memo[path]

    chosen = [(own, kept) for own, kept in blocks if inside(own)]
    if root is not None and root.main is None:
        # Without a mark, links in lists and the page's own imprint aren't content.
        score = scores(leaves)
        menu = lambda kept: all(p.link or not t.strip() for p, t in kept) and any(score.get(p, 0) < 20 for p, _ in kept)
        chosen = [(own, kept) for own, kept in chosen if not menu(kept) and not COPYRIGHT.match("".join(t for _, t in kept))]
    lines = (" ".join("".join(t for _, t in kept).split()) for _, kept in chosen)
    return "\n".join(x for x in lines if x)


def extract_batches(batches):
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of (page_id, url, html)."""
    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(extract_batches, SCHEMA)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
