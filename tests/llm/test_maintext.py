"""Main text against an independent cut of the tables' pages, and pages of other layouts."""

import html
import random
import re
import time

import pytest
from codexa.llm import maintext

SF = "/root/testdata/sf0.001"
WORDS = "the of river stone market garden evening letter window carried across found quiet against market tomorrow between".split()


def cut_out(page):
    """The article of a page of the tables, by its tags."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1] if found else "")
    lines = (" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n".join(x for x in lines if x)


def test_whole_table(spark):
    got = {r["page_id"]: r for r in maintext.op11_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages) and {i: r["text"] for i, r in got.items()} == {p["page_id"]: cut_out(p["html"]) for p in pages}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def paragraphs(rng, n):
    return [" ".join(sentence(rng, rng.randint(6, 18)) for _ in range(rng.randint(1, 5))) for _ in range(n)]


def around(rng, body, marked):
    """Boilerplate on all sides of an article."""
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in WORDS[:7])
    said = "".join(f"<div class=comment><p>{p}</p></div>" for p in paragraphs(rng, 3))
    side = "".join(f"<p>{p}</p>" for p in paragraphs(rng, 2))
    tags = ("header", "nav", "aside", "footer") if marked else ("div",) * 4
    a, b, c, d = tags
    return f"""<!doctype html><html class="no-js"><head><title>T &amp; t</title><style>p{{}}</style></head><body class="has-sidebar home">
<{a} class="site-header"><p>{sentence(rng, 9)}</p></{a}><{b} id="main-nav"><ul>{menu}</ul></{b}>
<div class="cookie-notice">{sentence(rng, 14)}</div><div id=wrap class="layout with-sidebar">{body}
<{c} class="sidebar">{side}</{c}></div><form><label>{sentence(rng, 5)}</label><input name=q><button>Go</button></form>
<section id="comments"><h3>Comments</h3>{said}</section><div class="adBox"><p>{sentence(rng, 12)}</p></div>
<{d} class="page-footer"><p>&copy; {sentence(rng, 12)}</p></{d}><script>document.write("<article>no</article>")</script></body></html>"""


@pytest.mark.parametrize("seed", range(6))
def test_boilerplate_by_tag_and_mark(seed):
    rng = random.Random(seed)
    own = paragraphs(rng, rng.randint(1, 8))
    title = "A title, short"
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{p.replace(' ', chr(10) + ' ', 1)}</p>" for p in own) + "<ul><li>one<li>two</ul>"
    want = "\n".join([title, *own, "one", "two"])
    for body in (f"<article class='post has-comments'>{inner}</article>", f"<main>{inner}</main>", f"<div role='main'>{inner}</div>", f"<div itemprop='articleBody'>{inner}</div>"):
        assert maintext.main_text(around(rng, body, seed % 2 == 0)) == want


@pytest.mark.parametrize("seed", range(6))
def test_ratios_find_an_article_without_marks(seed):
    """Nothing but the text's shape tells the article."""
    rng = random.Random(seed)
    own = paragraphs(rng, 12)
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in WORDS)
    tiles = "".join(f"<div class='t{i}'><span><a href=x>{w}</a></span></div>" for i, w in enumerate(WORDS))
    body = f"<div class='x1'><ul>{links}</ul></div><div class='x2'>{tiles}</div><div class='x3'><h2>A title</h2>{''.join(f'<p>{p}</p>' for p in own)}</div><div class='x4'><span>Home</span> <span>Top</span></div>"
    assert maintext.main_text(f"<html><body>{body}</body></html>") == "\n".join(["A title", *own])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain &lt;text&gt; alone", "plain <text> alone"), ("<article></article>", ""), ("<p>a<p>b", "a\nb"),
        ("<article><p>a &amp b &#233;&nbsp;&eacute; &unknown; &#x1F600;</p></article>", "a & b é é &unknown; 😀"),
        ("<article><p>a<br>b<b> c</b>d <i>e</i></p>tail<hr>end</article>", "a b cd e\ntail\nend"),
        ("<article><p>1 < 2 and 3 > 2</p><!-- <p>no</p> --><p title='a > b'>c</p></article>", "1 < 2 and 3 > 2\nc"),
        ("<ARTICLE><P>up</P><SCRIPT>if (a<b) '</p>'</SCRIPT><STYLE>p{}</STYLE></ARTICLE>", "up"),
        ("<article><p>seen<!-- open", "seen"), ("<article><p>seen<script>open", "seen"), ("<article><p>seen<a href='", "seen"),
        ("<article><header><h1>Title</h1><p>By someone</p></header><p>Text.</p><footer>no</footer><aside>no</aside><nav>no</nav></article>", "Title\nText."),
        ("<main><div class='related-posts'><p>Other.</p></div><p>Text.</p><div hidden>no</div><p style='display: none'>no</p></main>", "Text."),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre><dl><dt>k<dd>v</dl></article>", "a\nb\nc\nx y\nk\nv"),
        ("<article><p><b>one.<br></article><footer>no</footer>", "one."), ("<b>x<p>y</b>z</p>", "x\nyz"), ("<article>a</p>b</article>", "a\nb"),
    ],
)
def test_markup(page, want):
    assert maintext.main_text(page) == want


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<article>a</article>", "x", 1), (1, "u", "<article>a</article>", "x", 1), (None, None, None, None, None)]
    got = maintext.extract(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert maintext.extract(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("piece", ["<a \"", "<!--", "<div>", "<p><b>", "<script>", "<b></p>", "<li>x", "</script", "<b><div></b>x", "<p>x<div hidden ", "&amp", "<table><td>"])
def test_time_grows_with_length(piece):
    began = time.perf_counter()
    maintext.main_text(piece * 40_000)
    assert time.perf_counter() - began < 20


def test_very_long_page():
    own = [f"Paragraph {i} of a very long page." for i in range(50_000)]
    assert maintext.main_text("<nav>no</nav><article>" + "".join(f"<p>{p}" for p in own) + "</article>") == "\n".join(own)
