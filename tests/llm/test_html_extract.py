"""Pages with known articles, broken markup, and the given pages against a plain cut."""

import html
import re

import pytest

from shelfwise.llm import html_extract as H
from tests.conftest import SF_SMALL

LONG = "A sentence of some length, with a comma, and another one that goes on for a while. " * 4


def page(body, head="<title>T</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = [
    (None, []),
    ("", []),
    ("   ", []),
    ("just text &amp; more", ["just text & more"]),
    (page("<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>One &lt;b&gt;.<p>Two<br>lines</article><footer>f</footer>"), ["Head", "One <b>.", "Two lines"]),
    (page("<script>var a='</p><p>x';</script><article><p>Hi</p></article><div class='ad'>buy</div>"), ["Hi"]),
    (page(f"<div id=content><h1>Title</h1><p>{LONG}</p><div><p>{LONG}</p></div></div><div class='sidebar'><p>{LONG * 3}</p></div>"), ["Title", LONG.strip(), LONG.strip()]),
    (page(f"<div class='page-with-sidebar'><p>{LONG}</p></div><div class='sidebar'><p>x, y, z</p></div>"), [LONG.strip()]),
    (page(f"<article><p>{LONG}</p><section id=comments><p>{LONG}</p></section><form><p>Mail</p></form><aside>side</aside></article>"), [LONG.strip()]),
    (page(f"<div role=dialog>cookies</div><div class=cookie-notice><p>{LONG * 2}</p></div><main><p>{LONG}</p><ul><li>a<li>b</ul></main>"), [LONG.strip(), "a", "b"]),
    (page(f"<header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>{LONG}</p></article>"), ["Head", LONG.strip()]),
    (page(f"<div><p>{LONG}</p></div><div><p>{' '.join(f'<a href=/{i}>link number {i}, text</a>' for i in range(80))}</p></div>"), [LONG.strip()]),
    (page("<article><p>x &nbsp; y\n\tz</p><!-- c --><table><tr><td>1<td>2<tr><td>3</table><pre>a\n  b</pre></article>"), ["x y z", "1", "2", "3", "a b"]),
    ("<article><p>cut off in a tag <b>here</b><foo bar='", ["cut off in a tag here"]),
    ("<article><p>unclosed comment<!-- never ends <p>no</p>", ["unclosed comment"]),
    ("<p title='a>b'>quoted</p>", ["quoted"]),
    ("<form><p>whole page in a form</p></form>", ["whole page in a form"]),
    ("a < b and c > d", ["a < b and c > d"]),
    ("<article><p>&#233;&eacute;&#x1F600;&copy</article>", ["éé😀©"]),
]


@pytest.mark.parametrize("source,want", CASES)
def test_known_articles(source, want):
    assert H.main_blocks(source) == want


def test_deep_and_long_pages():
    deep = "<div>" * 20000 + "<p>core</p>" + "</div>" * 20000
    assert H.main_text(deep) == "core"
    many = page("<article>" + "<p>word, word</p>" * 30000 + "</article>")
    assert H.main_text(many).count("word, word") == 30000
    assert H.main_text("<article><p>" + "x" * 500000 + " <" * 2000).startswith("xxx")


def test_given_pages_and_odd_rows(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    for r in H.extract_main_text(pages).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.main_text == "\n\n".join(x for x in parts if x)
    rows = [(1, None, "u"), (None, "<p>x</p>", None), (None, "<p>x</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted(r.main_text for r in H.extract_main_text(df).collect()) == ["", "x", "x"]
    assert H.extract_main_text(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        H.extract_main_text(df, out_col="text")


SECTIONS = f"<section><h2>A</h2>{f'<p>{LONG}</p>' * 10}</section><section><h2>B</h2><p>Only a short remark stands here.</p></section>"


@pytest.mark.parametrize("around", ["<main>{}</main>", "<div role=main><div>{}</div></div>", "<div role='main'>{}</div>", "<div>{}</div>", "{}"])
def test_short_sections_without_an_article_tag_stay(around):
    links = "<section>" + "<a href=/>more, links</a> " * 9 + "</section>"
    body = "<nav>menu</nav>" + around.format(SECTIONS) + "<div class=ad>buy</div><footer>f</footer>"
    assert H.main_blocks(page(body)) == ["A", *[LONG.strip()] * 10, "B", "Only a short remark stands here."]
    assert H.main_blocks(page(f"<div>{SECTIONS}{links}</div>")) == ["A", *[LONG.strip()] * 10, "B", "Only a short remark stands here."]


#: Names as page builders, blogs and news sites use them; the truth is written by hand.
NAMED = [
    *[(f"<article><h1>Head</h1><p>{LONG}</p><div class='{c}'><p>{LONG}</p></div></article>", ["Head", LONG.strip()])
      for c in ("comment-body", "comments-container", "article-sidebar", "related-content", "newsletter-container", "post-comments", "commentlist", "entry-footer", "social-share")],
    (f"<article><p>{LONG}</p></article><div class='comment-content'><p>{LONG}</p></div>", [LONG.strip()]),
    (f"<article><p>{LONG}</p><p class=notice>Mind the gap.</p><section id=social><h2 id=related>Ties</h2><p>{LONG}</p></section></article>", [LONG.strip(), "Mind the gap.", "Ties", LONG.strip()]),
    ("<article><p>It is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p></article>", ["It is x=2 here."]),
    (f"<article><p>{LONG}</p><section id=comments><p>{LONG}</p></section></article>", [LONG.strip()]),
    (f"<div class='content-sidebar-wrap'><div><p>{LONG}</p></div></div>", [LONG.strip()]),
    (f"<div class='has-sidebar no-footer'><p>{LONG}</p></div>", [LONG.strip()]),
    (f"<div class='sidebar-layout'><p>{LONG}</p><div class='page-footer'><p>{LONG}</p></div></div>", [LONG.strip()]),
    ("<div><p>First, a short remark on this page.</p></div><div><p>Then one more.</p></div>", ["First, a short remark on this page.", "Then one more."]),
]


@pytest.mark.parametrize("body,want", NAMED)
def test_names_that_mark_parts(body, want):
    assert H.main_blocks(page(body)) == want


def test_page_builder_layouts_keep_every_paragraph():
    parts = [f"Part {i}. {LONG * (1 + i % 3)}".strip() for i in range(5)]
    rows = "".join(f"<div class=row><div class=col><p>{p}</p></div></div>" for p in parts)
    links = "<div class=col><ul>" + "".join(f"<li><a href=/{i}>Another story, number {i}</a></li>" for i in range(30)) + "</ul></div>"
    around = "<div class=top><a href=/>Home</a> <a href=/a>About</a></div>{}<div class=footer><p>Address, town</p></div>"
    assert H.main_blocks(page(around.format(rows))) == parts
    assert H.main_blocks(page(around.format(f"<div class=builder>{rows}{links}</div>"))) == parts
    assert H.main_blocks(page(around.format(f"<div><h1>Title</h1><div>{rows}</div></div>"))) == ["Title", *parts]


def test_comment_threads_inside_the_article():
    thread = "".join(f"<li class='comment depth-{i % 3}'><div class=comment-author>reader {i}</div><div class=comment-body><p>{LONG}</p></div></li>" for i in range(20))
    body = f"<article class=post><header class=entry-header><h1>Head</h1></header><div class=entry-content><p>{LONG}</p><blockquote>A quotation, kept.</blockquote></div><ol class=comment-list>{thread}</ol></article>"
    assert H.main_blocks(page(body)) == ["Head", LONG.strip(), "A quotation, kept."]


def test_deep_nesting_is_linear():
    import time

    t = time.time()
    n = 20_000
    deep = "".join(f"<div>word {i}, and more of it." for i in range(n)) + "</div>" * n
    assert len(H.main_blocks(deep)) > 0.89 * n
    inline = "<article>" + "<b>" * 5000 + "text<hr>" * 5000 + "</article>"
    assert len(H.main_blocks(inline)) == 5000
    items = "<div>" * 3000 + "<li>one" * 3000
    assert len(H.main_blocks(items)) == 3000
    assert time.time() - t < 10
