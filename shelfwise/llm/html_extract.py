"""Main text of web pages by tree scoring.

A tolerant pass turns a page into a tree of open and implied-closed elements. Every paragraph
passes points for its length and commas to its container, half of them to the container's
parent and again half to each further ancestor; a container's points are discounted by the share of
its text that is links. The best container is kept, or the marked article around it, or else the nearest
ancestor that holds most of the page's paragraphs; so are its good siblings.

How it scales: one page is one row; a narrow pass, no shuffle, memory bounded by a page.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.arrow import small_batches

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAIN_ROLE = re.compile(r"""(?<![\w-])role\s*=\s*(?:"\s*main\s*"|'\s*main\s*'|main(?=[\s/]|\Z))""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in _RAW}
_VOID = frozenset("br img hr input meta link area base col embed source track wbr param".split())
_BLOCK = frozenset(
    "p h1 h2 h3 h4 h5 h6 li div section article blockquote pre td th tr table tbody thead tfoot caption ul ol dl dt dd figure"
    " figcaption main header footer nav aside hr address details summary body html form fieldset hgroup center dialog menu search".split()
)
_ENDS_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption body html".split())
#: An opening tag ends these elements, up to the element that bounds them.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption address summary".split())
_OUT_TAGS = frozenset("nav footer aside menu dialog form button select datalist svg object canvas audio video map head search".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_OUT_WORDS = frozenset(
    "nav navbar navigation menu sidebar aside footer header masthead comment comments disqus replies respond ad ads advert adverts"
    " advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay notice notices"
    " alert newsletter subscribe subscription signup login share sharing social related breadcrumb breadcrumbs pagination pager".split()
)
#: Words that an article's own section may have in its id without being one of the above.
_TOPICS = frozenset("social share sharing notice notices alert login menu navigation related consent header".split())
#: Before one of the words above these say that the element merely has such a part.
_HAVING = frozenset("with has have having no without".split())
#: A name from the first to the second kind is a wrapper of the article, whatever stands between.
_MAIN_WORDS = frozenset("article content main post entry story page".split())
_WRAP_WORDS = frozenset("wrap wrapper container layout page row grid".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_START = {"article": 10, "main": 10, "section": 3, "div": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "th": -5}


_ARTICLE_HEADER = frozenset(["header"])


def _names_outside(token: str, spared) -> bool:
    """Does one class name or id say that its element is no part of an article?"""
    words = _WORDS.findall(_CAMEL.sub(" ", token).lower())
    if len(words) > 1 and words[-1] in _WRAP_WORDS and (words[0] in _MAIN_WORDS or words[-1] in ("layout", "page")):
        return False
    for w in words:
        if w in _HAVING:
            return False
        if (w in _OUT_WORDS or w.startswith("comment") and w != "commentary") and w not in spared:
            return True
    return False


class _Page:
    """Elements of a page as flat lists; element 0 is the root."""

    def __init__(self, source: str, by_name: bool):
        self.tag, self.parent, self.out = ["body"], [-1], [False]
        self.main: set[int] = set()  # elements of role main
        self.blocks: list[tuple[int, str, int]] = []  # owner, text, characters inside links
        self._read(source, by_name)

    def _outside(self, tag: str, attrs: str, in_article: bool, by_name: bool) -> bool:
        """Is the element no part of an article?"""
        if tag in _OUT_TAGS:
            return by_name or tag != "form"
        if tag == "header":
            return True
        if not attrs or not by_name or tag in ("html", "body", "main"):
            return False
        named = {}
        for m in _ATTR.finditer(attrs):
            named.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
            return True
        if named.get("role", "").lower() in _OUT_ROLES:
            return True
        if tag in _HEADINGS or (tag == "p" and in_article):
            return False  # such a name is an anchor or a style
        inside = in_article or tag == "article"
        for kind in ("class", "id"):
            spared = _TOPICS if kind == "id" and in_article and tag == "section" else _ARTICLE_HEADER if inside else ()
            if any(_names_outside(token, spared) for token in named.get(kind, "").split()):
                return True
        return False

    def _read(self, s: str, by_name: bool) -> None:
        tag, parent, out = self.tag, self.parent, self.out
        stack, count = [0], {"body": 1}
        open_blocks = [0]
        run: list[str] = []
        links = n_article = header = 0
        n_link = 0

        def flush() -> None:
            nonlocal n_link
            text = " ".join(html.unescape("".join(run)).split()) if run else ""
            run.clear()
            if text:
                self.blocks.append((open_blocks[-1], text, min(n_link, len(text))))
            n_link = 0

        def text(t: str) -> None:
            nonlocal n_link
            top = stack[-1]
            if out[top] or (header and not any(count.get(h) for h in _HEADINGS)):
                return
            run.append(t)
            if links:
                n_link += len(t.strip())

        def pop() -> str:
            nonlocal links, n_article, header
            t = tag[stack[-1]]
            if t in _BLOCK:
                flush()
                open_blocks.pop()
            stack.pop()
            count[t] -= 1
            links -= t == "a"
            n_article -= t == "article"
            header -= t == "header" and header > 0
            return t

        at, end = 0, len(s)
        while at < end:
            m = _TOKEN.search(s, at)
            if m is None:
                text(s[at:])
                break
            if m.start() > at:
                text(s[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, attrs = name.lower(), m[3] if m[2] else m[6]
            if m[1] or m[4]:  # end tag
                if not count.get(name) or name == "body":
                    continue
                depth = len(stack) - 1
                while tag[stack[depth]] != name:
                    depth -= 1
                if name not in _BLOCK and open_blocks[-1] > stack[depth]:
                    continue  # an inline element left open around blocks
                while len(stack) > depth:
                    pop()
                continue
            if name in ("html", "body") or name == "head" and len(stack) > 1:
                continue
            if name in _RAW:
                stop = _RAW_END[name].search(s, at)
                close = s.find(">", stop.end()) if stop else -1
                at = end if close < 0 else close + 1
                continue
            if name in _VOID:
                if name == "br":
                    text(" ")
                elif name == "hr":
                    flush()
                continue
            if count.get("head") and name not in ("head", "object"):
                while len(stack) > 1:  # the first other element ends an open head
                    pop()
            if name in _ENDS_P and count.get("p"):
                while pop() != "p":
                    pass
            if name in _IMPLIED and any(count.get(c) for c in _IMPLIED[name][0]):
                close, bound = _IMPLIED[name]
                depth = len(stack) - 1
                while depth and tag[stack[depth]] not in close and tag[stack[depth]] not in bound:
                    depth -= 1
                if depth and tag[stack[depth]] in close:
                    while len(stack) > depth:
                        pop()
            if name in _BLOCK:
                flush()
            outside = out[stack[-1]]
            if not outside:
                if name == "header" and n_article:
                    header += 1  # an article's own header: its headings stay
                else:
                    outside = self._outside(name, attrs, n_article > 0, by_name)
            if attrs and _MAIN_ROLE.search(attrs):
                self.main.add(len(tag))
            tag.append(name)
            parent.append(stack[-1])
            out.append(outside)
            stack.append(len(tag) - 1)
            if name in _BLOCK:
                open_blocks.append(len(tag) - 1)
            count[name] = count.get(name, 0) + 1
            links += name == "a"
            n_article += name == "article"
        while len(stack) > 1:
            pop()
        flush()


class _Scores:
    """Of each element: points, text length, share of the text that is links (1 without text), and weight of its paragraphs."""

    def __init__(self, page: _Page):
        n = len(page.tag)
        passed, self.size, linked, self.weight = [0.0] * n, [0] * n, [0] * n, [0.0] * n
        for owner, text, n_link in page.blocks:
            s = min(1.0, len(text) / 25) + text.count(",") + min(len(text) / 100, 3.0)
            s *= 1 - n_link / len(text)
            self.size[owner] += len(text)
            linked[owner] += n_link
            self.weight[owner] += s
            passed[page.parent[owner] if page.tag[owner] in _PARAGRAPH and owner else owner] += s
        for i in range(n - 1, 0, -1):  # an element stands after its parent: one way up passes all points
            up = page.parent[i]
            self.size[up] += self.size[i]
            linked[up] += linked[i]
            self.weight[up] += self.weight[i]
            passed[up] += passed[i] / 2
        self.links = [a / b if b else 1.0 for a, b in zip(linked, self.size)]
        self.points = [(p + _START.get(t, 0)) * (1 - x) if p and size else 0.0 for p, t, x, size in zip(passed, page.tag, self.links, self.size)]


#: A container that holds less of the page's paragraphs gives way to an ancestor that holds as much.
_MOST = 0.9
_SENTENCE = re.compile(r"""[.!?…。！？]["'”’»)]*$""")


def main_blocks(source: str | None) -> list[str]:
    """The article's blocks in page order, white space collapsed; none for a null or empty page."""
    if not source:
        return []
    for by_name in (True, False):  # the second try: a page whose names or one form put everything outside
        page = _Page(source, by_name)
        if page.blocks:
            break
    else:
        return []
    score = _Scores(page)
    best = max(range(len(page.tag)), key=score.points.__getitem__)
    path = [best]
    while path[-1] > 0:
        path.append(page.parent[path[-1]])
    marked = [i for i in path if page.tag[i] in ("article", "main") or i in page.main]
    dropped: set[int] = set()
    if marked:
        best = marked[-1]
    else:
        climbed = next(i for i in path if score.weight[i] >= _MOST * score.weight[0])
        if climbed != best:
            # an ancestor also holds what stands beside the article: lists of links go
            held = set(path[: path.index(climbed) + 1])
            dropped = {i for i in range(1, len(page.tag)) if page.parent[i] in held and i not in held and score.links[i] >= 0.5 and page.tag[i] not in _PARAGRAPH}
            best = climbed
    last: dict[int, str] = {}
    roots = {best}
    if best:
        child_of = [0] * len(page.tag)  # the sibling of the container (or itself) that an element stands in
        for i in range(1, len(page.tag)):
            child_of[i] = i if page.parent[i] == page.parent[best] else child_of[page.parent[i]]
        last = {child_of[owner]: text for owner, text, _ in page.blocks}
        for i in range(1, len(page.tag)):
            if page.parent[i] != page.parent[best] or i == best or not score.size[i]:
                continue
            linked, size = score.links[i], score.size[i]
            same = page.tag[best] == "section" == page.tag[i]  # a short section of the same article
            told = linked < 0.25 and size > 80 and page.tag[i] in _PARAGRAPH or not linked and not marked and _SENTENCE.search(last.get(i, ""))
            if score.points[i] >= max(10.0, 0.2 * score.points[best]) or page.tag[i] == "h1" or same and linked < 0.25 or told:
                roots.add(i)
    kept = [False] * len(page.tag)
    for i in range(len(page.tag)):
        kept[i] = i in roots or (i > 0 and kept[page.parent[i]] and i not in dropped)
    return [text for owner, text, _ in page.blocks if kept[owner]]


def main_text(source: str | None) -> str:
    return "\n\n".join(main_blocks(source))


def main_text_of(source: Column, spark: SparkSession) -> Column:
    """Main text of a page's whole html (null: empty string)."""
    small_batches(spark)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(main_text, na_action=None).astype(object)

    return run(source.cast("string"))


def extract_main_text(df: DataFrame, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """``df`` with column ``out_col``; all rows and columns stay, repeats too; an empty table gives none,
    an ``out_col`` that ``df`` has already is an error."""
    if out_col in df.columns:
        raise ValueError(f"{out_col} is a column already; choose another out_col")
    return df.withColumn(out_col, main_text_of(F.col(html_col), df.sparkSession))
