"""Publisher pages: title, authors, abstract and paragraphs of HTML, in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "title string, authors array<string>, abstract string, paragraphs array<string>"
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


@dataclass(frozen=True)
class Site:
    """What to read of a publisher's pages: element tags, and (attribute, value) marks of elements."""

    paragraph: str = "p"
    title: tuple[str, ...] = ("h1",)
    author: tuple[tuple[str, str], ...] = (("class", "author"), ("class", "contrib-author"), ("itemprop", "author"))
    abstract: tuple[tuple[str, str], ...] = (("class", "abstract"), ("id", "abstract"), ("id", "Abs1-content"))
    drop_tags: frozenset[str] = frozenset({"script", "style", "nav", "noscript", "header", "footer", "figure", "table", "aside"})
    drop_marks: tuple[tuple[str, str], ...] = (("class", "references"), ("class", "ref-list"), ("role", "navigation"))
    stop_headers: frozenset[str] = frozenset({"references", "see also", "external links"})
    skip_text: tuple[str, ...] = ("requires JavaScript",)
    numbered_anchors: bool = True


SITES: dict[str, Site] = {
    "default": Site(), "pmc": Site(skip_text=("web site requires JavaScript",)), "nature": Site(author=(("data-test", "author-name"),)),
    "oup": Site(abstract=(("class", "abstract"),)), "springer": Site(abstract=(("id", "Abs1-content"),)), "wiley": Site(abstract=(("class", "article-section__content"),)),
    "bioscientifica": Site(abstract=(("class", "abstract"),)), "wikipedia": Site(numbered_anchors=False),
}


@dataclass
class _Page(HTMLParser):
    site: Site = field(default_factory=Site)

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, abstract, author
        self.title, self.authors, self.abstract, self.paragraphs = "", [], [], []
        self.buffers: list[tuple[str, list[str]]] = []
        self.stopped = False

    def _marked(self, attrs: dict, marks) -> bool:
        return any(v in (attrs.get(a) or "").split() for a, v in marks)

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        if tag == self.site.paragraph and any(t == tag for t, *_ in self.stack):
            self.handle_endtag(tag)  # an open paragraph ends where the next begins
        up = self.stack[-1] if self.stack else ("", False, False, False)
        at = dict(attrs)
        drop = up[1] or tag in self.site.drop_tags or self._marked(at, self.site.drop_marks)
        if not self.site.numbered_anchors and tag == "sup" and "reference" in (at.get("class") or ""):
            drop = True
        self.stack.append((tag, drop, up[2] or self._marked(at, self.site.abstract), self._marked(at, self.site.author)))
        if tag == self.site.paragraph or tag in self.site.title or tag in ("title", "h2", "h3") or self.stack[-1][3]:
            self.buffers.append((tag, []))

    def handle_endtag(self, tag):
        while self.stack:
            t, drop, abstract, author = self.stack.pop()
            if self.buffers and self.buffers[-1][0] == t and (t == self.site.paragraph or t in self.site.title or t in ("title", "h2", "h3") or author):
                self._close(t, " ".join("".join(self.buffers.pop()[1]).split()), drop, abstract, author)
            if t == tag:
                break

    def _close(self, tag, text, drop, abstract, author):
        if tag in ("h2", "h3"):
            self.stopped = self.stopped or text.lower() in self.site.stop_headers
        if drop or not text:
            return
        if tag == "title":
            self.title = self.title or text
        elif author:
            self.authors.append(text)
        elif tag in self.site.title:
            self.title = text
        elif tag == self.site.paragraph and not self.stopped and not any(s in text for s in self.site.skip_text):
            (self.abstract if abstract else self.paragraphs).append(text)

    def handle_data(self, data):
        if self.buffers and not (self.stack and self.stack[-1][1]):
            self.buffers[-1][1].append(data)


def parse_page(html: str | None, site: str = "default") -> tuple[str | None, list[str], str | None, list[str]]:
    """(title, authors, abstract, paragraphs) of one page; scripts, styles, navigation and reference lists are left out."""
    if not html:
        return None, [], None, []
    page = _Page(SITES.get(site, SITES["default"]))
    page.feed(html)
    page.close()
    while page.stack:
        page.handle_endtag(page.stack[-1][0])
    return page.title or None, page.authors, "\n".join(page.abstract) or None, page.paragraphs


def page_parts(site: str = "default"):
    """Arrow UDF: HTML column to ``RESULT``; null and empty pages give nulls and empty lists."""

    @F.pandas_udf(RESULT)
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(h, site) for h in html], columns=["title", "authors", "abstract", "paragraphs"])

    return run


def read_pages(df: DataFrame, html: str, site: str = "default", *keep: Column | str) -> DataFrame:
    return df.select(*keep, page_parts(site)(F.col(html)).alias("page")).select(*keep, "page.*")
