"""What a page says, by the kind of site: fields found by selectors in the HTML that a fetch has brought.

A page is parsed once into a flat list of elements in document order; a selector is a chain of simple ones (tag, #id, .class, [attr],
[attr="v"], [attr*="v"]), matched from the right. The rules are a table of fields per kind, so another kind is another row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.urls import classify_content

from .readers import VOID

#: Elements whose text a reader doesn't see.
UNSEEN = frozenset(("script", "style", "head", "template", "noscript"))


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    up: Element | None
    parts: list[str | Element] = field(default_factory=list)

    def words(self) -> Iterator[str]:
        for p in self.parts:
            if isinstance(p, str):
                yield p
            elif p.tag not in UNSEEN:
                yield from p.words()

    @property
    def text(self) -> str:
        return " ".join(" ".join(self.words()).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.now = Element("", {}, None)
        self.root, self.all = self.now, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.parts.append(e)
        self.all.append(e)
        if tag not in VOID:
            self.now = e

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.now = self.now.up

    def handle_endtag(self, tag: str) -> None:
        at = self.now
        while at.up is not None and at.tag != tag:
            at = at.up
        if at.up is not None:  # an end without a start is passed over
            self.now = at.up

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.now.parts.append(data)


_PART = re.compile(r'([#.])([\w-]+)|\[([\w:-]+)(?:(\*?=)"([^"]*)")?\]|([\w-]+)')


@cache
def _compiled(selector: str) -> tuple[tuple[tuple[str, str, str], ...], ...]:
    """A chain of simple selectors, each a tuple of tests (kind, name, value)."""
    chain = []
    for simple in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", selector):
        tests = []
        for mark, name, attr, op, value, tag in _PART.findall(simple):
            tests.append(("tag", tag, "") if tag else ("id", name, "") if mark == "#" else ("class", name, "") if mark else (op or "has", attr, value))
        chain.append(tuple(tests))
    return tuple(chain)


def _passes(e: Element, tests: tuple[tuple[str, str, str], ...]) -> bool:
    for kind, name, value in tests:
        own = e.attrs.get(name)
        ok = (
            e.tag == name if kind == "tag"
            else e.attrs.get("id") == name if kind == "id"
            else name in e.attrs.get("class", "").split() if kind == "class"
            else own is not None if kind == "has"
            else own == value if kind == "="
            else own is not None and value in own
        )
        if not ok:
            return False
    return True


class Page:
    """Elements of a page in document order, found by selectors."""

    def __init__(self, html: str):
        tree = _Tree()
        tree.feed(html)
        tree.close()
        self.root, self.elements = tree.root, tree.all

    def find(self, selectors: str) -> list[Element]:
        """Elements that fit one of several selectors, separated by commas, in document order."""
        chains = [_compiled(s.strip()) for s in selectors.split(",")]
        return [e for e in self.elements if any(self._fits(e, c) for c in chains)]

    def _fits(self, e: Element | None, chain: tuple) -> bool:
        if not _passes(e, chain[-1]):
            return False
        for tests in reversed(chain[:-1]):
            e = e.up
            while e is not None and not (e.tag and _passes(e, tests)):
                e = e.up
            if e is None:
                return False
        return True

    def first(self, *choices: str, attr: str | None = None) -> str:
        """The text of the first element of the first choice that has any, or where that is blank its attribute."""
        for c in choices:
            found = self.find(c)
            if found:
                return found[0].text or (found[0].attrs.get(attr, "") if attr else "")
        return ""

    def has(self, selectors: str) -> bool:
        return bool(self.find(selectors))

    @property
    def title(self) -> str:
        return self.first("title")

    @property
    def body(self) -> str:
        found = self.find("body")
        return (found[0] if found else self.root).text

    def number(self, selectors: str) -> int:
        """The first digits of the first element's text; 0 without."""
        found = re.search(r"\d+", self.first(selectors))
        return int(found.group()) if found else 0


#: Selectors of the kinds of site.
LOGIN = 'form[action*="login"], input[name="email"], input[placeholder*="correo"], button[name="login"]'
POST = ['div[data-ft*="content_owner_id_new"]', ".userContent", '[data-ad-preview="message"]', '[data-testid="post_message"]']
ARTICLE = "article, .article, .post, .nota, .entry"
NEWS_TITLE = ["h1", ".article-title", ".post-title", ".entry-title", "article h1", '[property="og:title"]']
NEWS_SUMMARY = [".article-summary", ".entry-summary", ".post-excerpt", ".bajada", ".summary", '[property="og:description"]']
NEWS_BODY = ["article .content", ".article-body", ".post-content", ".entry-content", ".article-text"]
NEWS_AUTHOR = [".author", ".article-author", ".byline", '[rel="author"]']
NEWS_DATE = [".date", ".article-date", ".post-date", '[property="article:published_time"]', "time"]
MAIN = ["main", "article", "#content", ".content", ".main", ".post", ".page"]
EMBEDDED_PDF = 'embed[type="application/pdf"], object[type="application/pdf"]'
NOT_READABLE = "Documento PDF detectado - texto no extraíble directamente"


def _facebook(p: Page, url: str) -> dict:
    if p.has(LOGIN):
        found = p.find('meta[property="og:description"]')
        return {"title": p.title, "text": found[0].attrs.get("content", "") if found else "", "login_required": True}
    images = [e.attrs.get("src", "") for e in p.find('a[href*="photo.php"] img, [data-ft*="photo"] img')]
    return {
        "title": p.title,
        "text": p.first(*POST) or p.first("#contentArea, article"),
        "author": p.first('h3, [data-ft*="author"], strong.actor'),
        "date": p.first("abbr", attr="title"),
        "images": [x for x in images if x and not x.startswith("data:image")],
        "has_images": p.has('[data-ft*="photo"], a[href*="photo.php"]'),
        "has_video": p.has('video, [data-sigil*="inlineVideo"]'),
        "comments": p.number('[data-testid="UFI2CommentsCount/root"]'),
        "reactions": p.number('[data-testid="UFI2TopReactions/tooltip"] span[aria-hidden="true"]'),
    }


def _youtube(p: Page, url: str) -> dict:
    return {
        "title": p.first('h1.title, [id="title"] h1, [id="container"] h1') or p.title,
        "text": p.first('#description, #description-text, [id="description"] yt-formatted-string'),
        "author": p.first("#owner-name a, #channel-name, .ytd-channel-name"),
        "date": p.first("#info-strings yt-formatted-string, #upload-info span.date"),
        "views": p.first(".view-count, #count .short-view-count"),
    }


def _news(p: Page, url: str) -> dict:
    return {
        "title": p.first(*NEWS_TITLE) if p.has(", ".join(NEWS_TITLE)) else p.title,
        "summary": p.first(*NEWS_SUMMARY),
        "text": p.first(*NEWS_BODY) or p.first(ARTICLE),
        "author": p.first(*NEWS_AUTHOR),
        "date": p.first(*NEWS_DATE, attr="datetime"),
        "has_images": p.has("article img, .article img, .post img"),
    }


def _document(p: Page, url: str) -> dict:
    embedded = p.has(EMBEDDED_PDF)
    return {"title": p.title, "text": NOT_READABLE if embedded else p.body, "pages": 0 if embedded else 1}


def _other(p: Page, url: str) -> dict:
    texts = [found[0].text for found in map(p.find, MAIN) if found]
    return {"title": p.title, "text": max(texts, key=len, default="") or p.body}


def _image(p: Page, url: str) -> dict:
    parts = urlsplit(url)
    return {"title": parts.path.rsplit("/", 1)[-1], "author": parts.netloc}


KINDS = {"facebook": _facebook, "youtube": _youtube, "news": _news, "image": _image, "document": _document}
_TEXTS, _FLAGS, _COUNTS = ("title", "text", "summary", "author", "date", "views"), ("login_required", "has_images", "has_video"), ("comments", "reactions", "pages")
FIELDS = T.StructType([*[T.StructField(n, T.StringType()) for n in _TEXTS], *[T.StructField(n, T.BooleanType()) for n in _FLAGS], *[T.StructField(n, T.IntegerType()) for n in _COUNTS], T.StructField("images", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


def content_of(html: str, url: str, kind: str) -> dict:
    """The fields of FIELDS; what a kind has no rule for is '', false or 0."""
    blank = {**dict.fromkeys(_TEXTS, ""), **dict.fromkeys(_FLAGS, False), **dict.fromkeys(_COUNTS, 0), "images": [], "error": None}
    try:
        return blank | KINDS.get(kind, _other)(Page(html), url)
    except Exception as e:  # a page that can't be read is a row with its error
        return blank | {"error": f"{type(e).__name__}: {e}"}


@F.pandas_udf(FIELDS)
def page_content(html: pd.Series, url: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """content_of by rows; nulls are empty."""
    rows = [content_of(h, u, k) for h, u, k in zip(html.fillna(""), url.fillna(""), kind.fillna(""), strict=True)]
    return pd.DataFrame(rows, columns=FIELDS.names)


def contents(pages: DataFrame, url: Column, html: Column) -> DataFrame:
    """pages plus kind and content."""
    return pages.withColumn("kind", classify_content(url)).withColumn("content", page_content(html, url, F.col("kind")))


def texts_of_success(pages: DataFrame) -> DataFrame:
    """Of pages with content the rows that could be read and say something, with their text."""
    return pages.withColumn("text", F.col("content.text")).where(F.col("content.error").isNull() & (F.trim("text") != ""))
