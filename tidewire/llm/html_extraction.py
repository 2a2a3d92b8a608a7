"""HTML extraction: the main text of a page is its maximum-scoring subsequence of words and tags.

A page is read into a sequence of text pieces and tags. A word scores by where it stands (inside or outside an element that marks an
article, its innermost block, inside or outside a link), a tag, which never scores above zero, by its name and by where it stands.
The weights are log odds counted on the labelled pages of the table, those with one <article>, whose words and tags are labelled
inside or outside of it; all of them are counted, as sums per feature, so what goes to the driver is one row for each of the
features named here. One linear scan then finds the contiguous region of the greatest sum, and its ends widen to whole blocks.

Menus, headers and footers of the page, sidebars, notices, adverts, forms, comments of readers, scripts and styles are known by element, role
or the words of class and id (BOILERPLATE). They score nothing, so that one amid an article doesn't cut it in two, and are left out of the
text. Elements that mark an article count where the page has one, else classes and ids that name one, else a page is judged by blocks and
links; if no word scores then, by links alone. The header of an article belongs to it.

Text: character references are decoded once, white space inside a block becomes one space (line breaks and inline tags don't end a block),
blocks are trimmed, empty ones go, and the rest is joined by newlines in page order. Nothing else is dropped or capped.

Cases: null, empty and textless pages give an empty text; markup that isn't closed ends with its parent or the page; an unclosed comment,
script or style takes the rest; a `<` before anything but a name is text. Without labelled pages the weights are those of PRIOR. Rows
stay as they are, repeated ones too; a column named main_text is replaced, others pass through. A page is read in time linear in its length,
without a shuffle.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, ship, with_row

# Names of HTML, by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is raw text, and those without main text whatever holds them.
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"])
UNSEEN = frozenset("audio button canvas datalist head iframe input noembed noframes noscript object option script select style svg template textarea title video xmp".split())
#: Elements and roles that mark boilerplate; a header does so outside an article only.
OUTSIDE = frozenset("aside dialog footer form menu nav".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that mark boilerplate.
BOILERPLATE = frozenset(
    "ad adbox ads adsense advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs byline comment commentlist comments commentary consent cookie cookies disclaimer discussion disqus "
    "feedback footer form gdpr login masthead menu menus modal nav navbar navigation navi newsletter notice notices notification outbrain overlay pager pagination popup "
    "privacy promo promos promoted promotion recommended recommendations register related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored "
    "subscribe subscription taboola teaser teasers toolbar widget widgets".split()
)
#: Whole classes and ids that mark the article, for pages without an element that does.
CONTENT = frozenset(
    "article articlebody article-body article-content article-text article__body body-content content contents entry entry-content main main-content maincontent main-text post post-body post-content story story-body story-content page-content text-content".split()
)
# End of the fixed values.

#: Before pages are counted, PRIOR words are taken to lie inside and outside in these shares (1/2 for others), and log odds end at LIMIT.
SHARES = dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption text".split(), 0.9) | dict.fromkeys("a li nav ul footer aside form link".split(), 0.1)
PRIOR, LIMIT, PLACE_LIMIT = 4.0, 4.0, 12.0
#: The least that a tag costs.
TAG_COST = 0.05

_NAMES = BLOCKS | INLINE
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_OPENS = re.compile(r"</?[a-zA-Z]")
_HINTED = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
_SKIPPED = re.compile(r"(?:has|with|no|without|is|js)[-_]")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


@dataclass(slots=True)
class Item:
    """A text piece or a tag of a page, with what its score depends on."""

    kind: str  # "text" or "tag"
    name: str  # innermost block of a text, name of a tag
    text: str
    words: int
    link: bool
    mark: str  # "element", "hint" or "": the strongest mark of an article that holds it
    main: bool  # inside <main>
    out: bool  # inside boilerplate
    block: int  # number of the block


def _marks(name: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """(mark, boilerplate) of an opening tag; inside: an article holds it."""
    if not _HINTED.search(attributes):
        return ("element", False) if name == "article" else ("", name in UNSEEN or name in OUTSIDE or (name == "header" and not inside))
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    names = (found.get("class", "") + " " + found.get("id", "")).split() if name not in ("html", "body") else []
    words = [w.lower() for n in names if not _SKIPPED.match(n) for w in _PARTS.split(n)]
    out = name in UNSEEN or name in OUTSIDE or role in OUTSIDE_ROLES or not BOILERPLATE.isdisjoint(words) or (not inside and (name == "header" or "header" in words))
    out = out or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    # a marked article within a form or the like is an article all the same; one that bears a name of boilerplate isn't
    if not out and (name == "article" or role == "article" or "articlebody" in found.get("itemprop", "").lower().split()):
        return "element", False
    return ("hint" if not out and any(n.lower() in CONTENT for n in names) else ""), out


def read(page: str) -> list[Item]:
    """The page's text pieces and tags in order."""
    items: list[Item] = []
    # name, mark, in <main>, boilerplate, block name, in link
    stack: list[tuple[str, str, bool, bool, str, bool]] = [("", "", False, False, "", False)]
    at, end, block, tag = 0, len(page), 0, _TAG
    opened: Counter = Counter()

    def leave(k: int) -> None:
        for element in stack[k:]:
            opened[element[0]] -= 1
        del stack[k:]

    def put(raw: str) -> None:
        text = entities.unescape(raw)
        _, mark, main, out, inner, link = stack[-1]
        items.append(Item("text", inner, text, len(text.split()), link, mark, main, out, block))

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            put(page[at:lt])
        if lt == end:
            break
        if page.startswith("<!--", lt):
            close = lt if page.startswith("<!-->", lt) else page.find("-->", lt + 4)
            at = end if close < 0 else page.find(">", close) + 1
            continue
        if lt + 1 < end and page[lt + 1] in "!?":
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = tag.match(page, lt)
        if m is None and tag is _TAG and _OPENS.match(page, lt):
            # quotes that don't close: from here on a tag ends at its first `>`
            tag = _PLAIN_TAG
            m = tag.match(page, lt)
        if m is None:
            if _OPENS.match(page, lt):
                break
            put("<")
            at = lt + 1
            continue
        at, closing, name = m.end(), m.group(1) == "/", m.group(2).lower()
        is_block = name in BLOCKS
        block += is_block
        _, mark, main, out, inner, link = stack[-1]
        if closing:
            # an inline tag ends nothing beyond its block, a block whatever it holds; one that isn't open ends nothing
            k = len(stack) - 1 if opened[name] else 0
            while k > 0 and stack[k][0] != name and (is_block or stack[k][0] not in BLOCKS):
                k -= 1
            if k > 0 and stack[k][0] == name:
                leave(k)
            _, mark, main, out, inner, link = stack[-1]
            items.append(Item("tag", name, "", 0, link, mark, main, out, block))
            continue
        if is_block and opened["p"]:
            # a paragraph ends at the next block, list items and cells at their like
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    leave(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in _CLOSES:
            like, bound = _CLOSES[name]
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in like) else ():
                if stack[k][0] in like:
                    leave(k)
                    break
                if stack[k][0] in bound:
                    break
        _, mark, main, out, inner, link = stack[-1]
        own, bad = _marks(name, m.group(3), bool(mark))
        # the innermost mark decides
        here = ("element" if own == "element" else mark or own, main or name == "main", (out or bad) and own != "element", name if is_block else inner, link or name == "a")
        items.append(Item("tag", name, "", 0, here[4], here[0], here[1], here[2], block))
        if name in VOID:
            continue
        if name in RAW and not m.group(3).endswith("/"):
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = close.start() if close else end
            stack.append((name, *here))
            opened[name] += 1
            continue
        if not m.group(3).endswith("/") or name in _NAMES:
            stack.append((name, *here))
            opened[name] += 1
    return items


def level_of(items: list[Item]) -> str:
    """What marks the page's article: an element, a class or id, or nothing. <main> counts as a class does."""
    shown = [i for i in items if not i.out]
    if any(i.mark == "element" for i in shown):
        return "element"
    return "hint" if any(i.mark or i.main for i in shown) else ""


def place_of(item: Item, level: str) -> str:
    """in, out or open: inside the article, outside of it, or not to be told from marks."""
    if not level:
        return "open"
    if level == "element":
        return "in" if item.mark == "element" else "open" if item.main else "out"
    return "in" if item.mark or item.main else "out"


def features(items: list[Item]) -> Counter:
    """(feature, name, inside) -> words or tags of a labelled page."""
    out: Counter = Counter()
    for i in items:
        inside = i.mark == "element" and not i.out
        name = i.name if i.name in _NAMES else "other"
        if i.kind == "tag":
            out["tag", name, inside] += 1
        elif i.words:
            out["block", name, inside] += i.words
            out["link", "link" if i.link else "text", inside] += i.words
            out["place", "in" if i.mark == "element" else "out", inside] += i.words
    return out


Weights = dict[tuple[str, str], float]


def weights_of(counts: dict[tuple[str, str, bool], int]) -> Weights:
    """Log odds of inside against outside for each feature."""
    out: Weights = {}
    for feature, names in (("tag", _NAMES | {"other"}), ("block", _NAMES | {"other"}), ("link", ["link", "text"]), ("place", ["in", "out"])):
        for name in names:
            share = {"in": 0.99, "out": 0.01}.get(name, SHARES.get(name, 0.5)) if feature in ("place",) else SHARES.get(name, 0.5)
            inside, outside = (counts.get((feature, name, x), 0) for x in (True, False))
            odds = math.log((inside + PRIOR * share) / (outside + PRIOR * (1 - share)))
            limit = PLACE_LIMIT if feature == "place" else LIMIT
            out[feature, name] = max(-limit, min(limit, odds))
    # a mark weighs as much as all else together, however few pages are labelled
    out["place", "in"], out["place", "out"] = max(out["place", "in"], 2.5 * LIMIT), min(out["place", "out"], -2.5 * LIMIT)
    out["place", "open"] = 0.0
    return out


def score(item: Item, place: str, weights: Weights, blocks: bool = True) -> float:
    name = item.name if item.name in _NAMES else "other"
    if item.kind == "tag":
        return min(-TAG_COST, weights["tag", name] + weights["place", place]) if not item.out else -TAG_COST
    if item.out or not item.words:
        return 0.0
    word = weights["place", place] + weights["link", "link" if item.link else "text"] + (weights["block", name] if blocks else 0.0)
    return item.words * word


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous stretch with the greatest positive sum, the first and shortest of equal ones; (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, region = total, (start, k + 1)
    return region


def main_text(page: str, weights: Weights) -> str:
    """The main text of a page."""
    items = read(page)
    level = level_of(items)
    places = [place_of(i, level) for i in items]
    region = best_region([score(i, p, weights) for i, p in zip(items, places, strict=True)])
    if region == (0, 0):
        region = best_region([score(i, p, weights, blocks=False) for i, p in zip(items, places, strict=True)])
    if region == (0, 0):
        return ""
    first, last = items[region[0]].block, items[region[1] - 1].block
    held: dict[int, list[str]] = {}
    for i, p in zip(items, places, strict=True):
        if first <= i.block <= last and not i.out and p != "out":
            # a line break is white space
            held.setdefault(i.block, []).append(i.text if i.kind == "text" else " " if i.name == "br" else "")
    blocks = (" ".join("".join(pieces).split()) for pieces in held.values())
    return "\n".join(b for b in blocks if b)


def labelled(items: list[Item]) -> bool:
    """Whether the page has one <article> that is no boilerplate."""
    return sum(i.kind == "tag" and i.name == "article" and i.mark == "element" and not i.out for i in items) == 1


def fit(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights from all pages with one <article>."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for raw in byte_rows(batch.column("t")):
                items = read(raw.decode())
                if labelled(items):
                    held.update(features(items))
        rows = [(f, n, x, c) for (f, n, x), c in held.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["feature", "name", "inside", "n"])

    marked = pages.select(F.col(f"`{html_col}`").alias("t")).where(F.col("t").rlike("<[aA][rR][tT][iI][cC][lL][eE]"))
    sums = marked.mapInArrow(run, "feature string, name string, inside boolean, n bigint").groupBy("feature", "name", "inside").agg(F.sum("n").alias("n"))
    return weights_of({(r["feature"], r["name"], r["inside"]): r["n"] for r in sums.collect()})


def extract(pages: DataFrame, html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """pages plus main_text; weights are fitted to pages unless given."""
    ship(pages.sparkSession)
    weights = weights or fit(pages, html_col)
    kept = [c for c in pages.columns if c != "main_text"]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{html_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(raw.decode(), weights) for raw in byte_rows(batch.column("t"))]
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], names=["row", "main_text"])

    out = rows.mapInArrow(run, with_row(rows, "main_text string"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "main_text")
