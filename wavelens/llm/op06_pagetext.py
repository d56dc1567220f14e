"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text; every block has the path of block tags (with
their ids and classes) from the root. Per path the mean text length and the mean number
of punctuation marks of its blocks are taken; both run through a Gaussian
smoothing over the page's blocks, each relative to the page's mean, and are fused
by their geometric mean. Paths whose fused value reaches ``threshold`` times the
page's mean (weighted by text) hold content. So a one-word paragraph counts with
its long siblings, a long link list does not.

What is known not to be article text is left out before: navigation, page headers
and footers, asides, forms, scripts, styles, and elements whose class, id or role
names a menu, sidebar, notice, advert, share bar or reader comments. A class that only
modifies its element (has-sidebar, no-header, category-legal), inside an article (and for
paragraphs and headings) a class with a word that does not go with the name (social-issues), and
the header of an article name nothing, and an element that holds the page's article, or most of its prose by
the tag paths, is never left out by its name. Around the content blocks the smallest enclosing element below ``body`` completes the
article (its headings and short blocks).

Blocks: character references decoded, white space to one blank, trimmed, joined in
page order by line feeds. Open and missing end tags are taken as browsers do
for paragraphs and list items. Pages are read one at a time in Arrow batches; no
shuffle. Null or empty html, or a page without content: empty text, 0
characters. Repeated rows and null ids give a row each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: elements by their role in a page
BLOCK = frozenset("""html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr
td th caption blockquote pre figure figcaption address details summary center hgroup header footer nav aside form
fieldset menu dialog""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select xmp".split())
SKIP = frozenset("head nav footer aside form menu dialog button fieldset noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: a block start closes an open one of these
CLOSES = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th"}
BOILER = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menus?|breadcrumbs?|sidebars?|footers?|"
    r"headers?|masthead|cookies?|consent|notices?|alerts?|gdpr|popups?|modal|overlay|newsletter|subscribe\w*|"
    r"signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|replies|respond|widgets?|"
    r"pagination|pager|toolbar|copyright|legal|disclaimer")
#: before a word of a class: the element is not that thing, but has or lacks it or is about it
MODIFIERS = frozenset("has have no not non with without hide category tag".split())
#: before "header": the header of an article
ARTICLE = frozenset("article entry post story content".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: words beside a name in one class of an element that is that thing ("share-buttons"); any
#: other word makes the class speak of something else ("social-issues")
WITH_NAME = frozenset("""area bar block box button buttons container content fixed form global group icons inline inner item
items left link links list main page panel post posts primary right secondary section site slot stories sticky top bottom
text tools unit user wrap wrapper""".split())
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/><]*)|!--|!\[CDATA\[|[!?])")
_TAG_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
THRESHOLD = 0.4
_PUNCT = re.compile(r"[.,;:!?。、，！？；：…]")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)[\s©]*(?:\(c\)\s*)?(?:19|20)\d\d", re.I)


@dataclass
class Page:
    """Text blocks in page order and the elements around them. Element 0 is the root; a
    parent's number is below its children's."""
    texts: list[str]
    at: list[int]              # each block's innermost element
    parent: list[int]
    tags: list[str]
    path: list[int]            # number of each element's path of tags, ids and classes
    skip: list[bool]           # no article text by what the element is
    named: list[bool]          # has the name of something beside the article
    articles: list[bool]

    def under(self, chosen: list[bool]) -> list[bool]:
        """Which elements are chosen or lie in a chosen one."""
        out = list(chosen)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def totals(self, of_blocks: dict[int, float]) -> list[float]:
        """Sum over the blocks within each element."""
        out = [0.0] * len(self.parent)
        for i, x in of_blocks.items():
            out[self.at[i]] += x
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def names_boiler(value: str, in_article: bool, whole: bool) -> bool:
    """Whether a class or id names something beside the article. ``whole``: the words beside
    the name must go with it."""
    for token in value.lower().split():
        before, named, alone = "", False, True
        for word in re.split(r"[^a-z]+", token):
            if BOILER.fullmatch(word) and before not in MODIFIERS and not (
                    word in ("header", "headers") and (in_article or before in ARTICLE)):
                named = True
            elif word and word not in WITH_NAME:
                alone = False
            before = word
        if named and (alone or not whole):
            return True
    return False


def read_page(page: str) -> Page:
    """Blocks and elements of a page. Every character is looked at a bounded number of times,
    also in malformed pages: a tag that never closes is text, a quote that never closes is
    a letter, and after a page's first tag whose quotes hide its end quotes count no more."""
    out = Page([], [], [-1], [""], [0], [False], [False], [False])
    inside = [False]                                     # in an article, by element
    paths: dict[tuple[int, str], int] = {}
    stack, opened = [0], Counter()
    parts: list[str] = []
    last = {c: page.rfind(c) for c in ">\"'"}
    quotes, buttons = True, True

    def flush():
        text = "".join(parts)
        parts.clear()
        if "&" in text:
            text = unescape(text)
        text = " ".join(text.split())
        if text:
            out.texts.append(text)
            out.at.append(stack[-1])

    def close(depth: int):
        opened.subtract(out.tags[e] for e in stack[depth:])
        del stack[depth:]

    def tag_end(at: int) -> int:
        nonlocal quotes
        pos = at
        while quotes:
            m = _TAG_STOP.search(page, pos)
            if m is None:
                quotes = False
            elif m.group() == ">":
                return m.end()
            else:
                pos = page.find(m.group(), m.end()) + 1 if m.start() < last[m.group()] else m.end()
        return page.find(">", at) + 1

    def after(tag: str, at: int) -> int:
        """Place behind the end tag of ``tag``, -1 if there is none."""
        m = re.compile(rf"</{tag}\b", re.I).search(page, at)
        return -1 if m is None else page.find(">", m.end()) + 1 or len(page)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at:m.start()])
        tag = m.group(2)
        if tag is None:                                  # comment, CDATA, declaration
            stop = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m.group(), ">")
            got = page.find(stop, m.end())
            at = end if got < 0 else got + len(stop)
            continue
        if m.end() > last[">"]:                          # no tag closes from here on
            parts.append(m.group())
            at = m.end()
            continue
        at = tag_end(m.end())
        attrs, tag = page[m.end():at - 1], tag.lower()
        if m.group(1):                                   # end tag
            if tag in BLOCK or tag == "head":
                flush()
                if opened[tag] > 0:
                    depth = len(stack) - 1
                    while out.tags[stack[depth]] != tag:
                        depth -= 1
                    close(depth)
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                at = after(tag, at)
                at = end if at < 0 else at
            continue
        if tag in ("br", "hr"):
            flush()
            continue
        if tag in VOID or (tag not in BLOCK and tag not in ("head", "button")):
            continue
        flush()
        if tag == "button":
            got = after(tag, at) if buttons else -1
            buttons = got >= 0
            at = got if buttons else at
            continue
        # what this start tag ends by itself
        closes = CLOSES.get(tag, "").split()
        for d in range(len(stack) - 1, 0, -1):
            over = out.tags[stack[d]]
            if over in closes or over == "p" or over in HEADINGS and tag in HEADINGS:
                close(d)
            elif over not in ("p", *HEADINGS):
                break
        if tag == "body" and opened["head"] > 0:
            stack[:] = [e for e in stack if out.tags[e] != "head"]
            opened["head"] = 0
        step, named, up = tag, [], stack[-1]
        for a in _ATTR.finditer(attrs):
            value = a.group(2) or a.group(3) or a.group(4) or ""
            kind = a.group(1).lower()
            named.append(("nav" if value.lower() in _ROLES else "") if kind == "role" else value)
            if kind == "class" and value:
                step += "." + ".".join(sorted(value.lower().split())[:3])
            elif kind == "id" and value:
                step += "#" + value
        main, number = tag in ("article", "main"), len(out.tags)
        skip = out.skip[up] or tag in SKIP or (tag == "header" and not inside[up])
        whole = inside[up] or tag in ("p", "pre", "blockquote", *HEADINGS)
        if attrs.endswith("/"):
            continue
        stack.append(number)
        opened[tag] += 1
        inside.append(inside[up] or main)
        out.parent.append(up)
        out.tags.append(tag)
        out.path.append(paths.setdefault((out.path[up], step), len(paths) + 1))
        out.skip.append(skip)
        out.articles.append(main)
        out.named.append(not (skip or main or tag in ("html", "body"))
                         and any(names_boiler(v, inside[up], whole) for v in named))
    flush()
    return out


def live_blocks(page: Page) -> list[int]:
    """Blocks that may be article text: without those that are something else by element, or
    lie in elements named as something else. Such an element stays if it is around the page's
    articles (if none is outside such elements) or holds most of their prose, or of the
    page's if it has no article. A line of rights outside articles goes, too."""
    inside = page.under(page.articles)
    live = [i for i, e in enumerate(page.at) if not page.skip[e] and (inside[e] or not _RIGHTS.match(page.texts[i]))]
    if not any(page.named):
        return live
    innermost, over = [-1] * len(page.parent), [False] * len(page.parent)     # article of an element; a name above it
    below_name = page.under(page.named)
    for e in range(1, len(page.parent)):
        innermost[e] = e if page.articles[e] else innermost[page.parent[e]]
        over[e] = below_name[page.parent[e]] if page.articles[e] else over[page.parent[e]]
    within = [i for i in live if inside[page.at[i]]]
    outside = [i for i in within if not over[page.at[i]]]
    around: set[int] = set()
    if any(page.tags[page.at[i]] not in HEADINGS for i in outside):
        judged = outside
    else:
        judged = within or live
        for i in within:
            e = innermost[page.at[i]]
            while e > 0 and e not in around:
                around.add(e)
                e = page.parent[e]
    if not judged:
        return live
    value, length = _path_values(page, judged)
    prose = length * (value >= THRESHOLD * np.average(value, weights=length))
    held = page.totals(dict(zip(judged, prose.tolist())))
    left = page.under([n and e not in around and held[e] <= prose.sum() / 2 for e, n in enumerate(page.named)])
    return [i for i in live if not left[page.at[i]]]


def _smooth(x: np.ndarray, radius: int, sigma: float) -> np.ndarray:
    """Gaussian means over neighbours; the ends use the neighbours there are."""
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(x, w)[radius:-radius] / np.convolve(np.ones(len(x)), w)[radius:-radius]


def _path_values(page: Page, live: list[int], radius: int = 1, sigma: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """Fused value of every block's path, and the blocks' text lengths."""
    _, of = np.unique([page.path[page.at[i]] for i in live], return_inverse=True)
    length = np.array([len(page.texts[i]) for i in live], float)
    punct = np.array([len(_PUNCT.findall(page.texts[i])) for i in live], float) + 0.5
    n = np.bincount(of)
    values = []
    for x in (length, punct):
        ratio = (np.bincount(of, weights=x) / n)[of]
        if len(live) > 2 * radius:
            ratio = _smooth(ratio, radius, sigma)
        values.append(ratio / np.average(ratio, weights=length))
    fused = np.sqrt(values[0] * values[1])
    return (np.bincount(of, weights=fused) / n)[of], length


def content(page: Page, threshold: float = THRESHOLD, radius: int = 1, sigma: float = 0.6) -> list[int]:
    """The article's blocks in order."""
    live = live_blocks(page)
    if not live:
        return []
    value, length = _path_values(page, live, radius, sigma)
    keep = {live[k] for k in np.flatnonzero(value >= threshold * np.average(value, weights=length))}
    # complete the article: the smallest element below body around the content
    held = page.totals(dict.fromkeys(keep, 1.0))
    common = max(e for e, n in enumerate(held) if n == len(keep))
    tag, up = page.tags[common], max(page.parent[common], 0)
    if tag in ("p", "pre", *HEADINGS) and page.tags[up] not in ("", "html", "body"):
        common = up
    elif tag in ("", "html", "body", "p", "li", "pre", *HEADINGS):
        return sorted(keep)
    around = page.under([e == common for e in range(len(held))])
    return [i for i in live if i in keep or around[page.at[i]]]


def main_text(html: str) -> str:
    page = read_page(html)
    return "\n".join(page.texts[i] for i in content(page))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py() or "") for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select("page_id", "url", F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
