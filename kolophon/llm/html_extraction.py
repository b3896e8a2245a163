"""Main text of web pages by tag-path ratios.

A page is read once into its text blocks, each under a root-to-leaf path of block tags with
their classes. What the markup itself says is no text of the article, by tag, role or as
hidden, is left out. For each path the lengths and the punctuation of its blocks are
aggregated and put in proportion to the number of blocks; the two ratios are fused to a score
and smoothed over the blocks in page order. Words of class and id that speak of another purpose
lower a path's score, some more than others, unless their element is a wrapper that holds most
of the page's text. Paths whose mean score reaches a threshold are content.

The element that holds nearly all text of content paths is the article. An element in it whose
words speak against it stays if the paths that its text is on are content on the whole; the
others stay, as headings and short items belong to an article. Where no element within the body is the article, lists of links
are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolophon.llm.kernels import slices

#: What is left of the score of a path with words that may, or that surely do, tell of another purpose.
DOUBTFUL, UNLIKELY = 0.6, 0.1
#: Part of the mean score that a content path reaches; part of content that the article holds.
THRESHOLD, HOLDS = 0.4, 0.75
#: A wrapper holds HOLDS of a page's text, and sentences outside come to at most this part of that.
OUTSIDE = 0.05
#: Weights of a block and its neighbours in the smoothing.
KERNEL = (0.25, 0.5, 0.25)
#: Part of a path's text in links from which it is a list of links; fewest links of one.
LINKED, LINKS = 0.8, 3

# Tags by what they do to the text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
OTHER_TAGS = {"nav", "header", "footer", "aside", "form", "head", "noscript", "template", "button", "select", "option", "dialog", "menu", "svg", "math", "object", "audio", "video", "canvas", "fieldset", "legend", "datalist"}
OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
UNLIKELY_WORDS = {
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "masthead", "topbar", "footer", "sidebar",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "comment", "comments", "commentlist",
    "disqus", "respond", "replies", "reply", "share", "sharing", "social", "related", "recommended",
    "subscribe", "subscription", "newsletter", "signup", "login", "signin", "toolbar", "pagination", "pager", "paywall", "skip",
}
DOUBTFUL_WORDS = {
    "aside", "header", "notice", "notices", "alert", "discussion", "follow", "trending", "popular", "search", "form", "widget", "copyright", "legal", "disclaimer",
}
#: Tags that close an open one of the same kind, up to the nearest of the second set.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "pre", "section", "table", "ul"}
_SCOPE = {"ul", "ol", "dl", "table", "article", "section", "main", "body", "html", "aside", "blockquote", "div"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?…、。，！？،؟।]")
_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}


def _purpose(tag: str, attrs: str, inside: bool) -> tuple[float, str]:
    """What an element leaves of a score, 0 if the markup rules it out; and its classes without digits.

    ``inside``: the element is in an article, whose header may hold the headline.
    """
    if tag in OTHER_TAGS and tag != "form" and not (tag == "header" and inside):
        return 0.0, ""
    left, classes = DOUBTFUL if tag == "form" else 1.0, ""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return left, classes
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 0.0, ""
        if name == "role" and value.lower() in OTHER_ROLES:
            return 0.0, ""
        if name in ("class", "id"):
            found = [w.lower() for w in _SPLIT.split(value) if w]
            words = set(found)
            if name == "class":
                classes = "." + "-".join(found)
            if tag in ("html", "body", "main"):
                continue
            if inside and tag == "header":
                words.discard("header")
            if tag == "article":
                words &= {"comment", "comments", "reply", "ad", "advert", "advertisement", "sponsored", "promo", "related"}
            if words & UNLIKELY_WORDS:
                left = UNLIKELY
            elif words & DOUBTFUL_WORDS:
                left = min(left, DOUBTFUL)
    return left, classes


def _end_of(tag: str, page: str, pos: int) -> int | None:
    """Where the element ends whose start tag ends at ``pos``, others of its name within it included."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I).finditer(page, pos):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return None


class _Element:
    __slots__ = ("tag", "parent", "path", "other", "inside", "score", "left")

    def __init__(self, tag: str, parent: _Element | None, left: float = 1.0, classes: str = ""):
        self.tag, self.parent, self.score, self.left = tag, parent, 0.0, left
        self.other: bool = not left or parent is not None and parent.other
        self.path: str = f"{parent.path}/{tag}{classes}" if parent else tag
        self.inside: bool = tag in ("article", "main") or parent is not None and parent.inside


class _Block:
    __slots__ = ("element", "text", "linked", "links")

    def __init__(self, element: _Element, text: str, linked: int, links: int):
        self.element, self.text, self.linked, self.links = element, text, linked, links


def blocks_of(page: str) -> list[_Block]:
    """The blocks of a page that the markup does not rule out, in page order."""
    root = at = _Element("", None)
    found: list[_Block] = []
    parts: list[str] = []
    linked = links = in_link = 0

    def end_block() -> None:
        nonlocal linked, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(_Block(at, text, min(linked, len(text)), links))
            parts.clear()
        linked, links = 0, 0

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        if m is None:
            if not at.other:
                parts.append(page[pos:])
            break
        if m.start() > pos and not at.other:
            parts.append(page[pos : m.start()])
            linked += (m.start() - pos) * (in_link > 0)
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            if tag == "a":
                in_link = 0
            if tag in INLINE or tag in VOID and tag != "br":
                continue
            x = at
            while x.parent is not None and x.tag != tag:
                x = x.parent
            if x.parent is not None:
                end_block()
                at = x.parent
            elif tag in ("p", "br"):
                end_block()
            continue
        if tag in RAW:
            end = _END[tag].search(page, pos)
            pos = end.end() if end else size
            continue
        if tag == "br" or tag == "hr":
            end_block()
            continue
        if tag in VOID:
            continue
        if tag in INLINE:
            if tag == "a" and not at.other:
                in_link, links = 1, links + 1
            if not at.other and _purpose(tag, m[3], at.inside)[0] <= UNLIKELY:
                # An inline element of another purpose is one for its own sake.
                pos = _end_of(tag, page, pos) or pos
                in_link = 0 if tag == "a" else in_link
            continue
        end_block()
        in_link = 0
        closes = CLOSES.get(tag, {"p"} if tag in _ENDS_P else ())
        x, to = at, None
        while x.parent is not None and closes:
            if x.tag in closes:
                to = x.parent
            elif x.tag in _SCOPE:
                break
            x = x.parent
        if to is not None:
            at = to
        at = _Element(tag, at, *_purpose(tag, m[3], at.inside))
        if m[3].endswith("/") and tag in ("svg", "math"):
            at = at.parent or root
    end_block()
    return found


def _sentences(blocks: list[_Block]) -> int:
    return sum(len(b.text) - b.linked for b in blocks if _PUNCT.search(b.text))


def _chain(element: _Element | None) -> Iterator[_Element]:
    while element is not None:
        yield element
        element = element.parent


def _wrappers(blocks: list[_Block]) -> set[int]:
    """Elements that hold most of the page's text, outer ones first, whatever their words.

    If text is in articles whose words do not speak against them, that is what counts.
    """
    held: dict[int, list[int]] = {}
    total = [0, 0]
    veils: list[set[int]] = []
    order: dict[int, int] = {}
    for b in blocks:
        own = [id(x) for x in _chain(b.element) if x.left < 1]
        article = any(x.left == 1 and x.tag in ("article", "main") for x in _chain(b.element))
        w = len(b.text) - b.linked
        weights = (w, w * article)
        veils.append(set(own))
        for at, n in [(total, 0), *((held.setdefault(x, [0, 0]), 0) for x in own)]:
            at[0], at[1] = at[0] + weights[0], at[1] + weights[1]
        for n in reversed(own):
            order.setdefault(n, len(order))
    kind, most = (1, 1.0) if total[1] else (0, OUTSIDE)
    found: set[int] = set()
    for n in order:
        if held[n][kind] > 0 and held[n][kind] >= HOLDS * total[kind]:
            outside = _sentences([b for b, own in zip(blocks, veils, strict=True) if own <= found])
            if outside <= most * held[n][kind]:
                found.add(n)
    return found


def path_scores(length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The fused score of paths with so much text, and so many punctuation marks, for each node."""
    return np.sqrt(np.maximum(length * (1 + marks), 0))


def main_text(page: str | None) -> str:
    """The blocks of the page's article, joined by ``\\n``."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    wrappers = _wrappers(blocks)
    left = np.array([min(x.left for x in _chain(b.element) if id(x) not in wrappers) for b in blocks])
    paths: dict[tuple, int] = {}
    path = np.array([paths.setdefault((b.element.path, x), len(paths)) for b, x in zip(blocks, left.tolist(), strict=True)])
    length = np.array([len(b.text) for b in blocks], float)
    marks = np.array([len(_PUNCT.findall(b.text)) for b in blocks], float)
    linked, links = np.array([b.linked for b in blocks], float), np.array([b.links for b in blocks], float)
    count = np.bincount(path)
    by_path = lambda x: np.bincount(path, weights=x)
    # The ratios of text, and of punctuation, to nodes of a path, fused; links count against it.
    share = by_path(linked) / by_path(length)
    score = path_scores(by_path(length - linked) / count, by_path(marks) / count)[path]
    padded = np.pad(score, 1, mode="edge")
    smooth = sum(k * padded[i : i + len(score)] for i, k in enumerate(KERNEL))
    smooth = np.minimum(smooth, 2 * score) * left  # a neighbour lifts no path by more than twice
    mean = by_path(smooth) / count
    # What content is like is told by blocks that no word speaks against, if any has a sentence.
    like = next((x for x in ((left == 1) & (marks > 0), left > UNLIKELY) if x.any()), None)
    least = THRESHOLD * np.average(smooth[like], weights=length[like]) if like is not None else np.inf
    content = mean >= least
    # An element whose words speak against it is content if its text is on the whole, by the paths it is on.
    sums: dict[int, list[float]] = {}
    for b, x, n, m in zip(blocks, left.tolist(), length.tolist(), mean[path].tolist(), strict=True):
        for e in _chain(b.element):
            if e.left < 1 and id(e) not in wrappers and x >= e.left:
                at = sums.setdefault(id(e), [0.0, 0.0])
                at[0], at[1] = at[0] + n, at[1] + n * m
    against = {e for e, (n, m) in sums.items() if m < least * n}
    weight = np.where(content[path], (length - linked) * left, 0.0)
    if not weight.any():
        weight = length

    # From the root down, as long as one element holds nearly all content.
    total = weight.sum()
    for b, w in zip(blocks, weight.tolist(), strict=True):
        x: _Element | None = b.element
        while x is not None:
            x.score += w
            x = x.parent
    chain: set[int] = set()
    article = max(blocks, key=lambda b: b.element.score if b.element.score >= HOLDS * total else -1.0).element
    best = None
    for b in blocks:
        x = b.element
        depth = x.path.count("/")
        while x is not None:
            if x.score >= HOLDS * total and x.tag not in ("p", "li", "h1", "h2", "h3", "pre", "blockquote") and (best is None or depth > best[0]):
                best = (depth, x)
            x, depth = x.parent, depth - 1
    article = best[1] if best else article
    named = article
    while named is not None and named.tag not in ("article", "main"):
        named = named.parent
    if named is not None:
        article = named  # a part of an article is not cut from it
    chain.add(id(article))

    # Only where no element is singled out are lists of links told by themselves; an article's own are its text.
    lists = (share >= LINKED) & (by_path(links) >= LINKS) & (article.tag in ("", "html", "body"))
    kept = []
    for b, p in zip(blocks, path.tolist(), strict=True):
        x = b.element
        while x is not None and id(x) not in chain:
            x = x.parent
        if x is not None and not lists[p] and not any(id(e) in against for e in _chain(b.element)):
            kept.append(b.text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page.

    ``pages`` has ``page_id``, ``url`` and ``html``; other columns are ignored. Returns a row per
    row: page_id, url, text, n_chars (code points of text). A null or empty page has empty text,
    as has one without text outside menus and the like. Character references are decoded, white
    space within a block is one space, blocks are joined by ``\\n``. Null ids and repeated
    rows stay as they are; an empty table gives an empty result. No page needs another, so
    there is no shuffle.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = rows.select("page_id", "url").withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = pa.array([main_text(x) for x in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
