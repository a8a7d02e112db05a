"""Main-text extraction from HTML by tag-path ratios.

A page is read into a light tree. Its text nodes are aggregated by their root-to-leaf tag path: characters per node and
punctuation marks per node. Both ratios are smoothed over the nodes in page order, fused as a product, and averaged by
path; paths that reach ``SHARE`` of the mean score of a character are content paths, and the characters on them are an
element's content mass. The mass then decides:

* elements that by tag, role or class are not an article (menus, headers, footers, sidebars, notices, adverts, forms,
  reader comments) are left out, but a form or an element marked by its class that holds most of the mass is spared;
* ``article`` and ``main`` elements that hold most of the mass are the region, one of them if it holds most of theirs;
  on other pages it is the smallest element that holds all content paths, with the heading right before it;
* in the region, nodes on content paths are content, and so is what stands among them, but for blocks of links on other
  paths. Where the region is the whole body, only what shares a parent with content is.

Reading takes time in proportion to the page, however deep its elements are. Defined cases: null or empty html gives an
empty text; markup that doesn't close is closed where HTML would; an unterminated tag, comment or script runs to the end
of the page, as in browsers; equal pages give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.llm.common import slices, texts_of

SCHEMA = "page_id long, url string, text string, n_chars long"
SHARE, MOST, LINKED = 0.1, 0.5, 0.5

# fixed values: HTML's element groups
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe template svg noframes xmp canvas audio video textarea".split())
OUT = set("nav footer aside form button select dialog menu head label fieldset option".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
MARKS = set("ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsors sponsored promo promos promotion nav navbar navigation menu menus sidebar sidebars breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond discussion widget widgets toolbar pagination pager skip copyright disclaimer".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPES = set("article section div main aside nav header footer td th table li ul ol form body html blockquote dd figure details".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]+|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MARK = re.compile(r"[a-z]+")
_NONE = re.compile(r"display\s*:\s*none")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
REGIONS = {"article", "main"}


class Node:
    """An element: its tag, parent, place in the page, tag path, reason to be left out, and what it stands in."""

    __slots__ = ("tag", "parent", "place", "path", "out", "inside", "heading", "link")

    def __init__(self, tag: str, parent: Node | None, place: int = 0, path: int = 0, out: str = ""):
        self.tag, self.parent, self.place, self.path, self.out = tag, parent, place, path, out
        self.inside = bool(parent) and (parent.inside or parent.tag in REGIONS)
        self.heading = tag in HEADINGS or bool(parent) and parent.heading
        self.link = tag == "a" or bool(parent) and parent.link


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _reason(tag: str, given: dict[str, str]) -> str:
    """Why an element isn't the article's: "tag" for certain, "form", "mark" by its class or id, "header" or "title" if only its headings are."""
    if tag != "form" and (tag in OUT or given.get("role", "").lower() in ROLES) or "hidden" in given or given.get("aria-hidden") == "true" or _NONE.search(given.get("style", "")):
        return "tag"
    if tag in ("form", "header"):
        return tag
    names = set(_MARK.findall(f"{given.get('class', '')} {given.get('id', '')}".lower()))
    if tag not in ("html", "body", "article", "main") and names & MARKS:
        return "title" if names & MARKS == {"header"} else "mark"
    return ""


class Page:
    """The elements of a page in page order, and its text nodes as (element, text, block number)."""

    def __init__(self, page: str):
        self.nodes, self.texts = [Node("#", None)], []
        self.paths: dict[tuple[int, str], int] = {}
        self.page, self.at, self.block = page, self.nodes[0], 0
        self.open: dict[str, int] = {}
        place, found = 0, _TOKEN.search(page)
        while found:
            self._text(place, found.start())
            place = found.end()
            if found[2]:
                tag, closed = found[2].lower(), found[3].rstrip().endswith("/")
                if found[1]:
                    self._end(tag)
                elif tag in RAW:
                    if not closed:
                        end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, place)
                        place = end.end() if end else len(page)
                elif tag == "br":
                    self.texts.append((self.at, " ", self.block))
                else:
                    self._start(tag, found[3], closed)
            found = _TOKEN.search(page, place)
        self._text(place, len(page))

    def _text(self, low: int, high: int) -> None:
        if high > low and (own := html.unescape(self.page[low:high])):
            self.texts.append((self.at, own, self.block))

    def _leave(self, upto: Node) -> None:
        """Close elements until ``upto`` is the innermost open one."""
        while self.at is not upto:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def _end(self, tag: str) -> None:
        self.block += tag in BLOCKS
        walk = self.at if self.open.get(tag) else self.nodes[0]
        while walk.parent and walk.tag != tag:
            if tag not in BLOCKS and walk.tag in BLOCKS or tag == "p" and walk.tag in SCOPES:
                return
            walk = walk.parent
        if walk.parent:
            self._leave(walk.parent)

    def _close(self, ends: set[str], scope: set[str]) -> None:
        """Close the outermost open element of ``ends`` below the next one of ``scope``."""
        left, walk, upto = sum(self.open.get(t, 0) for t in ends), self.at, self.at
        while left and walk.parent and walk.tag not in scope:
            if walk.tag in ends:
                upto = walk.parent
                left -= 1
            walk = walk.parent
        self._leave(upto)

    def _start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in BLOCKS:
            self.block += 1
            self._close({"p"} | HEADINGS if tag in HEADINGS else {"p"}, SCOPES)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in VOID or closed and tag not in BLOCKS:
            return
        given = _attributes(attributes)
        reason = _reason(tag, given)
        kind = "." + ".".join(sorted(given["class"].lower().split())) if given.get("class") else ""
        if given.get("role", "").lower() == "main" or given.get("itemprop") == "articleBody":
            tag = "main"
        path = self.paths.setdefault((self.at.path, tag + kind), len(self.paths) + 1)
        self.at = Node(tag, self.at, len(self.nodes), path, reason)
        self.nodes.append(self.at)
        self.open[tag] = self.open.get(tag, 0) + 1


def path_scores(texts: list[tuple[Node, str, int]], width: int = 1) -> np.ndarray:
    """The score of each text node's tag path: characters and punctuation per node of the path, smoothed in page order, fused, averaged by path."""
    of = np.unique([n.path for n, _, _ in texts], return_inverse=True)[1]
    count = np.bincount(of)
    mean = lambda values: (np.bincount(of, values) / count)[of]
    kernel = np.exp(-0.5 * np.arange(-width, width + 1) ** 2)
    smooth = lambda x: np.convolve(x, kernel / kernel.sum(), "full")[width : width + len(x)]
    length, marks = mean([len(t.strip()) for _, t, _ in texts]), mean([len(_PUNCTUATION.findall(t)) for _, t, _ in texts])
    return mean(smooth(length) * (1 + smooth(marks)))


def _mass(page: Page, texts: list[tuple[Node, str, int]], values: np.ndarray) -> np.ndarray:
    """The sum of the text nodes' values in every element."""
    total = np.zeros(len(page.nodes))
    np.add.at(total, [n.place for n, _, _ in texts], values)
    total = total.tolist()
    for n in reversed(page.nodes[1:]):
        total[n.parent.place] += total[n.place]
    return np.array(total)


def _left_out(page: Page, mass: np.ndarray) -> tuple[list[bool], list[bool]]:
    """By element: whether it is left out, and whether but for its headings; of a page with an article none beside it is spared."""
    regions = np.zeros(len(page.nodes))
    regions[[n.place for n in page.nodes if n.tag in REGIONS and not n.inside and mass[n.place] > 0]] = 1
    held = regions.tolist()
    for n in reversed(page.nodes[1:]):
        held[n.parent.place] += held[n.place]
    out, soft = [False], [False]
    for n in page.nodes[1:]:
        spared = n.out in ("mark", "form", "title") and mass[n.place] > MOST * mass[0] and (not held[0] or held[n.place] > 0 or n.inside)
        kept_heading = n.out in ("header", "title") and n.inside
        out.append(out[n.parent.place] or bool(n.out) and not spared and not kept_heading)
        soft.append(soft[n.parent.place] or kept_heading and not spared)
    return out, soft


def _within(page: Page, roots: set[int]) -> np.ndarray:
    """By element: whether it is one of roots or stands in one."""
    held = np.zeros(len(page.nodes), bool)
    for n in page.nodes:
        held[n.place] = n.place in roots or bool(n.parent) and held[n.parent.place]
    return held


def extract(page: str | None) -> str:
    """The article's blocks, joined by two newlines."""
    tree = Page(page or "")
    texts = tree.texts
    if not any(t.strip() for _, t, _ in texts):
        return ""
    sizes = np.array([len(t.strip()) for _, t, _ in texts], float)
    scores = path_scores(texts)
    certain = np.array([n.out == "tag" for n in tree.nodes])
    for n in tree.nodes[1:]:
        certain[n.place] |= certain[n.parent.place]
    free = ~certain[[n.place for n, _, _ in texts]]
    if not (free & (sizes > 0)).any():
        return ""
    content = lambda some: np.where(some & (scores >= SHARE * np.average(scores[some], weights=sizes[some])), sizes, 0.0)
    out, soft = _left_out(tree, _mass(tree, texts, content(free)))
    free = np.array([not out[n.place] and not (soft[n.place] and not n.heading) for n, _, _ in texts])
    if not (free & (sizes > 0)).any():
        return ""
    solid = content(free)
    place, block = np.array([n.place for n, _, _ in texts]), np.unique([b for _, _, b in texts], return_inverse=True)[1]
    linked = np.bincount(block, sizes * [n.link for n, _, _ in texts]) > LINKED * np.bincount(block, sizes)
    solid[linked[block]] *= np.array([not n.link for n, _, _ in texts])[linked[block]]
    if not solid.any():
        solid = np.where(free, sizes, 0.0)
    mass = _mass(tree, texts, solid)

    regions = [n for n in tree.nodes if n.tag in REGIONS and mass[n.place] > 0]
    top = [n for n in regions if not n.inside]
    kept = sum(mass[n.place] for n in top)
    if kept > MOST * mass[0]:
        best = max(top, key=lambda n: mass[n.place])
        if mass[best.place] >= 0.6 * kept:
            below = _within(tree, {best.place})
            inner = max((n for n in regions if n.inside and n.tag == "article" and below[n.place]), key=lambda n: mass[n.place], default=None)
            top = [inner] if inner and mass[inner.place] >= 0.6 * mass[best.place] else [best]
        chosen = free & _within(tree, {n.place for n in top})[place] & (~linked[block] | (solid > 0))
        return _joined(texts, chosen)

    root = max((n for n in tree.nodes if mass[n.place] >= mass[0]), key=lambda n: n.place)  # all content is in it, so these are one line
    good = np.zeros(block.max() + 1, bool)
    good[block[solid > 0]] = True
    if root.tag in ("#", "html", "body"):
        holders = {tree.nodes[p].parent.place if tree.nodes[p].parent else 0 for p in place[solid > 0]} | {p for p in place[solid > 0].tolist() if tree.nodes[p].tag not in HEADINGS | {"p"}}
        beside = np.array([n.parent is None or n.parent.place in holders or n.place in holders for n, _, _ in texts])
    else:
        beside = _within(tree, {root.place})[place]
    chosen = free & (good[block] | beside & ~linked[block])
    first = int(np.flatnonzero(chosen & (sizes > 0))[0])
    for i in range(first - 1, -1, -1):  # the heading right before the region
        if free[i] and sizes[i]:
            if texts[i][0].heading:
                chosen |= free & (block == block[i])
            break
    return _joined(texts, chosen)


def _joined(texts: list[tuple[Node, str, int]], chosen: np.ndarray) -> str:
    out: dict[int, list[str]] = {}
    for (_, t, b), c in zip(texts, chosen.tolist()):
        if c:
            out.setdefault(b, []).append(t)
    return "\n\n".join(x for own in out.values() if (x := " ".join("".join(own).split())))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text of the whole html and its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [extract(t) for t in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, SCHEMA)
