"""Main text of web pages by tag-path ratios.

Each text node has the path of tags from the root to it.  Per path, text length and
punctuation are summed and divided by its nodes; the two ratios are smoothed with
those of sibling paths, fused to one score, lowered where a name on the path speaks of
things around an article, and compared with a threshold.  Nodes on paths above it are
content and choose the elements that hold most of the scored mass: the articles
together, else the deepest block.  Inside, a block stays if its path's score and those
of the content next to it reach the threshold together, so headings and short blocks
stay and what merely stands there does not.  Menus, footers, adverts, comments and
forms score nothing, except a form that holds most of the page's mass.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>"
    r"|[^<]+|<",
    re.S | re.I,
)
_ENDED = re.compile(r"</[a-z]+\s*>\Z", re.I)
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？¿¡]")

# HTML's void elements, blocks, and names of page parts around an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
AROUND_TAGS = frozenset("nav footer aside head button select option menu dialog fieldset label input".split())


def _names(words: str) -> re.Pattern[str]:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)


# Names that leave no doubt, and names that an article's own parts may have, too.
AROUND = _names(
    "ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar"
    "|footer|masthead|topbar|toolbar|cookies?|consent|gdpr|notice|notices|newsletter|subscribe|subscription|comments?|commentlist|disqus"
    "|respond|login|signup|register|pagination|pager|complementary|contentinfo")
DOUBTFUL = _names(
    "aside|banner|header|notification|alert|popup|modal|overlay|share|sharing|social|related|recommended|reply|replies|discussion|search"
    "|widget|toc|tags|skip")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: deeper elements count as siblings, as in browsers
DEPTH = 512
#: share of the scored mass that articles, a block or a form must hold to be the content
MOST = 0.7
#: what a doubtful name leaves of a score
LOWERED = 0.35


@dataclass
class Element:
    tag: str
    path: int  # number of the tag path
    parent: Element | None
    serial: int  # in page order, so a parent's is smaller
    depth: int = 0
    around: bool = False
    form: bool = False
    factor: float = 1.0
    within: frozenset[str] = frozenset()


@dataclass
class Node:
    element: Element
    block: int
    text: str

    @property
    def path(self) -> int:
        return self.element.path


def text_nodes(page: str) -> tuple[list[Node], list[int]]:
    """The page's text nodes in order, each with its element and block, and each tag
    path's parent path; tags that are left open are closed where HTML closes them."""
    root = Element("", 0, None, 0)
    numbers: dict[tuple[int, str], int] = {}
    above = [0]
    stack, nodes, block, serial = [root], [], 0, 0
    last = page.rfind(">") + 1  # no tag ends behind it
    if last < len(page):
        tail = Node(root, 0, page[last:])
        page = page[:last]
    else:
        tail = None
    for m in _TOKEN.finditer(page):
        tag = (m["tag"] or "").lower()
        if tag:
            if m["close"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        block += tag in BLOCKS  # a stray end tag ends nothing
                        break
                continue
            block += tag in BLOCKS
            if tag == "br":
                nodes.append(Node(stack[-1], block, " "))
            if tag in VOID:
                continue
            if tag in BLOCKS:  # a block ends an open paragraph, an item its neighbour
                ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ()) + ("p",)
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ends:
                        del stack[k:]
                        break
                    if stack[k].tag in BLOCKS:
                        break
            attrs = m["attrs"] or ""
            names = " ".join(next(x for x in a.groups("") if x) for a in _NAMED.finditer(attrs) if any(a.groups(""))) if "=" in attrs else ""
            parent = stack[-1]
            told = names
            if names and (tag in HEADINGS or tag == "section"):  # their ids are anchors named after the topic
                told = " ".join(next(x for x in a.groups("") if x) for a in _NAMED.finditer(attrs) if any(a.groups("")) and a[0][:2].lower() != "id")
            outer = tag in ("html", "body", "article", "main")
            around = parent.around or tag in AROUND_TAGS or (not outer and bool(told) and bool(AROUND.search(told)))
            if tag == "header" and "article" not in parent.within:
                around = True
            doubtful = not outer and bool(told) and bool(DOUBTFUL.search(told))
            serial += 1
            if not attrs.rstrip().endswith("/") and len(stack) <= DEPTH:
                step = (parent.path, f"{tag}.{names}" if names else tag)
                path = numbers.setdefault(step, len(above))
                if path == len(above):
                    above.append(parent.path)
                stack.append(Element(
                    tag, path, parent, serial, parent.depth + 1, around, parent.form or tag == "form",
                    LOWERED if doubtful else parent.factor, parent.within if tag in parent.within else parent.within | {tag}))
        elif m[0][0] != "<" or m[0] == "<":
            nodes.append(Node(stack[-1], block, m[0]))
        elif not _ENDED.search(m[0]) if m["raw"] else m[0].startswith("<!--") and not m[0].endswith("-->"):
            tail = None  # the rest belongs to what is never closed
    if tail is not None:
        cut = re.search(r"<(?:[a-zA-Z/!?]|$)", tail.text)  # a tag that never ends
        nodes.append(Node(stack[-1], block, tail.text[:cut.start()] if cut else tail.text))
    for n in nodes:
        n.text = html.unescape(n.text) if "&" in n.text else n.text
    return nodes, above


def path_scores(nodes: list[Node], above: list[int]) -> dict[int, float]:
    """Fused ratio per path: length and punctuation per node, each smoothed with the
    mean of the paths under the same parent."""
    chars: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    count: dict[int, int] = defaultdict(int)
    for n in nodes:
        text = n.text.strip()
        if not text:
            continue
        chars[n.path] += len(text)
        marks[n.path] += len(_PUNCTUATION.findall(text))
        count[n.path] += 1
    family: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    for p in count:
        sums = family[above[p]]
        for k, total in enumerate((count, chars, marks)):
            sums[k] += total[p]

    def smooth(k: int, total: dict[int, int], p: int) -> float:
        near = family[above[p]]
        return 0.75 * total[p] / count[p] + 0.25 * near[k] / near[0]

    return {p: smooth(1, chars, p) * (1 + smooth(2, marks, p)) for p in count}


@dataclass
class Scored:
    """Scored text nodes, the score a path needs, and the mass above it under each element."""

    live: list[Node]
    scores: dict[int, float]
    limit: float
    holds: dict[int, float]
    elements: dict[int, Element]

    def value(self, n: Node) -> float:
        """The node's score in units of the limit, its name not counted."""
        return self.scores[n.path] / self.limit

    def content(self, n: Node) -> bool:
        return self.value(n) * n.element.factor >= 1


def scored(live: list[Node], above: list[int], threshold: float) -> Scored:
    """Scores of the nodes' paths; mass is summed per element and handed to its parent once."""
    scores = path_scores(live, above)
    weights = [(scores[n.path] * n.element.factor, len(n.text)) for n in live]
    limit = threshold * sum(s * w for s, w in weights) / sum(w for _, w in weights)
    out = Scored(live, scores, max(limit, 1e-9), defaultdict(float), {})
    for n, (score, length) in zip(live, weights):
        e: Element | None = n.element
        if out.content(n):
            out.holds[e.serial] += score * length
        while e is not None and e.serial not in out.elements:
            out.elements[e.serial] = e
            e = e.parent
    for serial in sorted(out.elements, reverse=True):
        e = out.elements[serial]
        if e.parent is not None:
            out.holds[e.parent.serial] += out.holds[serial]
    return out


def chosen_elements(page: Scored) -> set[int]:
    """The outermost articles (else main) if they hold most of the scored mass, else the deepest block that does."""
    total = page.holds[0]
    for tag in ("article", "main"):
        named = {s for s, e in page.elements.items() if e.tag == tag and tag not in e.parent.within and page.holds[s] > 0}
        if named:
            if sum(page.holds[s] for s in named) >= MOST * total:
                return named
            break
    most = max((s for s, e in page.elements.items() if page.holds[s] >= MOST * total and (e.tag in BLOCKS - {"p"} | {""} or e.tag in HEADINGS)),
               key=lambda s: (page.elements[s].depth, page.holds[s]))
    while page.elements[most].tag in HEADINGS or page.elements[most].tag in ("li", "td", "blockquote"):
        most = page.elements[most].parent.serial
    return {most}


def kept_blocks(page: Scored, chosen: set[int]) -> set[int]:
    """Blocks whose best score, with the mean score of the nearest content on either
    side inside the chosen elements, reaches the limit after its name's factor."""
    best: dict[int, tuple[float, float]] = {}  # own score, factor
    strong: dict[int, float] = {}
    for n in page.live:
        if n.element.serial not in chosen:
            continue
        value = page.value(n)
        best[n.block] = max(best.get(n.block, (0.0, 0.0)), (value, n.element.factor))
        if page.content(n):
            strong[n.block] = max(strong.get(n.block, 0.0), value)
    order, before, after = sorted(best), {}, {}
    for steps, near in ((order, before), (order[::-1], after)):
        last = None
        for b in steps:
            near[b] = last
            last = strong.get(b, last)
    kept = set()
    for b in order:
        sides = [x for x in (before[b], after[b]) if x is not None]
        own, factor = best[b]
        if b in strong or factor * (own + (sum(sides) / len(sides) if sides else 0.0)) >= 1:
            kept.add(b)
    return kept


def main_text(page: str | None, threshold: float = 0.5) -> str:
    """The content's blocks, white space inside each turned to one space, joined by
    line feeds; empty without any text.  ``threshold`` times the mean score, weighted
    by text, is what a path needs to count as content."""
    nodes, above = text_nodes(page or "")
    plain = [n for n in nodes if not n.element.around and n.text.strip()]
    live = [n for n in plain if not n.element.form]
    if len(live) < len(plain):  # a form round the content is no sign-up box
        whole = scored(plain, above, threshold)
        inside = sum(whole.holds[s] for s, e in whole.elements.items() if e.tag == "form" and "form" not in e.parent.within)
        if inside >= MOST * whole.holds[0]:
            live = plain
    if not live:
        return ""
    result = scored(live, above, threshold)
    inside_of = chosen_elements(result)
    for serial in sorted(result.elements):  # parents come first
        e = result.elements[serial]
        if e.parent is not None and e.parent.serial in inside_of:
            inside_of.add(serial)
    kept = kept_blocks(result, inside_of)
    forms = live is plain
    blocks: dict[int, list[str]] = defaultdict(list)
    for n in nodes:
        e = n.element
        if n.block not in kept or e.around or (e.form and not forms) or (e.serial in result.elements and e.serial not in inside_of):
            continue
        if "header" in e.within and not HEADINGS & e.within:
            continue
        blocks[n.block].append(n.text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every row with main_text and main_chars (its code points) added.

    Null and empty pages and pages without text outside menus and the like give the
    empty text.  Repeated rows are kept.
    """
    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        return column.map(main_text)

    return pages.withColumn("main_text", extract(F.col(html_col))).withColumn("main_chars", F.length("main_text").cast("long"))
