"""HTML extraction by tree scoring.

A tolerant parser builds the tree of a page without scripts, styles and comments; boilerplate elements are cut off: at
once by tag, role and hidden state, and by the words of class and id once the tree is known. A name of boilerplate
words alone (`sidebar`, `cookie-notice`) is cut unless it holds the article and most of the page's plain text; a mixed
name (`content-with-sidebar`, `entry-header`) is kept as well where it holds an article, most of the plain text, or a
heading inside the article. Every paragraph of some length then passes points, for itself, its commas and its length, to
its ancestors: all to the parent, half to the next, a third of that half and so on, as long as they count. A container's
points are discounted by its link density. The best container, widened to the article or main element around it, is kept
with those of its siblings that score close to it or are prose without links.

The kept elements are written as blocks in page order: character references decoded, white space inside a block turned
into one space, ends trimmed, blocks joined by one line end. Nothing in a kept element is dropped or capped.

Work is page by page, in memory bounded by a page and time in proportion to its length, whatever its depth; there is no
shuffle.

Defined results: null and empty html give an empty text; a page without a scored container gives its article, main or
body without boilerplate; text without markup is one block; unclosed and stray tags are repaired; very long and very
deep pages are read whole; null ids and repeated rows give a row each; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bucketloom.llm.common import pages

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+")

#: Elements of HTML by what they do to the tree or the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg canvas audio video select head".split())
#: Of these, the ones whose content is read as markup where no closing tag follows.
OPEN_RAW = frozenset(("head", "svg"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
DROPPED = frozenset("nav aside footer form button dialog menu input label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NEGATIVE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead banner ad ads adv advert adverts advertisement advertising sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended recommendations comment comments commentlist disqus respond reply replies widget widgets pagination pager toolbar skip".split()
)
NEUTRAL = frozenset("has with no without is not".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
SAFE = frozenset(("html", "body", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "hgroup"))
PARAGRAPHS = frozenset(("p", "pre", "td", "blockquote", "li", "dd"))
START_POINTS = {"article": 20.0, "main": 15.0, "section": 3.0, "div": 3.0, "td": 2.0, "blockquote": 2.0, "form": -3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "th": -5.0}
LEAST_CHARS = 25
SIBLING_SHARE = 0.2


#: What stands below this share of a paragraph's points is left out.
LEAST_SHARE = 1e-6
#: What is known of an element: nothing against it, a mixed name, a name of boilerplate words, cut off.
PLAIN, MIXED, NAMED, CUT = range(4)


class Node:
    __slots__ = ("tag", "state", "inside", "parent", "parts", "points", "chars", "link_chars", "commas", "scored")

    def __init__(self, tag: str, state: int, parent: Node | None) -> None:
        self.tag, self.state, self.parent, self.parts, self.points, self.scored = tag, state, parent, [], 0.0, False
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.chars = self.link_chars = self.commas = 0


def suspicion(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """The state that an element's tag and attributes give it."""
    if tag in SAFE:
        return PLAIN
    if tag in DROPPED or (tag == "header" and not in_article) or attributes.get("role", "").lower() in ROLES:
        return CUT
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return CUT
    state = PLAIN
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = WORDS.findall(name)
        against = [w in NEGATIVE and not (k and words[k - 1] in NEUTRAL) for k, w in enumerate(words)]
        if not words or words[0] in NEUTRAL or not (against[0] or against[-1]):
            continue
        if COMMENTS & set(words):
            return CUT
        state = max(state, NAMED if all(against) else MIXED)
    return PLAIN if tag == "article" else state


class Tree:
    """The open elements of a page that is parsed."""

    def __init__(self) -> None:
        self.root = self.here = Node("html", PLAIN, None)
        self.open: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.here = node
        self.open[node.tag] += 1

    def close(self, node: Node) -> None:
        """Close node and all that is open in it."""
        while self.here is not node:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent
        self.open[node.tag] -= 1
        self.here = node.parent

    def nearest(self, tags, fences=()) -> Node | None:
        """The innermost open element of these tags that no fence stands before; found at once where there is none."""
        if not any(self.open[t] > 0 for t in tags):
            return None
        node = self.here
        while node is not None and node.tag not in tags:
            if node.tag in fences:
                return None
            node = node.parent
        return node


PARAGRAPH_FENCES = frozenset("td th li button html article section div".split())


def parse(page: str) -> Node:
    """The tree of a page; elements that are cut, or may be, say so in their state."""
    tree = Tree()
    at, end = 0, len(page)
    unclosed: set[str] = set()

    def text(a: int, b: int) -> None:
        if a < b:
            raw = page[a:b]
            tree.here.parts.append(html.unescape(raw) if "&" in raw else raw)

    while at < end:
        m = TAG.search(page, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if m[0].startswith("<![CDATA["):
            tree.here.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            node = tree.nearest((tag,))
            if node is not None:
                tree.close(node)
            elif tag in ("p", "br"):
                tree.here.parts.append(Node(tag, PLAIN, tree.here))
            continue
        if tag == "html":
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/"):
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if close is None:
                    unclosed.add(tag)
                at = close.end() if close else (at if tag in OPEN_RAW else end)
            tree.here.parts.append(" ")
            continue
        if tag in BLOCK and (node := tree.nearest(("p",), PARAGRAPH_FENCES)) is not None:  # a block ends the paragraph that is open
            tree.close(node)
        if tag in CLOSES and (node := tree.nearest(CLOSES[tag], FENCES[tag])) is not None:
            tree.close(node)
            if tag in ("tr", "tbody") and tree.here.tag in ("tr", "tbody", "thead"):
                tree.close(tree.here)
        attributes = {}
        if rest and not rest.isspace() and rest != "/":
            attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(rest)}
        node = Node(tag, PLAIN, tree.here)
        node.state = suspicion(tag, attributes, node.inside)
        tree.here.parts.append(node)
        if tag not in VOID and not rest.rstrip().endswith("/") or tag in ("p", "div", "span", "a"):
            tree.push(node)
    return tree.root


def nodes(root: Node) -> Iterator[Node]:
    """Every node that isn't cut, parents first; no recursion, so depth does not matter."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [x for x in reversed(node.parts) if isinstance(x, Node) and x.state != CUT]


def measure(order: list[Node]) -> None:
    """Characters, characters in links and commas below each node."""
    for node in reversed(order):
        node.chars = node.link_chars = node.commas = 0
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len(x.strip())
                node.commas += x.count(",") + x.count("،") + x.count("、") + x.count("，")
            elif x.state != CUT:
                node.chars, node.link_chars, node.commas = node.chars + x.chars, node.link_chars + x.link_chars, node.commas + x.commas
        if node.tag == "a":
            node.link_chars = node.chars


def settle(root: Node) -> None:
    """Decide on the elements whose names speak against them by what they hold."""
    order = list(nodes(root))
    if all(n.state == PLAIN for n in order):
        return
    measure(order)
    articles, headings, place = [0], [0], {}
    for n in order:
        place[id(n)] = len(articles) - 1
        articles.append(articles[-1] + (n.tag in ("article", "main")))
        headings.append(headings[-1] + (n.tag in HEADINGS))
    size = dict.fromkeys(place, 1)
    for n in reversed(order):
        if n.parent is not None:
            size[id(n.parent)] += size[id(n)]
    plain = root.chars - root.link_chars
    for n in order:
        if n.state == PLAIN:
            continue
        first, last = place[id(n)], place[id(n)] + size[id(n)]
        article, heading = articles[last] > articles[first], headings[last] > headings[first]
        most = 2 * (n.chars - n.link_chars) >= plain > 0
        if n.state == NAMED:
            n.state = PLAIN if article and most else CUT
        else:
            n.state = PLAIN if article or most or (n.inside and heading) else CUT


def points(order: list[Node]) -> None:
    for node in order:
        own = any(isinstance(x, str) and len(x.strip()) >= LEAST_CHARS for x in node.parts)
        if not (node.tag in PARAGRAPHS or (node.tag in ("div", "section", "article", "main", "body") and own)) or node.chars < LEAST_CHARS:
            continue
        worth = 1 + node.commas + min(node.chars / 100, 3)
        if node.tag not in PARAGRAPHS:  # text that stands in a container without a paragraph
            node.points += worth
            node.scored = True
        share, up = 1.0, node.parent
        while up is not None and share > LEAST_SHARE:
            up.points += worth * share
            up.scored = True
            share, up = share / (2 if share == 1.0 else 3), up.parent
    for node in order:
        if node.scored:
            node.points = (node.points + START_POINTS.get(node.tag, 0.0)) * (1 - node.link_chars / max(1, node.chars))


def chosen(root: Node) -> list[Node]:
    settle(root)
    order = list(nodes(root))
    measure(order)
    points(order)
    best = max((n for n in order if n.scored), key=lambda n: n.points, default=None)
    if best is None:
        tops = {n.tag: n for n in reversed(order)}
        return [tops.get("article") or tops.get("main") or tops.get("body") or root]
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    if best.tag in ("body", "html") or best.parent is None:
        return [best]
    kept = []
    for x in best.parent.parts:
        if not isinstance(x, Node) or x.state == CUT:
            continue
        prose = x.tag in ("p", "pre", "blockquote") and x.chars > 80 and x.link_chars < 0.25 * x.chars
        if x is best or prose or (x.scored and x.tag not in ("ul", "ol", "dl", "table") and x.points >= max(10.0, SIBLING_SHARE * best.points)):
            kept.append(x)
    return kept


def blocks(kept: list[Node]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if block := " ".join("".join(line).split()):
            out.append(block)
        line.clear()

    stack: list[Node | str | None] = list(reversed(kept))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.state == CUT:
            if x.tag in BLOCK:
                flush()
        elif x.tag in BLOCK:
            flush()
            stack.append(None)
            stack += reversed(x.parts)
        else:
            stack += reversed(x.parts)
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(chosen(parse(page)))) if page else ""


def extract(rows: DataFrame) -> DataFrame:
    """rows (page_id, url, html) to page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b["html"]]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, "string"), pa.array([len(x) for x in texts], "int64")], ["page_id", "url", "text", "n_chars"])

    return rows.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(pages(spark, sf_dir))
