"""Main text of web pages by tree scoring.

Each page becomes a tree of its block elements. A text block passes points for its length
and commas on to its ancestors (all to the parent, two thirds of that to the next, and so on), and
each container's sum is discounted by the share of its text that is in links; an article or
main element, or a class that names content, raises it. The best container gives the main text,
with those siblings whose value is a fifth of its own, and sibling headings and sentences that
are no links. Menus, headers and footers of the page, sidebars, forms, scripts, styles and
reader comments are taken out by element, role and class before scoring, and so are adverts,
notices and share bars, be they containers or single lines. A class name decides as a whole: all of its
words must name such a thing or its place, so that of "ad-slot-2" and "ad-free-guide" only the first
goes. Names that are not certain take out what sentences do not fill, and below the best container
so do blocks of links, whatever their names or sizes.

Character references are decoded, white space within a block becomes one blank, and blocks
are joined in page order by a line end. Line breaks inside a block are white space. A tag or
quote that never ends is text or ends at the next ">"; a button, drawing or player that
never ends hides nothing. Time and memory are linear in the page's length, however it is
broken or nested, so a very long page is one row like any other.

Nulls: a null page is an empty one. A page without text gives an empty string. Repeated rows
give repeated results. An empty table gives an empty result. Only page_id, url and html are
read, so extra columns take no part and cannot clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
STOP = re.compile(r""">|=\s*+(["'])""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("svg select button canvas audio video template datalist".split())
NEVER = frozenset("aside dialog footer form fieldset head menu nav search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | {"p", "pre", "blockquote", "li", "figcaption", "caption", "dd", "dt", "td", "th", "summary"}
CLOSES = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
    "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
SPACES = {"li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dd": {"dl"}, "dt": {"dl"}}
#: Words that name what is not the article, those that do so unless sentences fill the element, and readers' comments.
UNWANTED = frozenset(
    "ad ads adbox adslot advert advertisement advertisements advertising alert alerts banner breadcrumb breadcrumbs consent cookie cookies gdpr login "
    "masthead modal nav navbar navigation newsletter notice notices notification notifications outbrain pager pagination paywall popup promo promos "
    "promoted promotion recommendations recommended share sharing sidebar signin signup skip skyscraper social sponsor sponsored subscribe subscription "
    "taboola toolbar".split()
)
DOUBTFUL = frozenset("feedback menu more rail related search tags widget".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
OUTSIDE_ONLY = frozenset("header footer".split())
WANTED = frozenset("article body content entry main post story text".split())
#: Words of a name that say where or how something stands, not what it is.
NEUTRAL = WANTED | frozenset(
    "a and area articles aside author bar block blocks body bottom box btn button buttons card cards center class col column container count cta cell "
    "element first footer form grid group head header heading home icon icons id image img in inline inner item items js last layout left level line link "
    "links list lists long meta mobile module new news next of off on outer overlay page panel posts prev previous primary reader region right row secondary section "
    "sections sm small site slot stack sticky stories strip system tab the thread title to top tree unit user users view web wide wrap wrapper xl xs".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

SENTENCE = (".", "!", "?", "…", "。", "！", "？", '."', '!"', '?"', ".”", "!”", "?”")
PASSED_ON, BONUS, WANTED_BONUS, SIBLING_SHARE = 2 / 3, {"article": 4.0, "main": 2.0}, 1.25, 0.2
KEEP, DOUBT, SKIP = 0, 1, 2


class Node:
    """A block element; ``fate``: kept, skipped, or taken out if it turns out short or linked."""

    __slots__ = ("tag", "parent", "fate", "inside", "wanted", "score", "chars", "linked", "told", "kept")

    def __init__(self, tag: str, parent: Node | None, fate: int, inside: bool, wanted: bool = False):
        self.tag, self.parent, self.fate, self.inside, self.wanted = tag, parent, fate, inside, wanted
        self.score, self.chars, self.linked, self.told, self.kept = 0.0, 0, 0, 0, False

    def value(self) -> float:
        if not self.chars:
            return 0.0
        return self.score * (1 - self.linked / self.chars) * BONUS.get(self.tag, WANTED_BONUS if self.wanted else 1.0)

    def goes(self) -> bool:
        """Of doubtful ones those go that sentences do not fill; of all below a list or line, link blocks."""
        if self.fate == DOUBT:
            return self.linked > 0.3 * self.chars or self.told <= 0.5 * self.chars
        return self.fate == SKIP

    def only_links(self) -> bool:
        return self.tag not in HEADINGS and self.linked > 0.5 * self.chars and self.told <= 0.5 * self.chars


def words_of(name: str) -> frozenset[str]:
    """The words of one class name; numbers do not count."""
    return frozenset(w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w)


def fate_of(tag: str, attrs: str, inside: bool) -> tuple[int, bool]:
    """What becomes of an element, and whether its class names content; inside: within an article or main, whose own header (its title) belongs to it."""
    if tag in NEVER or tag in HIDDEN or tag == "header" and not inside:
        return SKIP, False
    if not attrs or tag in ("html", "body"):
        return KEEP, False
    named = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true":
        return SKIP, False
    if re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", named.get("style", ""), re.I):
        return SKIP, False
    if named.get("role", "").lower() in ROLES:
        return SKIP, False
    names = [words_of(name) for name in f"{named.get('class', '')} {named.get('id', '')}".split()]
    wanted = any(name & WANTED for name in names)
    is_a = lambda kind: any(name & kind and name <= kind | NEUTRAL for name in names)
    if is_a(COMMENTS):
        return SKIP, False
    if tag in ("article", "main"):
        return KEEP, wanted
    if is_a(UNWANTED):
        return SKIP, False
    if is_a(DOUBTFUL):
        return (DOUBT if inside or wanted else SKIP), False
    return (SKIP if not inside and is_a(OUTSIDE_ONLY) else KEEP), wanted


class Parser:
    """Text blocks of a page in order, and the tree of its block elements (parents first)."""

    def __init__(self, html: str):
        self.html, self.size, self.quotes = html, len(html), True
        self.last_end = html.rfind(">")
        self.nodes = [Node("html", None, KEEP, False)]
        self.stack = [self.nodes[0]]
        self.open: dict[str, list[int]] = defaultdict(list)  # where each kind of element is open
        self.found: list[tuple[Node, str, int]] = []  # element, text, characters in links
        self.held: list[str] = []
        self.linked, self.links = 0, False
        self.ends: dict[str, tuple[int, int]] = {}

    def text(self, start: int, stop: int) -> None:
        if start < stop and self.stack[-1].fate != SKIP:
            raw = self.html[start:stop]
            decoded = unescape(raw) if "&" in raw else raw
            self.held.append(decoded)
            if self.links:
                self.linked += len(decoded)

    def flush(self) -> None:
        if self.held:
            whole = " ".join("".join(self.held).split())
            if whole:
                self.found.append((self.stack[-1], whole, min(self.linked, len(whole))))
            self.held.clear()
        self.linked = 0

    def push(self, tag: str, fate: int, wanted: bool) -> None:
        top = self.stack[-1]
        node = Node(tag, top, SKIP if top.fate == SKIP else fate, top.inside or tag in ("article", "main"), wanted)
        self.nodes.append(node)
        self.open[tag].append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.open[node.tag].pop()
        del self.stack[depth:]

    def innermost(self, tags: Iterable[str]) -> int:
        return max((self.open[t][-1] for t in tags if self.open[t]), default=0)

    def tag_end(self, at: int) -> int:
        """Behind the ">" of the tag whose attributes start here; quoted values may hold one."""
        stop = STOP.search(self.html, at) if self.quotes else None
        while stop and stop[1]:
            close = self.html.find(stop[1], stop.end())
            if close < 0:
                break
            stop = STOP.search(self.html, close + 1)
        if stop and not stop[1]:
            return stop.end()
        self.quotes = False  # a quote is open to the end: from here on quotes mean nothing, so no text is looked through twice
        return self.html.find(">", at) + 1

    def closes(self, tag: str, at: int) -> bool:
        """Whether the hidden element that starts here has an end before the next of its kind starts."""
        begin, end = self.ends.get(tag, (-1, -1))
        if 0 <= end < at:
            end = -1
        if end < 0:
            hit = re.compile(rf"</{tag}\b", re.I).search(self.html, at)
            end = hit.start() if hit else self.size
        if begin < at:
            hit = re.compile(rf"<{tag}\b", re.I).search(self.html, at)
            begin = hit.start() if hit else self.size
        self.ends[tag] = begin, end
        return end < self.size and end <= begin

    def end_tag(self, tag: str) -> None:
        if tag == "a":
            self.links = False
        elif tag in BLOCKS or tag in HIDDEN:
            if tag in BLOCKS:
                self.flush()
            if self.open[tag]:
                self.pop_to(self.open[tag][-1])

    def start_tag(self, tag: str, attrs: str, at: int) -> int:
        """Where to go on."""
        if tag in RAW:
            self.held.append(" ")
            if not attrs.endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(self.html, at)
                return close.end() if close else self.size
        elif tag in HIDDEN:
            self.held.append(" ")
            if not attrs.endswith("/") and self.closes(tag, at):
                self.push(tag, SKIP, False)
        elif tag in BLOCKS:
            self.flush()
            if self.stack[-1].tag == "p":
                self.pop_to(len(self.stack) - 1)
            while tag in CLOSES and self.innermost(CLOSES[tag]) > self.innermost(SPACES.get(tag, ("table", "select"))):
                self.pop_to(self.innermost(CLOSES[tag]))
                if not tag.startswith("t"):
                    break
            if tag not in VOID:
                self.push(tag, *fate_of(tag, attrs, self.stack[-1].inside))
        elif tag == "a":
            self.links = True
        elif tag == "br":
            self.held.append(" ")
        return at

    def parse(self) -> Parser:
        html, at = self.html, 0
        while True:
            begin = html.find("<", at)
            if begin < 0 or begin > self.last_end:  # no tag can end any more
                break
            after = html[begin + 1 : begin + 2]
            name = NAME.match(html, begin + 1)
            if not name and after not in ("!", "?", "/"):
                self.text(at, begin + 1)
                at = begin + 1
                continue
            self.text(at, begin)
            if not name:
                if html.startswith("<!--", begin) and not html.startswith(("<!-->", "<!--->"), begin):
                    close = html.find("-->", begin + 4)
                    at = close + 3 if close >= 0 else self.size
                else:
                    at = html.find(">", begin) + 1
                continue
            at = self.tag_end(name.end())
            if not at:  # only after quotes to the end
                at = self.size
            attrs = html[name.end() : at - 1]
            if name[1]:
                self.end_tag(name[2].lower())
            else:
                at = self.start_tag(name[2].lower(), attrs, at)
        self.text(at, self.size)
        self.flush()
        return self


def main_text(html: str | None) -> str:
    page = Parser(html or "").parse()
    nodes = page.nodes
    for node, text, linked in page.found:
        node.chars += len(text)
        node.linked += linked
        if text.endswith(SENTENCE):
            node.told += len(text)
    for node in reversed(nodes[1:]):  # children before parents
        node.parent.chars += node.chars
        node.parent.linked += node.linked
        node.parent.told += node.told
    for node in nodes:
        if node.goes() or node.parent and node.parent.fate == SKIP:
            node.fate = SKIP
    blocks = [b for b in page.found if b[0].fate != SKIP]
    links = [node.only_links() for node in nodes]
    for node in nodes:
        node.chars = node.linked = 0
    for node, text, linked in blocks:
        container = node.parent if node.tag in LEAVES and node.parent else node
        container.score += 1 + text.count(",") + min(len(text) / 100, 3)
        node.chars += len(text)
        node.linked += linked
    for node in reversed(nodes[1:]):
        node.parent.score += PASSED_ON * node.score
        node.parent.chars += node.chars
        node.parent.linked += node.linked
    if not blocks:
        return ""
    best = max(nodes, key=Node.value)
    if not best.value():  # all of it in links
        best = nodes[0]
    least, own = SIBLING_SHARE * best.value(), {}
    for node, text, linked in blocks:
        own.setdefault(id(node), text)
    for node in nodes:
        beside = best.parent is not None and node.parent is best.parent and node is not best
        text = own.get(id(node), "") if beside and node.linked < 0.25 * node.chars else ""
        node.kept = (
            node is best or node.parent is not None and node.parent.kept or beside and node.value() >= least > 0
            or node.tag in HEADINGS and bool(text) or node.tag in LEAVES and text.endswith((".", "!", "?"))
        )
    # below the best container link blocks go as well, unless nothing else is there
    for node, only in zip(nodes, links):
        if node.parent is not None and node is not best and (only and best.linked <= 0.5 * best.chars or node.parent.fate == SKIP):
            node.fate = SKIP
    return "\n".join(text for node, text, _ in blocks if node.kept and node.fate != SKIP)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(batch.schema.get_field_index("html"))]
        kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n != "html"]
        columns = [*(c for c, _ in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*(n for _, n in kept), "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
