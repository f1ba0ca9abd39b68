"""Main-text extraction by minimum-cut labelling of a page's text blocks.

A page is read into text blocks. A small linear classifier over a block's
place in the document and its text gives the costs of calling it content or
boilerplate; these become capacities from the source and to the sink. Blocks
that stand next to each other, and blocks under one container, are joined by
smoothness edges that cost something when the two get different labels. A
maximum flow gives the cheapest labelling; the blocks on the source side are
the main text, in page order.

Each page is worked by itself, so nothing is shuffled; the graph has one node
a block and at most ``3`` edges a block.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trialspark.llm.common import text_of

# fixed values: names of HTML elements by their part in a page, and words of class and id names
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select option".split())
RAW_TEXT = frozenset("script style noscript textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CHROME = frozenset("nav header footer aside form menu dialog button fieldset".split())
SECTION_BREAKS = frozenset("article main section body html".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[^a-z])(ad|ads|adv|advert|adverts|advertisement|advertising|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|disqus|dialog|"
    r"footer|foot|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|overlay|pager|pagination|popup|privacy|promo|"
    r"recommended|related|replies|reply|respond|search|share|sharing|sidebar|side|signup|skip|social|sponsor|sponsored|subscribe|tags|toolbar|widget|widgets|alert|gdpr)(?:$|[^a-z])"
)
# parts of a name that tell the look of an element or the subject of its text
MODIFIERS = re.compile(
    r"^(?:with|has|have|no|without|is|not|category|cat|tag|topic|type|format|status|layout|theme|show|hide|js)[-_]|[-_](?:open|opened|closed|enabled|disabled|layout)$"
)
CONTENT_NAMES = re.compile(r"(?:^|[^a-z])(?:article|body|content|entry|main|post|story|text)(?:$|[^a-z])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

#: Costs in log-odds of content, added up over what holds for a block.
WEIGHTS = {
    "bias": 0.2,
    "in_main": 6.0,
    "in_chrome": -14.0,
    "named_whole": -8.0,
    "named_part": -4.5,
    "named_modifier": -1.5,
    "named_content": 1.5,
    "hidden": -12.0,
    "links": -4.0,
    "heading": 0.6,
    "words": 0.5,
    "sentence": 0.4,
    "symbol_only": -1.0,
}

#: How a name says boilerplate: by a modifier, by a part of it, by all of it.
MODIFIER, PART, WHOLE = 1, 2, 3
NAMED = {0: 0.0, MODIFIER: WEIGHTS["named_modifier"], PART: WEIGHTS["named_part"], WHOLE: WEIGHTS["named_whole"]}

#: Share of the page's unlinked text that an article holds at least to stand for the page's main text.
ARTICLE_SHARE = 0.1

#: Cost of a cut between neighbours in the page, and between blocks of one container.
NEXT_TO = 0.6
SAME_PARENT = 0.8

#: A quote opens a value only after an equals sign; elsewhere it is part of a name or of an unquoted value.
VALUE = r"\s*=\s*(?:\"[^\"]*\"|'[^']*'|[\"'][^>]*|[^\s>\"'][^\s>]*)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*+(?:[\s/]++|[^\s/>][^\s/>=]*+(?:{VALUE})?+)*+(?:>|\Z)|[^<]+|<", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(.*)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
#: What ends the text of a raw element; in a script, what opens and closes a comment that may hold a script.
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW_TEXT}
SCRIPT_MARK = re.compile(r"<!--(?:-?>)?|-->|</?script(?=[\s/>]|\Z)", re.I)


@dataclass(eq=False)
class Element:
    """An open element: what it says about the text below it."""

    name: str
    number: int
    in_main: bool = False
    in_chrome: bool = False
    named: int = 0
    content: bool = False
    hidden: bool = False
    above: Element | None = None
    article: bool = False
    main: bool = False
    holds_main: bool = False
    unlinked: int = 0


@dataclass
class Block:
    parent: int
    element: Element
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


@lru_cache(1 << 14)
def _named(name: str) -> int:
    """How one word of a class or id says boilerplate."""
    found = BOILERPLATE_NAMES.search(name)
    if not found:
        return 0
    return WHOLE if found[1] == name else MODIFIER if MODIFIERS.search(name) else PART


def _weigh_names(elements: list[Element]) -> None:
    """Let names of boilerplate hold for all below their element, and end main text, where they count.

    A name doesn't count on an element that is or holds a main element, or holds
    most of the unlinked text of the page's main part: that is its longest
    article outside of elements named as boilerplate (or only in ones that hold
    most of the page), else its main element, else the page. ``elements`` come in page order, the
    page itself first.
    """
    if not any(e.named for e in elements):
        return
    for e in elements:
        e.holds_main = e.main
    for e in reversed(elements[1:]):
        e.above.unlinked += e.unlinked
        e.above.holds_main |= e.holds_main
    page = elements[0]
    below_main, tainted, inside, ended = ([False] * len(elements) for _ in range(4))
    small = tainted[:]  # in a named element that doesn't hold most of the page's text
    for e in elements[1:]:
        below_main[e.number] = e.main or below_main[e.above.number]
        named = e.named >= PART and not e.holds_main
        tainted[e.number] = tainted[e.above.number] or named
        small[e.number] = small[e.above.number] or (named and 2 * e.unlinked <= page.unlinked)
    mains = [e for e in elements if e.main and e.unlinked]
    articles = [
        e for e in elements if e.article and e.unlinked and e.unlinked >= ARTICLE_SHARE * page.unlinked and (below_main[e.number] or not mains)
    ]
    clean = [e for e in articles if not tainted[e.number]] or [e for e in articles if not small[e.number]]
    part = max(clean or mains or [page], key=lambda e: e.unlinked)
    around, e = set(), part
    while e is not None:
        around.add(e.number)
        e = e.above
    inside[0] = part is page
    for e in elements[1:]:
        above = e.above
        inside[e.number] = e is part or inside[above.number]
        if e.holds_main or e.number in around or (inside[e.number] and 2 * e.unlinked > part.unlinked):
            e.named = 0
        if e.article:
            e.named = min(e.named, MODIFIER)
        ended[e.number] = ended[above.number] or e.named >= PART
        e.in_main = e.in_main and not ended[e.number]
        e.named = max(e.named, above.named)


def _opened(name: str, rest: str, above: Element, number: int) -> Element:
    # a header or footer of the article itself is chrome as well; a new article ends none of it
    attrs = {k.lower(): (a or b or c or "").lower() for k, a, b, c in ATTRIBUTE.findall(rest)} if rest.strip(" />") else {}
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
    article, main = "article" in (name, attrs.get("role")), "main" in (name, attrs.get("role"))
    return Element(
        name,
        number,
        above.in_main or article or main,
        above.in_chrome or name in CHROME or attrs.get("role") in ROLES,
        0 if name in ("body", "html") else max(map(_named, names.split()), default=0),
        above.content or (bool(names) and bool(CONTENT_NAMES.search(names))),
        above.hidden or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""),
        above,
        article,
        main,
    )


def raw_end(page: str, name: str, at: int) -> int:
    """Where the closing tag of a raw element starts whose text starts at ``at``; -1 if it isn't closed.

    Its text has no tags, so only the closing tag's own letters count. A script
    may stand in a comment of a script; that one's closing tag ends nothing.
    """
    if name == "script":
        state = "text"
        for mark in SCRIPT_MARK.finditer(page, at):
            what = mark[0].lower()
            if what == "</script":
                if state != "inner":
                    return mark.start()
                state = "comment"
            elif what == "<script":
                state = "inner" if state == "comment" else state
            elif what == "-->":
                state = "text"
            elif what == "<!--" and state == "text":
                state = "comment"
    found = RAW_ENDS[name].search(page, at)
    return found.start() if found else -1


def blocks_of(page: str) -> list[Block]:
    """The text blocks in page order, with what their elements say; empty ones are left out.

    Reads tag soup: unknown, unclosed and truncated tags are fine. Comments,
    scripts, styles and other raw elements hold no text. A line break and any
    element that isn't inline ends a block.
    """
    stack = [Element("", 0)]
    elements = stack[:]
    number, links, block = 0, 0, None
    out: list[Block] = []
    skip = ""
    at_char = 0
    while at_char < len(page):
        found = TOKEN.match(page, at_char)
        token, at_char = found[0], found.end()
        if token[0] == "<" and len(token) > 1:
            match = TAG.match(token)
            if not match:  # comment, declaration
                continue
            closing, name, rest = match[1] == "/", match[2].lower(), match[3]
            if name in RAW_TEXT and not closing and not rest.rstrip(">").endswith("/"):
                # the tag pattern doesn't hold in here: go on at the closing tag
                end = raw_end(page, name, at_char)
                if end >= 0:
                    at_char = end
                elif not skip:
                    break
            if skip:
                if closing and name == skip:
                    skip = ""
                continue
            if name in RAW:
                if not closing and not rest.rstrip(">").endswith("/"):
                    skip = name
                continue
            if name == "a":
                links = 0 if closing else 1
            if name in INLINE:
                if name == "wbr" or not rest.strip(" />"):
                    continue
            else:
                block = None
            if name in VOID:
                continue
            if closing:
                if any(e.name == name for e in stack[1:]):
                    while stack.pop().name != name:
                        pass
                continue
            if name in CLOSES_P:
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == "p" or stack[i].name not in INLINE), 0)
                if at and stack[at].name == "p":
                    del stack[at:]
            if name == "li" and any(e.name == "li" for e in stack):
                at = max(i for i, e in enumerate(stack) if e.name == "li")
                if not any(e.name in ("ul", "ol", "menu") for e in stack[at:]):
                    del stack[at:]
            number += 1
            stack.append(_opened(name, rest, stack[-1], number))
            elements.append(stack[-1])
        elif not skip:
            if block is None:
                if token.isspace():
                    continue
                here = stack[-1]
                holder = next((e for e in reversed(stack) if e.name not in INLINE), stack[0])
                above = next((e for e in reversed(stack[: stack.index(holder)]) if e.name not in INLINE), stack[0])
                block = Block(above.number, here, holder.name in ("h1", "h2", "h3", "h4", "h5", "h6"))
                out.append(block)
            block.parts.append(token)
            block.linked += links * len(token)
            if not links and not stack[-1].in_chrome and not stack[-1].hidden:
                stack[-1].unlinked += len(token.strip())
    _weigh_names(elements)
    return [b for b in out if b.text]


def content_cost(block: Block) -> float:
    """Log-odds that the block is content."""
    text, e = block.text, block.element
    words = text.split()
    size = sum(map(len, block.parts))
    return (
        WEIGHTS["bias"]
        + WEIGHTS["in_main"] * e.in_main
        + WEIGHTS["in_chrome"] * e.in_chrome
        + NAMED[e.named]
        + WEIGHTS["named_content"] * e.content
        + WEIGHTS["hidden"] * e.hidden
        + WEIGHTS["links"] * (block.linked / max(1, size)) * (not e.in_main)
        + WEIGHTS["heading"] * block.heading
        + WEIGHTS["words"] * min(3.0, math.log1p(len(words)) - 1.5)
        + WEIGHTS["sentence"] * (text[-1] in ".!?…。")
        + WEIGHTS["symbol_only"] * (not any(c.isalnum() for c in text))
    )


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut.

    A positive cost is the capacity from the source, a negative one that to the
    sink; edges cost their capacity when their ends are parted. Flow is sent in
    phases along shortest paths only (a level graph, each edge tried once a
    phase), so long chains of blocks take few phases; nodes that no residual
    path from the source reaches are on the sink side.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, cost in enumerate(costs):
        join(source, i, cost, 0.0) if cost > 0 else join(i, sink, -cost, 0.0)
    for a, b, cost in edges:
        join(a, b, cost, cost)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for k in out[a]:
                if room[k] > tiny and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    todo.append(to[k])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[k] for k in path)
                cut = len(path)
                for at, k in enumerate(path):
                    room[k] -= flow
                    room[k ^ 1] += flow
                    if room[k] <= tiny and at < cut:
                        cut = at
                del path[cut:]
                a = to[path[-1]] if path else source
                continue
            while tried[a] < len(out[a]):
                k = out[a][tried[a]]
                if room[k] > tiny and level[to[k]] == level[a] + 1:
                    path.append(k)
                    a = to[k]
                    break
                tried[a] += 1
            else:
                if not path:
                    break
                a = to[path.pop() ^ 1]
                tried[a] += 1


def main_text(page: str | None) -> str:
    """The main text of a page: content blocks joined by newlines; empty if there is none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    costs = [content_cost(b) for b in blocks]
    if all(c > 0 for c in costs) or all(c <= 0 for c in costs):
        keep = [c > 0 for c in costs]  # nothing to cut
    else:
        edges = [(i, i + 1, NEXT_TO) for i in range(len(blocks) - 1)]
        last: dict[int, int] = {}
        for i, block in enumerate(blocks):
            if block.parent in last:
                edges.append((last[block.parent], i, SAME_PARENT))
            last[block.parent] = i
        keep = min_cut(costs, edges)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(page: Column | str) -> Column:
    """Main text of each html page; empty for null, empty and text-free pages."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return run(text_of(page))
