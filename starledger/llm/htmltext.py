"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier gives each block a cost for being called
boilerplate and one for being called content: the capacities of its edges to the two terminals.
Blocks next to each other in the page, and more so those with one parent in the DOM, are joined by
smoothness edges. The minimum cut separates content from boilerplate.

A block whose own evidence outweighs all its smoothness edges keeps its label in every minimum cut;
such blocks are settled first and the maximum flow runs over the rest.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from starledger.llm.common import exact_columns, short_batches

#: A comment, CDATA, a declaration, or the start of a tag (its end is found by ``_Tags``).
_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)", re.S)
_SPECIAL = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_PART = re.compile(r"[a-z]+|[0-9]+")

# HTML's own element names (fixed values).
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q",
    "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Start tags that end an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}

#: Weights of the classifier: evidence for content (positive) or boilerplate (negative).
HARD, BIAS, ARTICLE, PARAGRAPH, HEADING, LONG, SENTENCE, SHORT, LINKS = -9.0, 0.2, 3.0, 1.0, 0.5, 1.5, 0.5, -0.5, -2.5
#: What an element that is partly named so leaves of ARTICLE inside an article: a section on share prices
#: is text, share buttons aren't, and their own evidence tells.
PARTLY_ARTICLE = 1.5
#: Added to the evidence where the cut finds no content, and what is boilerplate by its tag then has no
#: say: text that is alone on its page is its text.
ALONE = 2.0
#: Smoothness: blocks next to each other, and more for those with the same parent or grandparent.
NEXT, SIBLINGS, COUSINS = 0.3, 0.6, 0.3
#: Cost of a boilerplate word in the name of an element around a block: where it is the whole name
#: ("sidebar", "cookie-notice") or only a part ("has-sidebar"). The block's own evidence and the cut can outweigh it.
NAMED, PARTLY_NAMED = -4.5, -2.5

BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "svg", "object", "header"}
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "alert", "alerts", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie",
    "cookies", "copyright", "disqus", "dropdown", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "complementary", "contentinfo",
}
#: Words that name readers' comments, in any name but one that only says whether there are some.
COMMENT_WORDS = {"comment", "comments", "commenters", "discuss", "discussion", "discussions", "disqus", "feedback", "guestbook", "reactions", "replies", "reply", "respond", "responses"}
STATE_WORDS = {"closed", "disabled", "enabled", "has", "no", "open", "with", "without"}
ARTICLE_TAGS = {"article", "main"}
ARTICLE_WORDS = {"article", "content", "entry", "main", "post", "story"}
#: Boilerplate words that say nothing inside an article, as its header may hold the headline.
HEADER_WORDS = {"header"}


def _named(names: list[set[str]], ignored: set[str]) -> float:
    """The cost of an element's own names, each a set of words."""
    cost = 0.0
    for words in names:
        if not words.isdisjoint(COMMENT_WORDS) and words.isdisjoint(STATE_WORDS):
            cost = NAMED
        elif not (words - ignored).isdisjoint(BOILERPLATE_WORDS):
            cost = min(cost, NAMED if words <= BOILERPLATE_WORDS else PARTLY_NAMED)
    return cost


class _Element:
    __slots__ = ("name", "parent", "hard", "article", "named", "partly")

    def __init__(self, name: str, attrs: str, parent: _Element | None):
        self.name, self.parent = name, parent
        names: list[set[str]] = []
        if attrs and "=" in attrs:
            for m in _ATTRIBUTE.finditer(attrs):
                names += [set(_NAME_PART.findall(x)) for x in (m[2] or m[3] or m[4] or "").lower().split()]
        inside = parent is not None and parent.article
        # The header of an article may hold its headline: its blocks are judged like others.
        own = name in BOILERPLATE_TAGS and not (name == "header" and inside)
        self.hard = (parent is not None and parent.hard) or own
        cost = _named(names, HEADER_WORDS if inside else set())
        above = parent.named if parent is not None else 0.0
        article = any(not words.isdisjoint(ARTICLE_WORDS) and words.isdisjoint(BOILERPLATE_WORDS) for words in names)
        if name in ARTICLE_TAGS:
            # What an article is in doesn't speak against it, unless it names itself so (a list of comments).
            odd = cost < 0 and not article
            self.named, self.article, self.partly = (above if odd else 0.0), not (odd and (above == NAMED or cost == NAMED)), False
        else:
            self.named = 0.0 if name in ("html", "body") else min(above, cost)
            # A whole name ends an article, a part of one weakens it; within what is wholly named so, no class begins one.
            begins = article and not (cost or above == NAMED)
            self.article = (inside and self.named != NAMED) or begins
            self.partly = self.article and not begins and (parent.partly or self.named != above)


class _Tags:
    """Ends of a page's tags. A quoted value may hold ">" at any length; a quote that nothing closes is
    an ordinary character, and a tag whose quotes leave no end ends at its first ">".

    All searches go on from what earlier ones found, so the time is linear in the page.
    """

    def __init__(self, page: str):
        self.page = page
        self.first, self.plain = -1, -1  # the next quote or ">", the next ">"
        self.last = {sign: page.rfind(sign) for sign in "\"'"}  # from there on, nothing closes the sign
        self.endless: set[int] = set()  # quotes from which no end was found

    def end(self, at: int) -> int:
        """The place of the ">" that ends the tag whose attributes begin at ``at``; -1 if there is none."""
        page = self.page
        if self.plain < at:
            found = page.find(">", at)
            self.plain = len(page) if found < 0 else found
        if self.plain == len(page):
            return -1
        if self.first < at:
            self.first = _SPECIAL.search(page, at).start()
        place, seen = self.first, []
        while page[place] != ">":
            if place in self.endless:
                break
            seen.append(place)
            sign = page[place]
            close = page.find(sign, place + 1) if place < self.last[sign] else place
            m = _SPECIAL.search(page, close + 1)
            if m is None:
                break
            place = m.start()
        else:
            return place
        self.endless.update(seen)
        return self.plain


class Block:
    __slots__ = ("text", "links", "element")

    def __init__(self, text: str, links: int, element: _Element):
        self.text, self.links, self.element = text, links, element


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order: character references decoded, white space collapsed."""
    root = _Element("#page", "", None)
    stack, out = [root], []
    parts: list[str] = []
    links, link_depth, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(links, len(text)), stack[-1]))
            parts.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link_depth:
                links += len(text.strip())

    tags = _Tags(page)
    while m := _MARKUP.search(page, at):
        end = tags.end(m.end()) if m["name"] else m.end() - 1
        if end < 0:  # no tag ends any more
            say(page[at : m.end()])
            at = m.end()
            continue
        if m.start() > at:
            say(page[at : m.start()])
        at = end + 1
        if m["cdata"] is not None:
            say(m["cdata"])
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m["close"]), page[m.end() : end]
        if name == "br":
            parts.append("\n")
        elif name in INLINE:
            if name == "a":
                link_depth = 0 if closing else 1
        elif closing:
            flush()
            link_depth = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
        else:
            flush()
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in ENDS_P and stack[-1].name == "p" or name == stack[-1].name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                stack.pop()
            if name not in VOID and not attrs.endswith("/"):
                stack.append(_Element(name, attrs, stack[-1]))
    say(page[at:])
    flush()
    return out


def evidence(block: Block) -> float:
    """The classifier: above 0 speaks for content, below for boilerplate."""
    if block.element.hard:
        return HARD
    n, name = len(block.text), block.element.name
    score = BIAS + (LONG if n >= 80 else SHORT if n < 25 else 0.0)
    score += SENTENCE if block.text[-1] in ".!?…。！？\"”»" else 0.0
    score += PARAGRAPH if name in ("p", "pre", "blockquote") else HEADING if name in ("h1", "h2", "h3", "h4", "h5", "h6") else 0.0
    score += block.element.named + (PARTLY_ARTICLE if block.element.partly else ARTICLE if block.element.article else 0.0)
    return score + (LINKS if 2 * block.links > n else 0.0)


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, weight): neighbours in the page, and the nearest blocks of one parent or grandparent."""
    weights: dict[tuple[int, int], float] = {}

    def join(i: int, j: int, weight: float) -> None:
        weights[i, j] = weights.get((i, j), 0.0) + weight

    near: dict[tuple[int, int], int] = {}
    for j, b in enumerate(blocks):
        if j:
            join(j - 1, j, NEXT)
        up = b.element
        for level, weight in ((1, SIBLINGS), (2, COUSINS)):
            up = up.parent
            if up is None:
                break
            i = near.get((level, id(up)))
            if i is not None:
                join(i, j, weight)
            near[level, id(up)] = j
    return [(i, j, w) for (i, j), w in weights.items()]


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; on ties, the sink's.

    ``unary`` above 0 is the capacity from the source to the node, below 0 that to the sink.
    """
    n = len(unary)
    own, label = list(unary), [None] * n
    beside: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        beside[i][j] = beside[i].get(j, 0.0) + w
        beside[j][i] = beside[j].get(i, 0.0) + w
    todo = deque(range(n))
    while todo:  # nodes that their own evidence settles; their edges become evidence for their neighbours
        i = todo.popleft()
        if label[i] is None and abs(own[i]) > sum(beside[i].values()):
            label[i] = own[i] > 0
            for j, w in beside[i].items():
                own[j] += w if label[i] else -w
                del beside[j][i]
                todo.append(j)
            beside[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow([own[i] for i in rest], rest, beside), strict=True):
            label[i] = side
    return label


def _flow(unary: list[float], nodes: list[int], beside: list[dict[int, float]]) -> list[bool]:
    """The source's side by augmenting along shortest paths, level by level (Dinic)."""
    number = {v: k for k, v in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    capacity: list[dict[int, float]] = [{} for _ in range(len(nodes) + 2)]
    for k, v in enumerate(nodes):
        for j, w in beside[v].items():
            capacity[k][number[j]] = w
        a, b = (source, k) if unary[k] > 0 else (k, sink)
        capacity[a][b] = abs(unary[k])
        capacity[b].setdefault(a, 0.0)
    tiny = 1e-9
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in capacity[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [k in level for k in range(len(nodes))]
        arcs = [[v for v in near if level.get(v) == level.get(u, -9) + 1] for u, near in enumerate(capacity)]
        at = [0] * len(arcs)
        while True:
            path = [source]
            while path and path[-1] != sink:
                u = path[-1]
                while at[u] < len(arcs[u]) and capacity[u][arcs[u][at[u]]] <= tiny:
                    at[u] += 1
                if at[u] < len(arcs[u]):
                    path.append(arcs[u][at[u]])
                else:
                    path.pop()
                    if path:
                        at[path[-1]] += 1
            if not path:
                break
            steps = list(zip(path, path[1:], strict=False))
            push = min(capacity[a][b] for a, b in steps)
            for a, b in steps:
                capacity[a][b] -= push
                capacity[b][a] = capacity[b].get(a, 0.0) + push


def main_text(page: str) -> str:
    """The page's content blocks in order, joined by one blank."""
    blocks = blocks_of(page)
    own, edges = [evidence(b) for b in blocks], smoothness(blocks)
    content = minimum_cut(own, edges)
    if blocks and not any(content):
        content = minimum_cut([x if x == HARD else x + ALONE for x in own], [e for e in edges if HARD not in (own[e[0]], own[e[1]])])
    return " ".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """A row for each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page has an empty text. Unclosed or broken markup is read as browsers do where
    it matters here: a new block ends a paragraph, an unclosed script or comment runs to the end.
    Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(page) if page else "" for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    short_batches(pages.sparkSession)
    return exact_columns(pages, [("page_id", "long"), ("url", "string"), ("html", "string")]).mapInArrow(run, "page_id long, url string, text string, n_chars long")
