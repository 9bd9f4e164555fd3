"""Main-text extraction by a minimum cut over a page's blocks.

A page becomes a row of text blocks that hang on a tree of elements. A logistic classifier over what a block says
(length, links, sentences, clauses) gives it costs for being content or boilerplate, which become capacities to the two
terminals. Markup is no feature of the classifier, as markup is where its labels come from; a heading says nothing of
itself and hangs on the block that it stands before. Each element that HTML, a role or a
name marks as article, menu, header, footer, notice, form and so on is a node of its own, a section, with a terminal
capacity of its own; blocks hang on their nearest section, and sections on the section around them. Neighbours in
page order are joined by their distance in the tree, and so are the blocks of one parent. The maximum flow's cut
labels blocks and sections together, so markup and neighbours change a block's label only through edges.

A section that holds all that marks the page's article, and more text than stands outside of all boilerplate, is a
wrapper: what its name, or its tag, says of it doesn't count. Nor does a name speak against an article or main element
that holds another one, or that is the page's only one.

The classifier is learned from blocks that sections label, on a bounded number of blocks of a bounded number of
pages; the strength of the edges is the one, of a few, at which the cut without any section's capacity agrees best
with those labels. A node whose terminal capacity outweighs all its edges has its label already, so it is folded
into its neighbours' terminals before the flow is computed; this leaves the cut as it is.

Elements end by HTML's rules where end tags are left out. Time and memory are in proportion to the page. Null, empty
and unparsable pages have no text; scripts, styles, comments and unfinished tags never count. Text that only stands in
for an element (of drawings, players, templates, lists of choices) is left out if that element has an end tag; one
that is never closed takes nothing of the page with it. Rows are independent: repeated rows and null ids give
repeated results. Surplus columns are ignored.
"""

from __future__ import annotations

import html
import re
from array import array
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

# Names that HTML gives a meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold characters and no tags: only their own end tag ends them.
RAW = frozenset("script style textarea iframe title noembed noframes xmp".split())
#: Elements whose text stands in for something else.
SILENT = frozenset("svg math object canvas video audio select datalist template noscript".split())
FOREIGN = frozenset("svg math".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CONTENT_ROLES = frozenset("main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split()) | HEADINGS
#: Elements whose end tags may be left out, by group; a start tag ends the group's innermost open one, unless an
#: element of the second list stands between.
MEMBERS = {"p": "p", "li": "li", "dd": "dd dt", "cell": "td th", "row": "tr", "rows": "thead tbody tfoot caption colgroup", "option": "option optgroup", "heading": "h1 h2 h3 h4 h5 h6"}
BOUNDS = {"p": "table td th caption button object template", "li": "ul ol menu", "dd": "dl", "cell": "table", "row": "table", "rows": "table", "option": "select datalist", "heading": "div section article table td th li"}
#: Words of class names, ids and roles that tell of boilerplate and of content.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice notices alert alerts "
    "nav navbar navigation menu menus sidebar side breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations subscribe subscription newsletter signup login popup modal overlay widget widgets "
    "toolbar pagination pager copyright legal skip".split()
)
CONTENT_WORDS = frozenset("article content post entry main story body text prose".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.S)
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+")
SENTENCE_END = frozenset(".!?:;\"'”»…。！？")

FEATURES = ("bias", "log_words", "link_share", "sentence", "clauses", "copyright", "parent_links")
#: Weights that the fit starts from and is drawn to, as log odds of being content.
PRIOR = (-2.2, 0.9, -3.0, 1.5, 0.5, -3.0, -2.0)
PULL = 4.0
#: The fit's sample: pages, the first by a hash of their html, and evenly spread blocks of each.
FIT_PAGES, FIT_BLOCKS = 400, 200
#: Smoothness of two blocks next to each other, over their distance in the tree, and of blocks of one parent; the fit
#: multiplies both by one of STRENGTHS.
NEAR, SIBLING = 0.5, 0.3
#: How strongly a heading hangs on the block that it stands before.
HEADS = 3.0
STRENGTHS = (0.25, 0.5, 1.0, 2.0, 4.0)
#: Most log odds that a block has of its own.
MOST_ODDS = 4.0
#: Log odds of sections, and how strongly blocks and inner sections hang on them.
SECTION_ODDS = {"boiler": -12.0, "named": -10.0, "content": 8.0, "hinted": 4.0}
SECTION_HOLD = {"boiler": 8.0, "named": 6.0, "content": 4.5, "hinted": 2.5}
#: How strongly sections hang on sections around them that aren't boilerplate.
LOOSE = 1.0

@dataclass(slots=True)
class Page:
    """Blocks in page order, each with its element, and elements with their parents. Element 0 is the page; parents
    come before their children."""

    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    names: dict[int, tuple[str, str]] = field(default_factory=dict)  # role, and the words of the other names
    closed: set[int] = field(default_factory=set)  # elements of SILENT that have an end


def grouped(names: dict[str, str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for group, tags in names.items():
        for tag in tags.split():
            found.setdefault(tag, []).append(group)
    return found


GROUPS_OF, BOUNDS_OF = grouped(MEMBERS), grouped(BOUNDS)
#: What a start tag ends: the outermost group first.
ENDED_BY = {tag: groups for tag in {*ENDS_PARAGRAPH, *GROUPS_OF} if (groups := (["p"] if tag in ENDS_PARAGRAPH else []) + (["row"] if tag in ("thead", "tbody", "tfoot") else []) + GROUPS_OF.get(tag, []))}


def names_of(attributes: str) -> tuple[str, str]:
    role, words = "", []
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            role = value.strip()
        else:
            words.append(value)
    return role, " ".join(words)


def parsed(source: str) -> Page:
    """The page's blocks and elements. Tags may be left out, misnested or cut off."""
    page = Page()
    texts, links_of, at_of, parent, depth, tag_of = page.texts, page.links, page.at, page.parent, page.depth, page.tag
    stack = [0]
    open_tags: dict[str, int] = {}
    #: Of each group the places in the stack of its open elements, and of its bounds as negative numbers.
    places: dict[str, list[int]] = {group: [] for group in MEMBERS}
    parts: list[str] = []
    link, links, foreign = False, 0, 0
    endless: set[str] = set()  # elements of RAW that no end tag follows any more

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                texts.append(text)
                links_of.append(links)
                at_of.append(stack[-1])
            parts.clear()
        links = 0

    def say(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link:
            links += len(text)

    def pop_to(size: int) -> None:
        nonlocal link, foreign
        while len(stack) > size:
            tag = tag_of[stack.pop()]
            open_tags[tag] -= 1
            foreign -= tag in FOREIGN
            for group in GROUPS_OF.get(tag, ()):
                places[group].pop()
            for group in BOUNDS_OF.get(tag, ()):
                places[group].pop()
        link = False

    at, search = 0, TOKEN.search
    while m := search(source, at):
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag, closing = name.lower(), m[1] == "/"
        if tag in INLINE:
            if tag == "a":
                link = not closing
            continue
        raw = tag in RAW and (not foreign or tag in ("script", "style"))  # in a drawing a title is like any element
        if raw and not closing:
            end = None if tag in endless else ENDS[tag].search(source, at)
            if end:
                at = end.start()
            else:
                endless.add(tag)
                # Code without an end runs to the end of the page; other text without an end runs to the next tag.
                at = len(source) if tag in ("script", "style") or (start := source.find("<", at)) < 0 else start
            continue
        if raw or tag in ("html", "head", "body"):
            flush()  # the tags of these three may be left out, and say nothing of the text by themselves
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if open_tags.get(tag):
                size = len(stack) - 1
                while tag_of[stack[size]] != tag:
                    size -= 1
                if tag in SILENT:
                    page.closed.add(stack[size])
                pop_to(size)
            elif tag in HEADINGS and places["heading"] and places["heading"][-1] > 0:
                pop_to(places["heading"][-1])  # any heading's end tag ends the open one
            continue
        if foreign and tag in ENDS_PARAGRAPH:
            size = len(stack)
            while foreign:  # what can't stand in a drawing ends it
                size -= 1
                if tag_of[stack[size]] in FOREIGN:
                    page.closed.add(stack[size])
                    pop_to(size)
        for group in ENDED_BY.get(tag, ()):
            if places[group] and places[group][-1] > 0:
                pop_to(places[group][-1])
        if m[3].endswith("/") and foreign:
            continue
        number = len(parent)
        parent.append(stack[-1])
        depth.append(depth[stack[-1]] + 1)
        tag_of.append(tag)
        if m[3] and "=" in m[3]:
            role, words = names_of(m[3])
            if role or words:
                page.names[number] = role, words
        for group in GROUPS_OF.get(tag, ()):
            places[group].append(len(stack))
        for group in BOUNDS_OF.get(tag, ()):
            places[group].append(-len(stack))
        stack.append(number)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        foreign += tag in FOREIGN
    if at < len(source):
        say(source[at:])
    flush()
    return heard(page)


def heard(page: Page) -> Page:
    """The page without the blocks of closed elements of SILENT."""
    if page.closed:
        silent = [False] * len(page.parent)
        for e in range(1, len(page.parent)):
            silent[e] = silent[page.parent[e]] or e in page.closed
        kept = [i for i, e in enumerate(page.at) if not silent[e]]
        for column in ("texts", "links", "at"):
            old = getattr(page, column)
            setattr(page, column, [old[i] for i in kept])
    return page


def kind_of(page: Page, e: int) -> str | None:
    """What an element's tag, role and names say of it."""
    tag = page.tag[e]
    role, names = page.names.get(e, ("", ""))
    words = set(NAME_WORD.findall(names))
    boiler, content = bool(words & BOILER_WORDS), bool(words & CONTENT_WORDS)
    if tag in BOILER_TAGS or role in BOILER_ROLES:
        return "boiler"
    if tag in CONTENT_TAGS or role in CONTENT_ROLES:
        return "named" if boiler and not content else "content"
    if tag == "header":
        return "header"
    if boiler != content:
        return "named" if boiler else "hinted"
    return None


def sections_of(page: Page) -> tuple[list[int], list[str], list[int], list[int]]:
    """Sections: their elements, kinds, and the sections around them (-1: none); and the nearest section of each element."""
    elements, kinds, around, nearest = [], [], [], [-1] * len(page.parent)
    content = [False] * len(page.parent)
    spoken = page.names
    for e in range(1, len(page.parent)):
        up = page.parent[e]
        nearest[e], content[e] = nearest[up], content[up]
        tag = page.tag[e]
        if e not in spoken and tag not in BOILER_TAGS and tag not in CONTENT_TAGS and tag != "header":
            continue
        kind = kind_of(page, e)
        if kind == "header":  # of an article, a header holds its title
            kind = None if content[up] else "boiler"
        if kind:
            content[e] = content[up] or kind == "content"
            around.append(nearest[up])
            nearest[e] = len(elements)
            elements.append(e)
            kinds.append(kind)
    return elements, kinds, around, nearest


def unwrapped(page: Page, sections: tuple[list[int], list[str], list[int], list[int]]) -> list[str | None]:
    """The sections' kinds; None for what would be boilerplate but wraps the page's text, and content for the only
    article or main element, whatever its name."""
    elements, kinds, around, nearest = sections
    count = len(elements)
    kinds = list(kinds)
    tagged = [page.tag[e] in CONTENT_TAGS or page.names.get(e, ("", ""))[0] in CONTENT_ROLES for e in elements]
    holds, told = [False] * count, [False] * count  # an article in it; boilerplate around it
    for s in range(count):
        told[s] = around[s] >= 0 and (told[around[s]] or kinds[around[s]] == "boiler" or (kinds[around[s]] == "named" and not tagged[around[s]]))
    for s in range(count - 1, -1, -1):
        if around[s] >= 0 and (holds[s] or tagged[s]):
            holds[around[s]] = True
    plain = sum(k == "content" and not t for k, t in zip(kinds, told, strict=True))
    named = [s for s in range(count) if tagged[s] and kinds[s] == "named" and not told[s]]
    for s in named:
        if holds[s]:
            kinds[s] = None
    alone = [s for s in named if not holds[s]]
    # Text by the innermost boilerplate around it; none: -1.
    inner = [-1] * count
    for s in range(count):
        up = inner[around[s]] if around[s] >= 0 else -1
        inner[s] = s if kinds[s] in ("boiler", "named") else up
    own, free = [0] * count, 0
    for text, e in zip(page.texts, page.at, strict=True):
        s = inner[nearest[e]] if nearest[e] >= 0 else -1
        if s >= 0:
            own[s] += len(text)
        else:
            free += len(text)
    if not plain and len(alone) == 1 and (page.tag[elements[alone[0]]] == "main" or own[alone[0]] > free):
        kinds[alone[0]] = "content"
    # What marks the page's article: article and main elements, or else names, or else first-level headings.
    marks, every = [0] * count, 0
    for mark in ("content", "hinted"):
        if not every and (every := kinds.count(mark)):
            marks = [int(k == mark) for k in kinds]
    if not every:
        for e in [e for e, tag in enumerate(page.tag) if tag == "h1"]:
            every += 1
            if nearest[e] >= 0:
                marks[nearest[e]] += 1
    for s in range(count - 1, -1, -1):
        if around[s] >= 0:
            marks[around[s]] += marks[s]
    # Sections with all marks lie in one another, so an inner one's text is what the outer one wraps, too.
    found, inside = list(kinds), 0
    for s in range(count - 1, -1, -1):
        if kinds[s] in ("boiler", "named") and every and marks[s] == every:
            inside += own[s]
            if inside > free:
                found[s] = None
    return found


def features_of(page: Page) -> np.ndarray:
    """A row of FEATURES for each block."""
    texts, n = page.texts, len(page.texts)
    x = np.ones((n, len(FEATURES)))
    size = np.fromiter(map(len, texts), np.float64, n)
    words = np.fromiter((t.count(" ") for t in texts), np.float64, n) + 1
    links = np.array(page.links, np.float64)
    at = np.array(page.at, np.int64)
    up = np.array(page.parent, np.int64)[at]
    chars_up, links_up = np.bincount(up, size, len(page.parent)), np.bincount(up, links, len(page.parent))
    x[:, 1] = np.log1p(words)
    x[:, 2] = np.minimum(1.0, links / size)
    x[:, 3] = np.fromiter((t[-1] in SENTENCE_END for t in texts), np.float64, n)
    x[:, 4] = np.minimum(1.0, np.fromiter((t.count(",") + t.count(". ") + t.count("，") + t.count("。") for t in texts), np.float64, n) / 3)
    x[:, 5] = np.fromiter(("©" in t for t in texts), np.float64, n)
    x[:, 6] = np.minimum(1.0, links_up[up] / np.maximum(chars_up[up], 1))
    return x


def costs_of(page: Page, weights: np.ndarray) -> np.ndarray:
    """Each block's log odds of being content; a heading has none."""
    headings = np.fromiter((page.tag[e] in HEADINGS for e in page.at), bool, len(page.at))
    return np.where(headings, 0.0, np.clip(features_of(page) @ weights, -MOST_ODDS, MOST_ODDS))


def smoothness(page: Page, strength: float) -> tuple[array, array, array]:
    """Edges between blocks: ends and capacities."""
    parent, depth, at = page.parent, page.depth, page.at
    left, right, room, last = array("q"), array("q"), array("d"), {}
    for i, e in enumerate(at):
        if i:
            a, b, steps = at[i - 1], e, 0
            while a != b:  # steps sum to no more than twice the elements: the page is walked once
                if depth[a] >= depth[b]:
                    a = parent[a]
                else:
                    b = parent[b]
                steps += 1
            left.append(i - 1)
            right.append(i)
            room.append(strength * NEAR * 2 / max(2, steps))
        if page.tag[e] in HEADINGS and i + 1 < len(at):
            left.append(i)
            right.append(i + 1)
            room.append(strength * HEADS)
        before = last.get(parent[e])
        if before is not None and before != i - 1:
            left.append(before)
            right.append(i)
            room.append(strength * SIBLING)
        last[parent[e]] = i
    return left, right, room


def labels_of(page: Page, kinds: list[str | None], nearest: list[int]) -> np.ndarray:
    """What sections alone say of each block: 1 content, 0 boilerplate, -1 nothing."""
    says = {"content": 1, "boiler": 0, "named": 0}
    return np.array([says.get(kinds[nearest[e]], -1) if nearest[e] >= 0 else -1 for e in page.at], np.int64)


def cut_of(page: Page, weights: np.ndarray, strength: float, marked: bool = True) -> list[bool]:
    """Which blocks are content. marked: whether sections have terminal capacities."""
    n = len(page.texts)
    odds = costs_of(page, weights)
    left, right, room = smoothness(page, strength)
    sections = sections_of(page)
    elements, _, around, nearest = sections
    kinds = unwrapped(page, sections)
    if marked and elements:
        blocks = [0] * len(elements)
        for i, e in enumerate(page.at):
            if (s := nearest[e]) >= 0 and kinds[s]:
                blocks[s] += 1
                left.append(i)
                right.append(n + s)
                room.append(SECTION_HOLD[kinds[s]])
        # A section speaks for each of its blocks, so many doubtful ones don't outweigh it; boilerplate, for those of the
        # sections in it, too.
        inside = list(blocks)
        for s in range(len(elements) - 1, -1, -1):
            if around[s] >= 0:
                inside[around[s]] += inside[s]
        blocks = [i if k in ("boiler", "named") else b for k, i, b in zip(kinds, inside, blocks, strict=True)]
        odds = np.concatenate([odds, [SECTION_ODDS.get(k, 0.0) * max(1, b) for k, b in zip(kinds, blocks, strict=True)]])
        for s, t in enumerate(around):
            if t >= 0 and kinds[s]:
                left.append(n + s)
                right.append(n + t)
                # Boilerplate holds what it encloses; an article doesn't hold the menus in it.
                held = kinds[t] in ("boiler", "named") and kinds[s] != "boiler"
                room.append(2 * SECTION_HOLD[kinds[t]] * max(1, inside[s]) if held else LOOSE)
    return minimum_cut(odds, left, right, room)[:n]


def refined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression, drawn to the prior weights, by Newton's method."""
    w = prior = np.array(PRIOR)
    for _ in range(25 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + PULL * np.eye(len(w)), x.T @ (p - y) + PULL * (w - prior))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def minimum_cut(odds: Sequence[float], left: Sequence[int], right: Sequence[int], room: Sequence[float]) -> list[bool]:
    """Which nodes are on the source's side. odds: capacity from the source if positive, else to the sink. An edge
    joins a left node to a right one, with its room both ways."""
    n = len(odds)
    odds = np.array(odds, np.float64)
    i, j, c = np.array(left, np.int64), np.array(right, np.int64), np.array(room, np.float64)
    side = np.zeros(n, np.int8)
    # Whole arrays first, while they decide many nodes at a time; then node by node.
    while True:
        weight = np.bincount(i, c, n) + np.bincount(j, c, n)
        new = (side == 0) & (np.abs(odds) >= weight)
        side[new] = np.where(odds[new] >= 0, 1, -1)
        for one, other in ((i, j), (j, i)):
            pushes = new[one] & (side[other] == 0)
            odds += np.bincount(other[pushes], c[pushes] * side[one[pushes]], n)
        open_edges = (side[i] == 0) & (side[j] == 0)
        i, j, c = i[open_edges], j[open_edges], c[open_edges]
        if new.sum() < 100:
            break
    rest = np.flatnonzero(side == 0)
    if len(rest):
        place = np.zeros(n, np.int64)
        place[rest] = np.arange(len(rest))
        side[rest] = np.where(folded(odds[rest].tolist(), place[i].tolist(), place[j].tolist(), c.tolist()), 1, -1)
    return (side > 0).tolist()


def folded(odds: list[float], left: list[int], right: list[int], room: list[float]) -> list[bool]:
    """The cut, after nodes whose capacity outweighs their edges have become part of their neighbours' terminals."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in zip(left, right, room, strict=True):
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    side: list[bool | None] = [None] * n
    weight = [sum(x.values()) for x in near]
    ready = deque(i for i in range(n) if abs(odds[i]) >= weight[i])
    while ready:
        i = ready.popleft()
        if side[i] is not None:
            continue
        side[i] = odds[i] >= 0
        for j, c in near[i].items():
            if side[j] is None:
                odds[j] += c if side[i] else -c
                weight[j] -= c
                near[j].pop(i)
                if abs(odds[j]) >= weight[j]:
                    ready.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, s in zip(rest, flow_cut(rest, odds, near, side), strict=True):
            side[i] = s
    return [bool(s) for s in side]


def flow_cut(nodes: list[int], odds: list[float], near: list[dict[int, float]], fixed: list[bool | None]) -> list[bool]:
    """Maximum flow by shortest augmenting paths in phases (Dinic), then what the source still reaches."""
    place = {v: k for k, v in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    graph: list[list[int]] = [[] for _ in range(len(nodes) + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for v in nodes:
        if odds[v] > 0:
            join(source, place[v], odds[v], 0.0)
        elif odds[v] < 0:
            join(place[v], sink, -odds[v], 0.0)
        for j, c in near[v].items():
            if fixed[j] is None and v < j:
                join(place[v], place[j], c, c)
    tiny = 1e-12

    def levels() -> list[int]:
        level = [-1] * len(graph)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        return level

    while (level := levels())[sink] >= 0:
        upto = [0] * len(graph)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, at = [], source
                continue
            while upto[at] < len(graph[at]) and not (room[e := graph[at][upto[at]]] > tiny and level[to[e]] == level[at] + 1):
                upto[at] += 1
            if upto[at] < len(graph[at]):
                path.append(graph[at][upto[at]])
                at = to[path[-1]]
            elif at == source:
                break
            else:
                level[at] = -1
                at = to[path.pop() ^ 1]
    reached = levels()
    return [reached[k] >= 0 for k in range(len(nodes))]


@dataclass
class Classifier:
    weights: np.ndarray
    strength: float = 1.0


def main_text(source: str | None, fit: Classifier) -> str:
    page = parsed(source) if source else Page()
    if not page.texts:
        return ""
    return " ".join(t for t, kept in zip(page.texts, cut_of(page, fit.weights, fit.strength), strict=True) if kept)


def labelled(source: str) -> tuple[Page, np.ndarray]:
    page = parsed(source)
    sections = sections_of(page)
    return page, labels_of(page, unwrapped(page, sections), sections[3])


def fitted(pages: DataFrame, html_col: str = "html") -> Classifier:
    """Weights and strength of edges from FIT_PAGES pages; the driver gets FIT_BLOCKS blocks of each at most."""
    spark = pages.sparkSession
    bounded_batches(spark)
    sample = pages.select(F.col(html_col).alias("html")).where("html is not null").orderBy(F.xxhash64("html"), "html").limit(FIT_PAGES)
    names = ["page", "x", "y"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("html").to_pylist():
                page, y = labelled(source)
                told = np.flatnonzero((y >= 0) & np.array([page.tag[e] not in HEADINGS for e in page.at], bool))
                told = told[:: max(1, -(-len(told) // FIT_BLOCKS))]
                x = features_of(page)[told] if len(told) else np.empty((0, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([pa.array([len(page.texts)] * len(told), pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(y[told], pa.int32())], names=names)

    # In order, so that sums of floating point numbers don't depend on how rows were dealt to tasks.
    rows = sample.mapInArrow(blocks, "page long, x array<double>, y int").orderBy(*names).toArrow()
    x = np.array(rows["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    weights = refined(x, rows["y"].to_numpy().astype(np.float64))
    own = weights.tolist()

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(own)
        for batch in batches:
            wrong = np.zeros(len(STRENGTHS), np.int64)
            for source in batch.column("html").to_pylist():
                page, y = labelled(source)
                if (y >= 0).any():
                    wrong += [int((np.array(cut_of(page, w, s, marked=False)) != (y == 1))[y >= 0].sum()) for s in STRENGTHS]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(STRENGTHS)), pa.int32()), pa.array(wrong)], names=["strength", "wrong"])

    found = {r["strength"]: r["wrong"] for r in sample.mapInArrow(errors, "strength int, wrong long").groupBy("strength").sum("wrong").toDF("strength", "wrong").collect()}
    return Classifier(weights, STRENGTHS[min(found, key=lambda s: (found[s], abs(STRENGTHS[s] - 1), s))] if found and len(x) else 1.0)


def extracted(pages: DataFrame, fit: Classifier, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep``, then text and n_chars."""
    bounded_batches(pages.sparkSession)
    own, strength = [float(w) for w in fit.weights], fit.strength

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Classifier(np.array(own), strength)
        for batch in batches:
            texts = [main_text(t, w) for t in batch.column("_html").to_pylist()]
            columns = [*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, pages[html_col].alias("_html")).mapInArrow(work, f"{kinds}text string, n_chars long")
