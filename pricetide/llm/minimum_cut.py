"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks: the text between two block-level boundaries, with the elements around it. A linear classifier over
words, links, punctuation and the elements' names, roles, classes and ids gives each block a cost of being content and a cost of being
boilerplate; these are the capacities of its edges to the two terminals. Blocks that follow each other and blocks that are
neighbours within one container are joined by smoothness edges, the stronger the closer they stand in the tree. The minimum cut is the
labelling of least total cost; it is found by maximum flow. Blocks whose terminal costs outweigh all their smoothness edges are
labelled first and their edges given to their neighbours' terminals, so the flow runs over the undecided blocks only.

The classifier is a table of fixed costs (`COSTS`), a parameter; nothing is learnt from the pages, so a page's text depends on that page alone.

Defined results: null html is like an empty one: no block, empty text. Pages without markup are one block, which is content. A comment, tag or
script that is open at the end of the page swallows the rest, as browsers do. Long pages are read whole, in one pass over the characters. Cuts of equal cost
(ties) take the one with most content. Repeated rows and null ids stay as they are; an empty table gives no rows; further columns of any name are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

# Fixed values of HTML: elements without an end tag, those that open a new block, and those whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
#: An open element of these ends when one of the named begins.
ENDED_BY = {
    "p": BLOCK - frozenset("body head html title option optgroup".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"]),
    "td": frozenset("td th tr tbody tfoot".split()), "th": frozenset("td th tr tbody tfoot".split()), "tr": frozenset("tr tbody tfoot".split()), "thead": frozenset("tbody tfoot".split()), "tbody": frozenset("tbody tfoot".split())}
#: Elements that such an end never reaches across.
SCOPES = frozenset("article aside body button dialog dl footer form header html main nav ol section table td th ul".split())
#: Form controls, whose text is no text of the block they stand in.
CONTROLS = frozenset(["button", "select"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Fixed words of class names, ids and roles.
BOILERPLATE_ELEMENTS = frozenset("aside button dialog fieldset footer form menu nav search select".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts affiliate banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown footer gdpr header login "
    "masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup popups privacy promo promos promotion promoted recommended recommendations related replies reply respond search share sharing "
    "sidebar signin signup skip social sponsor sponsored subscribe subscription tagcloud teaser toolbar topbar widget widgets".split())
CONTENT_WORDS = frozenset("article articlebody blogpost body content entry main post postbody story text".split())

#: Costs in hundredths, for (+) or against (-) content; edges: smoothness between blocks.
COSTS: dict[str, int] = {
    "base": 60, "boilerplate element": -3000, "content element": 500, "outside the article": -450, "header": -3000, "heading": 60, "word": 4, "most words": 160, "mark": 25, "most marks": 100, "mostly linked": -500, "list item": -40,
    "edge follows": 60, "edge siblings": 90, "edge same container": 40}

#: Elements nested deeper stand for the one at this depth, as in browsers: their text stays, and every walk up the tree is short.
DEEPEST = 400

_TOKEN = re.compile(
    r"<!---?>|<!--.*?(?:--!?>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?P<key>class|id|role|itemprop|hidden|aria-hidden)(?![\w-])(?:\s*+=\s*+(?:\"(?P<a>[^\"]*+)\"|'(?P<b>[^']*+)'|(?P<c>[^\s>\"']++)))?", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARKS = re.compile(r"[.,;:!?。、,]")


@dataclass(slots=True)
class Element:
    name: str
    parent: Element | None
    sign: int = 0  # 1: holds content by its name, -1: holds boilerplate
    hard: bool = False  # boilerplate even around an article
    site_header: bool = False
    depth: int = 0
    has_heading: bool = False
    has_article: bool = False


@dataclass(slots=True)
class Block:
    """Text between two boundaries, its words and linked words, and the innermost block-level element around it."""

    text: str
    linked: int
    words: int
    element: Element
    cost: int = field(default=0)


def _names_of(rest: str) -> tuple[set[str], set[str], bool]:
    """Words of class, id and itemprop, roles, and whether the element is hidden."""
    names: set[str] = set()
    roles: set[str] = set()
    hidden = False
    if "=" not in rest and "hidden" not in rest.lower():
        return names, roles, hidden
    for found in _ATTRIBUTE.finditer(rest):
        key = found["key"].lower()
        value = found["a"] or found["b"] or found["c"] or ""
        if found.start() and not (rest[found.start() - 1].isspace() or rest[found.start() - 1] in "/\"'"):
            continue
        if key == "role":
            roles.update(value.lower().split())
        elif key == "hidden":
            hidden = hidden or value.lower() != "until-found"
        elif key == "aria-hidden":
            continue
        else:
            names.update(w.lower() for w in _NAMES.findall(value))
    return names, roles, hidden


def _open(name: str, rest: str, parent: Element) -> Element:
    element = Element(name, parent, depth=parent.depth + 1)
    names, roles, hidden = _names_of(rest)
    if name in ("body", "html"):
        return element
    if hidden or name in BOILERPLATE_ELEMENTS or roles & BOILERPLATE_ROLES:
        element.sign, element.hard = -1, name != "form" or hidden
    elif name == "header":
        element.site_header = True
    elif names & BOILERPLATE_WORDS and name not in ("main", *HEADINGS):
        element.sign, element.hard = -1, bool(names & {"comment", "comments", "commentlist", "disqus", "replies"})
    elif name in ("article", "main") or roles & {"article", "main"}:
        element.sign = 1
    elif names & CONTENT_WORDS:
        element.sign = 1
    if name in ("article", "main") or roles & {"article", "main"} or "articlebody" in {n.lower() for n in re.findall(r"itemprop\s*=\s*[\"']?(\w+)", rest)}:
        element.has_article = element.sign > 0
    return element


def _common(one: Element, two: Element) -> Element:
    """The innermost element around both."""
    while one is not two:
        if one.depth >= two.depth:
            one = one.parent
        else:
            two = two.parent
    return one


def read_blocks(page: str) -> list[Block]:
    """Blocks of a page in order; scripts, styles, titles, comments and markup are gone."""
    root = Element("html", None)
    stack, blocks = [root], []
    pieces: list[str] = []
    linked: list[str] = []
    links = controls = 0
    deeper: dict[str, int] = {}
    owner = root
    at, end = 0, len(page)

    def close_block() -> None:
        nonlocal owner
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                while owner.name not in BLOCK and not owner.sign and owner.parent is not None:
                    owner = owner.parent
                blocks.append(Block(text, sum(len(p.split()) for p in linked), text.count(" ") + 1, owner))
            pieces.clear()
            linked.clear()

    def add(raw: str) -> None:
        nonlocal owner
        if not raw:
            return
        text = references.unescape(raw) if "&" in raw else raw
        if controls or not pieces and text.isspace():
            return
        owner = _common(owner, stack[-1]) if pieces else stack[-1]
        pieces.append(text)
        if links:
            linked.append(text)

    def pop_to(depth: int) -> None:
        nonlocal links, controls
        while len(stack) > depth:
            gone = stack.pop()
            links -= gone.name == "a"
            controls -= gone.name in CONTROLS

    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["close"]:
            if name in BLOCK:
                close_block()
            if deeper.get(name) and len(stack) >= DEEPEST:
                deeper[name] -= 1
                continue
                if name == "p" and not any(e.name == "p" for e in reversed(stack)):
                    continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    pop_to(k)
                    break
                if name not in BLOCK and stack[k].name in BLOCK:  # an inline end tag closes nothing outside its block
                    break
                if name in ("p", "li", "dd", "dt") and stack[k].name in SCOPES:
                    break
            continue
        if name in BLOCK:
            close_block()
            for k in range(len(stack) - 1, 0, -1):
                if name in ENDED_BY.get(stack[k].name, ()):
                    pop_to(k)
                elif stack[k].name in SCOPES:
                    break
            if name in HEADINGS or name == "main":
                for e in reversed(stack):
                    if name in ("h1", "main"):
                        e.has_heading = True
        if name in RAW:
            if found["rest"].endswith("/") and name == "noscript":
                continue
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in ("br", "hr"):
            add(" ")
        if name in VOID or name in ("html", "body") and any(e.name == name for e in stack[1:]):
            continue
        if name == "a" and links:  # links do not nest
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "a":
                    pop_to(k)
                    break
        if len(stack) >= DEEPEST:
            deeper[name] = deeper.get(name, 0) + 1
            continue
        element = _open(name, found["rest"], stack[-1])
        if element.has_article:
            for e in stack:
                e.has_article = True
        stack.append(element)
        links += name == "a"
        controls += name in CONTROLS
    close_block()
    return blocks


def judge(blocks: list[Block], costs: Mapping[str, int] = COSTS) -> None:
    """Set each block's cost: how much more it costs to call it boilerplate than content."""
    has_article = any(e.has_article for b in blocks[:1] for e in _up(b.element))
    known: dict[int, tuple[int, bool, bool]] = {}

    def around(element: Element) -> tuple[int, bool, bool]:
        """Sign of the nearest element that has one (a hard one anywhere wins), whether it is in an article, in a site's header."""
        chain = []
        e: Element | None = element
        while e is not None and id(e) not in known:
            chain.append(e)
            e = e.parent
        state = known[id(e)] if e is not None else (0, False, False)
        for e in reversed(chain):
            sign, inside, header = state
            wrapper = e.sign < 0 and not e.hard and (e.has_heading or e.has_article)  # a layout around the article
            if e.site_header and not inside:
                header = True
            elif sign == -2 or e.sign < 0 and not wrapper:
                sign = -2
            elif e.sign > 0:
                sign = 1
            inside = inside or e.sign > 0 and e.has_article
            state = known[id(e)] = (sign, inside, header)
        return state

    for block in blocks:
        sign, inside, header = around(block.element)
        cost = costs["base"] + min(block.words * costs["word"], costs["most words"]) + min(len(_MARKS.findall(block.text)) * costs["mark"], costs["most marks"])
        cost += costs["mostly linked"] * max(3 * min(block.linked, block.words) - block.words, 0) // (2 * block.words)
        cost += costs["heading"] * (block.element.name in HEADINGS) + costs["list item"] * (block.element.name == "li")
        if sign == -2:
            cost += costs["boilerplate element"]
        elif header:
            cost += costs["header"]
        elif sign == 1:
            cost += costs["content element"]
        if has_article and not inside:
            cost += costs["outside the article"]
        block.cost = cost or 1


def _up(element: Element | None) -> Iterator[Element]:
    while element is not None:
        yield element
        element = element.parent


def smoothness(blocks: list[Block], costs: Mapping[str, int] = COSTS) -> list[tuple[int, int, int]]:
    """Edges (i, j, capacity) between blocks that follow each other and between neighbours within one container."""
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            before = blocks[i - 1].element
            apart = 0
            one, two = before, block.element
            while one is not two and apart < 6:  # steps up the tree to what both are in
                if one.depth >= two.depth and one.parent is not None:
                    one = one.parent
                elif two.parent is not None:
                    two = two.parent
                apart += 1
            edges[i - 1, i] = costs["edge follows"] // (1 + apart // 2)
        parent = block.element.parent or block.element
        for container, weight in ((block.element, "edge siblings"), (parent, "edge siblings"), (parent.parent, "edge same container")):
            if container is not None and container.name != "html":
                if id(container) in last and last[id(container)] != i:
                    key = last[id(container)], i
                    edges[key] = edges.get(key, 0) + costs[weight]
                last[id(container)] = i
    return [(i, j, c) for (i, j), c in edges.items()]


def minimum_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (true: content) of least cost, for costs `terminal` (above 0: paid as boilerplate, below: paid as content) and edges paid where labels differ.

    Dinic's maximum flow in whole numbers. Of several cuts of least cost the one with most content is taken."""
    count = len(terminal)
    terminal = list(terminal)
    near: list[dict[int, int]] = [{} for _ in range(count)]
    for i, j, c in edges:
        if i != j and c > 0:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    label: list[bool | None] = [None] * count
    # Blocks that no neighbour can turn: their edges become costs of the neighbours.
    weight = [sum(n.values()) for n in near]
    settled = lambda i: 0 < terminal[i] >= weight[i] or -terminal[i] > weight[i]
    ready = [i for i in range(count) if settled(i)]
    while ready:
        i = ready.pop()
        if label[i] is not None:
            continue
        label[i] = terminal[i] >= 0
        for j, c in near[i].items():
            if label[j] is None:
                del near[j][i]
                weight[j] -= c
                terminal[j] += c if label[i] else -c
                if settled(j):
                    ready.append(j)
    rest = [i for i in range(count) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]
    place = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    to: list[int] = []
    left: list[int] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def edge(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(there)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for k, i in enumerate(rest):
        if terminal[i] > 0:
            edge(source, k, terminal[i], 0)
        elif terminal[i] < 0:
            edge(k, sink, -terminal[i], 0)
        for j, c in near[i].items():
            if i < j and j in place:
                edge(k, place[j], c, c)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        line = deque([source])
        while line:
            a = line.popleft()
            for e in out[a]:
                if left[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    line.append(to[e])
        if level[sink] < 0:
            break
        turn = [0] * len(out)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                first = len(path)
                for k, e in enumerate(path):
                    left[e] -= flow
                    left[e ^ 1] += flow
                    if not left[e] and k < first:
                        first = k
                a = to[path[first] ^ 1]
                del path[first:]
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if left[e] and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                turn[a] += 1
    # What cannot reach the sink is content.
    reaches = [False] * len(out)
    reaches[sink] = True
    line = deque([sink])
    while line:
        b = line.popleft()
        for e in out[b]:
            if left[e ^ 1] and not reaches[to[e]]:
                reaches[to[e]] = True
                line.append(to[e])
    for k, i in enumerate(rest):
        label[i] = not reaches[k]
    return [bool(x) for x in label]


def label_page(page: str, costs: Mapping[str, int] = COSTS) -> list[tuple[str, bool]]:
    """Blocks of a page and whether each is content."""
    blocks = read_blocks(page)
    judge(blocks, costs)
    return [(b.text, keep) for b, keep in zip(blocks, minimum_cut([b.cost for b in blocks], smoothness(blocks, costs)), strict=True)]


def main_text(page: str, costs: Mapping[str, int] = COSTS) -> str:
    """Content blocks, one a line."""
    return "\n".join(text for text, keep in label_page(page, costs) if keep)


def extract(pages: DataFrame, costs: Mapping[str, int] = COSTS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points), n_blocks, n_kept."""
    table = dict(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 64) for k in range(0, whole.num_rows, 64)):
                labelled = [label_page(h or "", table) for h in batch.column("html").to_pylist()]
                kept = [[t for t, keep in blocks if keep] for blocks in labelled]
                texts = ["\n".join(k) for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in labelled], pa.int64()), pa.array([len(k) for k in kept], pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")


@query("op12_minimum_cut")
def op12_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
