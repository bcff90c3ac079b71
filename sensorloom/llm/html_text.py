"""Main text of web pages by minimum cut.

A page becomes a chain of text blocks. A linear classifier over tags, names, link density and
text turns each block into two terminal capacities (the cost of calling it boilerplate or
content); neighbours in the page and in the DOM are tied by smoothness edges. The minimum cut
is the cheapest consistent labelling: short lines inside an article stay with it, long notices
in a sidebar do not.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.arrow_text import slices, trimmed

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul select option button head".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("table ul ol dl div article section main body html td th nav aside select menu".split())
GROUPS = frozenset("article aside body center details dialog div fieldset footer form header main menu nav section td th table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANCHORS = HEADINGS | {"p", "li", "dt", "dd", "a", "span"}  # their ids name places in a text, not its layout
BOILER_TAGS = frozenset("nav aside footer menu select button dialog option head".split())
SOFT_TAGS = frozenset("header form fieldset".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu sidebar "
    "sidenav aside footer foot masthead topbar toolbar breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr privacy popup modal overlay "
    "notice notices alert newsletter subscribe subscription signup login signin share sharing social related recommended recommendations teaser widget "
    "comment comments commentlist disqus respond reply replies copyright legal disclaimer skip search searchform form contentinfo complementary "
    "banner dialog tagcloud toc shoutbox paywall".split()
)
# Words that may stand beside a name of boilerplate in one class or id ("site-footer", "nav_list") without changing what it names.
LAYOUT_NAMES = frozenset(
    "site page main left right top bottom primary secondary global wrapper wrap container area block box section list item items inner outer header "
    "head bar link links content post entry article story text body js id col column row mobile desktop sticky fixed unit slot module panel field "
    "button btn group title meta info big small large mini my the facebook twitter google".split()
)
ABSENCE_NAMES = frozenset("no not without hide has with category categories tag tags topic format type".split())
SOFT_NAMES = frozenset("header head top".split())
MAIN_NAMES = frozenset("article main".split())
CONTENT_NAMES = frozenset("article main content post entry story text body".split())

# Log-odds of content, in units of the smoothness edges.
W_BOILER, W_MAIN, W_OUTSIDE, W_NAMED, W_LINKS, W_PRIOR = -9.0, 6.0, -4.0, 3.0, -5.0, -0.5
W_HEADING = 0.8
TIE_NEXT, TIE_BESIDE, TIE_FAR, TIE_SIBLING = 1.0, 0.5, 0.3, 0.8


def boilerplate_name(value: str) -> tuple[bool, bool]:
    """Whether a class, id or role names boilerplate outright, and whether it may.

    Each name is judged whole: outright only if all its words are of boilerplate or layout
    ("site-footer"), not if it says what is absent or filed where ("no-sidebar", "tag-legal").
    """
    outright = perhaps = False
    for name in value.split():
        words = {w.lower() for w in NAME.findall(name)}
        if words & BOILER_NAMES and not words & ABSENCE_NAMES:
            if words <= BOILER_NAMES | LAYOUT_NAMES:
                outright = True
            else:
                perhaps = True
    return outright, perhaps


class Place:
    """An open element: its name and what its blocks inherit."""

    __slots__ = ("name", "group", "boiler", "soft", "main", "named")

    def __init__(self, name: str, key: int, above: Place | None, attributes: str):
        self.name, self.group = name, key if above is None or name in GROUPS else above.group
        boiler = above.boiler if above else False
        soft, main, named = (above.soft, above.main, above.named) if above else (False, False, False)
        if name in BOILER_TAGS:
            boiler = True
        elif name in MAIN_TAGS:
            soft, main = False, True
        elif name in SOFT_TAGS and not main:
            soft = True
        if len(attributes) > 3 and name not in ("html", "body"):
            for match in ATTRIBUTE.finditer(attributes):
                kind, value = match[1].lower(), (match[2] or "").strip("\"'")
                if kind == "style":
                    boiler = boiler or bool(HIDDEN.search(value))
                elif kind == "hidden" or kind == "aria-hidden":
                    boiler = boiler or value.lower() in ("", "true", "hidden")
                elif kind != "id" or name not in ANCHORS:
                    words = {w.lower() for w in NAME.findall(value)}
                    outright, perhaps = boilerplate_name(value) if words & BOILER_NAMES else (False, False)
                    boiler = boiler or outright
                    soft = soft or perhaps and not main
                    if outright or perhaps:
                        pass
                    elif kind == "role" and words & MAIN_NAMES:
                        soft, main = False, True
                    elif words & CONTENT_NAMES:
                        named = True
                    elif words & SOFT_NAMES and not main and name not in HEADINGS:
                        soft = True
        self.boiler, self.soft, self.main, self.named = boiler, soft, main, named


class Block:
    __slots__ = ("text", "links", "place", "heading")

    def __init__(self, text: str, links: int, place: Place, heading: bool):
        self.text, self.links, self.place, self.heading = text, links, place, heading


def parse_blocks(html: str) -> list[Block]:
    """Text blocks in page order; white space inside is one space, character references are decoded."""
    stack = [Place("", 0, None, "")]
    blocks: list[Block] = []
    pieces: list[str] = []
    at = links = anchors = keys = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                blocks.append(Block(text, min(links, len(text)), stack[-1], any(p.name in HEADINGS for p in stack[-3:])))
            pieces.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal anchors
        for place in stack[depth:]:
            anchors -= place.name == "a"
        del stack[depth:]

    n = len(html)
    while at < n:
        match = TAG.search(html, at)
        end = match.start() if match else n
        if end > at:
            piece = html[at:end]
            pieces.append(piece)
            if anchors > 0:
                links += len(piece)
        if not match:
            break
        at = match.end()
        name = match[2]
        if name is None:
            if match[0].startswith("<![CDATA["):
                pieces.append(match[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        block = name in BLOCK
        if block:
            flush()
        if match[1]:
            depth = len(stack) - 1
            while depth > 0 and stack[depth].name != name and (block or stack[depth].name not in BLOCK):
                depth -= 1
            if depth > 0 and stack[depth].name == name:
                close(depth)
            continue
        if name == "br":
            pieces.append(" ")
        if name in VOID or match[3].endswith("/") and not block and name not in RAW:
            continue  # "<svg/>", "<i/>": nothing is inside
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else n
            continue
        if block:
            shut = CLOSES.get(name, ())
            depth = len(stack) - 1
            while depth > 0 and stack[depth].name not in SCOPES:
                if stack[depth].name in shut or stack[depth].name == "p" and name != "button":
                    close(depth)
                    break
                depth -= 1
            else:
                if depth > 0 and stack[depth].name in shut:
                    close(depth)
        keys += 1
        stack.append(Place(name, keys, stack[-1], match[3]))
        anchors += name == "a"
    flush()
    return blocks


def content_score(block: Block, has_main: bool) -> float:
    """Log-odds of content: above 0 the block looks like content."""
    place, text = block.place, block.text
    if place.boiler:
        return W_BOILER
    words = text.count(" ") + 1
    score = W_PRIOR + min(2.0, words / 15) + (W_MAIN if place.main else W_OUTSIDE if has_main else 0.0)
    if place.named:
        score += W_NAMED
    if block.heading:
        score += W_HEADING
    if place.soft:
        score += W_OUTSIDE
    score += W_LINKS * (block.links / len(text)) ** 2
    if text[-1] in ".!?:;…\"'”»)":
        score += 0.7
    elif words < 5 and not block.heading:
        score -= 1.0
    return score


def minimum_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Content labels that minimise the cost of blocks against their score plus that of cut ties.

    A block whose score outweighs all its open ties keeps its own side in some minimum cut, so
    it is fixed first and its ties become part of its neighbours' scores; what is left goes
    through a maximum flow.
    """
    n = len(scores)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in ties:
        near[a].append((b, w))
        near[b].append((a, w))
    score, open_ties = list(scores), [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(score[i]) < open_ties[i]:
            continue
        label[i] = score[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                score[j] += w if label[i] else -w
                open_ties[j] -= w
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        at = {i: k + 2 for k, i in enumerate(rest)}
        arcs = [(0, at[i], score[i], 0.0) if score[i] > 0 else (at[i], 1, -score[i], 0.0) for i in rest]
        arcs += [(at[a], at[b], w, w) for a, b, w in ties if a in at and b in at]
        reached = source_side(len(rest) + 2, arcs)
        for i in rest:
            label[i] = at[i] in reached
    return [bool(x) for x in label]


def source_side(n: int, arcs: list[tuple[int, int, float, float]]) -> set[int]:
    """Nodes on the side of node 0 of a minimum cut between 0 and 1 (shortest augmenting paths)."""
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, there, back in arcs:
        room[a][b] = room[a].get(b, 0.0) + there
        room[b][a] = room[b].get(a, 0.0) + back
    while True:
        via, queue = {0: 0}, deque([0])
        while queue and 1 not in via:
            x = queue.popleft()
            for y, r in room[x].items():
                if r > 1e-9 and y not in via:
                    via[y] = x
                    queue.append(y)
        if 1 not in via:
            return set(via)
        path, y = [], 1
        while y:
            path.append((via[y], y))
            y = via[y]
        amount = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= amount
            room[b][a] += amount


def main_text(html: str) -> str:
    """The content blocks of a page, one a line."""
    blocks = parse_blocks(html)
    has_main = any(b.place.main and not b.place.boiler for b in blocks)
    ties = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        key = block.place.group
        if i:
            before = blocks[i - 1].place
            same = before.main == block.place.main and before.boiler == block.place.boiler
            ties.append((i - 1, i, (TIE_NEXT if before.group == key else TIE_BESIDE) if same else TIE_FAR))
        if key in last and last[key] != i - 1:
            ties.append((last[key], i, TIE_SIBLING))
        last[key] = i
    labels = minimum_cut([content_score(b, has_main) for b in blocks], ties)
    return "\n".join(b.text for b, keep in zip(blocks, labels) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` (code points) of every row; null html is empty, null ids and urls stay.

    Pages without content blocks, also empty ones, have an empty text. Nothing is cut short:
    markup that ends early is read as far as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                texts = [main_text(h or "") for h in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")
