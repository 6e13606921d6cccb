"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A linear classifier over a block's ancestors, links and words gives two costs,
the capacities to the source (content) and the sink (boilerplate). Neighbouring blocks and blocks under one parent are
tied by smoothness edges, weaker the more tags lie between them. The minimum cut, found by maximum flow, labels all
blocks of the page at once; the text is the content blocks in page order.

Pages are independent: one map without a shuffle, whole pages, nothing dropped or capped.

Defined results: a null or empty page has empty text and 0 characters; text outside any tag is a block like any other;
unclosed tags end with their parent, an unclosed comment, script or style with the page; repeated rows are all returned.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|canvas|object|math|select|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

# Element names of HTML and telling names of classes and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
                   "thead tr ul button option".split())
CLOSES_P = BLOCKS - {"html", "body", "head", "button", "option"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu button dialog head fieldset option legend".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side aside widget comment comments respond disqus "
    "cookie cookies consent notice banner popup modal overlay menu nav navigation navbar breadcrumb breadcrumbs footer header masthead topbar "
    "share sharing social related recommended newsletter subscribe subscription login signup pagination pager toolbar copyright legal skip search".split())
CONTENT_NAMES = frozenset("article content main post entry story body text".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

WEIGHTS = {"bias": -1.2, "content": 4.0, "boilerplate": -9.0, "words": 2.2, "links": -4.0, "stops": 0.8, "heading": 0.6, "paragraph": 0.8}
ADJACENT, SIBLING, REACH = 0.5, 0.4, 4.0


@dataclass
class Block:
    text: str
    tag: str
    parent: int          # number of the enclosing element
    depth: int
    content: bool
    boilerplate: bool
    links: int           # characters inside links


@dataclass
class _Element:
    name: str
    number: int
    content: bool
    boilerplate: bool
    link: bool


def _hints(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element says that it holds content, or boilerplate."""
    content, boilerplate = name in CONTENT_TAGS, name in BOILERPLATE_TAGS or name == "header" and not inside
    if attributes and "=" in attributes or "hidden" in attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            value, key = a or b or c, key.lower()
            if key in ("class", "id"):
                for part in value.split():
                    parts = {x.lower() for x in NAME.findall(part)}
                    boilerplate |= bool(parts & BOILERPLATE_NAMES) and not (inside and parts & {"header"} and name != "div")
                    content |= bool(parts & CONTENT_NAMES) and not parts & BOILERPLATE_NAMES
            elif key == "role":
                boilerplate |= value.lower() in BOILERPLATE_ROLES
                content |= value.lower() in ("main", "article")
            elif key == "style":
                boilerplate |= "display:none" in value.replace(" ", "").lower()
            else:
                boilerplate |= value.lower() != "false"
    if name in ("html", "body"):
        return False, False
    return content, boilerplate


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order: what stands between the starts and ends of block elements."""
    stack = [_Element("", 0, False, False, False)]
    blocks: list[Block] = []
    pieces: list[str] = []
    links, count, at = 0, 0, 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(pieces).split())
        if text:
            holder = next((e for e in reversed(stack) if e.name in BLOCKS), stack[0])
            above = stack[max(0, stack.index(holder) - 1)]
            blocks.append(Block(text, holder.name, above.number, len(stack), stack[-1].content, stack[-1].boilerplate, min(links, len(text))))
        pieces.clear()
        links = 0

    def close_to(index: int) -> None:
        flush()
        del stack[index:]

    def innermost(names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in stop:
                return 0
        return 0

    for token in TOKEN.finditer(page):
        if token.start() > at:
            piece = html.unescape(page[at:token.start()])
            pieces.append(piece)
            if stack[-1].link:
                links += len(piece.strip())
        at = token.end()
        name = (token[3] or token[6] or "").lower()
        if not name:
            continue
        if token[2] or token[5]:
            where = innermost({name})
            if where:
                if any(e.name in BLOCKS for e in stack[where:]):
                    close_to(where)
                else:
                    del stack[where:]
            elif name in BLOCKS:
                flush()
            continue
        attributes = token[4] or token[7] or ""
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                pieces.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if name in CLOSES_P and (where := innermost({"p"}, frozenset({"td", "th", "button"}))):
            close_to(where)
        if name in SAME_LEVEL and (where := innermost(SAME_LEVEL[name], frozenset({"ul", "ol", "dl", "table", "menu"}))):
            close_to(where)
        if name == "body" and (where := innermost({"head"})):
            close_to(where)
        top = stack[-1]
        content, boilerplate = _hints(name, attributes, top.content)
        count += 1
        if not attributes.rstrip().endswith("/") or name in BLOCKS:
            stack.append(_Element(name, count, top.content or content, top.boilerplate or boilerplate, top.link or name == "a"))
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    flush()
    return blocks


def score(block: Block) -> float:
    """Log odds that a block is content."""
    words = block.text.count(" ") + 1
    w = WEIGHTS
    return (w["bias"] + w["content"] * block.content + w["boilerplate"] * block.boilerplate + w["words"] * min(1.0, words / 25)
            + w["links"] * block.links / len(block.text) + w["stops"] * min(1.0, sum(map(block.text.count, ".!?")) / 2)
            + w["heading"] * (block.tag in ("h1", "h2", "h3")) + w["paragraph"] * (block.tag == "p"))


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut, the largest such side; by shortest augmenting paths.

    ``edges`` are undirected. A node keeps only what its two terminal capacities differ in: the rest flows at once.
    """
    size = len(source)
    spare = [a - b for a, b in zip(source, sink)]            # > 0: left from the source, < 0: left to the sink
    near: list[dict[int, float]] = [{} for _ in range(size)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    tiny = 1e-9
    while True:
        before = {i: i for i in range(size) if spare[i] > tiny}
        queue, end = deque(before), -1
        while queue and end < 0:
            a = queue.popleft()
            for b, c in near[a].items():
                if c > tiny and b not in before:
                    before[b] = a
                    if spare[b] < -tiny:
                        end = b
                        break
                    queue.append(b)
        if end < 0:
            break
        path = [end]
        while before[path[-1]] != path[-1]:
            path.append(before[path[-1]])
        path.reverse()
        flow = min(spare[path[0]], -spare[end], *(near[a][b] for a, b in zip(path, path[1:])))
        spare[path[0]] -= flow
        spare[end] += flow
        for a, b in zip(path, path[1:]):
            near[a][b] -= flow
            near[b][a] = near[b].get(a, 0.0) + flow
    # nodes from which the sink can still be reached are its side
    reached = [s < -tiny for s in spare]
    queue = deque(i for i in range(size) if reached[i])
    while queue:
        b = queue.popleft()
        for a in near[b]:
            if not reached[a] and near[a].get(b, 0.0) > tiny:
                reached[a] = True
                queue.append(a)
    return [not r for r in reached]


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours and between a block and the last one under the same parent."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            before = blocks[i - 1]
            apart = abs(block.depth - before.depth) + 2 * (block.parent != before.parent)
            edges.append((i - 1, i, ADJACENT * math.exp(-apart / REACH)))
        if block.parent in last:
            edges.append((last[block.parent], i, SIBLING))
        last[block.parent] = i
    return edges


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scores = [score(b) for b in blocks]
    source = [max(0.0, s) + math.log1p(math.exp(-abs(s))) for s in scores]
    sink = [a - s for a, s in zip(source, scores)]
    keep = minimum_cut(source, sink, smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_text(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the page by default) with ``text`` and ``n_chars``."""
    names = [c for c in pages.columns if c != page] if keep is None else list(keep)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "__page"):
            found = [main_text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(found, pa.string()), pa.array([len(f) for f in found], pa.int64())],
                names=[*batch.schema.names[:len(names)], "text", "n_chars"])

    schema = pages.select(*names).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*names, F.col(page).alias("__page")).mapInArrow(extract, schema)
