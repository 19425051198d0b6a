r"""Main text of web pages by a minimum cut over text blocks.

A page becomes a row of text blocks, each knowing the containers it lies in. A logistic classifier gives every block a cost of being
content and of being boilerplate; the costs are the capacities from the source and to the sink. Neighbours in page order, and
neighbours among the blocks of one container, are joined by smoothness edges whose capacity halves with every step between them in
the document tree. The maximum flow's source side is the content: the labelling of least total cost.

The classifier is fitted on the blocks of at most `sample` pages, labelled by what pages say of themselves: blocks within article or
main are content, blocks within menus, footers, asides, forms and containers with telling class names are not. A name says nothing of an article, a
main element or a container of one, and nothing where it tells what is had or not had (has-sidebar, with-ads, no-menu); a
reader's comment may be an article. Formulas, drawings and fallback texts are inline text like any other. The classifier is fitted on
each block twice, with and without its container features, so that pages without such markup are still judged by their text.

Defined cases: null or empty html has an empty text; markup that is cut off or badly nested is read as far as it goes; repeated
rows and null ids are handled like any row; pages without labelled blocks of both kinds leave fixed weights in charge; an empty
table gives an empty result; other columns are not read. Character references are decoded before white space is joined.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm.base import query, table

#: Pages, and blocks of these, that the classifier is fitted on at most.
SAMPLE = 2_000
SAMPLE_BLOCKS = 40_000
#: Capacity of a smoothness edge between blocks that share their parent; it halves with every further step in the tree.
SMOOTH = 0.8

# Fixed values of HTML and of common class names.
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert advertisement alert banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disqus footer "
    "form gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo related respond search share sharing "
    "sidebar signup social sponsor sponsored sponsors subscribe teaser toolbar widget".split())
_CONTENT_NAMES = frozenset("article articlebody body content entry main maincontent post postbody story text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|title|textarea|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|<(select|button)\b(?:(?!<\2\b).)*?</\2\s*>"  # left open they hide nothing
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<[/!?a-zA-Z][^>]*+(?:>|\Z)", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
_ABOUT_OTHERS = frozenset("has with without no hide show".split())

ARTICLE, BAD_TAG, BAD_NAME, GOOD_NAME = 1, 2, 4, 8


class Node:
    """An open container: what it says of itself, whether an article lies in it, and in the end what holds for the blocks in it."""

    __slots__ = ("tag", "parent", "depth", "own", "named", "holds", "marks")

    def __init__(self, tag: str, parent: Node | None, own: int = 0, named: bool = False):
        self.tag, self.parent, self.own, self.named, self.holds, self.marks = tag, parent, own, named, False, 0
        self.depth = parent.depth + 1 if parent else 0

    def settle(self) -> None:
        """To be called once all of the page is read, for parents first."""
        own = self.own & ~BAD_TAG if self.holds and self.tag == "form" else self.own
        self.marks = (self.parent.marks if self.parent else 0) | own | (BAD_NAME if self.named and not self.holds else 0)


@dataclass(frozen=True)
class Block:
    """A run of text between block boundaries, in its innermost container."""

    text: str
    node: Node
    linked: int

    @property
    def tag(self) -> str:
        return self.node.tag

    @property
    def marks(self) -> int:
        return self.node.marks


def _said(attributes: str | None) -> tuple[bool, bool, bool]:
    """Whether names tell of boilerplate, of content, of a reader's comment."""
    bad = good = comment = False
    if attributes and "=" in attributes:
        for m in _NAMED.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                parts = _PARTS.findall(name)
                if not parts or not _ABOUT_OTHERS.isdisjoint(parts):
                    continue
                content = not _CONTENT_NAMES.isdisjoint(parts)
                # the header of an article or entry is its own
                bad |= any(p in _BOILERPLATE_NAMES and not (content and p == "header") for p in parts)
                good |= content
                comment |= parts[0] == "comment"
    return bad, good and not bad, comment


def _opened(tag: str, attributes: str | None, parent: Node, inside: bool) -> Node:
    """`inside`: an article or main element is open already."""
    bad, good, comment = _said(attributes)
    own = GOOD_NAME if good else 0
    if tag in ("article", "main"):
        node = Node(tag, parent, own | ARTICLE, comment and tag == "article")
        if not node.named:
            node.holds, up = True, parent
            while up and not up.holds:
                up.holds, up = True, up.parent
        return node
    if tag in _BOILERPLATE_TAGS or (tag == "header" and not inside):
        own |= BAD_TAG
    return Node(tag, parent, own, bad and tag not in ("html", "body"))


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in page order, without empty ones."""
    out: list[Block] = []
    root = Node("", None)
    stack, nodes, articles = [root], [root], 0
    pieces: list[str] = []
    linked = in_link = 0
    at = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, stack[-1], min(linked, len(text))))
        pieces, linked = [], 0

    def close(at: int) -> None:
        nonlocal articles
        articles -= sum(bool(node.own & ARTICLE) for node in stack[at:])
        for node in stack[at:]:
            open_tags[node.tag] -= 1
        del stack[at:]

    open_tags: Counter[str] = Counter()
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        name = m[4]
        if name is None:
            if m[1] is not None or m[2] is not None:
                pieces.append(" ")
            continue
        tag = name.lower()
        if tag == "a":
            in_link = 0 if m[3] else 1
        elif tag not in _BLOCK_TAGS:
            if tag in ("br", "img", "input"):
                pieces.append(" ")
        elif m[3]:
            flush()
            in_link = 0
            if open_tags[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
        else:
            flush()
            in_link = 0
            if tag == "hr":
                continue
            if stack[-1].tag == "p" or stack[-1].tag in _HEADINGS and tag in _HEADINGS:
                close(len(stack) - 1)
            while stack[-1].tag in _CLOSES_ITSELF.get(tag, ()):
                close(len(stack) - 1)
            node = _opened(tag, m[5], stack[-1], articles > 0)
            articles += bool(node.own & ARTICLE)
            open_tags[tag] += 1
            stack.append(node)
            nodes.append(node)
    if at < len(page):
        pieces.append(page[at:])
    flush()
    for node in nodes:
        node.settle()
    return out


FEATURES = 13
CONTAINER_FEATURES = slice(9, 13)
#: Weights the fit is drawn towards, used as they are where nothing can be learned; the last is the constant.
FIXED_WEIGHTS = np.array([0.3, -2.0, 0.4, 0.3, 0.5, 0.3, -0.5, 0.0, -0.5, 3.0, -6.0, -6.0, 1.0, -1.0])


def features(b: Block) -> list[float]:
    text, n = b.text, len(b.text)
    words = text.count(" ") + 1
    stops = text.count(".") + text.count(",") + text.count("!") + text.count("?")
    heading, item = b.tag in _HEADINGS, b.tag in ("li", "dt", "dd", "td", "th", "summary")
    return [
        min(words, 100) ** 0.5, b.linked / n, min(stops, 5) / 2.0, float(text[-1] in ".!?:\"”»"), float(b.tag in ("p", "blockquote", "pre")), float(heading),
        float(item), float(words <= 3), float("©" in text or "http" in text),
        float(b.marks & ARTICLE > 0), float(b.marks & BAD_TAG > 0), float(b.marks & BAD_NAME > 0), float(b.marks & GOOD_NAME > 0)]


def label(b: Block) -> float | None:
    """What the page says: 1 content, 0 boilerplate, None nothing."""
    if b.marks & (BAD_TAG | BAD_NAME):
        return 0.0
    return 1.0 if b.marks & ARTICLE else None


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 0.02, rounds: int = 30) -> np.ndarray:
    """Logistic regression drawn towards FIXED_WEIGHTS, by Newton steps, classes weighted alike; each row also with its container features blanked."""
    blank = x.copy()
    blank[:, CONTAINER_FEATURES] = 0.0
    a = np.hstack([np.vstack([x, blank]), np.ones((2 * len(x), 1))])
    t = np.r_[y, y]
    weight = np.where(t > 0, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9)) / len(t)
    w = FIXED_WEIGHTS.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - t)) + penalty * (w - FIXED_WEIGHTS)
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return w


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut: node i has capacity gain[i] from the source if positive, -gain[i] to the sink if negative.

    Nodes get levels by breadth-first search; paths that climb one level at a time are filled depth first until none is left;
    then levels are set anew, until the sink has none. Edges found full are not tried again within a round, so that a
    round takes time in proportion to the edges and a long page of a few thousand blocks stays cheap.
    """
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            edge(source, i, g, 0.0)
        elif g < 0:
            edge(i, sink, -g, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if level[to[e]] < 0 and room[e] > 1e-9:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        untried = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                while path and room[path[-1]] > 1e-9:  # go back to before the first full edge
                    path.pop()
                full = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                del path[full:]
                at = to[path[-1]] if path else source
            while untried[at] < len(out[at]):
                e = out[at][untried[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                untried[at] += 1
            if untried[at] < len(out[at]):
                path.append(e)
                at = to[e]
            elif path:  # a dead end: not to be entered again
                at = to[path.pop() ^ 1]
                untried[at] += 1
            else:
                break


def _steps(a: Node, b: Node, most: int = 64) -> int:
    """Steps between two containers in the document tree, `most` at most: an edge over so many has no capacity left."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(blocks: list[Block], smooth: float = SMOOTH) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, and between neighbours among the children of one container."""
    edges = [(i, i + 1, smooth * 0.5 ** max(0, _steps(blocks[i].node, blocks[i + 1].node) - 2)) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = id(b.node.parent or b.node)
        before = last.get(parent)
        if before is not None and before != i - 1:
            edges.append((before, i, smooth))
        last[parent] = i
    return edges


def main_text(page: str, weights: np.ndarray, smooth: float = SMOOTH) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    gain = (np.array([features(b) for b in blocks]) @ weights[:-1] + weights[-1]).tolist()
    return "\n".join(b.text for b, content in zip(blocks, minimum_cut(gain, smoothness(blocks, smooth))) if content)


def train(pages: DataFrame, sample: int = SAMPLE, most_blocks: int = SAMPLE_BLOCKS) -> np.ndarray:
    """Weights from at most `sample` pages, chosen by a hash of their ids; `pages` holds page_id and html."""
    chosen = pages.filter("page_id IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page, i, t, features(b)) for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for i, b in enumerate(blocks_of(text)) if (t := label(b)) is not None]
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "place", "label", "x"])

    # `chosen` has at most `sample` ids, and at most `most_blocks` rows of numbers reach the driver
    rows = (pages.join(F.broadcast(chosen), "page_id").select("page_id", "html").mapInArrow(run, "page_id long, place long, label double, x array<double>")
            .orderBy(F.xxhash64("page_id", "place"), "page_id", "place").limit(most_blocks).toArrow())
    y = np.asarray(rows["label"])
    if not len(y) or y.min() == y.max():
        return FIXED_WEIGHTS
    return fit_weights(np.asarray(rows["x"].combine_chunks().flatten()).reshape(len(y), FEATURES), y)


def page_rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))


def extract(pages: DataFrame, weights: np.ndarray, smooth: float = SMOOTH) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of page_id, url and html."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, weights, smooth) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


@query("op5_html_extraction")
def html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = page_rows(table(spark, sf, "pages"))
    return extract(pages, train(pages))
