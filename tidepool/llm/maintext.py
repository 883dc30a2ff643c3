"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of blocks: runs of text between block-level tags. A logistic classifier, trained on landmarks of a
bounded sample of pages (article and main against nav, footer, aside and the like; without any, its prior holds), and
the landmarks and names that a block stands under price both labels; the prices are the terminal capacities of a graph
whose smoothness edges join neighbouring blocks and blocks close in the tree. A maximum flow separates content from
boilerplate. No price is beyond what the others can outweigh: a name that says boilerplate costs less than an article
and a block that reads like one earn, if it is a vague one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.base import mapped

# Tag names of HTML, and names that sites give to what is not their article.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Of these, those that swallow the rest of a page if they are not closed.
ENDLESS = frozenset("script style textarea title".split())
SILENT = frozenset("template svg canvas audio video select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AGAINST = frozenset("nav footer aside menu".split())
#: What is not content unless an article or main stands in it.
AROUND = frozenset("form dialog".split())
FOR = frozenset("article main".split())
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus gdpr masthead menu menubar nav navbar navigation newsletter pager pagination popup promo promoted promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription".split()
)
VAGUE_NAMES = frozenset("bottom consent copyright footer header legal login modal notice notices reply teaser toolbar top widget widgets".split())
#: A name that begins so says what state a page is in, not what an element is.
STATES = frozenset("has is no not with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Elements that bear a part of the page; names of others, as of headings, tell about the text.
PARTS = frozenset("div section ul ol dl table td li span details fieldset figure blockquote center header".split())

_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
_NAME = re.compile(r"[^a-z0-9]+")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/><]*")
_STOP = re.compile("[<>\"']")
_ANGLE = re.compile("[<>]")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
#: Deeper elements count as children of the one at this depth; their text is kept.
DEEPEST = 256
NAMED, VAGUELY = 10.0, 4.0


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    parent: int  # a number for the element that holds the block's own
    depth: int
    linked: int  # characters inside links
    stands: int  # landmarks: 1 article or main, -1 boilerplate, 0 neither
    named: float  # what the names and roles of the elements around it cost
    hidden: bool


@dataclass(slots=True)
class _Open:
    tag: str
    number: int
    stands: int
    around: bool
    named: float
    hidden: bool
    silent: bool


def _price_of_name(value: str) -> float:
    """Of a class or id of one word or more: high if at least half of them name boilerplate, low if some do, or vaguely."""
    price = 0.0
    for form in (value, "".join(f"-{c}" if c.isupper() and i and not value[i - 1].isupper() else c for i, c in enumerate(value))):  # sideBar is sidebar, side and bar
        words = [w for w in _NAME.split(form.lower()) if w and not w.isdigit()]
        if words and words[0] not in STATES:
            named = sum(w in NAMES for w in words)
            price = max(price, NAMED if 2 * named >= len(words) else VAGUELY if named or any(w in VAGUE_NAMES for w in words) else 0.0)
    return price


def _opened(tag: str, attributes: str, number: int, above: _Open) -> _Open:
    named, hidden, stands, around = above.named, above.hidden, above.stands, above.around
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                if tag in PARTS:
                    named = max(named, *(_price_of_name(v) for v in value.split()), 0.0)
            elif name == "role":
                named = max(named, NAMED if value.lower() in ROLES and tag not in FOR and tag not in ("body", "html") else 0.0)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    if tag in AGAINST or tag == "header" and stands != 1:
        stands, around = -1, False
    elif tag in AROUND and stands != -1:
        stands, around = -1, True
    elif tag in FOR and (stands != -1 or around):
        stands, around = 1, False
    return _Open(tag, number, stands, around, named, hidden, above.silent or tag in SILENT)


def _end_of_tag(page: str, at: int, none: set[str]) -> tuple[int, int]:
    """Where the attributes end that begin at `at`, and where the page goes on. A tag that breaks off ends at the next
    `<`; a quote that is never closed is none. none: the quotes that do not occur further on."""
    plain = at
    while m := _STOP.search(page, at):
        c, at = m[0], m.end()
        if c == ">":
            return m.start(), at
        if c == "<":
            break
        end = -1 if c in none else page.find(c, at)
        if end < 0:
            none.add(c)
        else:
            at = end + 1
    m = _ANGLE.search(page, plain)
    return (len(page), len(page)) if not m else (m.start(), m.end() if m[0] == ">" else m.start())


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page with text in them, in order, in time that grows with its length. Tags may be left open, nested
    wrongly or broken off."""
    page = page or ""
    found: list[Block] = []
    stack = [_Open("", 0, 0, False, 0.0, False, False)]
    count: Counter = Counter()  # of the open elements by tag
    number, at, n = 0, 0, len(page)
    words: list[str] = []
    linked = 0
    missing: set[str] = set()
    quotes: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if words:
            if text := " ".join("".join(words).split()):
                top = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in BLOCK), 0)
                own, last = stack[top], stack[-1]
                found.append(Block(text, own.tag, stack[top - 1].number if top else 0, len(stack), min(linked, len(text)), last.stands, last.named, last.hidden))
            words.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].silent:
            words.append(html.unescape(raw) if "&" in raw else raw)
            if count["a"]:
                linked += len(words[-1])

    def pop(to: int) -> None:
        for x in stack[to:]:
            count[x.tag] -= 1
        del stack[to:]

    def close(tag: str) -> None:
        if count[tag]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    return pop(i)
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    return None  # an inline end tag ends no block

    def imply(tag: str) -> None:
        """Ends what a start tag of a block ends by itself."""
        if tag in ("li", "dd", "dt", "tr", "td", "th") and count[tag]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ("ul", "ol", "dl", "table", "article", "section", "nav", "div"):
                    break
                if stack[i].tag == tag:
                    pop(i)
                    break
        if count["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    return pop(i)
                if stack[i].tag in BLOCK:
                    return None

    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            say(page[at:])
            break
        say(page[at:open_])
        at = open_ + 1
        if page.startswith("!--", at):
            at += 3
            if page.startswith((">", "->"), at):
                at = page.index(">", at) + 1
            else:
                end = page.find("-->", at)
                at = n if end < 0 else end + 3
            continue
        if page.startswith(("!", "?"), at):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        ending = page.startswith("/", at)
        m = _TAG_NAME.match(page, at + ending)
        if not m:
            say("<")
            continue
        tag = m[0].lower()
        end, at = _end_of_tag(page, m.end(), quotes)
        attributes = page[m.end() : end]
        if ending:
            if tag in BLOCK:
                flush()
            close(tag)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                over = None if tag in missing else _END[tag].search(page, at)
                if over:
                    at = over.end()
                else:
                    missing.add(tag)
                    at = n if tag in ENDLESS else at
            continue
        if tag in BLOCK:
            flush()
            imply(tag)
        elif tag == "br":
            words.append(" ")
        if tag not in VOID and not (tag in SILENT and attributes.endswith("/")) and len(stack) < DEEPEST:
            number += 1
            stack.append(_opened(tag, attributes, number, stack[-1]))
            count[tag] += 1
    flush()
    return found


N_FEATURES = 9


def features(block: Block) -> list[float]:
    text = block.text
    words = text.count(" ") + 1
    return [
        1.0,
        math.log1p(words),
        block.linked / len(text),
        min(len(text) / words, 20) / 10,
        float(text[-1] in ".!?:;\"'"),
        min((text.count(".") + text.count(",")) / words, 1.0),
        float(block.tag == "p"),
        float(block.tag[:1] == "h" and block.tag[1:].isdigit()),
        float(block.tag in ("li", "td", "th", "dd", "dt")),
    ]


#: Long texts that end like sentences and hold few links read like content, before anything is learned.
PRIOR = np.array([-2.0, 1.0, -4.0, 0.0, 1.0, 0.0, 0.5, 0.5, -0.5])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 500, l2: float = 1e-2) -> np.ndarray:
    """Weights of a logistic classifier, both classes weighing the same, held near the prior. Without both, the prior."""
    w = PRIOR.copy()
    if not len(y) or y.min() == y.max():
        return w
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    speed = np.zeros(N_FEATURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed + x.T @ ((y - p) * share) - l2 * (w - PRIOR)
        w = w + 0.2 * speed
    return w


def min_cut(lean: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels that minimise the sum of lean against the label (positive: content) and of the edges between labels.

    First, a node that leans more than all its edges weigh takes its label whatever its neighbours do; what is left is cut by
    augmenting paths. Ties go to boilerplate.
    """
    n, lean = len(lean), list(lean)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        if w > 0 and i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(lean[i]) > sum(near[i].values()):
            label[i] = lean[i] > 0
            for j, w in near[i].items():
                lean[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if not left:
        return [bool(x) for x in label]
    source, sink = n, n + 1
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left} | {source: {}, sink: {}}
    for i in left:
        room[source][i] = max(lean[i], 0.0)
        room[i][source] = 0.0
        room[i][sink] = max(-lean[i], 0.0)
        room[sink][i] = 0.0
    while True:
        come, line = {source: source}, deque([source])
        while line and sink not in come:
            i = line.popleft()
            for j, w in room[i].items():
                if w > 1e-12 and j not in come:
                    come[j] = i
                    line.append(j)
        if sink not in come:
            break
        path, i = [], sink
        while i != source:
            path.append((come[i], i))
            i = come[i]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] += flow
    for i in left:
        label[i] = i in come
    return [bool(x) for x in label]


@dataclass
class Extractor:
    """Classifier weights and the prices of landmarks, names and edges."""

    weights: np.ndarray = field(default_factory=PRIOR.copy)
    landmark_for: float = 5.0
    landmark_against: float = 8.0
    hidden: float = 20.0
    adjacent: float = 0.8
    siblings: float = 0.6

    def content(self, blocks: list[Block]) -> list[bool]:
        scores = np.clip(np.array([features(b) for b in blocks]) @ self.weights, -4, 4).tolist() if blocks else []
        lean = []
        for b, s in zip(blocks, scores):
            s += self.landmark_for * (b.stands == 1) - self.landmark_against * (b.stands == -1) - b.named - self.hidden * b.hidden
            lean.append(s)
        edges: dict[tuple[int, int], float] = {}
        last: dict[int, int] = {}
        for i, b in enumerate(blocks):
            if i:
                edges[i - 1, i] = self.adjacent / (1 + abs(blocks[i - 1].depth - b.depth))
            if (j := last.get(b.parent)) is not None:
                edges[j, i] = edges.get((j, i), 0.0) + self.siblings
            last[b.parent] = i
        return min_cut(lean, edges)

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page)
        return "\n\n".join(b.text for b, keep in zip(blocks, self.content(blocks)) if keep)


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", pages_at_most: int = 500, blocks_at_most: int = 50) -> Extractor:
    """The classifier from the landmarks of about pages_at_most pages, picked by a hash of the id. A page with more landmark
    blocks than blocks_at_most gives every nth of them, one to two times as many."""
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    share = min(1.0, pages_at_most / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("page")), F.lit(1_000_000)) < share * 1_000_000)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = [], []
            for page in batch["html"]:
                own = [b for b in blocks_of(page) if b.stands or b.named >= NAMED]
                step = max(1, len(own) // blocks_at_most)
                x += [features(b) for b in own[::step]]
                y += [int(b.stands == 1 and b.named < NAMED) for b in own[::step]]
            yield pd.DataFrame({"x": pd.Series(x, dtype=object), "y": pd.Series(y, dtype="int32")})

    got = sorted((list(r["x"]), r["y"]) for r in sample.mapInPandas(measured, "x array<double>, y int").collect())
    return Extractor(fit(np.array([x for x, _ in got]).reshape(-1, N_FEATURES), np.array([y for _, y in got])))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pages_at_most: int = 500) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages: the blocks labelled content, joined by two line feeds.

    Null and empty html, and pages without content, give an empty text. Equal pages get equal texts; rows with the same id
    are taken each by itself; null ids and urls are kept. An empty table gives no rows; extra columns are ignored.
    """
    model = learn(pages, id_col, html_col, pages_at_most)

    # markup takes time that grows with its length, whatever is left open; only the cut of blocks in doubt may take more
    def extract(batch: pd.Series) -> pd.Series:
        return pd.Series([model.text(page) for page in batch], dtype=object)

    text = mapped(extract, "string", F.col(html_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
