"""Main text of web pages by minimum cut.

The page is cut into blocks of text at block-level tags.  A logistic classifier gives each
block a cost of being boilerplate and a cost of being content; these are its capacities from
the source and to the sink.  Neighbouring blocks, and consecutive blocks of one DOM parent, are
joined by smoothness edges.  The minimum cut (by max-flow) labels all blocks at once.  What the
elements around a block say (menus, footers, forms, adverts, ..., or the article) adds finite
capacities, so every block is free: marks, text and neighbours are weighed against each other, and
a page without marks is labelled by the other two.

The classifier is trained here, on blocks of a bounded sample of pages (at most ``TRAIN_PAGES``
of at most ``TRAIN_BYTES`` each): blocks inside an article element against those inside marked
boilerplate.  It sees only text features, so it also labels pages without such marks.

Defined results
    null, empty html, no text   empty text
    broken or cut-off html      parsed as far as it goes; tags that are never closed end with their parent; a malformed tag ends at
                                the next ">", and only one without any ">" after it ends the page
    very long pages             whole; memory in proportion to the page
    repeated rows               each is a page of its own
    empty table                 no rows
    extra columns               not read
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML element names by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "template", "svg", "iframe", "textarea", "title"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "object", "canvas", "math", "mrow", "mi", "mo", "mn", "ms", "mtext", "mfrac", "msqrt", "mroot", "msup", "msub", "msubsup", "mover", "munder", "munderover", "mfenced", "mspace", "mstyle", "mtable", "mtr", "mtd", "semantics"}
NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "label", "dialog", "menu", "head", "fieldset"}
P_ENDERS = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "nav", "header", "footer", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "hr", "fieldset", "address"}
# Words that mark boilerplate: a class, id or role of them alone, or of them and words that only say where or how.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "sidebar", "aside", "rail", "widget", "widgets", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "copyright", "related", "recommended", "recommendations", "comment", "comments", "disqus", "reply", "replies", "respond", "masthead", "topbar", "toolbar", "skip", "search", "contentinfo", "complementary", "alert", "disclaimer"}
PLACES = {"site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "inner", "outer", "box", "block", "bar", "area", "section", "container", "wrapper", "wrap", "holder", "list", "item", "items", "link", "links", "button", "buttons", "form", "icon", "icons", "panel", "column", "content", "unit", "slot", "posts", "stories", "post", "story", "policy", "law", "message", "text", "small", "large", "mobile", "desktop", "sticky", "fixed"}
CONTENT = {"article", "main"}
CONTENT_MARKS = {"article", "main", "articlebody", "post-content", "entry-content", "article-body", "post-body", "article-content", "main-content", "story-body"}

#: Raw text for HTML parsers too: without an end tag it goes on to the end of the page.
RAW_TEXT = {"script", "style", "iframe", "textarea", "title"}
TRAIN_PAGES, TRAIN_BYTES = 400, 1 << 20
#: Capacities for the marks around a block: boilerplate, inside the article, outside a marked article.
NEVER_COST, ARTICLE_COST, OUTSIDE_COST = 10.0, 8.0, 6.0
#: The classifier's log odds count up to this.
MAX_ODDS = 5.0
SMOOTH_NEXT, SMOOTH_PARENT = 0.2, 1.5
# As HTML parsers do: a quote opens a value only after "=", "</" before anything but a letter is a comment to ">".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</(?![a-zA-Z])[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))?)*+)>|([^<]+|<)", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?]")


def _marks(name: str) -> bool:
    """A name that says boilerplate as a whole: ``cookie-notice`` does, ``search-for-meaning`` doesn't."""
    parts = {p for p in re.split(r"[-_]+|\d+", name) if p}
    return bool(parts & MARKS) and parts <= MARKS | PLACES


def _attributes(raw: str) -> tuple[set[str], bool, bool]:
    """(names, marked as boilerplate, hidden) from class, id, role and itemprop."""
    names: set[str] = set()
    hidden = False
    for key, value in _ATTR.findall(raw):
        value, key = value.strip("\"'").lower(), key.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        elif key in ("class", "id", "role", "itemprop"):
            names.update(value.split())
    return names, any(map(_marks, names)), hidden


class Block:
    __slots__ = ("text", "links", "never", "content", "parent", "heading")

    def __init__(self, text, links, never, content, parent, heading):
        self.text, self.links, self.never, self.content, self.parent, self.heading = text, links, never, content, parent, heading


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with what the DOM above them says."""
    out: list[Block] = []
    # of each open element: name, never content, inside content, own number
    stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
    number, links = 0, 0
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            if text:
                at = next((e for e in reversed(stack) if e[0] not in INLINE), stack[0])
                above = stack[stack.index(at) - 1] if at[0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dd", "dt", "blockquote") and len(stack) > 1 else at
                out.append(Block(text, linked, at[1], at[2], above[3], at[0] in ("h1", "h2", "h3", "h4", "h5", "h6")))
            pieces.clear()
        linked = 0

    pos, end, unclosed = 0, len(page), set()
    while pos < end:
        m = _TOKEN.match(page, pos)
        if m is None:  # a tag that the end cuts off
            break
        pos = m.end()
        text = m.group(4)
        if text is not None:
            if text == "<" and page[pos : pos + 1].isalpha() or text == "<" and page[pos : pos + 1] == "/":
                break  # a tag that the end cuts off: no ">" is left
            pieces.append(text)
            if links:
                linked += len(text.strip())
            continue
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if name in VOID:
                continue
            if name not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if name in INLINE and any(e[0] not in INLINE for e in stack[k + 1 :]):
                        break  # it ended with its parent already
                    links -= sum(e[0] == "a" for e in stack[k:])
                    del stack[k:]
                    break
            continue
        if name in RAW:
            close = None if name in unclosed else _CLOSE[name].search(page, pos)
            if close is None:
                unclosed.add(name)  # nor is there one further on
            if close and (name == "title" or not m.group(3).endswith("/")):
                pos = close.end()
            elif name in RAW_TEXT and not close:
                pos = end
            continue  # others without an end tag are as if they were not there
        if name == "br":
            pieces.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in P_ENDERS or name in ("li", "dd", "dt", "tr", "td", "th", "option"):
                ends = {"p"} if name in P_ENDERS else {"li"} if name == "li" else {"dd", "dt"} if name in ("dd", "dt") else {"td", "th"} if name in ("td", "th") else {"tr", "td", "th"} if name == "tr" else {"option"}
                stops = {"ul", "ol", "dl", "table", "div", "section", "article", "body"}
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        links -= sum(e[0] == "a" for e in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in stops:
                        break
        if name in VOID or m.group(3).endswith("/"):
            continue
        number += 1
        up = stack[-1]
        names, marked, hidden = _attributes(m.group(3)) if m.group(3) else (set(), False, False)
        content = up[2] or (name in CONTENT and not up[1]) or bool(names & CONTENT_MARKS)
        never = up[1] or hidden or name in NEVER or (name == "header" and not up[2])
        if name not in ("html", "body", "article", "main") and not never:
            never = marked and not names & CONTENT_MARKS
        stack.append((name, never, content, number))
        if name == "a":
            links += 1
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """Text features only: sizes (own and of all text beside it), links, punctuation, place."""
    n = len(blocks)
    out = np.zeros((n, 8))
    beside: dict[int, int] = {}
    for b in blocks:
        beside[b.parent] = beside.get(b.parent, 0) + max(0, len(b.text) - b.links)
    for k, b in enumerate(blocks):
        size = len(b.text)
        marks = len(_PUNCT.findall(b.text))
        out[k] = (1.0, math.log1p(size), min(1.0, b.links / size), min(1.0, 20 * marks / size), float(b.text[-1] in ".!?"), float(b.heading), abs((k + 0.5) / n - 0.5) * 2, math.log1p(beside[b.parent]))
    return out


def train(pages: list[str], rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights (Newton steps) from blocks that their pages mark as content or as boilerplate."""
    xs, ys = [], []
    for page in pages:
        blocks = blocks_of(page)
        if blocks:
            x = features(blocks)
            known = [k for k, b in enumerate(blocks) if b.never or b.content]
            xs.append(x[known])
            ys += [float(blocks[k].content and not blocks[k].never) for k in known]
    start = np.array([-5.0, 0.5, -4.0, 0.5, 0.5, 0.5, -0.5, 0.6])  # a prior that stands where no page marks its blocks
    if not ys or min(ys) == max(ys):
        return start
    x, y, w = np.vstack(xs), np.array(ys), start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - start)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of a minimum cut; edges work both ways.

    What a node can pass straight from source to sink goes first.  The rest flows in phases:
    distances from the source, then flow along shortest paths until none is left.  At the end
    the nodes that the source still reaches are on its side.
    """
    n, eps = len(source), 1e-12
    s = [a - min(a, b) for a, b in zip(source, sink)]
    t = [b - min(a, b) for a, b in zip(source, sink)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    while True:
        level = [0 if x > eps else -1 for x in s]
        queue = deque(i for i in range(n) if not level[i])
        found = False
        while queue:
            i = queue.popleft()
            found = found or t[i] > eps
            for j, c in near[i].items():
                if c > eps and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not found:
            return [x >= 0 for x in level]
        ahead = [iter(list(x)) for x in near]  # each edge is tried once a phase
        for start in range(n):
            path = [start] if level[start] == 0 else []
            while path and s[start] > eps:
                i = path[-1]
                if t[i] > eps:
                    flow = min([s[start], t[i], *(near[a][b] for a, b in zip(path, path[1:]))])
                    s[start] -= flow
                    t[i] -= flow
                    keep = len(path)
                    for k in range(len(path) - 2, -1, -1):
                        a, b = path[k], path[k + 1]
                        near[a][b] -= flow
                        near[b][a] += flow
                        if near[a][b] <= eps:
                            keep = k + 1
                    del path[keep:]
                    continue
                for j in ahead[i]:
                    if level[j] == level[i] + 1 and near[i][j] > eps:
                        path.append(j)
                        break
                else:
                    path.pop()


def label(blocks: list[Block], weights: np.ndarray, smooth: float = 1.0) -> list[bool]:
    """Content or not, for each block."""
    if not blocks:
        return []
    z = np.clip(features(blocks) @ weights, -MAX_ODDS, MAX_ODDS)
    marked = any(b.content and not b.never for b in blocks)
    source, sink, edges, last = [], [], [], {}
    for k, b in enumerate(blocks):
        # -log(1 - p) and -log p: what it costs to call the block boilerplate, or content
        source.append(float(np.logaddexp(0, z[k])) + ARTICLE_COST * (b.content and not b.never))
        sink.append(float(np.logaddexp(0, -z[k])) + NEVER_COST * b.never + OUTSIDE_COST * (marked and not b.content))
        if k:
            edges.append((k - 1, k, smooth * SMOOTH_NEXT))
        if b.parent in last:
            edges.append((last[b.parent], k, smooth * SMOOTH_PARENT))
        last[b.parent] = k
    return cut(source, sink, edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, weights)) if keep)


def trained_weights(pages: DataFrame, html: str = "html", limit: int = TRAIN_PAGES) -> np.ndarray:
    """Weights from ``limit`` pages at most, the same ones in every run (least hashes)."""
    slim = pages.select(F.col(f"`{html}`").alias("html")).where(F.octet_length("html") <= TRAIN_BYTES)
    share = min(1.0, 2 * limit / max(1, pages.count()))  # so that no task sorts more than a few of the sample
    near = slim.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    return train([r[0] for r in near.orderBy(F.xxhash64("html"), "html").limit(limit).collect()])


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of every page."""
    weights = trained_weights(pages, html)
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    own = slim.select("page_id", "url").schema
    schema = T.StructType([*own, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, kept = [], [], []
            for page in batch.column(2).to_pylist():
                blocks = blocks_of(page or "")
                keep = label(blocks, weights)
                texts.append("\n".join(b.text for b, k in zip(blocks, keep) if k))
                sizes.append(len(blocks))
                kept.append(sum(keep))
            columns = [pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in ([len(t) for t in texts], sizes, kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=schema.names)

    return slim.mapInArrow(run, schema)
