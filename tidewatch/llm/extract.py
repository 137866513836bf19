"""HTML extraction: text blocks of a page are labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by how they take part in the layout, and usual names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea xmp title noembed noframes svg".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head
    header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
ENDS_SIBLING = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")),
                "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
PARTS = frozenset("nav footer aside form button select dialog menu label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs
    footer cookie cookies consent notice alert newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply
    replies widget popup modal toolbar pagination pager tags copyright legal disclaimer masthead""".split())
PROSE = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figcaption dd dt li".split())
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
TAG_REST = re.compile(r"""(?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?)*+>""")       # a sign > in a quoted value does not end the tag
TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")

FORM = 2                  # page part "form", set apart from the others
SCALE = 100               # costs are rounded to hundredths, capacities are whole numbers
NEAR = 8                  # steps up the tree by which the distance of two blocks is measured


class _Node:
    __slots__ = ("name", "parent", "bad", "good", "link")

    def __init__(self, name, parent, bad, good, link):
        self.name, self.parent, self.bad, self.good, self.link = name, parent, bad, good, link


class Block:
    __slots__ = ("text", "node", "linked", "size")

    def __init__(self, text, node, linked, size):
        self.text, self.node, self.linked, self.size = text, node, linked, size


def _attributes(tag: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(tag)}


def _child(name: str, tag: str, parent: _Node) -> _Node:
    """A new element: what page part it or an element around it is, and whether it lies in the article or in a link.

    A form may be put around a whole page, so an article in it is none of its fields."""
    bad, good = parent.bad, parent.good
    if name in ("article", "main"):
        good = True
        if bad == FORM:
            bad = False
    elif name == "form" and not bad:
        bad = FORM
    elif name in PARTS or name == "header" and not good:
        bad = True
    if "=" in tag or "hidden" in tag:
        a = _attributes(tag)
        words = set(re.split(r"[\s_-]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))
        style = a.get("style", "").replace(" ", "").lower()
        if (words & NAMES or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style
                or "header" in words and not good) and name not in ("html", "body", "article", "main"):
            bad = True
        if a.get("role") == "main" or a.get("itemprop") == "articleBody":
            good = True
            if bad == FORM:
                bad = False
    return _Node(name, parent, bad, good, parent.link or name == "a")


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order; markup that is not closed, or closed twice, ends where a browser would end it."""
    root = _Node("#root", None, False, False, False)
    stack, open_names = [root], {}
    out: list[Block] = []
    pieces: list[str] = []
    linked = size = 0
    pos, end, owner = 0, len(page), root

    def flush():
        nonlocal linked, size
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, owner, linked, size))
            pieces.clear()
            linked = size = 0

    def pop_to(k):
        while len(stack) > k:
            open_names[stack.pop().name] -= 1

    def add(text):
        nonlocal linked, size, owner
        if text:
            n = len(text.strip())
            if n and not size:
                k = len(stack) - 1
                while stack[k].name not in BLOCK and k:
                    k -= 1
                owner = stack[k]
            size += n
            linked += n if stack[-1].link else 0
            pieces.append(html.unescape(text) if "&" in text else text)

    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            add(page[pos:])
            break
        add(page[pos:lt])
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            pos = close + 3 if close >= 0 else end
            continue
        m = TAG_NAME.match(page, lt + 1)
        if not m:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):
                close = page.find(">", lt)
                pos = close + 1 if close >= 0 else end
            else:
                add("<")
                pos = lt + 1
            continue
        rest = TAG_REST.match(page, m.end())
        tag = rest[0][:-1] if rest else page[m.end():]
        pos = rest.end() if rest else end
        name = m[1].lower()
        if page[lt + 1] == "/":
            if name in BLOCK:
                flush()
            if open_names.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                pop_to(k)
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, pos)
            stop = page.find(">", close.end()) if close else -1
            pos = stop + 1 if stop >= 0 else end
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK:
            flush()
            if open_names.get("p"):
                k = len(stack) - 1
                while stack[k].name != "p":
                    k -= 1
                pop_to(k)
            if name in ENDS_SIBLING:
                same, around = ENDS_SIBLING[name]
                k = len(stack) - 1
                while k and stack[k].name not in around and stack[k].name not in same.split():
                    k -= 1
                if k and stack[k].name in same.split():
                    pop_to(k)
        if name not in VOID and not tag.endswith("/"):
            stack.append(_child(name, tag, stack[-1]))
            open_names[name] = open_names.get(name, 0) + 1
    flush()
    return out


def evidence(b: Block) -> float:
    """Log-odds of a block to be content, from its own text and place."""
    words = b.text.count(" ") + 1
    score = -0.8 + 2.5 * min(words, 40) / 40 - 4.0 * b.linked / max(1, b.size)
    if b.text[-1] in ".!?:;…\"'”»。！？":
        score += 0.5
    if b.node.name in PROSE:
        score += 0.8
    if b.node.good:
        score += 2.5
    if b.node.bad:
        score -= 8.0
    return score


def _distance(a: _Node, b: _Node) -> int:
    """Edges between two elements in the tree; 2 * NEAR if they do not meet within NEAR steps."""
    up = {}
    for k in range(NEAR):
        up[id(a)] = k
        a = a.parent
        if a is None:
            break
    for k in range(NEAR):
        if id(b) in up:
            return up[id(b)] + k
        b = b.parent
        if b is None:
            break
    return 2 * NEAR


class Cut:
    """Maximum flow by shortest augmenting layers; afterwards the nodes that the source still reaches are on its side."""

    def __init__(self, n: int):
        self.n, self.to, self.room, self.at = n, [], [], [[] for _ in range(n)]

    def join(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.at[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.at[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * self.n
        level[s] = 0
        todo = deque([s])
        while todo:
            a = todo.popleft()
            for e in self.at[a]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    todo.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        while True:
            level = self._levels(s)
            if level[t] < 0:
                return [x >= 0 for x in level]
            turn, path, a = [0] * self.n, [], s
            while True:
                if a == t:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    a = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                edges = self.at[a]
                while turn[a] < len(edges):
                    e = edges[turn[a]]
                    if self.room[e] and level[self.to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(edges):
                    path.append(edges[turn[a]])
                    a = self.to[path[-1]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    turn[a] += 1
                else:
                    break


def content(blocks: list[Block]) -> list[bool]:
    """Which blocks are content: the cheapest labelling, where a label against the evidence costs it, and a border between neighbours
    costs more the closer they are in the tree.  Neighbours are blocks that follow each other on the page or in one element."""
    n = len(blocks)
    cost = [round(SCALE * evidence(b)) for b in blocks]
    if all(c > 0 for c in cost) or all(c <= 0 for c in cost):
        return [c > 0 for c in cost]
    graph = Cut(n + 2)
    last: dict[int, int] = {}
    for i, c in enumerate(cost):
        if c > 0:
            graph.join(n, i, c)
        elif c < 0:
            graph.join(i, n + 1, -c)
        if i:
            w = round(SCALE * 1.2 / (1 + _distance(blocks[i - 1].node, blocks[i].node)))
            graph.join(i - 1, i, w, w)
        before = last.get(id(blocks[i].node.parent), i - 1)
        if before < i - 1:                      # kept apart by other blocks, but children of one element
            graph.join(before, i, SCALE // 4, SCALE // 4)
        last[id(blocks[i].node.parent)] = i
    return graph.source_side(n, n + 1)[:n]


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks in order, two line ends between them; empty for null, empty and text-free pages."""
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, ok in zip(blocks, content(blocks), strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``.

    Whole pages are read, nothing is dropped but what the cut labels boilerplate.  Ids and URLs may be null or repeated and come back as
    they are; further columns are ignored; an empty table gives no rows.  One pass without a shuffle: a page is its own small graph."""
    def scan(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"].cast(pa.int64()), batch["url"].cast(pa.string()), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
            .mapInArrow(scan, "page_id BIGINT, url STRING, text STRING, n_chars BIGINT"))
