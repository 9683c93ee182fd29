"""The main text of a page: content marginals of a tree-structured graphical model.

Block elements are the nodes of a tree, each content or not. A node's evidence is its tag, the words
in its class, id and role, how much text it holds and how much of that is links. A potential on each
edge says how likely a child is content given its parent's state and its own tag. Counts over labelled pages give
both. One pass from the leaves to the root and one back (sum-product) give every node's exact
marginal; text whose node is content with probability one half or more is the page's main text.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.llm.common import map_arrow, texts_of
from secondlook.llm.labelled_pages import pages

# fixed values: elements of HTML
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot
th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = "script|style|title|textarea|template|svg|iframe|head"  # what is inside is no text of the page; of others the model decides
TO_THE_END = {"script", "style"}  # never closed, they reach to the end of the page; of others only the tag goes then
# Quoted values may be long or hold a "<", but not both without bound: a quote that is never closed costs a bounded look ahead.
VALUES = r"(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|\"[^\"]{0,1000}\"|'[^']{0,1000}'|[\"'])*+"
CLOSES_P = BLOCKS - {"button", "label", "option", "select", "body", "html"}
ALONE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "p": BLOCKS - {"p"}}
HEAD_ONLY = re.compile(r"<head(?=[\s>]).*?(?:</head\s*>|(?=<body[\s>]))", re.I | re.S)
QUIET = re.compile(rf"<(?:(!--)|({SILENT})(?=[\s/>]){VALUES}>|[!?][^<>]*>)", re.I)
CLOSED = re.compile(rf"</({SILENT})\s*>", re.I)
TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({VALUES})>")
ATTRIBUTE = re.compile(r"\b(class|id|role|y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")
SMOOTH = 0.5


class Node:
    __slots__ = ("tag", "parent", "names", "label", "runs", "text", "links", "children")

    def __init__(self, tag: str, parent: int, names: tuple, label: int):
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.text = self.links = 0  # characters of the whole subtree
        self.children: list[int] = []


def audible(page: str) -> str:
    """The page without comments, declarations and silent elements. Each part is looked at once, however many are never closed."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in CLOSED.finditer(page):
        ends.setdefault(m.group(1).lower(), []).append(m.span())
    out, at = [], 0
    while m := QUIET.search(page, at):
        out.append(page[at:m.start()])
        at = m.end()
        if m.group(1):
            end = page.find("-->", at)
            at = end + 3 if end >= 0 else len(page)
        elif m.group(2) and not m.group().endswith("/>"):
            tag = m.group(2).lower()
            own = ends.get(tag, [])
            k = bisect_left(own, (at,))
            if k < len(own):
                at = own[k][1]
            elif tag in TO_THE_END:
                at = len(page)
    return "".join(out) + page[at:]


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order (a root first), and runs of text as (node, raw text)."""
    nodes, runs = [Node("#root", -1, (), 0)], []
    stack, here, anchor, buffer = [0], 0, 0, []

    def flush() -> None:
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            if not text.isspace():
                runs.append((here, text))

    page = audible(HEAD_ONLY.sub("", page, count=1))
    at = 0
    for m in TAG.finditer(page):
        begin = m.start()
        if begin > at:
            piece = page[at:begin]
            buffer.append(piece)
            size = len(piece)
            nodes[here].text += size
            if anchor:
                nodes[here].links += size
        at = m.end()
        shut, tag, rest = m.group(1), m.group(2).lower(), m.group(3)
        if tag not in BLOCKS:
            if tag == "a":
                anchor = 0 if shut else 1
            elif tag == "br":
                buffer.append(" ")
            continue
        flush()
        anchor = 0
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    del stack[k:]
                    break
        else:
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == "p":
                        del stack[k:]
                        break
                    if nodes[stack[k]].tag in SCOPE["p"]:
                        break
            if tag in ALONE:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag in ALONE[tag]:
                        del stack[k:]
                    elif nodes[stack[k]].tag in SCOPE[tag]:
                        break
            names, label = (), nodes[stack[-1]].label
            if "=" in rest:
                found = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(rest)}
                label = int(found.pop("y", label)) if found.get("y", "0") in ("0", "1") else label
                names = tuple(set(NAME.findall(" ".join(found.values()).lower())))
            parent = stack[-1]
            nodes[parent].children.append(len(nodes))
            nodes.append(Node(tag, parent, names, label))
            if tag not in VOID:
                stack.append(len(nodes) - 1)
        here = stack[-1]
    if at < len(page):
        buffer.append(page[at:])
        nodes[here].text += len(page) - at
    flush()
    for k in range(len(nodes) - 1, 0, -1):
        n = nodes[k]
        nodes[n.parent].text += n.text
        nodes[n.parent].links += n.links
    return nodes, runs


def evidence(n: Node) -> list[tuple]:
    size = n.text
    return [("size", n.tag in ("li", "p", "div", "section") and n.tag, 0 if size < 1 else 1 + min(4, int(math.log(size, 5)))),
            ("links", 0 if not size else 1 + min(3, int(4 * n.links / size))), *[("name", w) for w in n.names]]


class ContentModel:
    """Log potentials from counts: edge[(tag, parent state)] and evidence[feature], each for states 0 and 1."""

    def __init__(self, labelled: list[str]):
        edge: dict[tuple, list[float]] = defaultdict(lambda: [SMOOTH, SMOOTH])
        seen: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
        totals, kinds = [0.0, 0.0], Counter()
        for page in labelled:
            nodes, _ = parse(page)
            for n in nodes[1:]:
                edge[n.tag, nodes[n.parent].label][n.label] += 1
                totals[n.label] += 1
                for f in evidence(n):
                    seen[f][n.label] += 1
        kinds.update(f[0] for f in seen)
        self.edge = {k: (a / (a + b), b / (a + b)) for k, (a, b) in edge.items()}
        # a tag that no labelled page has follows its parent
        self.unknown = [(0.95, 0.05), (0.1, 0.9)]
        self.evidence = {f: tuple((x + SMOOTH) / (t + SMOOTH * kinds[f[0]]) for x, t in zip(c, totals)) for f, c in seen.items()}

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content of every node."""
        size = len(nodes)
        up0, up1 = [1.0] * size, [1.0] * size  # own evidence times what the children say
        for k in range(1, size):
            a = b = 1.0
            for f in evidence(nodes[k]):
                if f in self.evidence:
                    x, y = self.evidence[f]
                    a, b = a * x, b * y
            up0[k], up1[k] = a / (a + b), b / (a + b)
        tables = [None, *[(self.edge.get((n.tag, 0), self.unknown[0]), self.edge.get((n.tag, 1), self.unknown[1])) for n in nodes[1:]]]
        message: list = [None] * size
        for k in range(size - 1, 0, -1):  # upward: children come after their parents
            (p00, p01), (p10, p11) = tables[k]
            a, b = up0[k], up1[k]
            m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
            message[k] = m0, m1
            parent = nodes[k].parent
            x, y = up0[parent] * m0, up1[parent] * m1
            up0[parent], up1[parent] = x / (x + y), y / (x + y)
        out = [0.0] * size
        down: list = [(1.0, 0.0)] * size  # the root lies outside every article
        for k in range(1, size):  # downward: the parent's belief without this child's own message
            parent = nodes[k].parent
            d0, d1 = down[parent]
            m0, m1 = message[k]
            a, b = d0 * up0[parent] / m0, d1 * up1[parent] / m1
            (p00, p01), (p10, p11) = tables[k]
            x, y = a * p00 + b * p10, a * p01 + b * p11
            down[k] = x / (x + y), y / (x + y)
            x, y = down[k][0] * up0[k], down[k][1] * up1[k]
            out[k] = y / (x + y)
        return out

    def text(self, page: str) -> str:
        nodes, runs = parse(page)
        chance = self.marginals(nodes)
        blocks = (" ".join((html.unescape(raw) if "&" in raw else raw).split()) for k, raw in runs if chance[k] >= 0.5)
        return "\n".join(b for b in blocks if b)


def extract(df: DataFrame, model: ContentModel | None = None, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per input row.

    A missing or empty page, and one without main text, has empty text. Broken markup is read as
    far as it goes; repeated rows are repeated. Other columns are ignored.
    """
    model = model or ContentModel(pages())

    def run(batch: pa.RecordBatch) -> dict:
        texts = [model.text(raw.decode()) for raw in texts_of(batch.column(2))]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
