"""Main-text extraction by minimum-cut labelling.

A page is read into blocks: runs of text that no block-level tag interrupts, each with the element it lies in. A
logistic classifier on length, links, punctuation and shape, and finite evidence from the markup around a block,
together give the block's log-odds of being content; the costs of either label become capacities from the source and
to the sink. Blocks that follow one another, and blocks side by side in one element, are tied by edges whose capacity
falls with their distance in the document tree. The maximum flow's minimum cut separates content from boilerplate.

The flow network is reduced first: a block with at most two neighbours is folded into them with the capacity of the
flow that it lets pass, which changes neither the greatest flow nor the cut. Edges between blocks of one element never
cross, so pages reduce completely, in time proportional to their blocks; what other networks leave is solved by
augmenting paths.

Evidence is never certain. An article or main element speaks for content; elements as nav, aside or form, and names in
class, id or role that tell boilerplate, speak against it, names that only hold such a word half as much; the nearest
of them prevails. Ids are often made from headings, so a word in an id alone says little: nothing on a heading, a quarter
inside an article or main, unless half of the element's text is links or it holds a form's controls, and elsewhere the
less, the more of its text is prose (ids of readers' comments count in full). Against a wrapper that holds most of the page's marked text it weakens to nothing, and a form or a
name with such a word also where it holds most of the whole text; names of readers' comments keep their weight. What the
classifier weighs is learned in numpy from a bounded sample of pages (``sample_pages`` of the least hashes and ``sample_bytes``), with the
blocks on which the markup is clear as labels; it sees nothing of the markup's names itself.

Text of scripts, styles, templates, iframes, forms' controls and the head is never a block.

Defined results: a null or empty html has an empty text, as has a page all of whose blocks are boilerplate; ids and
URLs are carried, null too; repeated rows are extracted each for itself; of several minimum cuts the one with the
fewest content blocks is taken; a tag whose quotes do not close ends at its next >; other columns are dropped; an empty
table gives an empty result. A very long or very deep page is one row in one task, in time linear in its length.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fitting, slices

# Kinds of elements.
_SKIPPED = frozenset(["script", "style", "template", "head", "title", "iframe", "select", "textarea", "button", "option", "datalist", "annotation", "annotation-xml"])
_RAW = frozenset(["script", "style", "iframe", "textarea"])
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"])
_BLOCKS = frozenset(
    ["address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
)
_CONTENT = frozenset(["article", "main"])
_BOILERPLATE = frozenset(["nav", "footer", "header", "aside", "form", "menu", "dialog", "fieldset"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_CONTROLS = frozenset(["input", "select", "textarea", "button"])
_CLOSED_BY = {
    "p": _BLOCKS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
# Words in class, id and role that tell boilerplate.
_TELLING = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|login|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|widget\w*|related|recommend\w*|share|sharing|social|comments?|disqus|respond|repl(?:y|ies)|footer\w*|masthead|copyright|search|pagination|pager|toolbar|skip|complementary|contentinfo|alert|form)(?=$|[\s_-])"
    r"|(?:^|\s)(?:(?:site|page|top|global)[_-]?)?header(?=$|\s)"
)
_TURNED = re.compile(r"(?i)(?:^|(?<=\s))(?:no|not|has|have|is|with|without|show|hide)[_-]\S+")
_COMMENTS = re.compile(r"(?i)(?:comments?|disqus|respond|repl(?:y|ies))")
# Words that leave a name telling as a whole.
_NEUTRAL = frozenset("area bar block box button buttons container count form group holder icons inner item items left link links list message primary right row section secondary slot text thread top bottom title unit wrap wrapper".split())
_MAIN_ROLE = re.compile(r"(?i)(?:^|[\s_-])(?:article|main|content|entry|post|story|body)(?=$|[\s_-])")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|=)*+)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_NAMED = re.compile(r"(?i)class|id|role|hidden")
_SPACE = re.compile(r"\s+")
_BODY = re.compile(r"<body[\s>]", re.I)

_PART, _WHOLE, _READERS = 1, 2, 3


class Block(NamedTuple):
    text: str
    element: int  # the innermost open element
    linked: int  # characters of the text inside links
    shared: int  # open elements that it has in common with the block before


class Elements:
    """The page's block-level elements in the order in which they open; element 0 is the page itself."""

    def __init__(self):
        self.parent, self.depth, self.tag, self.tells, self.main, self.hidden = [0], [0], [""], [0], [False], [False]
        self.by_id, self.controls = [0], [0]  # what an id alone tells, and controls of forms

    def open(self, parent: int, tag: str, tells: int, by_id: int, main: bool, hidden: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.tells.append(tells)
        self.by_id.append(by_id)
        self.controls.append(0)
        self.main.append(main or self.main[parent])
        self.hidden.append(hidden or self.hidden[parent])
        return len(self.tag) - 1


@lru_cache(1 << 14)
def _telling(said: str, tag: str) -> int:
    """How surely names of class, id and role tell boilerplate: a word in one, all of one, or readers' comments."""
    found = 0
    for name in _TURNED.sub("", said).split():
        if not _TELLING.search(name) or (tag == "header" and name.lower().endswith("header")):
            continue
        parts = [x for x in re.split(r"[_-]", name) if x]
        telling = [bool(_TELLING.search(x)) for x in parts]
        whole = all(t or x.lower() in _NEUTRAL for t, x in zip(telling, parts, strict=True)) or name.lower().endswith("header")
        found = max(found, _PART if not whole else _READERS if any(_COMMENTS.fullmatch(x) for x in parts) else _WHOLE)
    return found


@lru_cache(1 << 14)
def _is_main(said: str) -> bool:
    return _MAIN_ROLE.search(said) is not None


def blocks_of(html: str | None) -> tuple[list[Block], Elements]:
    """The page's non-empty blocks in order, white space collapsed and character references decoded; and its elements."""
    out: list[Block] = []
    elements = Elements()
    if not html:
        return out, elements
    stack = [0]
    opened: Counter = Counter()
    endless: set[str] = set()  # skipped elements that are not closed any more
    parts: list[str] = []
    link_parts: list[str] = []
    in_link = False
    lowest = 0  # the fewest open elements since the last block

    def flush() -> None:
        nonlocal lowest
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            linked = len(_SPACE.sub(" ", unescape("".join(link_parts))).strip())
            out.append(Block(text, stack[-1], min(linked, len(text)), lowest))
            lowest = len(stack) - 1
        parts.clear()
        link_parts.clear()

    def take(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                link_parts.append(text)

    def close(count: int) -> None:
        nonlocal lowest
        for e in stack[count:]:
            opened[elements.tag[e]] -= 1
        del stack[count:]
        lowest = min(lowest, count - 1)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            take(html[at:])
            break
        take(html[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            take(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
        if not m[1]:
            continue
        tag, said = m[1].lower(), m[2]
        if not m[3]:  # a quote that does not close, or a tag cut off at the page's end
            end = html.find(">", m.end(1))
            said, at = (html[m.end(1) : end], end + 1) if end >= 0 else ("", size)
            if end < 0:
                break
        if html[m.start() + 1] == "/":
            if tag in _BLOCKS:
                flush()
                if opened[tag]:
                    last = len(stack) - 1
                    while elements.tag[stack[last]] != tag:
                        last -= 1
                    close(last)
            elif tag == "a":
                in_link = False
            elif tag == "br":
                take(" ")
            continue
        if tag in _CONTROLS:
            elements.controls[stack[-1]] += 1
        if tag in _SKIPPED:
            if not said.endswith("/"):
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                else:
                    # an unclosed head or title ends where the body starts, raw text at the page's end; of others only the tag goes
                    body = _BODY.search(html, at) if tag in ("head", "title") and tag not in endless else None
                    at = body.start() if body else size if tag in _RAW else at
                    endless.add(tag)
            take(" ")
            continue
        if tag in _BLOCKS:
            flush()
            while tag in _CLOSED_BY.get(elements.tag[stack[-1]], ()):
                close(len(stack) - 1)
            if tag in _VOID:
                continue
            names: list[tuple[str, str]] = []
            if said and _NAMED.search(said):
                names = [(n.lower(), x or y or z) for n, x, y, z in _ATTRIBUTE.findall(said)]
            own = " ".join(v for n, v in names if n in ("class", "role")) if tag not in ("html", "body") else ""
            named = " ".join(v for n, v in names if n == "id") if tag not in ("html", "body") else ""
            tells = _telling(own, tag) if own else 0
            by_id = _telling(named, tag) if named and tag not in _HEADINGS else 0
            hidden = any(n == "hidden" or (n == "aria-hidden" and v == "true") for n, v in names)
            main = _is_main(f"{own} {named}") if own or named else False
            stack.append(elements.open(stack[-1], tag, max(tells, by_id if by_id == _READERS else 0), by_id if by_id > tells else 0, main, hidden))
            opened[tag] += 1
            in_link = False
        elif tag == "a":
            in_link = True
        elif tag in ("br", "img", "input"):
            take(" ")
    flush()
    return out, elements


def evidence(blocks: list[Block], elements: Elements) -> np.ndarray:
    """What the markup says of each block: in an article or main element (0 or 1), in boilerplate (0 to 1), in an element
    whose name tells content (0 or 1), hidden (0 or 1)."""
    count = len(elements.tag)
    parent, tag, tells = elements.parent, elements.tag, elements.tells
    readers, marked = [False] * count, [False] * count
    for e in range(1, count):
        readers[e] = readers[parent[e]] or tells[e] == _READERS
        marked[e] = not readers[e] and (marked[parent[e]] or tag[e] in _CONTENT)
    size, within = [0] * count, [0] * count  # characters in each element, and those of them in marked ones
    linked, prose, controls = [0] * count, [0] * count, list(elements.controls)
    for b in blocks:
        n = len(b.text)
        size[b.element] += n
        within[b.element] += n if marked[b.element] else 0
        linked[b.element] += b.linked
        prose[b.element] += n if n >= 80 and 2 * b.linked < n and _punctuated(b.text) else 0
    for e in range(count - 1, 0, -1):
        for sums in (size, within, linked, prose, controls):
            sums[parent[e]] += sums[e]
    beyond_half = lambda part, whole: min(1.0, max(0.0, 2 * part / whole - 1)) if whole else 0.0
    content, boilerplate = [0.0] * count, [0.0] * count
    for e in range(1, count):
        up = parent[e]
        content[e], boilerplate[e] = content[up], boilerplate[up]
        if tag[e] in _CONTENT and tells[e] != _READERS:
            content[e] = 1.0
            continue
        kind = tag[e] in _BOILERPLATE and not (tag[e] == "header" and content[up])  # such a header holds the article's own title
        if not kind and not tells[e] and not elements.by_id[e]:
            continue
        strength = 1.0 if kind or _WHOLE in (tells[e], elements.by_id[e]) or tells[e] == _READERS else 0.5
        if not kind and not tells[e]:  # an id alone
            if content[up] or elements.main[up]:
                strength *= 1.0 if 2 * linked[e] >= size[e] or controls[e] else 0.25
            else:
                strength *= 1 - 0.6 * prose[e] / size[e] if size[e] else 1.0
        if tells[e] != _READERS:
            strength *= 1 - (beyond_half(within[e], within[0]) if within[0] else beyond_half(size[e], size[0]))
            if tag[e] == "form" or not kind and tells[e] == _PART:
                strength *= 1 - beyond_half(size[e], size[0])
        boilerplate[e] = max(boilerplate[up], strength)
    return np.array([(content[b.element], boilerplate[b.element], elements.main[b.element], elements.hidden[b.element]) for b in blocks], dtype=np.float64).reshape(-1, 4)


#: Log-odds of content that the columns of ``evidence`` add.
EVIDENCE = np.array([4.0, -11.0, 1.5, -8.0])
#: Before any training: the weights of the columns of ``shape``, in order. Their sum counts up to 4 either way.
DEFAULT = np.array([2.5, -3.0, 1.0, 0.3, -1.0, 1.0, -2.2])
_MOST = 4.0


def _punctuated(text: str) -> bool:
    return sum(text.count(c) for c in ".,;:!?") > len(text) / 60


def shape(blocks: list[Block], elements: Elements) -> np.ndarray:
    """One row for each block: length, share of links, in a paragraph, in a heading, in a list, punctuation, 1."""
    x = np.zeros((len(blocks), len(DEFAULT)))
    for row, b in zip(x, blocks, strict=True):
        n, tag = len(b.text), elements.tag[b.element]
        row[0] = min(np.log1p(n) / 6, 1.5)
        row[1] = b.linked / n
        row[2] = tag in ("p", "blockquote", "pre")
        row[3] = tag in _HEADINGS
        row[4] = tag == "li" or elements.tag[elements.parent[b.element]] == "li"
        row[5] = _punctuated(b.text)
        row[6] = 1
    return x


def train(pages: list[str | None], epochs: int = 300, rate: float = 0.5, strength: float = 20.0) -> np.ndarray:
    """Logistic regression by gradient descent, pulled towards ``DEFAULT`` as by ``strength`` blocks."""
    rows, labels = [np.zeros((0, len(DEFAULT)))], [np.zeros(0)]
    for html in pages:
        blocks, elements = blocks_of(html)
        content, boilerplate, _, hidden = evidence(blocks, elements).T
        against = (boilerplate >= 0.75) | (hidden > 0)
        clear = against | ((content > 0) & (boilerplate == 0))
        rows.append(shape(blocks, elements)[clear])
        labels.append((~against[clear]).astype(np.float64))
    x, y = np.concatenate(rows), np.concatenate(labels)
    if len(np.unique(y)) < 2:
        return DEFAULT.copy()
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = DEFAULT.copy()
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ ((p - y) * weight) + strength * (w - DEFAULT) / 10) / len(x)
    return w


def minimum_cut(content: np.ndarray, boilerplate: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """The labels (True: content) of least total cost.

    ``content`` and ``boilerplate`` are the costs of giving a block that label; an edge costs its weight when its ends
    differ. Blocks of at most two neighbours are folded away first; the label of each follows from its neighbours'.
    """
    n = len(content)
    more = (np.asarray(content, dtype=np.float64) - boilerplate).tolist()  # what content costs more than boilerplate
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, c in edges:
        if u != v and c > 0:
            near[u][v] = near[v][u] = near[u].get(v, 0.0) + c
    folded: list[tuple[int, float, tuple[tuple[int, float], ...]]] = []
    gone = [False] * n
    queue = [i for i in range(n - 1, -1, -1) if len(near[i]) <= 2]
    while queue:
        v = queue.pop()
        if gone[v] or len(near[v]) > 2:
            continue
        gone[v] = True
        cost, ends = more[v], tuple(near[v].items())
        folded.append((v, cost, ends))
        if len(ends) == 1:
            ((a, w),) = ends
            more[a] += min(w, cost) - min(0.0, cost + w)  # the flow that v passes on to a
        elif ends:
            (a, x), (b, y) = ends
            # least costs of v for the labels of a and b
            neither, only_b, only_a, both = min(0.0, cost + x + y), min(y, cost + x), min(x, cost + y), min(x + y, cost)
            more[a] += (only_a + both - neither - only_b) / 2
            more[b] += (only_b + both - neither - only_a) / 2
            passing = (only_a + only_b - neither - both) / 2
            if passing > 0:
                near[a][b] = near[b][a] = near[a].get(b, 0.0) + passing
        for a, _ in ends:
            del near[a][v]
            if len(near[a]) <= 2:
                queue.append(a)
    label = [False] * n
    left = [i for i in range(n) if not gone[i]]
    if left:
        for i, y in zip(left, _augmented(left, more, near), strict=True):
            label[i] = y
    for v, cost, ends in reversed(folded):
        label[v] = cost + sum(-w if label[a] else w for a, w in ends) < -1e-9
    return np.array(label, dtype=bool)


def _augmented(nodes: list[int], more: list[float], near: list[dict[int, float]]) -> list[bool]:
    """The labels of the least minimum cut by shortest augmenting paths; the source's side is content."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    room |= {source: {i: -more[i] for i in nodes if more[i] < 0}, sink: {}}
    for i in nodes:
        if more[i] > 0:
            room[i][sink] = more[i]
            room[sink][i] = 0.0
        room[i][source] = 0.0
    while True:
        before = {source: source}
        queue = deque([source])
        while queue and sink not in before:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-9 and v not in before:
                    before[v] = u
                    queue.append(v)
        if sink not in before:
            return [i in before for i in nodes]
        path, v = [], sink
        while v != source:
            path.append((before[v], v))
            v = before[v]
        flow = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= flow
            room[v][u] = room[v].get(u, 0.0) + flow


def smoothness(blocks: list[Block], elements: Elements, near: float, sibling: float) -> list[tuple[int, int, float]]:
    """Edges between neighbours by nearness in the tree, and between a block and the last one beside it in an element.

    Text that lies in an element beside other elements counts among them.
    """
    holds = [False] * len(elements.tag)
    for p in elements.parent[1:]:
        holds[p] = True
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            apart = elements.depth[blocks[i - 1].element] + elements.depth[b.element] - 2 * b.shared
            edges.append((i - 1, i, near / (1 + apart)))
        beside = b.element if holds[b.element] else elements.parent[b.element]
        if (j := last.get(beside)) is not None:
            edges.append((j, i, sibling))
        last[beside] = i
    return edges


def label(blocks: list[Block], elements: Elements, weights: np.ndarray, near: float = 1.0, sibling: float = 0.5) -> np.ndarray:
    if not blocks:
        return np.zeros(0, dtype=bool)
    logit = np.clip(shape(blocks, elements) @ weights, -_MOST, _MOST) + evidence(blocks, elements) @ EVIDENCE
    return minimum_cut(np.log1p(np.exp(-logit)), np.log1p(np.exp(logit)), smoothness(blocks, elements, near, sibling))


def main_text(html: str | None, weights: np.ndarray) -> str:
    blocks, elements = blocks_of(html)
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, elements, weights), strict=True) if keep)


def fit(pages: DataFrame, html_col: str = "html", sample_pages: int = 400, sample_bytes: int = 64 << 20) -> np.ndarray:
    """Weights from ``sample_pages`` pages of the least hashes, of ``sample_bytes`` in all at most; pages that do not fit are passed over."""
    own = pages.select(F.col(html_col).cast("string").alias("html")).where(F.col("html").isNotNull())
    drawn = own.select(F.xxhash64("html").alias("h"), F.octet_length("html").alias("n")).groupBy("h").agg(F.max("n").alias("n")).orderBy("h").limit(4 * sample_pages).collect()
    taken = [drawn[i]["h"] for i in fitting([r["n"] for r in drawn], sample_bytes, sample_pages, sample_bytes // 32)]
    hashed = pages.sparkSession.createDataFrame([(h,) for h in taken], "h long")
    rows = own.withColumn("h", F.xxhash64("html")).join(F.broadcast(hashed), "h", "left_semi").dropDuplicates(["h"]).select("html").collect()
    return train(sorted(r["html"] for r in rows))


def extract(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices(batches, 256):
            for key, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = main_text(html, weights)
                yield key, url, text, len(text)

    return arrow_map(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), run, schema, rows=512)
