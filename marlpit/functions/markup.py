"""HTML fragments to text: links, tables and lines. The only Python on this path; each function maps one text to one.

Parsing uses the standard library's lenient tokenizer: tags that never close end with their parent.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that are Python's at a time.
ROWS = 128

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "noscript", "template", "head", "title"}
_ENDS = {"tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "p": {"p"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "tbody"}}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs = tag, attrs or {}
        self.children: list[Node | str] = []

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


class _Tree(HTMLParser):
    """Open elements are counted by name, apart in each open table, so that a stray end tag costs one look."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.within: list[Counter] = [Counter()]

    def shut(self) -> str:
        """Close the innermost element."""
        tag = self.open.pop().tag
        if tag == "table":
            self.within.pop()
        else:
            self.within[-1][tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs) -> None:
        ends = _ENDS.get(tag, ())
        while self.open[-1].tag in ends:
            self.shut()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            if tag == "table":
                self.within.append(Counter())
            else:
                self.within[-1][tag] += 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        # a stray end tag does not close the table that holds it
        if len(self.within) > 1 if tag == "table" else self.within[-1][tag]:
            while self.shut() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def strings(node: Node) -> list[str]:
    """Non-empty stripped strings below a node, in order, without those of scripts and styles."""
    out = []
    pending: list[Node | str] = [node]
    while pending:
        x = pending.pop()
        if isinstance(x, str):
            if s := x.strip():
                out.append(s)
        elif x.tag not in _SILENT:
            pending += reversed(x.children)
    return out


def _rows(table: Node) -> list[Node]:
    """Its own rows, also those one level down in thead, tbody and tfoot."""
    found = []
    for child in table.nodes():
        if child.tag == "tr":
            found.append(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            found += [x for x in child.nodes() if x.tag == "tr"]
    return found


def _outermost(node: Node, tag: str) -> list[Node]:
    """The elements of this kind below ``node`` that lie in no other of them, in order."""
    found = []
    pending = node.nodes()[::-1]
    while pending:
        x = pending.pop()
        if x.tag == tag:
            found.append(x)
        else:
            pending += x.nodes()[::-1]
    return found


def _all(node: Node, tag: str) -> list[Node]:
    """The elements of this kind below ``node``, each after those that it holds."""
    found = []
    pending = node.nodes()
    while pending:
        x = pending.pop()
        if x.tag == tag:
            found.append(x)
        pending += x.nodes()
    return found[::-1]


def _as_text(node: Node, text: str) -> None:
    """``node`` becomes a string in its place."""
    node.tag, node.children = "", [text] if text else []


def _shown(table: Node) -> tuple[str, list[Node]]:
    """The table's pipe rows, a separator below row 0 if that has cells; and the tables in its cells, taken out of them."""
    lines, inner = [], []
    for number, row in enumerate(_rows(table)):
        cells = []
        for cell in row.nodes():
            if cell.tag in ("td", "th"):
                for nested in _outermost(cell, "table"):
                    held = Node("table", nested.attrs)
                    held.children = nested.children
                    inner.append(held)
                    _as_text(nested, "")
                cells.append(" ".join(strings(cell)).replace("\n", " "))
        if cells:
            lines.append("| " + " | ".join(cells) + " |")
            if number == 0:
                lines.append("| " + " | ".join("---" for _ in cells) + " |")
    return "\n".join(lines), inner


def table_markdown(table: Node) -> str:
    """The table's rows, then those of nested tables as blocks of their own."""
    blocks = []
    pending = [table]
    while pending:
        text, inner = _shown(pending.pop())
        blocks.append(text)
        pending += inner[::-1]
    return "\n\n".join(filter(None, blocks))


def _rewrite(root: Node, base: str) -> None:
    """Links and outermost tables become strings in place."""
    for link in _all(root, "a"):
        if "href" in link.attrs:
            url = link.attrs["href"]
            _as_text(link, f" [{''.join(strings(link))}]({base + url if url.startswith('/') else url}) ")
    for table in _outermost(root, "table"):
        _as_text(table, f"\n\n{table_markdown(table)}\n\n")


def body_text(html: str | None, base: str = "") -> str:
    """The fragment's strings, one to a line, with links and tables as markdown; no more than one blank line together."""
    root = parse(html or "")
    _rewrite(root, base)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(strings(root)))


def _only_ended(html: str) -> str:
    """Character references without a semicolon, or of no known name, as the text that they are."""
    return re.sub(r"&(#\w+;|\w+;)?", lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[0][1:]}", html)


def page_lines(html: str | None, ended: bool = False) -> list[str]:
    """The page's text lines, each at its first occurrence only.

    Browsers read ``&amp`` without its semicolon too, as in a title that was cut; with ``ended`` it stays as it is.
    """
    html = html or ""
    found = (" ".join(line.split()) for s in strings(parse(_only_ended(html) if ended else html)) for line in s.split("\n"))
    return list(dict.fromkeys(x for x in found if x))


def _column(f: Callable[[str | None], object], to: pa.DataType, kind: T.DataType, html: Column) -> Column:
    """``f`` of each row; of a batch only ``ROWS`` rows at a time are Python's, the others are Arrow's bytes."""

    def run(batch: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], to), *(pa.array([f(x) for x in batch.slice(i, ROWS).to_pylist()], to) for i in range(0, len(batch), ROWS))])

    return F.arrow_udf(run, kind)(html)


def body_text_column(html: Column, base: str = "") -> Column:
    return _column(lambda x: None if x is None else body_text(x, base), pa.string(), T.StringType(), html)


def page_lines_column(html: Column, ended: bool = False) -> Column:
    return _column(lambda x: page_lines(x, ended), pa.list_(pa.string()), T.ArrayType(T.StringType()), html)
