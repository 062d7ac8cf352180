"""Splitting documents. All splitters map one row to an array, so nothing is shuffled.

A null text has no pieces, nor has an empty one, but for ``packed_paragraphs`` and whole rules, whose piece is the empty
text. Repeated rows are split each for itself; ids are carried, null too. Pieces are numbered by their place in the
text, so there are no ties. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Sequence
from itertools import accumulate, dropwhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from . import metadata

# Sizes and overlaps in characters.
PLAIN, FAQ, RULE_OVERFLOW, CHILD = (800, 150), (2000, 200), (3000, 200), (800, 100)
SEPARATORS = ("\n\n", "\n", " ", "")
CHILD_SEPARATORS = ("\n\n", "\n", "。", ". ", " ", "")
FAQ_MARK = "faq"

#: Rows of a batch that are Python's at a time.
ROWS = 128

# Headings of numbered rules (number and title), their items, markdown headings.
_RULE = re.compile(r"(?P<major>[0-9]+\.[0-9]+(?:\.[0-9]+)?)\s+(?P<title>.+)|(?P<item>[0-9]+)\.\s+(?P<name>.+)")
_HEADING = re.compile(r"(#{1,3}) (.*)")


def recursive_split(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters cut at the first separator that occurs, finer ones where needed.

    A separator stays at the start of the piece after it. Consecutive pieces share up to ``overlap`` characters.
    """
    level = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    separator, finer = separators[level], separators[level + 1 :]
    if separator:
        first, *rest = text.split(separator)
        pieces = [p for p in (first, *(separator + r for r in rest)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    fitting: list[str] = []
    for p in pieces:
        if len(p) < size:
            fitting.append(p)
            continue
        out += _pack(fitting, size, overlap)
        fitting = []
        out += recursive_split(p, size, overlap, finer) if finer else [p]
    return out + _pack(fitting, size, overlap)


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, start, held = [], 0, 0
    for i, p in enumerate(pieces):
        if held + len(p) > size:
            if i > start and (whole := "".join(pieces[start:i]).strip()):
                out.append(whole)
            while held > overlap or (held and held + len(p) > size):
                held -= len(pieces[start])
                start += 1
        held += len(p)
    if whole := "".join(pieces[start:]).strip():
        out.append(whole)
    return out


def pack_paragraphs(text: str, most: int = 1200, overlap: int = 150) -> list[str]:
    """Paragraphs joined while they fit; a longer one is sliced, and only its slices overlap.

    From the place of every paragraph in the text that all would make together, the last that fits beside a first one is
    found by bisection.
    """
    if overlap >= most:
        raise ValueError("overlap must be less than the size")
    if len(text) <= most:
        return [text]
    paragraphs = [x for x in map(str.strip, text.split("\n\n")) if x]
    place = [0, *accumulate(len(x) + 2 for x in paragraphs)]
    chunks: list[str] = []
    first = 0
    while first < len(paragraphs):
        beyond = bisect_right(place, place[first] + most + 2) - 1
        if beyond > first:
            chunks.append("\n\n".join(paragraphs[first:beyond]))
            first = beyond
        else:
            long = paragraphs[first]
            chunks += filter(None, (long[i : i + most].strip() for i in range(0, len(long), most - overlap)))
            first += 1
    return chunks


def numbered_sections(text: str) -> list[dict]:
    """Sections of numbered rules, in the order in which they end: a heading's items, then its own text.

    What stands before the first heading ``N.N title`` is dropped. A heading without text of its own has no section
    for it, an item without text has an empty one. The lines that are headings or items are marked first; a section's
    body is what lies between two marks.
    """
    lines = [x.rstrip() for x in re.sub(r"\r\n?", "\n", text).split("\n")]
    marks = [(i, m) for i, m in enumerate(_RULE.fullmatch(x.strip()) for x in lines) if m]
    marks = list(dropwhile(lambda x: x[1]["major"] is None, marks))
    ends = [*(i for i, _ in marks[1:]), len(lines)][: len(marks)]
    out: list[dict] = []
    own = None
    for (at, m), end in zip(marks, ends, strict=True):
        section = {"sub_no": m["item"], "sub_title": m["name"] and m["name"].strip(), "body": "\n".join(lines[at + 1 : end]).strip()}
        if m["major"]:
            out += [own] if own and own["body"] else []
            major = {"major_no": m["major"], "major_title": m["title"].strip()}
            own = major | section
        else:
            out.append(major | section)
    return out + ([own] if own and own["body"] else [])


def header_sections(text: str) -> list[dict]:
    """Sections that begin at markdown headings of up to three levels, with the headings that hold; headings stay in the text."""
    out: list[dict] = []
    held: list[str | None] = [None, None, None]
    body: list[str] = []
    fenced = False

    def close() -> None:
        if joined := "\n".join(body).strip():
            out.append({"title": held[0], "section": held[1], "subsection": held[2], "body": joined})
        body.clear()

    for line in re.sub(r"\r\n?", "\n", text).split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        m = None if fenced else _HEADING.fullmatch(line)
        if m:
            close()
            level = len(m[1]) - 1
            held[level:] = [m[2].strip()] + [None] * (2 - level)
        body.append(line)
    close()
    return out


def _column(f: Callable[..., list], kind: str, *columns: Column) -> Column:
    """``f`` of each row. A batch is read and its pieces are put away ``ROWS`` rows at a time, so of most rows only Arrow's bytes are held."""
    to = to_arrow_type(T.DataType.fromDDL(kind))

    def run(*batch: pa.Array) -> pa.Array:
        parts = [pa.array([], to)]
        for i in range(0, len(batch[0]), ROWS):
            parts.append(pa.array([None if row[0] is None else f(*row) for row in zip(*(b.slice(i, ROWS).to_pylist() for b in batch), strict=True)], to))
        return pa.concat_arrays(parts)

    return F.arrow_udf(run, kind)(*columns)


def recursive_chunks(text: Column, size: Column, overlap: Column, separators: Sequence[str] = SEPARATORS) -> Column:
    return _column(lambda t, s, o: recursive_split(t, int(s), int(o), separators), "array<string>", text, size, overlap)


def route(docs: DataFrame, source_col: str = "source", type_col: str = "doc_type", text_col: str = "text", plain=PLAIN, faq=FAQ, overflow=RULE_OVERFLOW, rule_folder: str = metadata.RULE_FOLDER, faq_mark: str = FAQ_MARK) -> DataFrame:
    """``docs`` by chunk: ``chunk_id`` from 1 in each document, and the chunk in place of the text.

    The folder decides together with the document: rules in the rule folder stay whole where they fit, longer ones have
    a size of their own; so do other documents of folders whose path holds ``faq_mark``. Rules elsewhere are split like
    any document. A null text has no chunk, an empty one neither, unless it is a whole rule.
    """
    ship(docs.sparkSession)
    folder = F.regexp_extract(F.replace(F.coalesce(F.col(source_col), F.lit("")), F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1)
    rule = F.contains(folder, F.lit(rule_folder)) & metadata.is_rule(F.col(source_col), F.col(type_col), rule_folder)
    pick = lambda i: F.when(rule, overflow[i]).when(F.contains(F.lower(folder), F.lit(faq_mark)), faq[i]).otherwise(plain[i])
    whole = rule & (F.length(text_col) <= overflow[0])
    parts = F.when(whole, F.array(F.col(text_col))).otherwise(recursive_chunks(F.when(~whole, F.col(text_col)), pick(0), pick(1)))
    kept = [c for c in docs.columns if c not in (text_col, "chunk_id")]
    return docs.select(*kept, F.posexplode(parts).alias("_at", text_col)).select(*kept, (F.col("_at") + 1).alias("chunk_id"), text_col)


def child_chunks(parents: DataFrame, id_col: str = "parent_id", text_col: str = "text", size: int = CHILD[0], overlap: int = CHILD[1]) -> DataFrame:
    """parent_id, child_id (from 1) and child text."""
    ship(parents.sparkSession)
    parts = recursive_chunks(F.col(text_col), F.lit(size), F.lit(overlap), CHILD_SEPARATORS)
    return parents.select(F.col(id_col).alias("parent_id"), F.posexplode(parts).alias("_at", "child")).select("parent_id", (F.col("_at") + 1).alias("child_id"), "child")


def packed_paragraphs(text: Column, most: int = 1200, overlap: int = 150) -> Column:
    if overlap >= most:
        raise ValueError("overlap must be less than the size")
    return _column(lambda t: pack_paragraphs(t, most, overlap), "array<string>", text)


_SECTION = "array<struct<major_no:string,major_title:string,sub_no:string,sub_title:string,body:string>>"


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per numbered section, with its position ``section_id`` (from 1)."""
    ship(docs.sparkSession)
    found = _column(numbered_sections, _SECTION, F.col(text_col))
    return docs.select(id_col, F.posexplode(found).alias("_at", "s")).select(id_col, (F.col("_at") + 1).alias("section_id"), "s.*")


def section_chunks(found: DataFrame, title: str, id_col: str = "doc_id", most: int = 1200, overlap: int = 150) -> DataFrame:
    """Sections packed to chunks under their headings; ``chunk_id`` counts through a document."""
    ship(found.sparkSession)
    item = F.when((F.col("sub_no") != "") & (F.col("sub_title") != ""), F.concat(F.lit("[세부항목] "), F.col("sub_no"), F.lit(". "), F.col("sub_title")))
    head = F.concat_ws("\n", F.lit(f"[문서] {title}"), F.concat(F.lit("[대분류] "), F.col("major_no"), F.lit(" "), F.col("major_title")), item)
    parts = found.withColumn("head", head).select("*", F.posexplode(packed_paragraphs(F.col("body"), most, overlap)).alias("_at", "part"))
    text = F.regexp_replace(F.concat("head", F.lit("\n\n"), "part"), r"(?U)^\s+|\s+$", "")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(id_col).orderBy("section_id", "_at"))
    out = parts.withColumn("chunk_id", number).withColumn("text", text).withColumn("part_no", F.col("_at") + 1)
    return out.select(id_col, "chunk_id", "section_id", "major_no", "major_title", "sub_no", "sub_title", "part_no", "text", F.length("text").alias("text_len"))


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per markdown section: the id, the columns to keep, section_id (from 1), title, section, subsection, body."""
    ship(docs.sparkSession)
    found = _column(header_sections, "array<struct<title:string,section:string,subsection:string,body:string>>", F.col(text_col))
    own = [id_col, *keep]
    return docs.select(*own, F.posexplode(found).alias("_at", "s")).select(*own, (F.col("_at") + 1).alias("section_id"), "s.*")


def trim_front(text: Column) -> Column:
    """The text from its first numbered heading on, stripped; the whole text where there is none."""
    at = F.regexp_instr(text, F.lit(r"(?md)^[0-9]+\.[0-9]+(?:\.[0-9]+)?\s+.+$"))
    return F.regexp_replace(F.substr(text, F.greatest(at, F.lit(1))), r"(?U)^\s+|\s+$", "")
