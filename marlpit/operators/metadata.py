"""Front matter, source classes, keys and labels of documents.

All are expressions on a row: null sources and titles count as empty, a null text has no header and a null body, rows
repeat as they are, and an empty table stays empty. ``enrich`` replaces columns named meta, lists and doc_type.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once, strip
from ..functions.yaml import NOTHING, read

# Classes by a part of the path, in order of precedence after rules.
CLASS_MARKS = (("official", "official_md"), ("faq", "faq_output_md"), ("kms", "kms_output_md"))
RULE_FOLDER, RULE_TYPE = "내규소수2_md", "internal_rule"
RULE_FILE = r"(?i)^\d+\.\d+(?:\.\d+)?\.md$"
NO_PATH = "분류 없음"


def front_matter(text: Column, strip_body: bool = True) -> Column:
    """struct(meta map, lists map of arrays, body).

    A header starts with a line ``---`` at the very start and ends with the next such line; without both, the maps are
    empty and the body the whole text; a null text has a null body. ``key: value`` lines split at the first colon and
    lose quotes that stand at both ends; the last value of a key wins. Lines ``- x``, indented or not, are the items of
    the last key above them, if that has no value; so is a value ``[x, y]``. Other lines say nothing.
    """
    there = F.contains(text, F.lit("\r"))
    plain = F.when(there, F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    found = once(plain, lambda t: F.struct(F.regexp_extract(t, _FRONT, 0).alias("whole"), F.regexp_extract(t, _FRONT, 1).alias("header"), t.alias("t")))
    return once(found, lambda x: _told(x["whole"], x["header"], x["t"], text, strip_body))


#: A header between its two lines; only these are split, not the text.
_FRONT = r"(?Us)\A---[^\S\n]*\n(.*?\n)??[^\S\n]*---[^\S\n]*(?:\n|\z)"


def _told(whole: Column, header: Column, plain: Column, text: Column, strip_body: bool) -> Column:
    quoted = lambda v, q: (F.length(v) >= 2) & F.startswith(v, F.lit(q)) & F.endswith(v, F.lit(q))
    unquoted = lambda v: F.when(quoted(v, '"') | quoted(v, "'"), F.substring(v, 2, F.length(v) - 2)).otherwise(v)
    listed = lambda x: F.startswith(x, F.lit("- "))
    none, empty = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,array<string>>")

    def pairs_of(heads: Column) -> Column:
        return F.transform(heads, lambda r: F.struct(strip(F.substring_index(r["x"], ":", 1)).alias("k"), unquoted(strip(F.substr(r["x"], F.instr(r["x"], ":") + 1))).alias("v"), r["i"].alias("i")))

    def maps(rows: Column, heads: Column, pairs: Column) -> Column:
        meta = F.aggregate(pairs, none, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
        following = lambda n: F.coalesce(F.get(heads, n + 1)["i"], F.size(rows))
        inline = lambda v: F.transform(F.filter(F.split(F.substring(v, 2, F.length(v) - 2), ","), lambda x: strip(x) != ""), lambda x: unquoted(strip(x)))
        below = lambda p, n: F.transform(F.filter(F.slice(rows, p["i"] + 2, following(n) - p["i"] - 1), listed), lambda x: unquoted(strip(F.substr(x, F.lit(3)))))
        items = F.transform(pairs, lambda p, n: F.struct(p["k"].alias("k"), F.when(p["v"] == "", below(p, n)).when(F.startswith(p["v"], F.lit("[")) & F.endswith(p["v"], F.lit("]")), inline(p["v"])).alias("v")))
        held = F.filter(items, lambda p: F.size(F.coalesce(p["v"], F.array().cast("array<string>"))) > 0)
        lists = F.aggregate(held, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
        return F.struct(meta.alias("meta"), lists.alias("lists"))

    def read(rows: Column) -> Column:
        numbered = F.transform(rows, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        heads = F.filter(numbered, lambda r: F.contains(r["x"], F.lit(":")) & ~listed(r["x"]))
        return once(heads, lambda h: once(pairs_of(h), lambda p: maps(rows, h, p)))

    rows = F.when(header == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.substring(header, 1, F.length(header) - 1), "\n"), strip))
    body = F.substr(plain, F.length(whole) + 1)
    if strip_body:
        body = F.regexp_replace(body, r"(?U)^\s+", "")
    said = F.length(whole) > 0
    found = F.when(said, once(rows, read)).otherwise(F.struct(none.alias("meta"), empty.alias("lists")))
    return once(found, lambda m: F.struct(m["meta"].alias("meta"), m["lists"].alias("lists"), F.when(said, body).otherwise(text).alias("body")))


_YAML = "struct<meta:map<string,string>,lists:map<string,array<string>>,json:string,error:string>"


def yaml_front_matter(text: Column) -> Column:
    """struct(meta map of texts by dotted path, lists map of arrays by path, json, error, body): a header read as YAML.

    The header stands between a line ``---`` at the very start and the next such line, with LF ends; the body is what
    follows, as it is. Without a header the maps are empty and the body is the whole text; one that is no YAML has an
    error, and its body too. Only headers go to Python.
    """
    whole = F.regexp_extract(text, r"(?s)^---\n(.*?\n)?---(\n|\z)", 0)
    header = F.when(F.length(whole) > 0, F.regexp_replace(F.regexp_replace(whole, r"\A---\n", ""), r"---\n?\z", ""))
    found = F.pandas_udf(lambda s: pd.DataFrame([read(x) or NOTHING for x in s], columns=list(NOTHING)), _YAML)(header)
    return F.struct(*[found[c].alias(c) for c in NOTHING], F.when(header.isNull(), text).otherwise(F.substr(text, F.length(whole) + 1)).alias("body"))


def _slashed(source: Column) -> Column:
    return F.replace(F.coalesce(source, F.lit("")), F.lit("\\"), F.lit("/"))


def basename(source: Column) -> Column:
    return F.regexp_extract(_slashed(source), r"([^/]*)$", 1)


def is_rule(source: Column, doc_type: Column, folder: str = RULE_FOLDER) -> Column:
    return F.contains(_slashed(source), F.lit(folder)) | basename(source).rlike(RULE_FILE) | F.coalesce(doc_type == RULE_TYPE, F.lit(False))


def source_class(source: Column, doc_type: Column, marks: Sequence[tuple[str, str]] = CLASS_MARKS, folder: str = RULE_FOLDER) -> Column:
    out = F.when(is_rule(source, doc_type, folder), F.lit(RULE_TYPE))
    for name, mark in marks:
        out = out.when(F.contains(F.lower(_slashed(source)), F.lit(mark)), F.lit(name))
    return out.otherwise("other")


def enrich(docs: DataFrame, text_col: str = "text", source_col: str = "source", strip_body: bool = True, folder: str = RULE_FOLDER) -> DataFrame:
    """``docs`` with the header taken out of the text into ``meta``, ``lists`` and ``doc_type``."""
    out = docs.withColumn("_front", front_matter(F.col(text_col), strip_body))
    said = F.try_element_at(F.col("_front.meta"), F.lit("doc_type"))
    kind = F.coalesce(said, F.when(is_rule(F.col(source_col), said, folder), F.lit(RULE_TYPE)))
    return out.withColumn("meta", F.col("_front.meta")).withColumn("lists", F.col("_front.lists")).withColumn("doc_type", kind).withColumn(text_col, F.col("_front.body")).drop("_front")


def doc_key(source: Column, chunk_id: Column) -> Column:
    return F.concat(F.coalesce(source, F.lit("unknown_source")), F.lit("::chunk::"), chunk_id.cast("string"))


def display(doc_type: Column, code: Column, number: Column, title: Column, parent: Column, source: Column, chunk_id: Column) -> Column:
    """The label of a chunk: rules by their number and titles, others by file and chunk."""
    code, number, title, parent = (strip(F.coalesce(c, F.lit(""))) for c in (code, number, title, parent))
    said = lambda *cs: F.array_min(F.array(*[F.length(c) for c in cs])) > 0 if len(cs) > 1 else F.length(cs[0]) > 0
    rule = F.coalesce(doc_type == RULE_TYPE, F.lit(False))
    return (
        F.when(rule & said(code, number, parent, title) & (parent != title), F.concat(code, F.lit(" "), number, F.lit(" "), parent, F.lit(" > "), title))
        .when(rule & said(code, number, title), F.concat_ws(" ", code, number, title))
        .when(rule & said(number, title), F.concat_ws(" ", number, title))
        .when(rule & said(number), number)
        .otherwise(F.concat(basename(F.coalesce(source, F.lit("KMS"))), F.lit("#"), chunk_id.cast("string")))
    )


def categories(path: Column) -> Column:
    """The trimmed parts of a category path; empty where there is no category."""
    none = path.isNull() | path.isin("", NO_PATH)
    return F.when(none, F.array().cast("array<string>")).otherwise(F.transform(F.split(path, " > "), strip))


def category_depths(meta: Column, key: str = "분류") -> Column:
    """The map with an entry category_depth1, category_depth2, ... for each part of its category path."""
    parts = F.transform(categories(F.try_element_at(meta, F.lit(key))), lambda x, i: F.struct(F.concat(F.lit("category_depth"), i + 1), x))
    added = F.map_from_entries(parts)
    return F.map_concat(F.map_filter(meta, lambda k, _: ~F.startswith(k, F.lit("category_depth"))), added)
