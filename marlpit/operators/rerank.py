"""Rule-based reranking with the reasons for every score.

Null texts, titles, messages and sources count as empty; ties keep the fused order, so equal rows need different ``idx``;
other columns are carried, but for institutions, rerank_score and reasons, which are replaced; empty tables stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of
from .profile import Lexicon, doc_institutions


@dataclass(frozen=True)
class Weights:
    """Points by term and source class."""

    base: dict[str, float] = field(default_factory=lambda: {"internal_rule": 4.0, "official": 3.0, "faq": 2.0, "kms": 1.0})
    rule: dict[str, float] = field(default_factory=lambda: {"internal_rule": 3.0, "official": 1.5})
    system: dict[str, float] = field(default_factory=lambda: {"kms": 3.0})
    case: dict[str, float] = field(default_factory=lambda: {"faq": 1.5, "kms": 2.0})
    official: dict[str, float] = field(default_factory=lambda: {"official": 2.5})
    compare: dict[str, float] = field(default_factory=lambda: {"internal_rule": 1.8, "official": 1.8})
    property: tuple[float, float, float] = (4.0, 2.5, 1.0)
    product: float = 2.5
    institution: float = 1.8
    amount: float = 0.8
    parent: float = 0.2
    rank: tuple[float, float] = (0.3, 0.02)


# What the reasons are called.
BASE, RULE, SYSTEM, CASE, OFFICIAL, COMPARE, CORE = "base", "rule_bias", "system_bias", "case_bias", "official_bias", "compare_bias", "core_source"
PROPERTY_TITLE, PROPERTY_PARENT, PROPERTY_BODY = "property_title", "property_parent", "property_body"
PRODUCT, INSTITUTION, AMOUNT, PARENT, RANK = "product_match", "institution", "amount_signal", "parent_section_hint", "base_rank_bias"

TITLES = ("section_title", "parent_section_title", "doc_title")


def _by_class(kind: Column, points: dict[str, float], name: str, when: Column, shown: str | None = None) -> Column:
    """An item (points, reason) or null."""
    out = None
    for k, p in points.items():
        item = F.struct(F.lit(p).alias("points"), F.lit(f"{name}:{shown or k}+{p}").alias("reason"))
        out = F.when(when & (kind == k), item) if out is None else out.when(when & (kind == k), item)
    return out


def _item(points: Column, reason: Column) -> Column:
    return F.struct(points.cast("double").alias("points"), reason.alias("reason"))


def score(candidates: DataFrame, lexicon: Lexicon | None = None, weights: Weights | None = None) -> DataFrame:
    """``candidates`` with institutions, rerank_score (4 places) and reasons.

    Needs request_id, idx (fused rank from 0), profile, message, source, source_class, text, parent_section_no and the
    titles; missing titles are null. Each term is an item of points and reason, so the reasons always add up.
    """
    lex, w = lexicon or Lexicon(), weights or Weights()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    kind, p = F.col("source_class"), F.col("profile")
    section, text = low("section_title"), low("text")
    titles = F.concat_ws(" ", *[low(t) for t in TITLES])
    held = doc_institutions(F.col("source"), F.col("section_title"), F.col("parent_section_title"), F.col("doc_title"), F.col("text"), lex)
    one, two, three = w.property
    named = lambda where, points: lambda x: _item(F.lit(points), F.concat(F.lit(f"{where}:"), x, F.lit(f"+{points}")))
    properties = F.filter(
        F.transform(
            p["normalized_properties"],
            lambda x: F.when(F.contains(section, F.lower(x)), named(PROPERTY_TITLE, one)(x)).when(F.contains(titles, F.lower(x)), named(PROPERTY_PARENT, two)(x)).when(F.contains(text, F.lower(x)), named(PROPERTY_BODY, three)(x)),
        ),
        lambda x: x.isNotNull(),
    )
    products = F.size(F.filter(p["product_hits"], lambda x: F.contains(titles, F.lower(x)))) * F.lit(w.product)
    institutions = F.transform(F.filter(p["institutions"], lambda x: F.array_contains(F.col("institutions"), x)), lambda x: _item(F.lit(w.institution), F.concat(F.lit(f"{INSTITUTION}:"), x, F.lit(f"+{w.institution}"))))
    amount = any_of(F.lower(F.coalesce(F.col("message"), F.lit(""))), lex.amount) & any_of(text, lex.amount)
    bias = F.greatest(F.lit(0.0), F.lit(w.rank[0]) - F.col("idx") * F.lit(w.rank[1]))
    before = F.array(
        _by_class(kind, w.base, BASE, F.lit(True)),
        _by_class(kind, w.rule, RULE, p["rule_score"] >= 2),
        _by_class(kind, w.system, SYSTEM, p["system_score"] >= 1),
        _by_class(kind, w.case, CASE, p["case_score"] >= 1),
        _by_class(kind, w.official, OFFICIAL, p["official_score"] >= 1),
        _by_class(kind, w.compare, COMPARE, p["is_compare"], CORE),
    )
    after = F.array(
        F.when(amount, _item(F.lit(w.amount), F.lit(f"{AMOUNT}+{w.amount}"))),
        F.when(F.trim(F.coalesce(F.col("parent_section_no"), F.lit(""))) != "", _item(F.lit(w.parent), F.lit(f"{PARENT}+{w.parent}"))),
        _item(bias, F.concat(F.lit(f"{RANK}+"), F.format_number(bias, 2))),
    )
    product = F.array(F.when(products > 0, _item(products, F.concat(F.lit(f"{PRODUCT}+"), products.cast("string")))))
    items = F.filter(F.concat(before, properties, product, institutions, after), lambda x: x.isNotNull())
    out = candidates.withColumn("institutions", held).withColumn("_items", items)
    total = F.round(F.aggregate("_items", F.lit(0.0), lambda s, x: s + x["points"]), 4)
    return out.withColumn("rerank_score", total).withColumn("reasons", F.transform("_items", lambda x: x["reason"])).drop("_items")


def rerank(scored: DataFrame) -> DataFrame:
    """``scored`` with rerank_rank by score, ties by fused rank."""
    return scored.withColumn("rerank_rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("rerank_score"), "idx")))


def reason_text(reasons: Column, separator: str = " | ") -> Column:
    return F.array_join(reasons, separator)
