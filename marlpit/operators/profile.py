"""What a question asks for, told by keywords.

A null question is an empty one; expressions on a row, so there are no ties, rows repeat as they are, and an empty table
stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hits, present, strip


@dataclass(frozen=True)
class Lexicon:
    """Keywords by what they tell, and names with the words that stand for them."""

    rule: Sequence[str] = ("한도", "최대한도", "최대 금액", "최대금액", "얼마", "금리", "대상", "대출대상", "대상주택", "채권보전", "승인", "심사", "중도상환", "기한연장", "요건", "조건")
    system: Sequence[str] = ("전산", "화면", "입력", "등록", "처리", "메뉴", "#", "화면번호")
    case: Sequence[str] = ("가능", "가능한가", "경우", "케이스", "상황", "예외", "상담", "처리해야")
    official: Sequence[str] = ("hug", "hf", "sgi", "주택도시보증공사", "주택금융공사", "서울보증보험", "보증기관")
    compare: Sequence[str] = ("비교", "각각", "기관별", "보증기관별", "상품별")
    amount: Sequence[str] = ("억원", "만원", "금액", "최대")
    products: Sequence[str] = ("우량주택전세론", "버팀목", "디딤돌", "전세자금대출", "전세자금", "전세론", "주신보", "보증부월세", "오피스텔", "디딤돌대출", "중소기업취업청년")
    asked_institutions: dict[str, Sequence[str]] = field(default_factory=lambda: {"HUG": ["hug"], "HF": ["hf"], "SGI": ["sgi"]})
    institutions: dict[str, Sequence[str]] = field(default_factory=lambda: {"HUG": ["hug", "주택도시보증공사"], "HF": ["hf", "주택금융공사", "주신보"], "SGI": ["sgi", "서울보증보험"]})
    properties: dict[str, Sequence[str]] = field(
        default_factory=lambda: {
            "대출한도": ["한도", "최대한도", "최대 금액", "최대금액", "얼마", "억원", "금액"],
            "대출대상": ["대상", "대출대상", "대상자", "누가", "자격"],
            "대상주택": ["대상주택", "집 조건", "물건 조건", "주택 조건", "가능한 주택", "주택요건"],
            "대출금리": ["금리", "이율", "대출금리"],
            "심사 및 승인": ["승인", "승인권자", "누가 승인", "결재", "전결", "심사"],
            "채권보전": ["채권보전", "담보", "보전"],
            "중도상환해약금": ["중도상환", "중도상환해약금", "중도상환수수료"],
        }
    )

    @classmethod
    def of(cls, rows: DataFrame, most: int = 10_000) -> Lexicon:
        """A lexicon kept as a table: kind (a field of this class), name (null where the field is a plain list), word.

        Words and names are in alphabetic order; kinds that the table lacks are as above. More than ``most`` rows are an
        error, as all become part of expressions.
        """
        found = rows.select("kind", "name", "word").distinct().orderBy("kind", "name", "word").limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} words")
        held: dict = {}
        for r in found:
            if r["name"] is None:
                held.setdefault(r["kind"], []).append(r["word"])
            else:
                held.setdefault(r["kind"], {}).setdefault(r["name"], []).append(r["word"])
        return cls(**held)


def profile(question: Column, lexicon: Lexicon | None = None) -> Column:
    """struct of raw_text, five scores, is_compare, institutions, normalized_properties and product_hits."""
    lex = lexicon or Lexicon()
    raw = strip(F.coalesce(question, F.lit("")))
    low = F.lower(raw)
    institutions = present(low, lex.asked_institutions)
    products = present(low, {p: [p] for p in lex.products})
    compare = hits(low, lex.compare) + F.when(F.size(institutions) >= 2, 2).otherwise(0)
    return F.struct(
        raw.alias("raw_text"),
        (hits(low, lex.rule) + F.size(products)).alias("rule_score"),
        hits(low, lex.system).alias("system_score"),
        hits(low, lex.case).alias("case_score"),
        hits(low, lex.official).alias("official_score"),
        compare.alias("compare_score"),
        (compare >= 1).alias("is_compare"),
        institutions.alias("institutions"),
        present(low, lex.properties).alias("normalized_properties"),
        products.alias("product_hits"),
    )


def doc_institutions(source: Column, section: Column, parent: Column, title: Column, text: Column, lexicon: Lexicon | None = None, head: int = 1200) -> Column:
    """Institutions named in a document's path, titles or first characters."""
    blank = [F.coalesce(c, F.lit("")) for c in (source, section, parent, title, F.left(text, F.lit(head)))]
    return present(F.lower(F.concat_ws(" ", *blank)), (lexicon or Lexicon()).institutions)
