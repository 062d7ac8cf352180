"""String expressions with the semantics that documents need: Unicode white space, LF lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind; ``trim`` drops spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value computed once for a row, where lambdas would compute it for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lines(c: Column) -> Column:
    """Lines of a text, with CRLF and CR read as LF."""
    return F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n")


def tokens(c: Column) -> Column:
    """Non-empty runs between white space; case is kept."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def any_of(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many different words occur in the text; overlapping words all count."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w.lower())).cast("int") for w in words], F.lit(0))


def present(text: Column, named: dict[str, Sequence[str]]) -> Column:
    """Names, in order, of which any word occurs in the text."""
    return F.filter(F.array(*[F.when(any_of(text, [w.lower() for w in ws]), F.lit(name)) for name, ws in named.items()]), lambda x: x.isNotNull())


def shown(number: Column) -> Column:
    """A number of at most four decimal places as text, without an exponent."""
    small = F.regexp_replace(F.format_string("%.4f", number), "0+$", "")
    return F.when((number > 0) & (number < 0.001), small).otherwise(number.cast("string"))
