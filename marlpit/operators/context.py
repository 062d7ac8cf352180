"""What goes into the prompt: selected chunks, earlier messages, templates.

Null texts count as empty; ties in a conversation's turns are in no defined order, so turns must differ; a request
without candidates has no context; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Order of source classes, and the first of them that comparisons look in.
ORDER = ("internal_rule", "official", "faq", "kms", "other")
COMPARED = ORDER[:4]


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def select_context(reranked: DataFrame, limit: int = 6) -> DataFrame:
    """request_id, position (from 1), key of at most ``limit`` different candidates.

    For a comparison, every asked institution first gets the best candidate of each class that is not taken yet. Then
    classes follow in order, reranked within each. Needs request_id, key, rerank_rank, source_class, institutions and
    profile. A request's candidates, as many as retrieval returns, are folded inside one row.
    """
    one = F.struct("rerank_rank", "key", F.col("source_class").alias("kind"), "institutions")
    rows = reranked.groupBy("request_id").agg(F.array_sort(F.collect_list(one)).alias("all"), F.any_value(F.struct("profile.is_compare", "profile.institutions")).alias("p"))
    wanted = F.when(F.col("p.is_compare"), F.flatten(F.transform("p.institutions", lambda i: F.transform(F.array(*[F.lit(c) for c in COMPARED]), lambda c: F.struct(i.alias("who"), c.alias("kind")))))).otherwise(F.array().cast("array<struct<who:string,kind:string>>"))
    key_type = reranked.schema["key"].dataType.simpleString()
    none = F.array().cast(f"array<{key_type}>")

    def take(taken: Column, want: Column) -> Column:
        fit = F.filter("all", lambda x: (x["kind"] == want["kind"]) & F.array_contains(x["institutions"], want["who"]) & ~F.array_contains(taken, x["key"]))
        return F.when((F.size(fit) > 0) & (F.size(taken) < limit), F.array_append(taken, F.get(fit, F.lit(0))["key"])).otherwise(taken)

    compared = F.aggregate(wanted, none, take)
    filled = F.flatten(F.array(*[F.transform(F.filter("all", _is(c)), lambda x: x["key"]) for c in ORDER]))
    chosen = F.slice(F.array_distinct(F.concat(compared, filled)), 1, limit)
    return rows.select("request_id", F.posexplode(chosen).alias("_at", "key")).select("request_id", (F.col("_at") + 1).alias("position"), "key")


def history(messages: DataFrame, turns: int | Column, conv_col: str = "conv_id", turn_col: str = "turn", head: int = 50) -> DataFrame:
    """``messages`` with recent: the last ``turns`` messages before each, one to a line, null when there are none.

    ``turns`` is a number, or a column that says it for each message; then the greatest number asked is looked up first.
    """
    if isinstance(turns, int):
        turns, most = F.lit(turns), max(turns, 0)
    else:
        most = messages.agg(F.max(turns)).first()[0] or 0
    if most <= 0:
        return messages.withColumn("recent", F.lit(None).cast("string"))
    line = F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), F.left(F.coalesce("text", F.lit("")), F.lit(head)), F.lit("\n"))
    before = F.collect_list(line).over(Window.partitionBy(conv_col).orderBy(turn_col).rowsBetween(-most, -1))
    kept = F.greatest(F.least(F.coalesce(turns, F.lit(0)), F.size(before)), F.lit(0))
    return messages.withColumn("recent", F.nullif(F.array_join(F.slice(before, F.size(before) - kept + 1, kept), ""), F.lit("")))


def answered_question(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``messages`` with question: the text just before, ``N/A`` for a conversation's first."""
    return messages.withColumn("question", F.lag("text", 1, "N/A").over(Window.partitionBy(conv_col).orderBy(turn_col)))


_PLACE_BITS = 33  # of monotonically_increasing_id, below the partition's number


def in_pieces(rows: DataFrame, by: str, order: str, reach: int, pieces: int | None = None) -> DataFrame:
    """``rows`` in pieces of like size along (by, order), as columns _piece, _place (through all rows) and _guest.

    A conversation of any length is spread over as many pieces as its rows need. Each piece also holds, as guests, the
    ``reach`` rows before its first one, so that a window over a piece sees what a window over the whole would see. There
    are at most ``pieces``; left out, as many as Spark makes of the data's size.
    """
    number = [] if pieces is None else [pieces]
    sorted_ = rows.repartitionByRange(*number, F.col(by), F.col(order)).sortWithinPartitions(by, order)
    placed = cut(sorted_.withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_id", _PLACE_BITS).cast("int")
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row for each piece
    ends = list(accumulate(r["n"] for r in sizes))
    starts = {r["p"]: end - r["n"] for r, end in zip(sizes, ends, strict=True)}
    known = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]) if starts else F.create_map().cast("map<int,int>")
    place = F.try_element_at(known, part).cast("long") + F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    own = placed.withColumn("_piece", part).withColumn("_place", place).drop("_id")
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).cast("long").alias("s")) for p, s in starts.items()]) if starts else F.array().cast("array<struct<p:int,s:bigint>>")
    later = F.transform(F.filter(listed, lambda x: (x["s"] > F.col("_place")) & (x["s"] - reach <= F.col("_place"))), lambda x: x["p"])
    # only a piece's last rows are guests of another
    guests = own.withColumn("_piece", F.explode(later))
    return own.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))


def long_history(messages: DataFrame, turns: int, conv_col: str = "conv_id", turn_col: str = "turn", head: int = 50, pieces: int | None = None) -> DataFrame:
    """As ``history`` with a number of turns, for conversations that are too long for a task; with question as well, as
    ``answered_question`` has it."""
    reach = max(turns, 1)
    line = F.concat(F.when(F.col("role") == "user", "Q: ").otherwise("A: "), F.left(F.coalesce("text", F.lit("")), F.lit(head)), F.lit("\n"))
    rows = in_pieces(messages, conv_col, turn_col, reach, pieces)
    before = F.collect_list(F.struct(F.col(conv_col).alias("c"), line.alias("x"), F.col("text").alias("t"))).over(Window.partitionBy("_piece").orderBy("_place").rowsBetween(-reach, -1))
    same = F.filter(F.col("_before"), lambda b: b["c"].eqNullSafe(F.col(conv_col)))
    kept = F.slice("_same", F.greatest(F.size("_same") - turns + 1, F.lit(1)), turns) if turns > 0 else F.slice("_same", 1, 0)
    found = rows.withColumn("_before", before).where(~F.col("_guest")).withColumn("_same", same)
    recent = F.nullif(F.array_join(F.transform(kept, lambda b: b["x"]), ""), F.lit(""))
    question = F.when(F.size("_same") > 0, F.element_at("_same", -1)["t"]).otherwise("N/A")
    return found.withColumn("recent", recent).withColumn("question", question).select(*messages.columns, "recent", "question")


def context_block(display: Column, text: Column) -> Column:
    return F.concat(F.lit("--- [참조: "), display, F.lit("] ---\n"), text)


#: Templates are the caller's; these are plain defaults.
REWRITE = "Earlier messages:\n{recent_context}\nQuestion: {message}\nSearch query:"
SYSTEM = "Answer from the given documents only."
ANSWER = "Documents:\n{context}\n\nQuestion: {message}\n\nSources: {src}"


def render(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced once; what a value holds is not read as a template."""
    parts, rest = [], template
    while True:
        at = min(((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=None)
        if at is None:
            return F.concat(*parts, F.lit(rest))
        parts += [F.lit(rest[: at[0]]), F.coalesce(values[at[1]].cast("string"), F.lit(""))]
        rest = rest[at[0] + len(at[1]) + 2 :]


def joined(rows: DataFrame, by: str, order: Column | str, columns: dict[str, tuple[Column, str]]) -> DataFrame:
    """Ordered string aggregates: for each name a column and the separator."""
    order = F.col(order) if isinstance(order, str) else order
    pairs = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.cast("string").alias("x")))), lambda s: s["x"]), sep).alias(name) for name, (c, sep) in columns.items()]
    return rows.groupBy(by).agg(*pairs)

