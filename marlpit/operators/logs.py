"""Candidate summaries, diagnostic records and feedback rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vector import similarity

STAGES = ("bm25_top", "vector_top", "hybrid_before_rerank", "rerank_after", "final_context")
# Fixed value: the columns of a feedback row.
FEEDBACK = ("timestamp", "context_turns", "original_question", "searched_query", "ai_response", "feedback", "ref_documents", "search_reasons", "vector_similarities", "bm25_ranks", "rrf_final_scores")


def summary() -> Column:
    """The ten fields of a candidate; what is missing is 0 or empty."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return F.struct(
        "display",
        "source_type",
        said("section_no"),
        said("section_title"),
        said("parent_section_title"),
        F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"),
        F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"),
        similarity(F.col("distance")).alias("vector_score"),
        F.coalesce("rerank_score", F.lit(0.0)).alias("rerank_score"),
        F.coalesce(F.array_join("reasons", " | "), F.lit("")).alias("rerank_reason"),
    )


def diagnostics(candidates: DataFrame, requests: DataFrame, now: Column | None = None) -> DataFrame:
    """One record per request: timestamp, question, search_query, question_profile, and the candidates of each stage in order.

    ``candidates`` holds request_id, stage, position and the fields of ``summary``; as many rows as retrieval returns.
    """
    lists = candidates.groupBy("request_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("stage") == s, F.struct("position", summary().alias("c"))))), lambda x: x["c"]).alias(s) for s in STAGES])
    stamp = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    asked = requests.select("request_id", stamp.alias("timestamp"), F.col("message").alias("question"), "search_query", F.col("profile").alias("question_profile"))
    return asked.join(lists, "request_id", "left")


def feedback_rows(events: DataFrame, messages: DataFrame, results: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per event (conv_id, turn, liked), with the answer, the question before it and that request's results.

    ``results`` is keyed by conv_id and turn and carries context_turns, searched_query and the five joined strings.
    """
    from .context import answered_question

    stamp = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    keys = ["conv_id", "turn"]
    rows = events.join(answered_question(messages).select(*keys, "question", "text"), keys).join(results, keys, "left")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c)
    return rows.select(stamp.alias("timestamp"), F.coalesce("context_turns", F.lit(0)).alias("context_turns"), F.col("question").alias("original_question"), shown("searched_query"), F.col("text").alias("ai_response"), F.when(F.col("liked"), "LIKE").otherwise("DISLIKE").alias("feedback"), *[shown(c) for c in FEEDBACK[6:]])
