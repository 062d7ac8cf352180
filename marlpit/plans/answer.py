"""From questions to prompts: profile, retrieve, rerank, select, render, log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import context, fusion, logs, metadata, profile, rerank
from ..operators.profile import Lexicon
from ..operators.rerank import Weights
from ..session import cut

#: Texts in, as many texts out: a language model, or a client of one.
Model = Callable[[list[str]], list[str]]


@dataclass
class Answers:
    results: DataFrame
    diagnostics: DataFrame
    debug: DataFrame


def candidates(fused: DataFrame, chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Fused rows with their chunks' columns and the request's message and profile."""
    meta = lambda k: F.try_element_at(F.col("meta"), F.lit(k)).alias(k)
    known = chunks.select("key", "source", "chunk_id", "doc_type", "source_class", "text", *[meta(k) for k in ("doc_code", "section_no", "section_title", "parent_section_no", "parent_section_title", "doc_title")])
    return fused.withColumn("idx", F.col("rank") - 1).join(known, "key").join(requests.select("request_id", "message", "profile"), "request_id")


def spoken(prompt: Column, model: Model) -> Column:
    """struct(text, error) of the model's reply to each prompt; null prompts are not asked.

    Prompts go in batches. A batch that fails is asked again one by one, so an error stands only at its own request.
    """

    def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            said = list(model(prompts))
            if len(said) == len(prompts):
                return [(x, None) for x in said]
            raise ValueError(f"{len(said)} replies to {len(prompts)} prompts")
        except Exception as e:  # the model is the caller's: whatever it raises is the request's error
            return [(None, f"{type(e).__name__}: {e}")] if len(prompts) == 1 else [x for p in prompts for x in ask([p])]

    @F.pandas_udf("text string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        there = s.notna()
        said = iter(ask(s[there].tolist()) if there.any() else [])
        return pd.DataFrame([next(said) if x else (None, None) for x in there], columns=["text", "error"])

    return run(prompt)


def rewritten(requests: DataFrame, model: Model | None, template: str = context.REWRITE) -> DataFrame:
    """``requests`` with search_query and rewrite_error.

    Only requests with earlier messages (recent) and, where there is such a column, turns above 0 are rewritten; of
    others, and where the model fails or says nothing, the message is searched.
    """
    if model is None:
        return requests.withColumn("search_query", F.col("message")).withColumn("rewrite_error", F.lit(None).cast("string"))
    turns = F.coalesce(F.col("turns"), F.lit(0)) if "turns" in requests.columns else F.lit(1)
    asked = F.when((turns > 0) & (F.coalesce("recent", F.lit("")) != ""), context.render(template, recent_context=F.col("recent"), message=F.col("message")))
    said = requests.withColumn("_said", spoken(asked, model))
    return said.withColumn("search_query", F.coalesce(F.nullif(F.trim("_said.text"), F.lit("")), "message")).withColumn("rewrite_error", F.col("_said.error")).drop("_said")


def answer(index, requests: DataFrame, limit: int = 6, k: int = 12, lexicon: Lexicon | None = None, weights: Weights | None = None, rewrite: Model | None = None, model: Model | None = None, template: str = context.ANSWER, rewrite_template: str = context.REWRITE, system: str = context.SYSTEM) -> Answers:
    """Answers over a flat or a split index for requests (request_id, message; recent, the earlier messages or null; and, if
    given, turns).

    ``rewrite`` and ``model`` reply to prompts, a batch at a time; without ``model`` the answer is the prompt, which
    ``system`` precedes. The profile is always that of the message. A request for which a model fails has the error in
    its row, and a null answer or the message as its query; no other request is touched. Requests that find nothing have
    an empty context. A null message finds nothing.
    """
    asked = cut(rewritten(requests, rewrite, rewrite_template), "asked") if rewrite else rewritten(requests, None)
    asked = asked.withColumn("profile", profile.profile(F.col("message"), lexicon))
    found = index.search(asked.select("request_id", F.col("search_query").alias("query")), k)
    lists = {name: cut(rows, "list") for name, rows in found.lists.items()}
    found = replace(found, lists=lists)
    dense = lists[found.dense] if "distance" in lists[found.dense].columns else lists[found.dense].withColumn("distance", F.lit(None).cast("double"))
    fused = fusion.with_origin(lists[found.fused], lists[found.keyword], dense)
    ranked = cut(rerank.rerank(rerank.score(candidates(fused, index.chunks, asked), lexicon, weights)), "reranked")
    chosen = context.select_context(ranked, limit)
    shown = metadata.display(F.col("doc_type"), F.col("doc_code"), F.col("section_no"), F.col("section_title"), F.col("parent_section_title"), F.col("source"), F.col("chunk_id"))
    labelled = ranked.withColumn("display", shown)
    final = labelled.join(chosen, ["request_id", "key"])
    strings = context.joined(
        final.withColumn("block", context.context_block(F.col("display"), F.col("text"))).withColumn("why", F.array_join("reasons", " | ")),
        "request_id",
        "position",
        {"context": (F.col("block"), "\n\n"), "src": (F.col("display"), ", "), "ref_documents": (F.col("display"), "|"), "search_reasons": (F.col("why"), "|"), "vector_similarities": (text.shown(F.col("similarity")), "|"), "bm25_ranks": (F.col("bm25_rank"), "|"), "rrf_final_scores": (text.shown(F.col("rerank_score")), "|")},
    )
    prompt = F.concat(F.lit(f"{system}\n\n" if system else ""), context.render(template, context=F.col("context"), message=F.col("message"), src=F.col("src")))
    out = asked.join(strings, "request_id", "left").withColumn("prompt", prompt)
    said = spoken(F.col("prompt"), model) if model else F.struct(F.col("prompt").alias("text"), F.lit(None).cast("string").alias("error"))
    out = out.withColumn("_said", said)
    error = F.nullif(F.concat_ws("; ", "rewrite_error", "_said.error"), F.lit(""))
    results = out.select("request_id", "message", "search_query", "prompt", F.col("_said.text").alias("answer"), error.alias("error"), "ref_documents", "search_reasons", "vector_similarities", "bm25_ranks", "rrf_final_scores")

    return Answers(results, logs.diagnostics(stages(labelled, final), asked), found.debug())


def stages(labelled: DataFrame, final: DataFrame) -> DataFrame:
    """The five stages of a diagnostic record, in long form, of reranked candidates with their labels and of those chosen."""
    fields = [*labelled.columns]
    stage = lambda name, rows, position: rows.select(*fields, F.lit(name).alias("stage"), F.col(position).alias("position"))
    rows = (
        stage("bm25_top", labelled.where("bm25_rank > 0"), "bm25_rank")
        .unionByName(stage("vector_top", labelled.where("vector_rank > 0"), "vector_rank"))
        .unionByName(stage("hybrid_before_rerank", labelled, "rank"))
        .unionByName(stage("rerank_after", labelled, "rerank_rank"))
        .unionByName(stage("final_context", final, "position"))
    )
    return rows.withColumn("source_type", F.col("source_class"))
