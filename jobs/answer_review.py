"""Review logged answers: what each was asked, what the documents say to it, and how much of it they support.

    python -m jobs.answer_review --conversations DIR --documents DIR --target DIR [--config FILE]

For every assistant's message that is not its conversation's first: the message before it as the question, the messages
before that, the profile of what was asked, the best documents by keyword search, and the share of the answer's
different words that these documents hold. Answers go to TARGET/answers in folders by grade (good, weak, none);
TARGET/index holds the keyword index of the documents, as this run built it. A run replaces what an earlier one wrote, so
reruns give the same result.

Defined results: null or wordless questions find no documents, and wordless answers have no words to support: both have
support 0 and the grade none. Rows without a conversation or turn are not read; of several rows of one turn that whose
role and text come last counts. Documents with one key count as one. Empty tables give no rows. Columns that no setting
names are not read.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import LOG, config, session
from marlpit.functions.text import tokens
from marlpit.operators import context, lexical, profile

ANSWERS = "conv_id long, turn long, question string, recent string, official_score int, is_compare boolean, ref_documents string, top_score double, words int, supported int, support double, grade string"


def asked(messages: DataFrame, turns: int) -> DataFrame:
    """request_id, conv_id, turn, question, recent, answer of every answer that follows a message."""
    known = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    once = known.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).agg(F.max(F.struct("role", "text")).alias("x")).select("conv_id", "turn", "x.*")
    rows = context.answered_question(context.history(once, turns)).withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    answers = rows.where((F.col("role") == "assistant") & (F.col("place") > 1))
    return answers.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), "conv_id", "turn", "question", "recent", F.col("text").alias("answer"))


def supported(answers: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """request_id, ref_documents, top_score and supported: how many of the answer's words the found documents hold.

    Words meet inside a row for each found document, of which a request has few, and only those in common go on. Answers go to the
    documents, as texts; those are split where they meet.
    """
    said = found.select("request_id", "key").join(answers.select("request_id", "answer"), "request_id")
    common = said.join(docs, "key").select("request_id", F.array_intersect(F.array_distinct(tokens(F.col("answer"))), tokens(F.col("text"))).alias("common"))
    counts = common.groupBy("request_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("common")))).alias("supported"))
    refs = context.joined(found, "request_id", "rank", {"ref_documents": (F.col("key"), "|")}).join(found.groupBy("request_id").agg(F.max("score").alias("top_score")), "request_id")
    return refs.join(counts, "request_id", "left")


def run(spark: SparkSession, conversations: DataFrame, documents: DataFrame, target: str, settings: dict[str, Any] | None = None) -> dict[str, int]:
    """Review all answers of ``conversations``; how many answers were read and written."""
    settings = settings or config(None, "answer_review.json")
    docs = documents.select(F.col(settings["document_key"]).alias("key"), F.col(settings["document_text"]).alias("text")).where(F.col("key").isNotNull())
    index = lexical.store(docs, f"{target}/index", "key", "text")
    asked(conversations, settings["turns"]).write.mode("overwrite").parquet(f"{target}/asked")  # read by the search and both joins
    answers = spark.read.parquet(f"{target}/asked")
    found = lexical.search(index, answers.select("request_id", F.col("question").alias("query")), settings["documents_a_question"])
    told = profile.profile(F.col("question"))
    rows = answers.join(supported(answers, found, docs), "request_id", "left").withColumn("p", told)
    words = F.size(F.array_distinct(tokens(F.coalesce("answer", F.lit("")))))
    held = F.coalesce("supported", F.lit(0))
    rows = rows.withColumn("words", words).withColumn("supported", held).withColumn("support", F.round(F.coalesce(F.try_divide("supported", "words"), F.lit(0.0)), 6))
    grade = F.when(F.col("support") >= settings["well_supported"], "good").when(F.col("support") > 0, "weak").otherwise("none")
    shown = rows.select("conv_id", "turn", "question", "recent", "p.official_score", "p.is_compare", "ref_documents", "top_score", "words", "supported", "support", grade.alias("grade"))
    shown.repartition("grade", F.pmod(F.xxhash64("conv_id"), F.lit(settings["files_a_grade"]))).write.mode("overwrite").partitionBy("grade").parquet(f"{target}/answers")
    done = {"read": answers.count(), "written": reviewed(spark, target).count()}
    LOG.info("%d answers read, %d reviewed in %s", done["read"], done["written"], target)
    return done


def reviewed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(ANSWERS).parquet(f"{target}/answers")


def main() -> None:
    args = argparse.ArgumentParser(description="Review logged answers against the documents.")
    for name in ("conversations", "documents", "target"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", help="JSON file with settings over those of answer_review.json")
    said = args.parse_args()
    spark = session("answer-review")
    try:
        run(spark, spark.read.parquet(said.conversations), spark.read.parquet(said.documents), said.target, config(said.config, "answer_review.json"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
