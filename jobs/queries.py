"""The jobs as queries over the driver's tables, each run twice into one folder, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import answer_review, chunk_feed
from jobs.common import config
from marlpit.plans import queries as plans
from marlpit.session import shared_dir, ship


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which stays."""
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_chunk_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    folder = _folder(spark, "chunk-feed")
    made = plans.made_documents()
    settings = config(None, "chunk_feed.json") | {"key": made["key"], "source": made["source"], "doc_type": made["doc_type"], "text": r"trim(regexp_replace(" + made["text"] + r", '\\s+', ' '))"}
    source = f"{sf_dir}/documents.parque[t]"  # a pattern, as the table may be one file
    for _ in range(2):
        chunk_feed.run(spark, source, f"{folder}/table", f"{folder}/checkpoint", settings)
    found = chunk_feed.current(spark, f"{folder}/table")
    return found.select(F.col("key").cast("long").alias("key"), "source", "source_class", "chunk_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def job2_answer_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    folder = _folder(spark, "answer-review")
    for _ in range(2):
        answer_review.run(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return answer_review.reviewed(spark, folder).withColumn("top_score", F.round("top_score", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_chunk_feed, job2_answer_review)}


def oracle_sql() -> dict[str, str]:
    return {"job1_chunk_feed": plans.routed_chunks_sql("SELECT id AS key, r.source, r.source_class, part AS chunk_id, chars, md5(piece) AS text_md5 FROM pieces JOIN r USING (id)"), "job2_answer_review": plans.answer_review_sql()}
