"""Follow a folder of documents and keep the table of their chunks for retrieval.

    python -m jobs.chunk_feed --source DIR --target DIR --checkpoint DIR [--config FILE]

The source is a folder or a pattern of files or folders. Every run takes the files that are new or rewritten since the last one (a file stream with its checkpoint), takes front
matter out of the texts, tells each document's class, splits it as its class asks, and writes

    TARGET/documents/batch=N    key, source, source_class, pieces, error: what the batch N read
    TARGET/chunks/batch=N/source_class=C    key, chunk_id, source, doc_type, meta, text

A batch that is repeated after a failure overwrites its own partitions, so reruns give the same result; a run without
new files writes nothing. A document that comes again replaces its earlier version: ``current`` reads the chunks of each
key's newest batch. Within a batch, of several rows with one key that with the greatest version counts (see ``_newest``).

Defined results: rows without a key or a text are in ``documents`` with an error and have no chunks (a text that is
null replaces the version before); an empty text has no chunks; a source that is null is the key; columns that no
setting names are not read. The settings key, source, doc_type and text are SQL expressions over the input's columns.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, config, session
from marlpit.operators import chunking, metadata
from marlpit.sources.files import existing

CHUNKS = "key string, chunk_id int, source string, doc_type string, meta map<string,string>, text string, batch long, source_class string"
DOCUMENTS = "key string, source string, source_class string, pieces int, error string, batch long"


def _newest(rows: DataFrame) -> DataFrame:
    """One row a key: of several the one whose text, source and type come last, so that a repeated batch chooses alike."""
    last = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.struct(F.col("text").isNotNull(), "text", "source", "doc_type")).alias("x"))
    return last.select("key", "x.text", "x.source", "x.doc_type").unionByName(rows.where(F.col("key").isNull()))


def prepared(docs: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """key, source, doc_type, source_class, meta, text, error of input rows."""
    said = lambda c: F.expr(settings[c]).cast("string").alias(c)
    rows = _newest(docs.select(said("key"), said("source"), said("doc_type"), said("text"))).withColumn("source", F.coalesce("source", "key"))
    told = metadata.enrich(rows.withColumnRenamed("doc_type", "given")).withColumn("doc_type", F.coalesce("given", "doc_type")).drop("given")
    error = F.when(F.col("key").isNull(), "no key").when(F.col("text").isNull(), "no text")
    return told.withColumn("source_class", metadata.source_class(F.col("source"), F.col("doc_type"))).withColumn("error", error)


def _write(docs: DataFrame, batch: int, target: str, settings: dict[str, Any]) -> tuple[int, int]:
    """Write a batch; documents read and chunks written, counted in what was written."""
    rows = prepared(docs, settings).withColumn("batch", F.lit(batch).cast("long"))
    split = chunking.route(rows.where(F.col("error").isNull()).select("key", "source", "doc_type", "source_class", "meta", "text", "batch"))
    _overwrite(split.select("key", F.col("chunk_id").cast("int").alias("chunk_id"), "source", "doc_type", "meta", "text", "batch", "source_class"), f"{target}/chunks", "batch", "source_class")
    chunks = _read(docs.sparkSession, f"{target}/chunks", CHUNKS).where(F.col("batch") == batch)
    held = chunks.groupBy("key").agg(F.count("*").cast("int").alias("pieces"))
    listed = rows.join(held, "key", "left").select("key", "source", "source_class", F.coalesce("pieces", F.lit(0)).alias("pieces"), "error", "batch")
    _overwrite(listed, f"{target}/documents", "batch")
    return _read(docs.sparkSession, f"{target}/documents", DOCUMENTS).where(F.col("batch") == batch).count(), chunks.count()


def _overwrite(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if existing(spark, [path]) else spark.createDataFrame([], schema)


def run(spark: SparkSession, source: str, target: str, checkpoint: str, settings: dict[str, Any] | None = None) -> dict[str, int]:
    """Take what is new below ``source``; the numbers of batches, rows read and chunks written."""
    settings = settings or config(None, "chunk_feed.json")
    done = {"batches": 0, "read": 0, "written": 0}

    def batch(docs: DataFrame, number: int) -> None:
        read, written = _write(docs, number, target, settings)
        LOG.info("batch %d of %s: %d documents read, %d chunks written to %s", number, source, read, written, target)
        done.update(batches=done["batches"] + 1, read=done["read"] + read, written=done["written"] + written)

    schema = spark.read.format(settings["format"]).load(source).schema
    stream = spark.readStream.format(settings["format"]).schema(schema).option("maxFilesPerTrigger", settings["files_a_batch"]).load(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("%s: %d batches, %d documents read, %d chunks written", source, done["batches"], done["read"], done["written"])
    return done


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of every key's newest version."""
    newest = _read(spark, f"{target}/documents", DOCUMENTS).where(F.col("key").isNotNull()).groupBy("key").agg(F.max("batch").alias("batch"))
    return _read(spark, f"{target}/chunks", CHUNKS).join(newest, ["key", "batch"])


def main() -> None:
    args = argparse.ArgumentParser(description="Keep a chunk table up to date with a folder of documents.")
    for name in ("source", "target", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", help="JSON file with settings over those of chunk_feed.json")
    said = args.parse_args()
    spark = session("chunk-feed")
    try:
        run(spark, said.source, said.target, said.checkpoint, config(said.config, "chunk_feed.json"))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
