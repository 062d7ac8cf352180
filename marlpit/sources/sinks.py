"""Where results go: tables keyed for later joins, logs, previews. All writes are Spark's own, on any file system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, uncut
from .files import existing


BUCKETS = 64


def _replace(rows: DataFrame, path: str) -> None:
    """Rows keyed by pk, of several with one pk the greatest; rows stored under other keys stay.

    The table is dealt over ``BUCKETS`` folders by a hash of pk, and each folder over as many tasks as there are shuffle partitions for
    it. Only buckets that get rows are read and written again;
    what they will hold is first written to the shared folder, so a failure before the last step changes nothing.
    """
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != "pk"]
    new = cut(rows.groupBy("pk").agg(F.max(F.struct(*names)).alias("x")).select("pk", "x.*", F.pmod(F.xxhash64("pk"), F.lit(BUCKETS)).cast("int").alias("bucket")), "new")
    whole = new
    if existing(spark, [path]):
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as buckets at most
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        whole = cut(new.unionByName(old.join(new.select("pk"), [old["pk"].eqNullSafe(new["pk"])], "left_anti")), "whole")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    whole.repartition("bucket", F.pmod(F.xxhash64(F.lit("part"), "pk"), F.lit(parts))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    uncut(*{id(x): x for x in (new, whole)}.values())


def write_markdown(rows: DataFrame, path: str, error_path: str | None = None) -> None:
    """Texts keyed by pk, replacing earlier ones of the same pk; rows with an error go to a table of their own."""
    _replace(rows.where(F.col("error").isNull()).select("pk", "shown_id", "path", "text"), path)
    if error_path:
        _replace(rows.where(F.col("error").isNotNull()).select("pk", "error"), error_path)


def append_feedback(rows: DataFrame, path: str, kind: str = "parquet", batch: str | None = None) -> None:
    """Append to the log. Rows of a named ``batch`` have a folder of their own, which a repeated append of it replaces, so a batch
    that is delivered twice counts once; a log has named batches throughout, or none."""
    if batch is None:
        out = rows.write.mode("append")
    else:
        out = rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch")
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)


def append_diagnostics(records: DataFrame, path: str) -> None:
    """One JSON object per request and line; letters stay as they are."""
    records.write.mode("append").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def preview(chunks: DataFrame, n: int = 5, head: int = 800, order: str | Sequence[str] = "chunk_id", text_col: str = "text") -> DataFrame:
    """The first n chunks, their texts cut at ``head`` characters."""
    return chunks.orderBy(*([order] if isinstance(order, str) else order)).limit(n).withColumn(text_col, F.left(F.col(text_col), F.lit(head)))
