"""Weighted reciprocal-rank fusion, flat and nested.

Lists hold request_id, key and rank; other columns are dropped. A key that a list holds twice adds up and ties by its
first rank; null keys and requests are values like others; empty lists add nothing. Ties are broken as said in each
function, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what is added to a rank.
CONSTANT = 60


def fuse(lists: Sequence[tuple[DataFrame, float]], constant: int = CONSTANT) -> DataFrame:
    """request_id, key, rrf_score (10 places), rank over lists of (request_id, key, rank) and their weights.

    Nothing is cut off. Ties keep the order of first appearance: by list, then by rank in it.
    """
    rows = [df.select("request_id", "key", F.lit(i).alias("source"), F.col("rank").alias("at"), (F.lit(float(w)) / (constant + F.col("rank"))).alias("part")) for i, (df, w) in enumerate(lists)]
    summed = reduce(DataFrame.unionByName, rows).groupBy("request_id", "key").agg(F.round(F.sum("part"), 10).alias("rrf_score"), F.min(F.struct("source", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("rrf_score"), "first", "key"))
    return summed.withColumn("rank", rank).drop("first")


def hybrid(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    return fuse([(bm25, 0.3), (dense, 0.7)])


def parent_child(dense_parents: DataFrame, bm25_parents: DataFrame) -> DataFrame:
    """The dense list comes first here, which decides ties."""
    return fuse([(dense_parents, 0.5), (bm25_parents, 0.5)])


def nested(first: DataFrame, second: DataFrame) -> DataFrame:
    """Fusion of two fused lists."""
    return fuse([(first, 0.5), (second, 0.5)])


def contribution(in_bm25: Column, in_dense: Column) -> Column:
    return F.when(in_bm25 & in_dense, "Hybrid").when(in_bm25, "Keyword-Only").otherwise("Vector-Only")


def with_origin(fused: DataFrame, bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """``fused`` with bm25_rank and vector_rank (0 if absent), distance, similarity and contribution."""
    from .vector import similarity

    keys = ["request_id", "key"]
    out = fused.join(bm25.select(*keys, F.col("rank").alias("bm25_rank")), keys, "left").join(dense.select(*keys, F.col("rank").alias("vector_rank"), "distance"), keys, "left")
    label = contribution(F.col("bm25_rank").isNotNull(), F.col("vector_rank").isNotNull())
    shown = F.round(F.lit(1.0) / (CONSTANT + F.col("rank")), 6)
    return out.withColumn("contribution", label).withColumn("similarity", similarity(F.col("distance"))).withColumn("display_rrf", shown).fillna(0, ["bm25_rank", "vector_rank"])


def first_hits(hits: DataFrame) -> DataFrame:
    """request_id, key, rank by the first of each key's hits; of keys with one first rank the smaller comes first."""
    found = hits.groupBy("request_id", "key").agg(F.min("rank").alias("first"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("first", "key"))
    return found.select("request_id", "key", rank.alias("rank"))


def parents_of(hits: DataFrame, children: DataFrame) -> DataFrame:
    """The parents of hits that are keyed by child, in the order of their first child."""
    return first_hits(hits.join(children.select(F.col("child_key").alias("key"), "parent_id"), "key").select("request_id", F.col("parent_id").alias("key"), "rank"))


def debug_lists(**lists: DataFrame) -> DataFrame:
    """list_name, request_id, key, rank of several ranked lists."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("list_name"), "request_id", "key", "rank") for name, df in lists.items()])
