"""Keyword search that skips blocks of postings which cannot reach a request's best documents.

The documents of a shard are dealt into blocks of at most some hundred, those of like length together, as a term's part of
a score falls with a document's length. A term's postings in a shard are one row of arrays, block after block, with the
tops, the greatest part that the term gives to any document of a block. For a request the sum of its terms' tops bounds
every score in a block. The blocks with the greatest bounds are scored first; of all others only those whose bound reaches
the k-th best score found there are scored too, so the result is exactly that of ``lexical.search``. Bounds and scores are
summed in tasks that hold a shard while requests stream past, so no row is made for a request and a document.

Stored, the tops lie in folders by a hash of the term and are read for the terms asked only; the arrays lie in folders
by zones of shards and are read in the zones of the blocks that are left.

Defined results are those of ``lexical``: null and empty texts are documents without terms, requests without known terms
find nothing, ties go to the smaller key. Rows with one key are one document whose postings are in the block of its
greatest length; empty tables find nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import cut, ship
from . import lexical
from .lexical import BUCKETS, NAMED, SENT

#: Folders of stored blocks, the blocks of each request that are scored first, and by what a shard's number is multiplied in a block's.
ZONES, FIRST, APART = 64, 4, 1 << 32

_BLOCKS = ["term", "shard", "keys", "tfs", "dls", "blocks", "starts", "sizes"]


@dataclass
class BlockIndex:
    """tops(term, block, top), blocks(term, shard, keys, tfs, dls; blocks, starts and sizes: which postings lie in each), terms(term, idf),
    stats(n, avgdl, shards); stored ones also have bucket (of tops and terms) and zone (of blocks)."""

    tops: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    def write(self, path: str) -> None:
        shards = self.stats.first()["shards"]
        zone = F.pmod("shard", F.lit(ZONES)).cast("int")
        placed = self.blocks.select("term", "shard", "keys", "tfs", "dls", "blocks", "starts", "sizes", zone.alias("zone"))
        placed.repartitionById(shards, "shard").sortWithinPartitions("zone", "term").write.mode("overwrite").partitionBy("zone").parquet(f"{path}/blocks")
        lexical._place(self.blocks.select("term", "shard", "blocks", "tops"), f"{path}/tops", "shard", shards)
        lexical._place(self.terms, f"{path}/terms", "term", shards)
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark: SparkSession, path: str) -> BlockIndex:
        stats = spark.read.parquet(f"{path}/stats")
        key = stats.schema["first"].dataType.simpleString()
        table = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        tops = table("tops", "term string, shard int, blocks array<bigint>, tops array<double>, bucket int")
        blocks = table("blocks", f"term string, shard int, keys array<{key}>, tfs array<int>, dls array<int>, blocks array<bigint>, starts array<int>, sizes array<int>, zone int")
        return BlockIndex(_tops(tops), blocks, table("terms", "term string, df long, idf double, bucket int"), stats)


def _tops(rows: DataFrame) -> DataFrame:
    held = [c for c in rows.columns if c == "bucket"]
    return rows.select("term", *held, F.explode(F.arrays_zip("blocks", "tops")).alias("b")).select("term", F.col("b.blocks").alias("block"), F.col("b.tops").alias("top"), *held)


def _in_blocks(lists: DataFrame, documents: int) -> DataFrame:
    """Lists that lie by shard in their partitions, with the postings in the order of blocks."""
    kinds = {"blocks": T.ArrayType(T.LongType()), "starts": T.ArrayType(T.IntegerType()), "sizes": T.ArrayType(T.IntegerType())}
    out = T.StructType([*lists.schema.fields, *(T.StructField(k, v) for k, v in kinds.items())])

    def regrouped(parts: list[pa.RecordBatch], used: list[int]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        keys, tfs, dls = (rows.column(c).combine_chunks() for c in ("keys", "tfs", "dls"))
        row = np.repeat(np.arange(len(keys)), pc.list_value_length(keys).to_numpy())
        coded = keys.flatten().dictionary_encode("encode")
        doc = coded.indices.to_numpy().astype(np.int64)
        tf, dl = tfs.flatten().to_numpy(), dls.flatten().to_numpy()
        length = np.zeros(len(coded.dictionary), dtype=np.int64)
        np.maximum.at(length, doc, dl)
        block = np.empty(len(length), dtype=np.int64)
        block[np.argsort(length, kind="stable")] = rows.column("shard")[0].as_py() * APART + used[0] + np.arange(len(length)) // documents
        used[0] += -(-len(length) // documents)
        by = np.lexsort((block[doc], row))
        row, doc = row[by], doc[by]
        own = block[doc]
        starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (own[1:] != own[:-1])))
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        ends = pa.array(np.append(heads, len(row)), pa.int32())
        tops = pa.array(np.searchsorted(starts, np.append(heads, len(row))), pa.int32())
        at = pa.array(row[heads])
        each = lambda x, kind, where: pa.ListArray.from_arrays(where, pa.array(x, kind))
        columns = [rows.column("term").combine_chunks().take(at), rows.column("shard").combine_chunks().take(at), pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(doc))), each(tf[by], pa.int32(), ends), each(dl[by], pa.int32(), ends), each(own[starts], pa.int64(), tops), each(starts - np.repeat(heads, np.diff(tops.to_numpy())), pa.int32(), tops), each(np.diff(np.append(starts, len(row))), pa.int32(), tops)]
        whole = pa.RecordBatch.from_arrays(columns, names=_BLOCKS)
        for i in range(0, whole.num_rows, 10_000):
            yield whole.slice(i, 10_000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        shard, used = None, [0]
        for b in batches:
            told, at = b.column("term").is_null().to_numpy(zero_copy_only=False), b.column("shard").to_numpy()
            ends = np.flatnonzero(told[1:] | told[:-1] | (at[1:] != at[:-1])) + 1
            for start, end in zip([0, *ends.tolist()], [*ends.tolist(), b.num_rows], strict=True):
                if start == end:
                    continue
                if parts and (told[start] or at[start] != shard):  # what was counted at once ends with a row without a term
                    yield from regrouped(parts, used)
                    parts = []
                if at[start] != shard:
                    shard, used = at[start], [0]
                own = b.slice(start, end - start)
                if told[start]:
                    yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([[]], pa.list_(x)) for x in (pa.int64(), pa.int32(), pa.int32()))], names=_BLOCKS)
                else:
                    parts.append(own)
        if parts:
            yield from regrouped(parts, used)

    ship(lists.sparkSession)
    return lists.mapInArrow(run, out)


def _indexed(blocks: DataFrame, terms: DataFrame, stats: DataFrame) -> BlockIndex:
    """With the tops, which the mean length goes into."""
    mean = F.lit(stats.first()["avgdl"]).cast("double")
    top = F.transform(F.arrays_zip("starts", "sizes"), lambda x: F.array_max(F.slice("parts", x["starts"] + 1, x["sizes"])))
    topped = blocks.where("term is not null").withColumn("parts", lexical.parts(mean)).withColumn("tops", top).drop("parts")
    return BlockIndex(_tops(topped), topped, terms, stats)


def build(index: lexical.Bm25Index, documents: int = 128) -> BlockIndex:
    """The postings of an index in blocks of ``documents`` documents; those of a shard follow each other by length."""
    shards = index.stats.first()["shards"]
    lists = index.holding(index.terms)[0] if index.lists is None else index.lists
    dealt = lists.select("term", "shard", "keys", "tfs", "dls").where("term is not null").repartitionById(shards, "shard").sortWithinPartitions("shard")
    return _indexed(cut(_in_blocks(dealt, documents), "blocks"), index.terms, index.stats)


def of(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", documents: int = 128) -> BlockIndex:
    """As ``build`` of an index of the documents, which is not written."""
    lists, shards = lexical.listed(docs, key_col, text_col)
    blocks = cut(_in_blocks(lists, documents), "blocks")
    counts, stats = lexical.summed(blocks, shards)
    return _indexed(blocks, lexical.weighted_index(blocks, counts, stats).terms, stats)


def weighted(index: BlockIndex, requests: DataFrame, request_col: str = "request_id", query_col: str = "query") -> DataFrame:
    """request_id, term and weight of every request's known terms."""
    asked = requests.select(F.col(request_col).alias("request_id"), F.explode(tokens(F.col(query_col))).alias("term")).groupBy("request_id", "term").agg(F.count("*").alias("times"))
    return asked.join(_asked_for(index.terms, asked), "term").select("request_id", "term", (F.col("idf") * F.col("times")).alias("w"))


def _asked_for(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Of a stored table the folders of the terms asked for; few terms are named to the scan."""
    if "bucket" not in rows.columns:
        return rows
    named = [r["term"] for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        rows = rows.where(F.col("term").isin(named))
    folder = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    return rows.where(F.col("bucket").isin([r[0] for r in asked.select(folder).distinct().collect()]))  # as many as there are at most


def _dealt(rows: DataFrame, block) -> DataFrame:
    return rows.withColumn("shard", F.floor(block / APART).cast("int"))


def _number(weights: DataFrame) -> DataFrame:
    return weights.select("request_id", F.xxhash64("term").alias("term_id"), "w")


def _sent(rows: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """Rows whose ``by`` is among those of ``asked``, which goes to all tasks where it is small."""
    different = cut(asked.select(by).distinct(), "asked")
    return rows.join(F.broadcast(different) if different.count() <= SENT else different, by, "left_semi")


def bounds(index: BlockIndex, weights: DataFrame) -> DataFrame:
    """request_id, block and bound of every block that holds a term of a request."""
    shards = index.stats.first()["shards"]
    tops = _dealt(_sent(_asked_for(index.tops, weights), weights, "term"), F.col("block"))
    lists = tops.select("shard", F.xxhash64("term").alias("term_id"), F.array("block").alias("keys"), F.array("top").alias("parts"))
    asking = lexical.dealt(lexical.packed(_number(weights).withColumn("w", F.greatest("w", F.lit(0.0)))), shards)
    return lexical.best(lists, asking, shards, APART).select("request_id", F.col("key").alias("block"), F.col("score").alias("bound"))


def _scored(index: BlockIndex, weights: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """request_id, key and score (8 places) of each request's k best documents of a shard, of those in blocks that any request
    has chosen (request_id, block) and at least in its own."""
    blocks, stats = index.blocks, index.stats.select("avgdl", "shards").first()
    if "zone" in blocks.columns:
        zones = [r[0] for r in chosen.select(F.pmod(F.floor(F.col("block") / APART), F.lit(ZONES)).cast("int")).distinct().collect()]  # as many as there are at most
        blocks = blocks.where(F.col("zone").isin(zones))
    rows = _sent(blocks, weights, "term").select("term", "shard", "keys", "tfs", "dls", F.explode(F.arrays_zip("blocks", "starts", "sizes")).alias("b"))
    part = lambda c: F.slice(c, F.col("b.starts") + 1, F.col("b.sizes")).alias(c)
    own = _sent(rows.select("term", "shard", F.col("b.blocks").alias("block"), part("keys"), part("tfs"), part("dls")), chosen, "block")
    lists = own.select("shard", F.xxhash64("term").alias("term_id"), "keys", lexical.parts(F.lit(stats["avgdl"]).cast("double")))
    asking = _dealt(chosen, F.col("block")).select("request_id", "shard").distinct().join(lexical.packed(_number(weights)), "request_id")
    return lexical.best(lists, asking, stats["shards"], k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "key"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def plan(index: BlockIndex, requests: DataFrame, k: int = 12, first: int = FIRST, request_col: str = "request_id", query_col: str = "query") -> tuple[DataFrame, DataFrame, DataFrame]:
    """weights, the blocks to score (request_id, block, bound, place, tried) and the scores of those tried first.

    A block is left where its bound reaches the request's k-th best score of the blocks tried, or where those hold fewer
    than k documents.
    """
    weights = cut(weighted(index, requests, request_col, query_col), "weights")
    best = Window.partitionBy("request_id").orderBy(F.desc("bound"), "block")
    bounded = cut(bounds(index, weights), "bounds")
    tried = bounded.withColumn("place", F.row_number().over(best)).where(F.col("place") <= first)
    scored = cut(_scored(index, weights, cut(tried.select("request_id", "block"), "tried"), k), "scored")
    kth = _ranked(scored, k).groupBy("request_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = bounded.join(tried.select("request_id", "block", "place"), ["request_id", "block"], "left").join(kth, "request_id", "left")
    reaches = F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least"))  # scores are rounded, bounds are not
    return weights, cut(rest.where(F.col("place").isNull() & reaches).select("request_id", "block", "bound"), "left"), scored


def search(index: BlockIndex, requests: DataFrame, k: int = 12, request_col: str = "request_id", query_col: str = "query") -> DataFrame:
    """request_id, key, score (8 places), rank, as ``lexical.search`` gives them."""
    weights, left, scored = plan(index, requests, k, request_col=request_col, query_col=query_col)
    found = scored.unionByName(_scored(index, weights, left, k))  # one document may be in both, with one score
    return _ranked(found.groupBy("request_id", "key").agg(F.max("score").alias("score")), k)
