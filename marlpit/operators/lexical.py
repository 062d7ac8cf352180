"""Keyword search: Okapi BM25 over stored postings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..session import cut, ship, uncut

# Fixed values of the ranking function.
K1, B, EPSILON = 1.5, 0.75, 0.25


#: Folders that stored postings and terms are dealt over by a hash of the term, and how many terms a search names to its scans.
BUCKETS, NAMED = 64, 1_000

#: Documents that a task scores at most, about, and terms asked for that are sent to all tasks at most.
SHARD, SENT = 16_384, 200_000

#: Words that a task counts at once, about, and shards that a task of a stored index counts at most, where tasks would not idle.
WORDS, TOGETHER = 4_000_000, 2

_LISTED = ["term", "shard", "keys", "tfs", "dls"]


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class Bm25Index:
    """postings(term, key, tf, dl), terms(term, df, idf), stats(n, avgdl, first key, shards); lists(term, shard, keys, tfs, dls), the same
    postings by term and shard of documents, if there; stored ones also have bucket."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    lists: DataFrame | None = None

    def write(self, path: str) -> None:
        """Lists and terms lie in folders by bucket, sorted by term; a bucket is dealt over tasks by shard, so that terms of many
        postings are spread."""
        lists = _singles(self) if self.lists is None else self.lists
        _place(lists, f"{path}/lists", "shard", self.stats.first()["shards"])
        _place(self.terms, f"{path}/terms", "term", self.stats.first()["shards"])
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Bm25Index:
        stats = spark.read.parquet(f"{path}/stats")
        lists = _read_lists(spark, path, stats.schema["first"].dataType.simpleString())
        return Bm25Index(_postings(lists), spark.read.schema("term string, df long, idf double, bucket int").parquet(f"{path}/terms"), stats, lists)

    def holding(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Lists and terms, of a stored index only the folders that may hold terms asked for; few terms are named to the scan."""
        lists = _singles(self) if self.lists is None else self.lists
        if "bucket" not in lists.columns:
            return lists, self.terms
        buckets = [r[0] for r in asked.select(_bucket(F.col("term"))).distinct().collect()]  # as many as there are at most
        named = [r["term"] for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
        keep = F.col("bucket").isin(buckets)
        if len(named) <= NAMED:
            keep = keep & F.col("term").isin(named)
        return lists.where(keep), self.terms.where(keep)


def _place(rows: DataFrame, path: str, by: str, shards: int) -> None:
    parts = -(-shards // 16)
    to = F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")
    _lay(rows.withColumn("to", _bucket(F.col("term")) * parts + to).repartitionById(BUCKETS * parts, "to").drop("to"), path)


def _lay(rows: DataFrame, path: str) -> None:
    """Into folders by bucket, each task its own rows."""
    rows.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _read_lists(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.schema(f"term string, shard int, keys array<{key}>, tfs array<int>, dls array<int>, bucket int").parquet(f"{path}/lists")


def _postings(lists: DataFrame) -> DataFrame:
    held = [c for c in lists.columns if c == "bucket"]
    rows = lists.where("term is not null").select("term", *held, F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p"))
    return rows.select("term", F.col("p.keys").alias("key"), F.col("p.tfs").cast("long").alias("tf"), F.col("p.dls").alias("dl"), *held)


def _singles(index: Bm25Index) -> DataFrame:
    """Postings as lists of one."""
    shard = F.pmod(F.xxhash64("key"), F.lit(index.stats.first()["shards"])).cast("int")
    return index.postings.select("term", shard.alias("shard"), F.array("key").alias("keys"), F.array(F.col("tf").cast("int")).alias("tfs"), F.array("dl").alias("dls"))


def shards_of(spark: SparkSession, n: int) -> int:
    """Shards for n documents: of some ``SHARD``, smaller ones where tasks would idle."""
    return max(1, -(-n // SHARD), min(spark.sparkContext.defaultParallelism, -(-n // 1_024)))


def counted(texts: DataFrame, *by: str) -> DataFrame:
    """Postings (the columns ``by``, term, tf, dl) of rows with text and the columns ``by``, the first of which is the key.

    Rows meet by key before they are taken apart, so what moves is their texts and not their postings.
    """
    own = texts.repartition(by[0]).select(*by, tokens(F.col("text")).alias("ts"))
    return own.select(*by, F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy(*by, "term").agg(F.count("*").alias("tf"), F.any_value("dl").alias("dl"))


def measured(texts: DataFrame) -> DataFrame:
    """stats of rows with key and text, one row."""
    spark = texts.sparkSession
    own = texts.select("key", F.size(tokens(F.col("text"))).alias("dl"))
    told = cut(own.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.min("key").alias("first")), "stats")
    return told.withColumn("shards", F.lit(shards_of(spark, told.first()["n"])))


def listed(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", words: int = WORDS, together: int = 1) -> tuple[DataFrame, int]:
    """term, shard, keys, tfs, dls of the documents, and the number of shards, of which a task counts ``together`` at most.

    Texts move once, to their shards by a hash of the key; there a task counts some ``words`` words at a time, so postings are
    neither shuffled nor sorted one by one, and rows with one key are counted as one document. A row without a term says
    of what a task counted at once how many rows and how many texts there are (tfs), and how many words (dls).
    """
    spark = docs.sparkSession
    ship(spark)
    shards = shards_of(spark, docs.count())
    own = docs.select(F.pmod(F.xxhash64(F.col(key_col)), F.lit(shards)).cast("int").alias("shard"), F.col(key_col).alias("key"), F.col(text_col).alias("text"))
    tasks = min(shards, max(4 * spark.sparkContext.defaultParallelism, -(-shards // together)))
    dealt = own.repartitionById(tasks if together > 1 else shards, "shard").sortWithinPartitions("shard", "key").select("shard", "key", tokens(F.col("text")).alias("ts"))
    key = own.schema["key"].dataType
    kinds = {"term": T.StringType(), "shard": T.IntegerType(), "keys": T.ArrayType(key), "tfs": T.ArrayType(T.IntegerType()), "dls": T.ArrayType(T.IntegerType())}
    return dealt.mapInArrow(lambda batches: _in_runs(batches, words), T.StructType([T.StructField(k, v) for k, v in kinds.items()])), shards


def _changes(*columns: pa.Array) -> np.ndarray:
    """Numbers of the rows that differ from the one before."""
    codes = [c.dictionary_encode("encode").indices.to_numpy() for c in columns]
    differs = np.ones(len(codes[0]), dtype=bool)
    differs[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    return np.flatnonzero(differs)


def _in_runs(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    words = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        words += len(b.column("ts").flatten())
        if words >= most:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(_changes(*(rows.column(c).combine_chunks() for c in ("shard", "key")))[-1])  # a key may go on in the next batch
            if last:
                yield from _counted(rows.slice(0, last))
                held = rows.slice(last).combine_chunks().to_batches()
                words = sum(len(x.column("ts").flatten()) for x in held)
    if held:
        yield from _counted(pa.Table.from_batches(held))


def _counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Lists of documents' words; rows of one shard and key follow each other."""
    shard, key, texts = (rows.column(c).combine_chunks() for c in ("shard", "key", "ts"))
    size = pc.fill_null(pc.list_value_length(texts), 0).to_numpy()
    first = _changes(shard, key)
    doc = np.zeros(len(key), dtype=np.int64)
    doc[first[1:]] = 1
    doc = np.repeat(np.cumsum(doc), size)
    coded = texts.flatten().dictionary_encode()
    own = shard.to_numpy()[first]
    place = np.searchsorted(np.unique(own), own)  # shards follow each other
    terms, docs = len(coded.dictionary), len(first)
    found, times = np.unique((place[doc] * terms + coded.indices.to_numpy()) * docs + doc, return_counts=True)
    doc, at = found % docs, found // docs
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, dtype=np.int64)
    ends = pa.array(np.append(start, len(at)), pa.int32())
    keys, lengths = key.take(pa.array(first)), np.maximum.reduceat(size, first)
    lists = [keys.take(pa.array(doc)), pa.array(times, pa.int32()), pa.array(lengths[doc], pa.int32())]
    named = coded.dictionary.take(pa.array(at[start] % max(terms, 1)))
    out = pa.RecordBatch.from_arrays([named, pa.array(np.unique(own)[at[start] // max(terms, 1)], pa.int32()), *(pa.ListArray.from_arrays(ends, x) for x in lists)], names=_LISTED)
    for i in range(0, out.num_rows, 10_000):
        yield out.slice(i, 10_000)
    told = [[None], own[:1], [keys.drop_null().slice(0, 1).to_pylist()], [[len(size), len(size) - texts.null_count]], [[int(size.sum())]]]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(told, out.schema.types, strict=True)], names=_LISTED)


def summed(lists: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The documents that hold each term (term, df), and stats, of written lists."""
    said = lists.where("term is null").agg(F.coalesce(F.sum(F.get("tfs", F.lit(0))), F.lit(0)).alias("n"), F.sum(F.get("tfs", F.lit(1))).alias("texts"), F.sum(F.get("dls", F.lit(0))).alias("words"), F.min(F.get("keys", F.lit(0))).alias("first"))
    stats = cut(said.select("n", (F.col("words") / F.nullif(F.col("texts"), F.lit(0))).alias("avgdl"), "first", F.lit(shards).alias("shards")), "stats")
    return cut(lists.where("term is not null").groupBy("term").agg(F.sum(F.size("keys")).alias("df")), "counts"), stats


def build(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> Bm25Index:
    """Lists are written once to the shared folder; all that follows reads them, so texts are split once.

    Terms in more than half of the documents would weigh less than nothing; they get ``EPSILON`` of the mean weight.
    Null and empty texts are documents without terms; rows with one key are documents each for itself, whose postings
    add up; an empty table gives an index that finds nothing.
    """
    lists, shards = listed(docs, key_col, text_col)
    lists = cut(lists, "lists")
    return weighted_index(_postings(lists), *summed(lists, shards), lists)


def weighted_index(postings: DataFrame, counts: DataFrame, stats: DataFrame, lists: DataFrame | None = None) -> Bm25Index:
    """An index of postings, the documents that hold each term (term, df), and stats; terms get their weights."""
    weight = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = counts.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", weight.alias("raw"))
    mean = raw.agg((F.avg("raw") * EPSILON).alias("low"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("low")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(postings, terms, stats, lists)


def _rounded(score: np.ndarray) -> np.ndarray:
    """To 8 places."""
    return np.floor(score * 1e8 + 0.5) / 1e8


class _Shard:
    """Some documents' postings by term, the documents numbered in the order of their keys."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        lists = rows.column("keys").combine_chunks()
        coded = lists.flatten().dictionary_encode("encode")
        order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.keys = coded.dictionary.take(pa.array(order))
        term = np.repeat(rows.column("term_id").to_numpy(), pc.list_value_length(lists).to_numpy())
        by = np.argsort(term, kind="stable")
        self.docs, self.part = place[coded.indices.to_numpy()][by], rows.column("parts").combine_chunks().flatten().to_numpy()[by]
        self.terms, self.first = np.unique(term[by], return_index=True)
        self.end = np.append(self.first[1:], len(term))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents that hold any of the terms."""
        by = np.argsort(terms)
        terms, weights = terms[by], weights[by]
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = [(self.first[i], self.end[i], w) for i, t, w in zip(at, terms, weights, strict=True) if self.terms[i] == t]
        if not known:
            return np.empty(0, dtype=np.int64), np.empty(0)
        docs = np.concatenate([self.docs[a:b] for a, b, _ in known])
        sums = np.bincount(docs, np.concatenate([self.part[a:b] * w for a, b, w in known]), len(self.keys))
        held = np.flatnonzero(sums) if (weights > 0).all() else np.unique(docs)
        score = _rounded(sums[held])
        if len(held) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            held, score = held[score >= least], score[score >= least]
        order = np.lexsort((held, -score))[:k]
        return held[order], score[order]


def best(lists: DataFrame, requests: DataFrame, shards: int, k: int) -> DataFrame:
    """request_id, key, score (8 places) of each request's k best documents in each shard.

    ``lists`` (shard, term_id, keys, parts: what a weight is multiplied by) meet by shard with ``requests`` (shard, request_id,
    term_ids, ws; see ``packed``). A task holds a shard's lists, and requests stream past them, so only k rows for each request and
    shard go on, and no row for a request and a document that both hold a term.
    """
    ship(lists.sparkSession)
    keys, request = lists.schema["keys"].dataType, requests.schema["request_id"].dataType
    at = lambda asks: (F.col("shard") * 2 + asks).alias("at")
    none = lambda kind, name: F.array().cast(kind).alias(name)  # noqa: E731 - not null: Arrow's writer goes through all nulls of a list again for each row
    held = lists.select(at(0), "shard", F.lit(None).cast(request).alias("request_id"), none("array<long>", "term_ids"), none("array<double>", "ws"), "term_id", "keys", "parts")
    asking = requests.select(at(1), "shard", "request_id", "term_ids", "ws", F.lit(None).cast("long").alias("term_id"), none(keys, "keys"), none("array<double>", "parts"))
    out = T.StructType([T.StructField("request_id", request), T.StructField("key", keys.elementType), T.StructField("score", T.DoubleType())])

    def answered(shard: _Shard, asked: pa.RecordBatch) -> pa.RecordBatch:
        terms, weights = (asked.column(c).flatten().to_numpy() for c in ("term_ids", "ws"))
        cuts = [0, *np.cumsum(pc.list_value_length(asked.column("ws")).to_numpy()).tolist()]
        found = [shard.best(terms[a:z], weights[a:z], k) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        docs, score = (np.concatenate(x) for x in zip(*found, strict=True))
        own = np.repeat(np.arange(len(found)), [len(d) for d, _ in found])
        return pa.RecordBatch.from_arrays([asked.column("request_id").take(pa.array(own)), shard.keys.take(pa.array(docs)), pa.array(score)], names=["request_id", "key", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, whole = None, [], None
        for b in batches:
            at = b.column("at").to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                if at[start] // 2 != shard:
                    shard, parts, whole = at[start] // 2, [], None
                own = b.slice(start, end - start)
                if at[start] % 2 == 0:
                    parts.append(own.select(["keys", "term_id", "parts"]))
                elif parts or whole:
                    whole = whole or _Shard(parts)
                    parts = []
                    yield answered(whole, own)

    met = held.unionByName(asking).repartitionById(shards, "shard").sortWithinPartitions("at").drop("shard")
    return met.mapInArrow(run, out)


def part(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's weight is multiplied by in a document's score."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "key"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Bm25Index, requests: DataFrame, k: int = 12, request_col: str = "request_id", query_col: str = "query") -> DataFrame:
    """request_id, key, score (8 places), rank of the k best documents that hold any of a request's terms.

    A term counts as often as the request repeats it. Ties go to the smaller key. Documents are dealt into shards by a
    hash of the key; see ``best``. There terms are told by 64 bits of their hashes.
    """
    spark = requests.sparkSession
    asked = requests.select(F.col(request_col).alias("request_id"), F.explode(tokens(F.col(query_col))).alias("term")).groupBy("request_id", "term").agg(F.count("*").alias("times"))
    lists, terms = index.holding(asked)
    lists = lists.where("term is not null")  # the others say what a task counted
    different = cut(asked.select("term").distinct(), "asked")
    if different.count() <= SENT:
        lists, terms = (x.join(F.broadcast(different), "term", "left_semi") for x in (lists, terms))
    number = F.xxhash64("term").alias("term_id")
    weighted = asked.join(terms.select("term", "idf"), "term").select("request_id", number, (F.col("idf") * F.col("times")).alias("w"))
    stats = index.stats.select("avgdl", "shards").first()
    own = lists.select("shard", number, "keys", parts(F.lit(stats["avgdl"]).cast("double")))
    return ranked(best(own, dealt(packed(weighted), stats["shards"]), stats["shards"], k), k)


def packed(weights: DataFrame) -> DataFrame:
    """request_id, term_ids and ws of rows of request_id, term_id and w: a request's terms go to its shards as one row."""
    one = weights.groupBy("request_id").agg(F.collect_list(F.struct("term_id", "w")).alias("x"))
    return one.select("request_id", F.col("x.term_id").alias("term_ids"), F.col("x.w").alias("ws"))


def parts(avgdl: Column) -> Column:
    return F.zip_with("tfs", "dls", lambda tf, dl: part(tf, dl, avgdl)).alias("parts")


def dealt(requests: DataFrame, shards: int) -> DataFrame:
    """``requests`` once for each shard."""
    return requests.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def store(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text") -> Bm25Index:
    """As ``build``, written and read again. The tasks that count write their lists in place, so no postings are shuffled."""
    spark = docs.sparkSession
    lists, shards = listed(docs, key_col, text_col, together=TOGETHER)
    _lay(lists, f"{path}/lists")
    stored = _read_lists(spark, path, lists.schema["keys"].dataType.elementType.simpleString())
    counts, stats = summed(stored, shards)
    index = weighted_index(_postings(stored), counts, stats, stored)
    _place(index.terms, f"{path}/terms", "term", shards)
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    uncut(counts)
    return Bm25Index.read(spark, path)
