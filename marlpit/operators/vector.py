"""Exact vector search by squared distance, and embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, existing, ship

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(size: int = 64) -> Embedder:
    """Deterministic and offline: counts of hashed words, scaled to length 1."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").split():
                h = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % size] += 1 if h >> 63 else -1
            row /= np.linalg.norm(row) or 1
        return out.tolist()

    return embed


def embed(df: DataFrame, text_col: str, embedder: Embedder, out_col: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` with vectors; the embedder sees batches of texts."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors = pa.array(embedder([t or "" for t in part.column(at).to_pylist()]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)


def kept(df: DataFrame, text_col: str, embedder: Embedder, path: str, out_col: str = "embedding", batch: int = 256) -> DataFrame:
    """As ``embed``, with vectors kept by the text's digest below ``path``, a folder of this embedder's alone: only texts whose
    digest is not there yet are embedded, each once, however often they occur.

    A digest that two runs have added is read once, as an embedder gives equal texts equal vectors; null texts count as
    empty.
    """
    spark = df.sparkSession
    schema = "digest string, vector array<double>"
    there = lambda: spark.read.schema(schema).parquet(path) if existing(spark, [path]) else spark.createDataFrame([], schema)
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    texts = df.select(digest.alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["digest"])
    new = cut(texts.join(there().select("digest"), "digest", "left_anti"), "new-texts")
    if not new.isEmpty():
        embed(new, "text", embedder, "vector", batch).select("digest", "vector").write.mode("append").parquet(path)
    stored = there().dropDuplicates(["digest"]).select(F.col("digest").alias("_digest"), F.col("vector").alias(out_col))
    return df.join(stored, digest == F.col("_digest"), "left").drop("_digest")


def similarity(distance: Column) -> Column:
    return F.coalesce(F.round(1 / (1 + distance), 4), F.lit(0.0))


def _trimmed(who: np.ndarray, keys: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each number in ``who`` the k rows of least distance, ties by key."""
    order = np.lexsort((keys, distance, who))
    who, keys, distance = who[order], keys[order], distance[order]
    first = np.searchsorted(who, who, "left")
    kept = np.arange(len(who)) - first < k
    return who[kept], keys[kept], distance[kept]


def _nearest(asked: np.ndarray, keys: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``asked``, key and squared distance of the k nearest vectors of each row.

    One matrix product finds all that may be among them; their distances are then taken exactly.
    """
    lengths = (vectors**2).sum(axis=1)
    out = []
    for a in range(0, len(asked), 256):
        q = asked[a : a + 256]
        own = (q**2).sum(axis=1)
        about = own[:, None] + lengths - 2 * (q @ vectors.T)
        if len(vectors) > k:
            margin = 1e-9 * (own + lengths.max())  # above what the product can be off
            about = about <= (np.partition(about, k - 1, axis=1)[:, k - 1] + margin)[:, None]
        else:
            about = np.ones(about.shape, dtype=bool)
        i, j = np.nonzero(about)
        out.append(_trimmed(i + a, keys[j], ((vectors[j] - q[i]) ** 2).sum(axis=1), k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrices(batch: pa.RecordBatch, key: int, vec: int):
    """(width, row numbers, keys, matrix) for each length of vectors in a batch."""
    keys, column = batch.column(key).to_numpy(zero_copy_only=False), batch.column(vec)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size), at, keys[at], flat[starts[at][:, None] + np.arange(size)]


_FOUND = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("distance", T.DoubleType())])


def _batch(ids, keys, distances) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(distances, pa.float64())], names=_FOUND.names)


def sound(df: DataFrame, key: str, vec: str, name: str) -> DataFrame:
    """``name`` and v of the rows with a key and a vector of finite components."""
    none = F.array().cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias(name), F.coalesce(F.col(vec).cast("array<double>"), none).alias("v"))
    return rows.where(F.col(name).isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def top_k(vectors: DataFrame, requests: DataFrame, k: int = 12, key_col: str = "vec_id", vec_col: str = "embedding", request_col: str = "request_id", query_col: str = "vector", broadcast_rows: int = 2048, shard_rows: int = 16_384) -> DataFrame:
    """request_id, key, distance (squared, double), rank of each request's k nearest; ties go to the smaller key.

    Up to ``broadcast_rows`` requests go to the executors whole, and vectors are not moved. More of them stream past
    shards of at most about ``shard_rows`` vectors, so vectors move once and no task holds more than a shard. Either
    way only k rows for each request and task are shuffled on. Vectors that are null or hold null or non-finite
    components, null keys, and other sizes than the request's are no candidates; such requests find nothing. Repeated
    rows are candidates each for itself; empty tables give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    asked, own = sound(requests, request_col, query_col, "r"), sound(vectors, key_col, vec_col, "key")
    few = asked.limit(broadcast_rows + 1).collect()
    found = _to_all(own, few, k) if len(few) <= broadcast_rows else _past_shards(own, asked, k, shard_rows)
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("distance", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _to_all(own: DataFrame, asked: list, k: int) -> DataFrame:
    sizes = np.array([len(r["v"]) for r in asked])
    by_size = {int(n): (np.array([r["r"] for r in asked if len(r["v"]) == n]), np.array([r["v"] for r in asked if len(r["v"]) == n])) for n in np.unique(sizes)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for b in batches:
            for size, _, keys, matrix in _matrices(b, 0, 1):
                if size in by_size:
                    new = _nearest(by_size[size][1], keys, matrix, k)
                    best[size] = _trimmed(*(np.concatenate(x) for x in zip(best[size], new, strict=True)), k) if size in best else new
        for size, (who, keys, distance) in best.items():
            yield _batch(by_size[size][0][who], keys, distance)

    return own.mapInArrow(run, _FOUND)


def _past_shards(own: DataFrame, asked: DataFrame, k: int, shard_rows: int) -> DataFrame:
    shards = max(1, -(-own.count() // shard_rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, whole = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)  # shard, size, whether it asks
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for one, end in zip(cuts[:-1], cuts[1:], strict=True):
                if one == end:
                    continue
                if tuple(keys[one, :2]) != at:
                    at, held, whole = tuple(keys[one, :2]), [], None
                ((_, _, ids, matrix),) = _matrices(b.slice(one, end - one), 3, 4)
                if not keys[one, 2]:
                    held.append((ids, matrix))
                elif held or whole:
                    whole = whole or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                    who, found, distance = _nearest(matrix, *whole, k)
                    yield _batch(ids[who], found, distance)

    row = lambda df, key, asks: df.select("shard", F.size("v").alias("size"), F.lit(asks).alias("asks"), F.col(key).alias("id"), "v")
    left = row(own.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")), "key", 0)
    right = row(asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))), "r", 1)
    dealt = left.unionByName(right).repartitionById(shards, "shard").sortWithinPartitions("shard", "size", "asks", "id")
    return dealt.mapInArrow(run, _FOUND)
