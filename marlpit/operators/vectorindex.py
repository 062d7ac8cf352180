"""Exact vector search in folders around pivots, of which a search reads only those that can hold near vectors.

Each vector lies in the folder of its nearest pivot, sorted by its distance to it. For a request, a folder whose vectors
are between ``least`` and ``greatest`` from its pivot, which is d from the request, holds nothing nearer than
max(d - greatest, least - d), by the triangle inequality, nor nearer than half of what d exceeds the nearest pivot's
distance by. The folders nearest to each request are read first; then those that may still hold something nearer than the
k-th found there, and of these only vectors whose distance to the pivot is within that of the request's.

Pivots are chosen from a sample of at most ``sample`` vectors, each the one farthest from those before; any choice gives
exact results. A vector of another size than the pivots' lies in a folder of its own, which requests of other sizes read.

Defined results are those of ``vector.top_k``: null and non-finite vectors and null keys take no part, repeated rows are
found each for itself, ties go to the smaller key, empty tables find nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship
from .vector import _FOUND, _batch, _matrices, _nearest, _trimmed, sound, top_k

_OTHER = -1  # the folder of vectors of other sizes
_SLACK = 1e-9


def choose(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different vectors of the sample, each farthest from those before."""
    chosen = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


@dataclass
class VectorIndex:
    """vectors(key, v, away, pivot) in folders by pivot; the pivots' vectors, and of each folder rows, least and greatest away."""

    vectors: DataFrame
    pivots: np.ndarray
    folders: dict[int, tuple[int, float, float]]

    @staticmethod
    def read(spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()  # as many as pivots
        pivots = np.array([r["v"] for r in rows if r["pivot"] >= 0], dtype=np.float64)
        folders = {r["pivot"]: (r["rows"], r["least"], r["greatest"]) for r in rows if r["rows"]}
        return VectorIndex(spark.read.schema("key long, v array<double>, away double, pivot int").parquet(f"{path}/vectors"), pivots, folders)


def build(vectors: DataFrame, path: str, pivots: int = 64, sample: int = 4_096, key_col: str = "vec_id", vec_col: str = "embedding", files: int = 0) -> VectorIndex:
    """Write the index below ``path`` and read it; a folder is dealt over ``files`` tasks (0: as there are shuffle partitions)."""
    spark = vectors.sparkSession
    ship(spark)
    own = sound(vectors, key_col, vec_col, "key")
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    drawn = own.where(F.size("v") == (size[0]["n"] if size else 0)).orderBy(F.xxhash64("key"), "key").limit(sample).select("v").collect()
    centres = choose(np.array([r["v"] for r in drawn], dtype=np.float64), pivots) if drawn else np.zeros((0, 0))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("away", T.DoubleType()), T.StructField("pivot", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (centres**2).sum(axis=1)
        for b in batches:
            away, pivot = np.full(b.num_rows, np.nan), np.full(b.num_rows, _OTHER, dtype=np.int32)
            for width, at, _, matrix in _matrices(b, 0, 1):
                if len(centres) and width == centres.shape[1]:
                    pivot[at] = (lengths - 2 * matrix @ centres.T).argmin(axis=1)
                    away[at] = np.linalg.norm(matrix - centres[pivot[at]], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(away, from_pandas=True), pa.array(pivot)], names=schema.names)

    placed = own.mapInArrow(run, schema)
    files = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, pivots))
    dealt = placed.repartition("pivot", F.pmod(F.xxhash64("key"), F.lit(files))).sortWithinPartitions("pivot", "away")
    dealt.write.mode("overwrite").partitionBy("pivot").parquet(f"{path}/vectors")
    held = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("pivot").agg(F.count("*").alias("rows"), F.min("away").alias("least"), F.max("away").alias("greatest"))
    listed = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centres)] + [(_OTHER, None)], "pivot int, v array<double>")
    listed.join(held, "pivot", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    return VectorIndex.read(spark, path)


class Asked:
    """Requests as a matrix, their distances to the pivots, and the folders that each still needs."""

    def __init__(self, index: VectorIndex, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix, self.index = ids, matrix, index
        far = [(matrix**2).sum(axis=1)[:, None] + (index.pivots**2).sum(axis=1) - 2 * matrix @ index.pivots.T]
        self.far = np.sqrt(np.maximum(far[0], 0))
        self.there = np.array([p in index.folders for p in range(len(index.pivots))])
        rows, least, greatest = (np.array([index.folders.get(p, (0, 0.0, 0.0))[c] for p in range(len(index.pivots))]) for c in range(3))
        self.rows = rows
        slack = 1e-6 + _SLACK * self.far
        sides = np.maximum(self.far - greatest, least - self.far)
        self.bound = np.maximum(0, np.maximum(sides, (self.far - self.far.min(axis=1, keepdims=True)) / 2) - slack)

    def first(self, k: int) -> np.ndarray:
        """Which folders each request reads first: the nearest, until they hold k vectors."""
        order = np.argsort(np.where(self.there, self.far, np.inf), axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(self.far.shape, dtype=bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & self.there

    def rest(self, tried: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Which others may hold something as near as the k-th found."""
        return ~tried & self.there & (self.bound <= kth[:, None])


def _read(index: VectorIndex, asked: Asked, wanted: np.ndarray, reach: np.ndarray, k: int) -> DataFrame:
    """The k nearest of each request in the folders wanted, of vectors at most ``reach`` farther from or nearer to the pivot than it."""
    by_pivot = {int(p): np.flatnonzero(wanted[:, p]) for p in np.flatnonzero(wanted.any(axis=0))}
    near = None
    for p, who in by_pivot.items():
        low, high = (asked.far[who, p] - reach[who]).min() - 1e-6, (asked.far[who, p] + reach[who]).max() + 1e-6
        one = F.col("pivot") == p
        if np.isfinite(high):
            one = one & F.col("away").between(float(low), float(high))
        near = one if near is None else near | one
    rows = index.vectors.where(near if near is not None else F.lit(False)).select("key", "v", "pivot")
    ids, matrix = asked.ids, asked.matrix

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            pivot = b.column(2).to_numpy()
            for p in np.unique(pivot):
                who = by_pivot[int(p)]
                for _, _, keys, vectors in _matrices(b.filter(pa.array(pivot == p)), 0, 1):
                    at, found, distance = _nearest(matrix[who], keys, vectors, k)
                    new = who[at], found, distance
                    best = _trimmed(*(np.concatenate(x) for x in zip(best, new, strict=True)), k) if best else _trimmed(*new, k)
        if best:
            yield _batch(ids[best[0]], best[1], best[2])

    return rows.mapInArrow(run, _FOUND)


def search(index: VectorIndex, requests: DataFrame, k: int = 12, request_col: str = "request_id", query_col: str = "vector", most: int = 2_048) -> DataFrame:
    """request_id, key, distance (squared, double), rank of each request's k nearest.

    More than ``most`` requests, as those of other sizes, go to ``vector.top_k`` over what is stored.
    """
    asked = sound(requests, request_col, query_col, "r")
    few = asked.limit(most + 1).collect()
    plain = index.vectors.select("key", "v")
    again = lambda of, over: top_k(over, of, k, "key", "v", "r", "v")
    if len(few) > most or not len(index.pivots):
        return again(asked, plain)
    width = index.pivots.shape[1]
    own = [r for r in few if len(r["v"]) == width]
    others = again(asked.where(F.size("v") != width), plain.where(index.vectors["pivot"] == _OTHER))
    if not own:
        return others
    found, _ = nearest(index, Asked(index, np.array([r["r"] for r in own]), np.array([r["v"] for r in own], dtype=np.float64)), k)
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("distance", "key"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.unionByName(others) if len(own) < len(few) else ranked


def nearest(index: VectorIndex, asked: Asked, k: int) -> tuple[DataFrame, np.ndarray]:
    """The nearest of all requests, and which folders each of them read."""
    tried = asked.first(k)
    one = cut(_read(index, asked, tried, np.full(len(asked.ids), np.inf), k), "nearest")
    place = Window.partitionBy("request_id").orderBy("distance", "key")
    kth = one.withColumn("rank", F.row_number().over(place)).where(F.col("rank") == k).select("request_id", "distance").collect()  # a row a request
    reach = {r["request_id"]: r["distance"] ** 0.5 for r in kth}
    limit = np.array([reach.get(int(i), np.inf) for i in asked.ids])
    more = asked.rest(tried, limit)
    return one.unionByName(_read(index, asked, more, limit, k)), tried | more
