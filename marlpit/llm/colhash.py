"""Nearest neighbours by inner product with collision-counting hashing.

Rows are dealt over shards by a hash of their id; a shard is indexed once, and all queries stream past it. In a shard
every vector gets one more component that brings it to the shard's greatest length, so that the
largest inner product is the smallest distance. Random projections, one per hash function, are sorted arrays; a query's
window in each is centred on its own projection and found by binary search. Virtual rehashing widens all windows by one
factor at a time; a vector in at least ``threshold`` windows has collided often enough and is verified exactly. The
search of a shard ends when the k-th nearest verified vector is no farther than the radius that the windows stand for,
or when the windows hold everything.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id,
take no part; of rows with one id the least vector counts; only vectors of the query's dimension are its candidates;
ties go to the smaller id; other columns are dropped; an empty table, or no query, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import map_batches

_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def valid(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)


class Shard:
    """The sorted projections of some vectors of one dimension.

    Vectors are scaled by a power of two, and each query by its own, so that no square over- or underflows; the scores
    are of the vectors as they are.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hashes: int, ratio: float, misses: float, seed: int = 7):
        self.ids, self.vectors, self.hashes = ids, vectors.astype(np.float64), hashes
        self.scaled = np.ldexp(self.vectors, -np.frexp(np.abs(self.vectors).max())[1])
        squares = (self.scaled**2).sum(axis=1)
        self.top = math.sqrt(squares.max())
        self.directions = np.random.default_rng(seed).standard_normal((hashes, vectors.shape[1] + 1))
        extended = np.concatenate([self.scaled, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1)
        projected = (extended @ self.directions.T).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=1)
        self.order = order
        p = math.erf(1 / math.sqrt(2))  # a vector at distance R is within R of the query along a direction this often
        self.threshold = max(1, math.floor(hashes * p - misses * math.sqrt(hashes * p * (1 - p))))
        steps = math.ceil(math.log(2.01 / 0.2) / math.log(ratio))
        self.radii = 0.2 * self.top * ratio ** np.arange(steps)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query id, ids, scores) of the k nearest found for each query."""
        queries = queries.astype(np.float64)
        scaled = np.ldexp(queries, -np.frexp(np.abs(queries).max(axis=1))[1][:, None])
        lengths = np.sqrt((scaled**2).sum(axis=1))
        centred = (scaled * (self.top / lengths)[:, None]) @ self.directions[:, :-1].T
        low = np.empty((len(queries), len(self.radii), self.hashes), dtype=np.int64)
        high = np.empty_like(low)
        for h in range(self.hashes):
            low[:, :, h] = np.searchsorted(self.sorted[h], centred[:, h, None] - self.radii, "left")
            high[:, :, h] = np.searchsorted(self.sorted[h], centred[:, h, None] + self.radii, "right")
        for i, query_id in enumerate(query_ids):
            found = self._one(query_id, scaled[i], lengths[i], low[i], high[i], k)
            scores = (self.vectors[found] * queries[i]).sum(axis=1)
            best = np.lexsort((self.ids[found], -scores))[:k]
            yield query_id, self.ids[found[best]], scores[best]

    def _one(self, query_id, query, length, low, high, k):
        """The places of vectors of which the k nearest are the query's."""
        seen = self.ids == query_id
        found = np.empty(0, dtype=np.int64)
        near = np.empty(0)
        margin = 1e-9 * self.top * length  # above what the order of a sum can change
        collisions = np.zeros(len(self.ids), dtype=np.int64)
        least = self.threshold * min(k, len(self.ids))  # windows of fewer entries hold no k vectors that collided often enough
        begin = int(np.argmax(np.append((high - low).sum(axis=1) >= least, True)))
        start, stop = high[begin], high[begin]  # empty windows
        if begin < len(self.radii):
            start = stop = low[begin]
        for r in range(begin, len(self.radii) + 1):
            if r == len(self.radii):
                new = np.flatnonzero(~seen)
            else:  # the windows grow to the next radius: only what they gain is counted
                gained = [part for o, a, b, c, d in zip(self.order, low[r].tolist(), start.tolist(), stop.tolist(), high[r].tolist(), strict=True) for part in (o[a:b], o[c:d])]
                collisions += np.bincount(np.concatenate(gained), minlength=len(collisions))
                start, stop = low[r], high[r]
                new = np.flatnonzero((collisions >= self.threshold) & ~seen)
            if len(new):
                seen[new] = True
                found = np.concatenate([found, new])
                near = np.concatenate([near, self.scaled[new] @ query])
                if len(found) > k:
                    kept = near >= np.partition(near, -k)[-k] - margin
                    found, near = found[kept], near[kept]
            # squared distance of the extended vectors, the query scaled to the greatest length
            if r < len(self.radii) and len(found) >= k and 2 * self.top**2 - 2 * self.top * near.min() / length <= self.radii[r] ** 2:
                break
        return found


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, hashes: int = 48, ratio: float = 1.2, misses: float = 1.6, shard_rows: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for the rows that ``is_query`` marks by their id.

    ``is_query`` is a condition on a long column named id. ``misses`` is how many standard deviations below its mean
    the threshold lies for a vector at the radius itself. A task holds one shard; the queries stream past it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)  # shard, dimension, whether it asks
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for one, end in zip(cuts[:-1], cuts[1:], strict=True):
                if one == end:
                    continue
                part = b.slice(one, end - one)
                key, width = tuple(keys[one, :2].tolist()), int(keys[one, 1])
                if key != at:
                    at, held, shard = key, [], None
                ids = part.column(3).to_numpy()
                rows = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                if not keys[one, 2]:
                    held.append((ids, rows))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard, held = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), hashes, ratio, misses), []
                for a in range(0, len(ids), 256):
                    found = list(shard.search(ids[a : a + 256], rows[a : a + 256], k))
                    counts = [len(x) for _, x, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a : a + 256], counts)), pa.array(np.concatenate([x for _, x, _ in found])), pa.array(np.concatenate([x for _, _, x in found]))], ["query_id", "vec_id", "score"])

    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & valid(F.col("vec"))).groupBy("id").agg(F.min("vec").alias("vec"))
    base = cut(base, "vectors")
    shards = max(1, math.ceil(base.count() / shard_rows))
    rows = lambda df, shard, asks: df.withColumn("shard", shard).select("shard", F.size("vec").cast("long").alias("dim"), F.lit(asks).cast("long").alias("asks"), "id", "vec")
    indexed = rows(base, F.pmod(F.xxhash64("id"), F.lit(shards).cast("long")), 0)
    asked = rows(base.where(is_query), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))), 1)
    dealt = indexed.unionByName(asked).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "dim", "asks", "id")
    found = map_batches(dealt, run, _SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
