"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size, in classes whose upper size doubles. For a class of upper size u documents are
read as windows of 2u shingle positions that start every u, so that any passage as long as an item of the class lies
within one window and the sets compared are of like size. For items of the class of which a share of at least
``least`` is in a window, the Jaccard similarity has a lower bound; from it follows the number of one-row bands that
misses such a window less often than ``miss``. Windows that share a band with an item make their document a candidate,
and the share of the item's distinct shingles in the whole document is then counted exactly. Items for which the bound
asks for more than ``most_bands`` bands (they repeat few shingles over and over) are counted in every document.

Minima are kept for blocks of 16 positions; windows of all classes are unions of blocks.

Defined results: a null or wordless text or item contains and is contained in nothing; an item or text of fewer than
five words is a single shingle of all its words; null ids are carried; repeated rows are found each for itself; there
are no ties; a very long text is read as windows of its one row; other columns are dropped by ``find`` and kept by
``drop_contaminated``; empty tables give no hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, map_batches, slices
from .shingles import Shingler, mix

_BLOCK = 16
_FILTER_BITS = 22


class Finder:
    """Finds a bounded block of items in texts."""

    def __init__(self, items: list[tuple[object, str | None]], least: float = 0.8, miss: float = 1e-6, most_bands: int = 128, width: int = 5):
        self.least, self.shingler = least, Shingler(width)
        hashes, offsets = self.shingler([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes = np.diff(offsets)
        self.always: list[int] = []
        grouped: dict[int, list[int]] = {}
        need: dict[int, int] = {}
        for i, n in enumerate(sizes.tolist()):
            if not n:
                continue
            upper = _BLOCK * 2 ** max(0, math.ceil(math.log2(n / _BLOCK)))
            distinct = len(self.sets[i])
            least_jaccard = least * distinct / (2 * upper + (1 - least) * distinct)
            bands = math.ceil(math.log(miss) / math.log1p(-least_jaccard))
            if bands > most_bands:
                self.always.append(i)
            else:
                grouped.setdefault(upper, []).append(i)
                need[upper] = max(need.get(upper, 0), bands)
        self.bands = max(need.values(), default=0)
        rng = np.random.default_rng(11)
        self.flip = rng.integers(0, 1 << 32, self.bands, dtype=np.uint32)
        self.scale = rng.integers(0, 1 << 31, self.bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.classes = []
        for upper, members in sorted(grouped.items()):
            n = need[upper]
            keys = np.concatenate([self._keys(self._hash(self.sets[i])[:, :n].min(axis=0)[None, :]).ravel() for i in members])
            owner = np.repeat(np.array(members), n)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            there = np.zeros(1 << _FILTER_BITS, dtype=bool)
            there[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.classes.append((upper // _BLOCK, n, keys, owner, there))

    def _hash(self, shingles: np.ndarray) -> np.ndarray:
        top = (shingles >> np.uint64(32)).astype(np.uint32)
        return (top[:, None] ^ self.flip) * self.scale

    def _keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band and minimum."""
        band = np.arange(minima.shape[1], dtype=np.uint64) << np.uint64(32)
        return mix(minima.astype(np.uint64) | band)

    def _block_minima(self, shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Minima by block and band, with a neutral last row, and where each text's blocks begin."""
        counts = -(-np.diff(offsets) // _BLOCK)
        begins = np.concatenate([[0], np.cumsum(counts)])
        starts = np.repeat(offsets[:-1] - _BLOCK * begins[:-1], counts) + _BLOCK * np.arange(begins[-1])
        minima = np.full((begins[-1] + 1, self.bands), np.iinfo(np.uint32).max, dtype=np.uint32)
        if len(starts):
            # one row for each place in a block, so that minima run along whole rows; a short block repeats its last shingle
            ends = np.repeat(offsets[1:], counts) - 1
            top = (shingles >> np.uint64(32)).astype(np.uint32)[np.minimum(starts + np.arange(_BLOCK)[:, None], ends)]
            hashed = np.empty_like(top)
            for j in range(self.bands):
                np.bitwise_xor(top, self.flip[j], out=hashed)
                np.multiply(hashed, self.scale[j], out=hashed)
                minima[:-1, j] = hashed.min(axis=0)
        return minima, begins

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text's index, item's index, the item's distinct shingles that are in the text) where their share is enough."""
        shingles, offsets = self.shingler(texts)
        pairs: set[tuple[int, int]] = {(d, i) for d in range(len(texts)) if offsets[d + 1] > offsets[d] for i in self.always}
        if self.classes and len(shingles):
            minima, begins = self._block_minima(shingles, offsets)
            blocks = np.diff(begins)
            for step, n, keys, owner, there in self.classes:
                windows = np.where(blocks > 2 * step, -(-(blocks - 2 * step) // step) + 1, np.minimum(blocks, 1))
                text = np.repeat(np.arange(len(texts)), windows)
                k = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
                lo = begins[text] + k * step
                hi = np.minimum(lo + 2 * step, begins[text + 1])
                low = np.minimum.reduceat(minima[:, :n], np.stack([lo, hi], axis=1).ravel(), axis=0)[::2]
                found = self._keys(low)
                row, band = np.nonzero(there[(found >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                value = found[row, band]
                left, right = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
                for r, a, b in zip(row[right > left], left[right > left], right[right > left], strict=True):
                    pairs.update((int(text[r]), int(i)) for i in owner[a:b])
        last, own = -1, np.empty(0, dtype=np.uint64)
        for d, i in sorted(pairs):
            if d != last:
                last, own = d, np.unique(shingles[offsets[d] : offsets[d + 1]])
            item = self.sets[i]
            at = np.searchsorted(own, item)
            shared = int((own[np.minimum(at, len(own) - 1)] == item).sum())
            if shared >= self.least * len(item) - 1e-9:
                yield d, i, shared


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes``, so that what is sent to the executors at once is bounded."""
    own = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for k in range(blocks):
        yield [tuple(r) for r in own.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()]


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of each document and item it holds a share of at least ``least``.

    Documents are read once for each block of items; nothing is shuffled.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("item_shingles", T.LongType())])
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _item_blocks(items, item_col, item_text_col, block_bytes):

        def run(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[tuple]:
            finder = Finder(block, least)
            for b in slices(batches, 128):
                ids = b.column(0).to_pylist()
                for d, i, shared in finder.find(b.column(1).to_pylist()):
                    yield ids[d], finder.ids[i], shared, len(finder.sets[i])

        part = arrow_map(own, run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with all columns, without the rows whose text holds an item."""
    at = docs.columns.index(text_col)
    for block in _item_blocks(items, item_col, item_text_col, block_bytes):

        def run(batches: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            finder = Finder(block, least)
            for b in slices(batches, 128):
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[d for d, _, _ in finder.find(b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        docs = map_batches(docs, run, docs.schema)
    return docs


def find_sql(least: float = 0.8) -> str:
    """The same by brute force in DuckDB's SQL over ``documents`` and ``benchmark``."""
    shingled = """SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                  WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' #' || len(w)] ELSE [] END) AS s"""
    split = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    return f"""
WITH d AS ({shingled} FROM (SELECT doc_id AS id, {split} AS w FROM documents)),
b AS ({shingled} FROM (SELECT item_id AS id, {split} AS w FROM benchmark)),
n AS (SELECT id, count(*) AS item_shingles FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared, any_value(n.item_shingles) AS item_shingles,
       count(*) / any_value(n.item_shingles) AS containment
FROM d JOIN b USING (s) JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= {least} * any_value(n.item_shingles) - 1e-9"""

