"""MinHash near-duplicates with ProbMinHash sketches.

Every distinct shingle of a text is an element whose weight is 1 + ln(its count). Its arrivals are a Poisson process of
that rate; each falls on a register drawn uniformly, and a register keeps the element that came first. An element is
done when its next arrival is later than the last register's, which ends the process early. Two registers agree with
the probability Jaccard similarity of the weighted sets, which for equal weights is the Jaccard similarity. A text that
repeats a shingle has a second sketch with all weights 1 (for others it is the same), so that bands and registers see
both similarities: lines repeated in one copy only lower the first, not the second.

Texts are grouped by digest first, so exact copies cost one row each. Bands of registers are hashed to buckets. A
bucket's centre is its text with the most neighbours over all its buckets, and each text is verified against the centre
that it shares most buckets with: one pair a text, which joins nearly all of a group of near copies. In the buckets
that still hold several components, sketches are compared, in blocks, and every pair of different components whose
sketches of either kind agree in at least ``least`` less ``slack`` standard deviations of the registers is verified
too. So no pair of a bucket that could join two components goes unverified, but for what the sketches' slack leaves
(4e-6 of pairs right at the threshold, as the bands do; none where ``slack`` is so great that every pair of a bucket is
verified), and pairs within a component are not made. Verification is exact, on the texts' shingles.

A pair is linked when its probability Jaccard or its plain Jaccard similarity is at least ``least``. Classes are the
connected components.

Defined results: a null text is in a class of its own row (its class is its own id); an empty or wordless text is in
a class with its exact copies; the class id is the least id of the class, null if all its ids are null; repeated rows
are copies of one another; other columns are dropped by ``classes`` and kept by ``keep_first``; an empty table gives
no rows. A very long text is one row of its shingles in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, uncut
from .common import arrow_map, slices
from .components import components
from .shingles import Shingler, mix

_LOW = np.uint64((1 << 52) - 1)


def weighted(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, 52-bit element and weight of every distinct shingle of up to 4096 texts."""
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    keys, counts = np.unique(text << np.uint64(52) | shingles & _LOW, return_counts=True)
    return (keys >> np.uint64(52)).astype(np.int64), keys & _LOW, 1 + np.log(counts)


def sketch(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """For each text and register the element that arrived first (0 where the text has none)."""
    first = np.full(texts * registers, np.inf)
    owner = np.zeros(texts * registers, dtype=np.uint64)
    arrival = np.zeros(len(text))
    turn = 0
    while len(text):
        turn += 1
        r = mix(element + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        arrival = arrival - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        at = text * registers + (mix(r) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, arrival)
        won = arrival == first[at]
        owner[at[won]] = element[won]
        last = first.reshape(texts, registers).max(axis=1)
        going = arrival <= last[text]
        text, element, weight, arrival = text[going], element[going], weight[going], arrival[going]
    return owner.reshape(texts, registers)


def similarities(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Plain and probability Jaccard similarity of two weighted sets (elements, sorted; weights)."""
    common, at, to = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    size = len(x[0]) + len(y[0]) - len(common)
    if not len(common):
        return 0.0, 0.0
    a, b = x[1][at], y[1][to]
    only_a, only_b = x[1].sum() - a.sum(), y[1].sum() - b.sum()
    order = np.argsort(a / b)
    a, b = a[order], b[order]
    # for element i: the a of elements with a greater ratio, over a_i, plus the b of the others, over b_i
    above = a.sum() - np.cumsum(a) + only_a
    below = np.cumsum(b) + only_b
    return len(common) / size, float((1 / (above / a + below / b)).sum())


class Sketcher:
    def __init__(self, bands: int, rows: int, width: int):
        self.bands, self.rows, self.shingler = bands, rows, Shingler(width)

    def __call__(self, texts: list[str | None]) -> list[tuple[list[int | None], bytes] | None]:
        """Bucket numbers, one for each band, and 16 bits of each register; None for a text without shingles.

        Of a text that repeats shingles those of the sketch with equal weights follow; a bucket that is the same is None.
        """
        shingles, offsets = self.shingler(texts)
        text, element, weight = weighted(shingles, offsets)
        prints, value = self._of(sketch(text, element, weight, len(texts), self.bands * self.rows))
        lists = value.tolist()
        out = [(x, prints[i].tobytes()) if offsets[i + 1] > offsets[i] else None for i, x in enumerate(lists)]
        repeats = np.unique(text[weight > 1])
        if len(repeats):
            own = np.isin(text, repeats)
            plain = sketch(np.searchsorted(repeats, text[own]), element[own], np.ones(int(own.sum())), len(repeats), self.bands * self.rows)
            more, other = self._of(plain)
            for k, i in enumerate(repeats.tolist()):
                out[i] = (lists[i] + [y if x != y else None for x, y in zip(lists[i], other[k].tolist(), strict=True)], out[i][1] + more[k].tobytes())
        return out

    def _of(self, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prints and bucket numbers of sketches."""
        prints = (mix(got) >> np.uint64(48)).astype("<u2")
        got = got.reshape(len(got), self.bands, self.rows)
        value = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), got.shape[:2]).copy()
        for r in range(self.rows):
            value = mix(value * np.uint64(31) + got[:, :, r] + np.uint64(r + 1))
        return prints, value.view(np.int64)


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256; null for null."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _buckets(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """id, key, buckets and register prints of every row."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType())), T.StructField("prints", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        sketcher = Sketcher(bands, rows, width)
        for b in slices(batches, 512):
            ids, keys, texts = (c.to_pylist() for c in b.columns)
            first = {k: i for i, k in reversed(list(enumerate(keys))) if k is not None}
            distinct = sorted(first.values())
            got = dict(zip((keys[i] for i in distinct), sketcher([texts[i] for i in distinct]), strict=True))
            for i, k in zip(ids, keys, strict=True):
                yield i, k, *(got.get(k) or (None, None))

    return arrow_map(docs.select("id", "key", "text"), run, schema, rows=1024)


def _verified(pairs: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.

    Both joins leave hot keys to adaptive skew handling: nothing above them needs a key's rows together.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        shingler = Shingler(width)
        for b in slices(batches, 64):
            left, right, left_text, right_text = (c.to_pylist() for c in b.columns)
            number: dict[int, int] = {}
            texts = []
            for k, t in (*zip(left, left_text, strict=True), *zip(right, right_text, strict=True)):
                if k not in number:
                    number[k] = len(texts)
                    texts.append(t)
            text, element, weight = weighted(*shingler(texts))
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            part = lambda k: (element[ends[number[k]] : ends[number[k] + 1]], weight[ends[number[k]] : ends[number[k] + 1]])
            for x, y in zip(left, right, strict=True):
                if max(similarities(part(x), part(y))) >= least - 1e-12:
                    yield x, y

    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    with_a = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return arrow_map(with_a.select("a", "b", "text_a", "text_b"), run, schema)


def _ordered(one: Column, other: Column) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _labels(docs: DataFrame, least: float, bands: int, rows: int, width: int, slack: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """id and key of every row; number, key, least id and copies of every distinct text; component of each number that is linked."""
    keyed = cut(_buckets(docs, bands, rows, width), "buckets")
    distinct = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    numbered = cut(distinct.withColumn("number", F.monotonically_increasing_id()), "texts")  # fixed once it is written
    of = numbered.select(F.col("number").alias("key"), F.col("key").alias("of"), F.col("id").alias("of_id"))

    def own(df: DataFrame, numbers: DataFrame) -> DataFrame:
        """The rows that stand for their text."""
        return df.join(numbers, (df["key"] == F.col("of")) & df["id"].eqNullSafe(F.col("of_id"))).drop(df["key"])

    exploded = own(keyed, of).select("key", F.posexplode("buckets").alias("place", "bucket")).where(F.col("bucket").isNotNull())
    rows_of = exploded.select("key", F.pmod("place", F.lit(bands)).cast("int").alias("band"), "bucket")
    shared = rows_of.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).where(F.col("low") != F.col("high"))
    members = cut(rows_of.join(shared.select("bucket", "size"), "bucket").distinct(), "members")
    degree = members.groupBy("key").agg(F.sum("size").alias("degree"))
    carried = cut(own(docs, of.join(degree.select("key"), "key", "left_semi")).select("key", "text").dropDuplicates(["key"]), "carried")

    met = members.join(degree, "key")
    centres = met.groupBy("bucket").agg(F.max_by("key", F.struct("degree", "key")).alias("centre"))
    near = members.join(centres, "bucket").where(F.col("key") != F.col("centre")).groupBy("key", "centre").count()
    nearest = near.groupBy("key").agg(F.max_by("centre", F.struct("count", "centre")).alias("centre"))
    tested = cut(nearest.select(*_ordered(F.col("key"), F.col("centre"))).distinct(), "pairs")
    links = cut(_verified(tested, carried, least, width), "links")

    label = members.select("bucket", "band", "key").join(components(links), "key", "left").withColumn("component", F.coalesce("component", "key"))
    parts = label.groupBy("bucket", "component").agg(F.count("*").alias("texts"))
    mixed = parts.groupBy("bucket").agg(F.sum("texts").alias("size"), F.max(F.struct("texts", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    mixed = mixed.select("bucket", "size", F.col("top.component").alias("largest"), (F.col("size") - F.col("top.texts")).alias("rest"))
    prints = own(keyed, of).select("key", "prints").dropDuplicates(["key"])
    open_ = label.join(mixed, "bucket").join(prints, "key")
    tiles = cut(_likely(open_, least, bands * rows, slack, rows), "tiles")
    every = cut(links.union(_linking(tiles, carried, least, width)), "links")
    found = components(every)
    uncut(members, carried, tested, links, tiles, every)
    return keyed.select("id", "key"), numbered, found


def _likely(open_: DataFrame, least: float, registers: int, slack: float, rows: int, block: tuple[int, int] = (256, 1024)) -> DataFrame:
    """Pairs of different components in a bucket whose sketches agree often enough, each in its first bucket only.

    ``open_`` holds bucket, band, key, component, prints, and of the bucket its size, its largest component and the
    rest, the texts outside of it. The rest is compared with all texts, either dealt over blocks of a 64th of the
    bucket, but of no fewer and no more texts than ``block`` says: a task holds two blocks, whatever the bucket. Two
    blocks with such pairs make one row: bucket, low, high, and the pairs' keys a, b and components x, y as arrays.
    """
    enough = registers * (least - slack * (least * (1 - least) / registers) ** 0.5)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("bucket", "low", "high")), *(T.StructField(c, longs) for c in "abxy")])

    def run(key, table):
        band = table.column("band")[0].as_py() if table.num_rows else 0
        keys, parts = table.column("key").to_numpy(), table.column("component").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        outside = table.column("outside").to_numpy(zero_copy_only=False)
        held = table.column("prints").to_pylist()
        both = np.array([len(x) > 2 * registers for x in held], dtype=bool)  # those with two sketches
        prints = np.frombuffer(b"".join(x[: 2 * registers] for x in held), dtype="<u2").reshape(len(keys), registers)
        plain = np.frombuffer(b"".join(x[-2 * registers :] for x in held), dtype="<u2").reshape(len(keys), registers) if both.any() else prints
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, (16 << 20) // (max(1, len(right)) * registers))
        for at in range(0, len(left), step):
            rows_ = left[at : at + step]
            likely = (prints[rows_][:, None, :] == prints[right][None, :, :]).sum(axis=2, dtype=np.uint16) >= enough
            # a pair of texts without repeats has been compared; the others are compared by equal weights too
            for x, y in ((both[rows_], np.ones(len(right), dtype=bool)), (~both[rows_], both[right])):
                if x.any() and y.any():
                    at_x, at_y = np.flatnonzero(x), np.flatnonzero(y)
                    likely[np.ix_(at_x, at_y)] |= (plain[rows_[at_x]][:, None, :] == plain[right[at_y]][None, :, :]).sum(axis=2, dtype=np.uint16) >= enough
            # two texts of the rest meet twice, and count where the one with the smaller key asks
            once = ~outside[right][None, :] | (keys[rows_][:, None] < keys[right][None, :])
            i, j = np.nonzero(likely & once & (parts[rows_][:, None] != parts[right][None, :]))
            i, j = rows_[i], right[j]
            shape = (len(i), registers // rows, rows)
            same = (prints[i] == prints[j]).reshape(shape).all(axis=2)
            if (both[i] | both[j]).any():  # they may meet in a bucket of either sketch of both
                for x, y in ((plain, plain), (prints, plain), (plain, prints)):
                    same |= (x[i] == y[j]).reshape(shape).all(axis=2)
            first = same.argmax(axis=1) == band
            found.append((i[first], j[first]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 2
        if not len(i):
            return pa.table({f.name: pa.array([], t) for f, t in zip(schema, [pa.int64()] * 3 + [pa.list_(pa.int64())] * 4, strict=True)})
        own = [pa.array([k.as_py()], pa.int64()) for k in key]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (keys[i], keys[j], parts[i], parts[j])]
        return pa.table(dict(zip(schema.names, own + lists, strict=True)))

    texts = F.least(F.lit(block[1]), F.greatest(F.lit(block[0]), F.col("size") / 64))
    sized = open_.withColumn("outside", F.col("component") != F.col("largest")).withColumn("lefts", F.ceil(F.col("rest") / texts).cast("int")).withColumn("rights", F.ceil(F.col("size") / texts).cast("int"))
    place = lambda count: F.pmod(F.xxhash64("key"), F.col(count)).cast("int")
    upto = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    asking = F.transform(upto("rights"), lambda r: F.struct(place("lefts").alias("low"), r.alias("high"), F.lit(True).alias("asks")))
    asked = F.transform(upto("lefts"), lambda x: F.struct(x.alias("low"), place("rights").alias("high"), F.lit(False).alias("asks")))
    dealt = sized.withColumn("at", F.explode(F.when(F.col("outside"), F.concat(asking, asked)).otherwise(asked)))
    return dealt.select("bucket", "band", "key", "component", "prints", "outside", "at.*").groupBy("bucket", "low", "high").applyInArrow(run, schema)


class _Merged(dict):
    """Components that were found to be one, by their least number."""

    def top(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def _linking(tiles: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """Pairs (a, b) of the tiles that are similar enough, but for those whose components others of their tile join.

    A text goes to each tile that has a pair of it, once, however many pairs that are; pairs stay in their tile's row.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    tile = ["bucket", "low", "high"]

    def verified(pairs, sets) -> Iterator[tuple]:
        merged = _Merged()
        for a, b, x, y in zip(*pairs, strict=True):
            x, y = merged.top(x), merged.top(y)
            if x != y and max(similarities(sets[a], sets[b])) >= least - 1e-12:
                merged[max(x, y)] = min(x, y)
                yield a, b

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        shingler = Shingler(width)
        pairs, sets = [[]] * 4, {}
        for b in slices(batches, 64):
            keys, held = b.column(3).to_pylist(), b.column(4).to_pylist()
            text, element, weight = weighted(*shingler(held))
            ends = np.searchsorted(text, np.arange(len(held) + 1))
            for i, key in enumerate(keys):
                if key is None:  # a tile's pairs come before its texts
                    yield from verified(pairs, sets)
                    pairs, sets = [b.column(c)[i].as_py() for c in range(5, 9)], {}
                else:
                    sets[key] = element[ends[i] : ends[i + 1]].copy(), weight[ends[i] : ends[i + 1]].copy()
        yield from verified(pairs, sets)

    held = tiles.select(*tile, F.explode(F.array_distinct(F.concat("a", "b"))).alias("key")).join(texts, "key").select(*tile, "key", "text")
    rows = tiles.select(*tile, F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("text"), *"abxy").unionByName(held, allowMissingColumns=True)
    return arrow_map(rows.repartition(*tile).sortWithinPartitions(*tile, F.col("key").asc_nulls_first()), run, schema)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("key"), text.alias("text"))


def _with_component(numbered: DataFrame, labels: DataFrame) -> DataFrame:
    return numbered.join(labels.withColumnRenamed("key", "number"), "number", "left").withColumn("component", F.coalesce("component", "number"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, bands: int = 40, rows: int = 6, width: int = 5, slack: float = 4.5) -> DataFrame:
    """doc_id, class_id and class_size of every row."""
    keyed, numbered, labels = _labels(_prepared(docs, id_col, text_col), least, bands, rows, width, slack)
    texts = _with_component(numbered, labels)
    whole = texts.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    found = keyed.join(texts.select("key", "component").join(whole, "component"), "key", "left")
    alone = F.col("key").isNull()
    return found.select(F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, bands: int = 40, rows: int = 6, width: int = 5, slack: float = 4.5) -> DataFrame:
    """``docs`` with all columns, one row of each class: the one with the least id (a text all of whose
    ids are null comes first).

    Of repeated rows of that id and text any one is kept. Rows with a null text are all kept.
    """
    _, numbered, labels = _labels(_prepared(docs, id_col, text_col), least, bands, rows, width, slack)
    rank = F.struct(F.col("id").isNotNull(), "id", "number")
    kept = _with_component(numbered, labels).groupBy("component").agg(F.min_by(F.struct("id", "key"), rank).alias("x")).select(F.col("x.id").alias("_kept_id"), F.col("x.key").alias("_kept_key"))
    # columns by number, as theirs may have any name
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own_id, own_text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    long, key = F.col(own_id).cast("long"), text_key(F.col(own_text).cast("string"))
    marked = plain.join(kept, (key == F.col("_kept_key")) & long.eqNullSafe(F.col("_kept_id")), "left_semi")
    once = marked.withColumn("_key", key).withColumn("_id", long).dropDuplicates(["_id", "_key"]).select(*names)
    return once.union(plain.where(F.col(own_text).isNull())).toDF(*docs.columns)


def classes_sql(least: float = 0.8) -> str:
    """The same by brute force in DuckDB's SQL over ``documents`` with unique ids: all pairs that share a shingle.

    x and y are the weights of a shingle in either text of a pair; running sums by the ratio x / y give, for each common
    shingle, the weights that it is compared with.
    """
    split = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    return f"""
WITH RECURSIVE texts AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
words AS (SELECT id, {split} AS w FROM texts),
grams AS (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                            WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' #' || len(w)] ELSE [] END) AS s FROM words),
sets AS (SELECT id, s, 1 + ln(count(*)) AS v FROM grams GROUP BY id, s),
totals AS (SELECT id, sum(v) AS v, count(*) AS n FROM sets GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, a.v AS x, b.v AS y FROM sets a JOIN sets b ON a.s = b.s AND a.id < b.id),
pairs AS (SELECT a, b, count(*) AS n, sum(x) AS x, sum(y) AS y FROM common GROUP BY a, b),
sums AS (SELECT c.a, c.b, c.x, c.y, p.x - sum(c.x) OVER w + ta.v - p.x AS above, sum(c.y) OVER w + tb.v - p.y AS below
         FROM common c JOIN pairs p USING (a, b) JOIN totals ta ON ta.id = c.a JOIN totals tb ON tb.id = c.b
         WINDOW w AS (PARTITION BY c.a, c.b ORDER BY c.x / c.y)),
weighed AS (SELECT a, b, sum(1 / (above / x + below / y)) AS jp FROM sums GROUP BY a, b),
links AS (SELECT a, b FROM pairs JOIN weighed USING (a, b) JOIN totals ta ON ta.id = a JOIN totals tb ON tb.id = b
          WHERE greatest(jp, pairs.n / (ta.n + tb.n - pairs.n)) >= {least} - 1e-12),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id, id AS other FROM texts UNION SELECT r.id, l.b FROM reach r JOIN both_ l ON l.a = r.other),
tops AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id),
docs AS (SELECT d.doc_id, coalesce(t.class_id, d.doc_id) AS class_id FROM documents d LEFT JOIN texts x USING (text) LEFT JOIN tops t USING (id))
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM docs"""
