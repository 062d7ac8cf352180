"""Exact Jaccard join of documents' word n-gram sets, as a metric-space join.

Jaccard distance is a metric, so a document's distances to pivots bound its distance to every other document. But texts
that share nothing are all at distance 1 of each other, where no pivot tells them apart; so the first regions come from
counting instead, and pivots split them further:

1. Words are runs of characters other than ASCII white space, with A-Z in lower case; a text's set are its distinct runs
   of ``width`` words, or all its words as one where it has fewer. Equal sets are one point.
2. Every shingle's number of sets is counted by shards of shingles. A set can have a partner only where at least
   ``percent`` of a hundred of its shingles are in other sets too; of these, two partners must share one of their
   rarest, as many as may be missing and one more. Sets that no such shingle joins are in different regions: no link
   crosses regions.
3. A region that is small is joined in one task. A larger one gets pivots: each set is in the Voronoi cell of its nearest
   pivot, p, and is replicated to that of every pivot q where d(x, q) <= d(x, p) + 2 r, r being the greatest distance of
   a link: by the triangle inequality a partner of x in q's cell cannot be missed. Cells are joined the same way,
   recursively; cells all of whose sets are one component already need no join, and cells that pivots do not split are
   compared in blocks. Inside a task the same recursion goes on, and sets are compared exactly where their distances to
   all pivots differ by at most r and their components differ.

Sets of numbers stand for sets of shingles: 48 bits of a shingle's hash and its shard, and 64 bits for a whole set (two
different sets are taken for equal with probability 5e-20). Shingles that several sets of a block of texts share, and
copies, are one entry a block, so neither a frequent shingle nor a hot copy gathers its rows in a task.

Defined results: a null, empty or wordless text has an empty set, is linked with nothing and its component is its own
id; equal texts, and repeated rows, are linked; ties cannot occur, as a component's number is its smallest id, null ids
aside (a component without any other has null); a very long text is one row of its set in a task; without documents
there are no rows. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, uncut
from .common import arrow_map, slices
from .components import components
from .shingles import mix

_BITS = 48  # of a shingle's hash beside its shard's number
_LOW = np.uint64((1 << _BITS) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of rows of the exchange.
_ROW, _OWNED, _MANY, _LOCAL, _SIZE = range(5)
_PARTS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("kind", "to", "block", "id", "owner", "n")] + [T.StructField(c, T.BinaryType()) for c in ("owners", "counts", "hashes", "extra")]
)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


class SetMaker:
    """The sets of texts (as UTF-8), as sorted 64-bit hashes."""

    def __init__(self, width: int, memo: int = 300_000):
        self.width, self.memo, self.known = width, memo, _Memo()
        self.weights = mix(np.arange(1, width + 1, dtype=np.uint64) * _STEP) | np.uint64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # of bytes: A-Z, and ASCII white space
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.known) > self.memo:
            self.known.clear()
        hashes = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(words) < self.width:
            length = np.array([len(words)], dtype=np.uint64) * _STEP
            return mix((hashes * self.weights[: len(words)]).sum(dtype=np.uint64, keepdims=True) + length)
        runs = hashes[: len(words) - self.width + 1] * self.weights[0]
        for k in range(1, self.width):
            runs += hashes[k : k + len(runs)] * self.weights[k]
        runs = np.sort(mix(runs))
        return runs[np.concatenate([[True], runs[1:] != runs[:-1]])]


def _owner(values: np.ndarray) -> int:
    return int.from_bytes(blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _short(values: np.ndarray) -> bytes:
    """The low 48 bits of each, in six bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _BITS // 8]).tobytes()


def _long(data: bytes, shard: int) -> np.ndarray:
    out = np.zeros((len(data) * 8 // _BITS, 8), dtype=np.uint8)
    out[:, : _BITS // 8] = np.frombuffer(data, dtype=np.uint8).reshape(-1, _BITS // 8)
    return out.view("<u8").ravel() | np.uint64(shard << _BITS)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values of a sorted array begin, and their lengths."""
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, dtype=np.int64)
    return begins, np.diff(np.append(begins, len(values)))


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the runs that begin at ``begins``."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)


def _exchange(docs: DataFrame, width: int, shard_bits: int, block: int) -> DataFrame:
    """The rows that go to shards of shingles (``to``): sets' shingles by block, and what only passes through."""
    shards = 1 << shard_bits
    size = block

    def of(block: int, ids: list, sets: list[np.ndarray]) -> Iterator[tuple]:
        owners = [_owner(x) if len(x) else None for x in sets]
        for i, x, o in zip(ids, sets, owners, strict=True):
            yield _ROW, (block + (i or 0)) % shards, None, i, o, len(x), None, None, None, None
        first = {o: x for o, x in zip(owners, sets, strict=True) if o is not None}
        if not first:
            return
        names = np.fromiter(first, dtype=np.int64, count=len(first))
        sizes = np.fromiter(map(len, first.values()), dtype=np.int64, count=len(first))
        yield _SIZE, block % shards, block, None, None, None, names.tobytes(), sizes.astype("<u4").tobytes(), None, None
        values, own = np.concatenate([*first.values()]), np.repeat(np.arange(len(first), dtype=np.uint32), sizes)
        values = (values >> np.uint64(64 - shard_bits)) << np.uint64(_BITS) | values & _LOW
        order = np.argsort(values, kind="stable")
        values, own = values[order], own[order]
        begins, lengths = _runs(values)
        many = lengths > 1
        at = _spread(begins[many], lengths[many])
        if len(at):
            yield _LOCAL, block % shards, block, None, None, None, names.tobytes(), lengths[many].astype("<u4").tobytes(), values[begins[many]].tobytes(), own[at].astype("<u4").tobytes()
        bounds = np.arange(1, shards, dtype=np.uint64) << np.uint64(_BITS)
        one, several = begins[~many], begins[many]
        cuts = np.searchsorted(values[one], bounds), np.searchsorted(values[several], bounds)
        for shard, (x, y) in enumerate(zip(np.split(one, cuts[0]), np.split(several, cuts[1]), strict=True)):
            if len(x):
                x = x[np.argsort(own[x], kind="stable")]
                starts, counts = _runs(own[x])
                yield _OWNED, shard, block, None, None, None, names[own[x[starts]]].tobytes(), counts.astype("<u4").tobytes(), _short(values[x]), None
            if len(y):
                held = lengths[np.searchsorted(begins, y)]
                yield _MANY, shard, block, None, None, None, None, held.astype("<u4").tobytes(), _short(values[y]), None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        maker, ids, sets, total = SetMaker(width), [], [], 0
        number = None
        for b in slices(batches, 256):
            numbers, keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            for k in range(len(keys)):
                number = numbers[k] if number is None else number
                ids.append(keys[k])
                sets.append(maker(texts[k].as_py()))
                total += len(sets[-1])
                if total >= size:
                    yield from of(number, ids, sets)
                    ids, sets, total, number = [], [], 0, None
        if ids:
            yield from of(number, ids, sets)

    return arrow_map(docs.select(F.monotonically_increasing_id().alias("number"), "id", F.col("text").cast("binary").alias("text")), run, _PARTS, rows=32)


def _bundles(owner: np.ndarray, value: np.ndarray, count: np.ndarray, groups: int) -> Iterator[tuple]:
    """Rows of (set, shingle, sets of the shingle) for groups of sets."""
    group = (owner.view(np.uint64) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    begins, lengths = _runs(group[order])
    for at, n in zip(begins, lengths, strict=True):
        x = order[at : at + n]
        yield _OWNED, int(group[x[0]]), None, None, None, None, owner[x].tobytes(), count[x].astype("<u4").tobytes(), value[x].tobytes(), None


def _counted(exchange: DataFrame, shards: int, groups: int) -> DataFrame:
    """For every shingle of a shard the number of sets that hold it, sent to the sets that hold it where that is not one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        owners, values, blocks, counts, lists = [], [], [], [], []
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == _OWNED:
                    owners.append(np.repeat(np.frombuffer(row["owners"], dtype=np.int64), np.frombuffer(row["counts"], dtype="<u4")))
                    values.append(_long(row["hashes"], row["to"]))
                elif row["kind"] == _MANY:
                    lists.append(_long(row["hashes"], row["to"]))
                    counts.append(np.frombuffer(row["counts"], dtype="<u4"))
                    blocks.append(np.full(len(lists[-1]), row["block"]))
                elif row["kind"] == _SIZE:
                    names = np.frombuffer(row["owners"], dtype=np.int64)
                    group = (names.view(np.uint64) % np.uint64(groups)).astype(np.int64)
                    for g in np.unique(group):
                        yield _SIZE, int(g), None, None, None, None, names[group == g].tobytes(), np.frombuffer(row["counts"], dtype="<u4")[group == g].tobytes(), None, None
                else:
                    yield row["kind"], row["block"], *(row[c] for c in _PARTS.names[2:])
        none = np.empty(0, dtype=np.int64)
        owner, value = np.concatenate([none, *owners]), np.concatenate([none.view(np.uint64), *values])
        listed, held, block = np.concatenate([none.view(np.uint64), *lists]), np.concatenate([none, *counts]), np.concatenate([none, *blocks])
        del owners, values, lists, counts, blocks
        order = np.argsort(listed, kind="stable")
        begins, lengths = _runs(listed[order])
        known = listed[order][begins]  # shingles that a block holds several times
        several = np.add.reduceat(held[order], begins) if len(begins) else none
        order = np.argsort(value, kind="stable")
        owner, value = owner[order], value[order]
        begins, lengths = _runs(value)
        at = np.searchsorted(known, value[begins])
        also = np.zeros(len(begins), dtype=np.int64)
        found = (at < len(known)) & (known[np.minimum(at, max(0, len(known) - 1))] == value[begins]) if len(known) else np.zeros(len(begins), dtype=bool)
        also[found] = several[at[found]]
        open_ = (lengths > 1) | found
        x = _spread(begins[open_], lengths[open_])
        owner, value, run_ = owner[x], value[x], np.repeat(np.flatnonzero(open_), lengths[open_])
        order = np.lexsort((owner, run_))
        owner, value, run_ = owner[order], value[order], run_[order]
        own = np.concatenate([[True], (run_[1:] != run_[:-1]) | (owner[1:] != owner[:-1])]) if len(run_) else np.empty(0, dtype=bool)
        owner, value, run_ = owner[own], value[own], run_[own]  # copies in several blocks are one set
        total = np.bincount(run_, minlength=len(begins)) + also
        shared = total[run_] > 1
        yield from _bundles(owner[shared], value[shared], total[run_][shared], groups)
        if len(known):  # the blocks know whose these are
            extra = np.zeros(len(known), dtype=np.int64)
            extra[at[found]] = total[found] - also[found]
            of = np.searchsorted(known, listed)
            order = np.argsort(block, kind="stable")
            starts, lengths = _runs(block[order])
            for s, n in zip(starts, lengths, strict=True):
                y = order[s : s + n]
                yield _MANY, int(block[y[0]]), int(block[y[0]]), None, None, None, None, (several + extra)[of[y]].astype("<u4").tobytes(), listed[y].tobytes(), None

    return arrow_map(exchange.repartitionById(shards, F.col("to").cast("int")), run, _PARTS, rows=16)


def _answered(replies: DataFrame, groups: int, most: int = 4_000_000) -> DataFrame:
    """The shingles that blocks hold several times, sent to their sets with their counts; sets that several blocks of a task hold once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple[np.ndarray, ...]] = []
        names = lengths = values = owns = None
        at = None

        def out() -> Iterator[tuple]:
            if held:
                owner, value, count = (np.concatenate(c) for c in zip(*held, strict=True))
                order = np.lexsort((value, owner))
                owner, value, count = owner[order], value[order], count[order]
                own = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
                yield from _bundles(owner[own], value[own], count[own], groups)
                held.clear()

        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == _LOCAL:  # comes first of its block
                    at = row["block"]
                    names, lengths = np.frombuffer(row["owners"], dtype=np.int64), np.frombuffer(row["counts"], dtype="<u4").astype(np.int64)
                    values, owns = np.frombuffer(row["hashes"], dtype=np.uint64), np.frombuffer(row["extra"], dtype="<u4")
                    begins = np.cumsum(lengths) - lengths
                    continue
                assert row["block"] == at
                got = np.frombuffer(row["hashes"], dtype=np.uint64)
                places = np.searchsorted(values, got)
                x = _spread(begins[places], lengths[places])
                held.append((names[owns[x]], np.repeat(got, lengths[places]), np.repeat(np.frombuffer(row["counts"], dtype="<u4"), lengths[places])))
                if sum(len(x[0]) for x in held) > most:
                    yield from out()
        yield from out()

    rows = replies.where(F.col("kind").isin(_LOCAL, _MANY)).repartition("block").sortWithinPartitions("block", F.col("kind").desc())
    return arrow_map(rows, run, _PARTS, rows=16)


_CONTACT = T.StructType([T.StructField("owner", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("rarest", T.ArrayType(T.LongType()))])


def _contacts(bundles: DataFrame, percent: int, groups: int) -> DataFrame:
    """The sets that may have a partner: owner, n, the shingles that other sets hold too, and the rarest of them, of which two partners share one."""

    def compact(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        owner, value, count = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((value, owner))
        owner, value, count = owner[order], value[order], count[order]
        own = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]) if len(owner) else np.empty(0, dtype=bool)
        return owner[own], value[own], count[own]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        held, sizes, total, kept = [], {}, 0, 1_000_000
        for b in batches:
            for row in b.to_pylist():
                names, counts = np.frombuffer(row["owners"], dtype=np.int64), np.frombuffer(row["counts"], dtype="<u4").astype(np.int64)
                if row["kind"] == _SIZE:
                    sizes.update(zip(names.tolist(), counts.tolist(), strict=True))
                else:
                    held.append((names, np.frombuffer(row["hashes"], dtype=np.uint64), counts))
                    total += len(names)
                    if total > 2 * kept:  # copies in other blocks repeat what is held
                        held = [compact(held)]
                        total = len(held[0][0])
                        kept = max(kept, total)
        if not held:
            return
        owner, value, count = compact(held)
        begins, lengths = _runs(owner)
        for at, s in zip(begins.tolist(), lengths.tolist(), strict=True):
            name = int(owner[at])
            n = sizes[name]
            least = -(-percent * n // 100)
            if s >= least:
                values = value[at : at + s]
                rare = np.lexsort((values, count[at : at + s]))[: s - least + 1]
                yield name, n, values.tobytes(), values[rare].view(np.int64)

    return arrow_map(bundles.repartitionById(groups, F.col("to").cast("int")), run, _CONTACT, rows=512)


class Cell:
    """Sets that are joined in one task: pivots, Voronoi cells with windows, recursively; exact.

    ``label`` holds a number for each set; sets of one number are one component already. ``ask`` says which sets are at
    home here: pairs of two guests are met in other cells.
    """

    leaf, pivots = 256, 4

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], label: np.ndarray, ask: np.ndarray, percent: int):
        self.n, self.percent, self.ask = sizes.astype(np.int64), percent, ask
        self.lengths = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        self.begins = np.cumsum(self.lengths) - self.lengths
        names, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(names), dtype=bool)
        self.label = np.unique(label, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []
        self.reach = 1 - percent / 100 + 1e-9

    def common(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Shingles that set ``i`` shares with each of ``rows``."""
        own = self.codes[self.begins[i] : self.begins[i] + self.lengths[i]]
        self.mark[own] = True
        hit = self.mark[self.codes[_spread(self.begins[rows], self.lengths[rows])]]
        self.mark[own] = False
        sums = np.concatenate([[0], np.cumsum(hit)])
        ends = np.cumsum(self.lengths[rows])
        return sums[ends] - sums[ends - self.lengths[rows]]

    def meet(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Distances of set ``i`` to ``rows``, having linked what is linked."""
        common = self.common(i, rows)
        union = self.n[i] + self.n[rows] - common
        for j in rows[100 * common >= self.percent * union]:
            x, y = self.label[i], self.label[j]
            if x != y:
                self.label[self.label == y] = x
                self.links.append((i, int(j)))
        return 1 - common / union

    def join(self) -> list[tuple[int, int]]:
        """Pairs that make the sets' components what links make them."""
        todo = [(np.arange(len(self.n)), self.ask)]
        while todo:
            rows, home = todo.pop()
            if len(rows) < 2 or not home.any() or (self.label[rows] == self.label[rows[0]]).all():
                continue
            at = np.flatnonzero(home)
            chosen = at[np.linspace(0, len(at) - 1, min(self.pivots, len(at))).astype(np.int64)]
            to = np.stack([self.meet(int(rows[p]), rows) for p in chosen])
            if len(rows) <= self.leaf:
                self.compare(rows, home, to)
                continue
            nearest, least = to.argmin(axis=0), to.min(axis=0)
            for k in range(len(chosen)):
                inside = to[k] <= least + 2 * self.reach
                if inside.sum() > 0.7 * len(rows):
                    self.compare(rows[inside], (home & (nearest == k))[inside], to[:, inside])
                else:
                    todo.append((rows[inside], (home & (nearest == k))[inside]))
        return self.links

    def compare(self, rows: np.ndarray, home: np.ndarray, to: np.ndarray) -> None:
        """Every set at home with those of other components that the pivots leave possible."""
        least, most = self.n[rows] * self.percent, self.n[rows] * 100
        for k in np.flatnonzero(home):
            i = int(rows[k])
            other = np.flatnonzero(self.label[rows] != self.label[i])
            if len(other):
                other = other[(least[other] <= most[k]) & (least[k] <= most[other])]
                other = other[(np.abs(to[:, other] - to[:, k : k + 1]) <= self.reach).all(axis=0)]
                other = other[~home[other] | (other > k)]
                if len(other):
                    self.meet(i, rows[other])


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _joined(cells: DataFrame, percent: int, tile: list[str]) -> DataFrame:
    """Links (a, b) of small cells, each whole in a task: columns of ``tile``, owner, n, hashes, label, ask."""

    def of(rows: list[tuple]) -> Iterator[tuple]:
        owner, n, hashes, label, ask = zip(*rows, strict=True)
        cell = Cell(np.array(n), [np.frombuffer(x, dtype=np.uint64) for x in hashes], np.array(label), np.array(ask, dtype=bool), percent)
        for i, j in cell.join():
            yield owner[i], owner[j]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        at, held = None, []
        for b in slices(batches, 256):
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns, strict=True):
                if row[: len(tile)] != at and held:
                    yield from of(held)
                    held = []
                at = row[: len(tile)]
                held.append(row[len(tile) :])
        if held:
            yield from of(held)

    rows = cells.select(*tile, "owner", "n", "hashes", "label", "ask")
    return arrow_map(rows.repartition(*tile).sortWithinPartitions(*tile, "owner"), run, _LINK)


_SPLIT = T.StructType(
    [T.StructField("cell", T.LongType()), T.StructField("owner", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("ask", T.BooleanType()), T.StructField("pivots", T.ArrayType(T.LongType())), T.StructField("distances", T.ArrayType(T.DoubleType()))]
)


def _measured(big: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Each set's distances to the pivots of its cell."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices(batches, 256):
            for cell, owner, n, hashes, ask, near in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.frombuffer(hashes, dtype=np.uint64)
                far = []
                for p in near:
                    common = len(np.intersect1d(own, np.frombuffer(p["hashes"], dtype=np.uint64), assume_unique=True))
                    far.append(1 - common / (n + p["n"] - common))
                yield cell, owner, n, hashes, ask, [p["owner"] for p in near], far

    rows = big.select("cell", "owner", "n", "hashes", "ask").join(pivots, "cell").select("cell", "owner", "n", "hashes", "ask", "near")
    return arrow_map(rows, run, _SPLIT, rows=512)


def _links(contacts: DataFrame, percent: int, most: int, most_shingles: int, pivots: int) -> DataFrame:
    """Links (a, b) that make the components of all sets what all links make them."""
    session = contacts.sparkSession
    rare = contacts.select("owner", F.explode("rarest").alias("s"))
    lists = rare.groupBy("s").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low <> high").select("s", "low")
    touching = rare.join(lists, "s").where("owner <> low").select(F.col("owner").alias("a"), F.col("low").alias("b")).distinct()
    region = components(touching)
    cells = cut(contacts.join(region.withColumnRenamed("key", "owner"), "owner").select(F.col("component").alias("cell"), "owner", "n", "hashes", F.lit(True).alias("ask")), "regions")
    found: list[DataFrame] = []
    reach = 1 - percent / 100 + 1e-9
    label = None
    while True:
        named = cells.withColumn("label", F.col("owner")) if label is None else cells.join(label.select(F.col("key").alias("owner"), F.col("component").alias("of")), "owner", "left").withColumn("label", F.coalesce("of", "owner")).drop("of")
        sizes = named.groupBy("cell").agg(F.count("*").alias("rows"), F.sum(F.octet_length("hashes") / 8).alias("shingles"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.col("ask").cast("int")).alias("home"))
        sizes = sizes.where("low <> high and home > 0").select("cell", "rows", F.greatest(F.col("rows") / most, F.col("shingles") / most_shingles).alias("fill"))
        sizes = cut(sizes, "sizes")  # cells of one component are done
        small = named.join(sizes.where(F.col("fill") <= 1), "cell")
        found.append(cut(_joined(small, percent, ["cell"]), "links"))
        large = sizes.where(F.col("fill") > 1)
        if large.isEmpty():
            break
        big = cut(named.join(large, "cell"), "large")
        uncut(cells)
        order = Window.partitionBy("cell").orderBy(F.xxhash64("owner"), "owner")
        chosen = big.where("ask").withColumn("place", F.row_number().over(order)).where(F.col("place") <= pivots)
        near = chosen.groupBy("cell").agg(F.collect_list(F.struct("owner", "n", "hashes")).alias("near"))
        measured = cut(_measured(big, near, percent), "measured")
        pairs = measured.select("owner", "n", F.explode(F.arrays_zip("pivots", "distances")).alias("x")).where(F.col("x.distances") <= reach)
        found.append(cut(pairs.where(F.col("owner") != F.col("x.pivots")).select(F.col("owner").alias("a"), F.col("x.pivots").alias("b")).distinct(), "links"))
        label = _labels(found)
        # cells of the pivots; where they hold most of the cell again, its sets are dealt to pairs of blocks instead
        placed = measured.withColumn("least", F.array_min("distances")).withColumn("nearest", (F.array_position("distances", F.col("least")) - 1).cast("int"))
        to = F.filter(F.transform("pivots", lambda p, i: F.struct(p.alias("pivot"), i.alias("place"), (F.get("distances", i) <= F.col("least") + 2 * reach).alias("in"))), lambda x: x["in"])
        spread = placed.withColumn("to", F.explode(to))
        guests = spread.groupBy("cell", F.col("to.pivot").alias("pivot")).agg(F.count("*").alias("rows"))
        stuck = guests.join(sizes.withColumnRenamed("rows", "all"), "cell").groupBy("cell").agg((F.max(F.col("rows") / F.col("all")) > 0.7).alias("stuck"))
        stuck = cut(stuck, "stuck")
        labelled = measured.join(label.select(F.col("key").alias("owner"), F.col("component").alias("of")), "owner", "left").withColumn("label", F.coalesce("of", "owner"))
        tiles = _tiles(labelled.join(stuck.where("stuck"), "cell").join(sizes, "cell"))
        found.append(cut(_joined(tiles, percent, ["cell", "low", "high"]), "links"))
        halves = spread.join(stuck.where("not stuck"), "cell")
        cells = cut(halves.select(F.xxhash64("cell", "to.pivot").alias("cell"), "owner", "n", "hashes", (F.col("ask") & (F.col("nearest") == F.col("to.place"))).alias("ask")), "cells")
        label = _labels(found)
        uncut(big, measured, stuck, sizes)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return cut(out, "all-links") if len(found) > 1 else out


def _labels(found: list[DataFrame]) -> DataFrame:
    links = found[0]
    for x in found[1:]:
        links = links.union(x)
    return components(links)


def _tiles(cells: DataFrame) -> DataFrame:
    """Every set of a cell to the pairs of blocks that its block is in; cells of one component by now, and sets of it alone, are left out by the join."""
    open_ = cells.groupBy("cell").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("cell")
    blocks = F.ceil(2 * F.col("fill")).cast("int")
    own = F.pmod(F.xxhash64("owner"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("low"), F.greatest(k, F.col("own")).alias("high")))
    dealt = cells.join(open_, "cell").withColumn("blocks", blocks).withColumn("own", own).withColumn("at", F.explode(met))
    # of a pair of blocks the first asks; both sets of a pair of guests of the cell are met elsewhere
    return dealt.select("cell", "at.low", "at.high", "owner", "n", "hashes", "label", "ask")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, block: int = 1_000_000, most: int = 2_048, most_shingles: int = 4_000_000, pivots: int = 8) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    ``block`` shingles of texts are one entry of the exchange; regions of over ``most`` sets or ``most_shingles`` are split
    by ``pivots``, and cells that they do not split are compared in pairs of blocks, which hold half as much each.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(14, max(4, (size // 24_000_000).bit_length()))  # shards of some four million shingles
    groups = 2 << bits
    replies = cut(_counted(_exchange(plain, width, bits, block), 1 << bits, groups), "counted")
    bundles = replies.where(F.col("kind").isin(_OWNED, _SIZE)).union(_answered(replies, groups))
    contacts = cut(_contacts(bundles, percent, groups), "contacts")
    labels = components(_links(contacts, percent, most, most_shingles, pivots))
    rows = replies.where(F.col("kind") == _ROW).select("id", "owner", "n")
    sets = rows.where(F.col("owner").isNotNull()).groupBy("owner").agg(F.min("id").alias("low"))
    named = sets.join(labels.withColumnRenamed("key", "owner"), "owner", "left").withColumn("component", F.coalesce("component", "owner"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.select("owner", "component").join(least, "component").select("owner", "component_id")
    found = rows.join(of, "owner", "left")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("owner").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def join_sql(percent: int = 80, width: int = 5) -> str:
    """The same by brute force in DuckDB's SQL over ``documents``: all pairs that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i+{width - 1}], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
grams AS (SELECT doc_id, unnest(g) AS s FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= {percent} * (len(x.g) + len(y.g) - n)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ l ON l.a = r.other)
SELECT doc_id, len(any_value(g))::BIGINT AS n_shingles, min(other) AS component_id FROM reach JOIN sets USING (doc_id) GROUP BY doc_id"""
