"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A document's tokens beyond whole windows go, best fit, into the
open window that they leave fullest. When no window has room, the fullest is emitted: as it is when at most
``slack`` positions are free, or else topped up with the head of the piece. The windows still open at the end of the
partitions are merged in groups of ``merge_fan`` partitions.

Defined results: a null text is an empty one and has the end token only; a null id is carried; repeated rows are packed
each for itself; ties between windows go to the one opened first; other input columns are dropped; an empty table gives
no pieces. Memory is bounded by the open windows and one slice of rows; a very long text is cut into whole windows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship
from .common import arrow_map, remembers, slices

#: Characters whose handling by the tokenizer's normaliser and splitter is reproduced here; other texts go through it whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0370-\u03a2\u03a4-\u052f\u2010-\u2027\u20ac]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# How a tokenizer must normalise and split for its words to be encoded one by one.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Most words, and pieces of words, that a Python worker remembers.
_MEMO, _PIECE_MEMO = 500_000, 500_000

_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class WordTokens:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Where a tokenizer of words with an end mark normalises and splits as is known here, no token spans white space, and
    the ids of each word are remembered. New words are split into the tokenizer's pieces, and new pieces encoded
    together; a piece ends at a token that closes a word. Texts go through any other tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        suffix = own["model"].get("end_of_word_suffix")
        splits = [x.get("pattern", {}).get("Regex") for x in (own["pre_tokenizer"] or {}).get("pretokenizers", [])]
        special = all(x["content"].startswith("<|") for x in own["added_tokens"])
        self.by_word = bool(suffix) and own["normalizer"] == _NORMALIZER and splits == [_SPLITTER, None] and special
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if self.by_word:
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        split = {w: _PIECES.findall(w) for w in words}
        if len(self.pieces) > _PIECE_MEMO:
            self.pieces.clear()
        new = list({p for ps in split.values() for p in ps}.difference(self.pieces))
        runs = [new[i : i + 2000] for i in range(0, len(new), 2000)]
        for run, ids in zip(runs, self._encode([" ".join(r) for r in runs]), strict=True):
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            data, start = ids.tobytes(), 0
            for piece, end in zip(run, ends.tolist(), strict=True):
                self.pieces[piece] = data[start:end]
                start = end
        self.words.update((w, b"".join(map(self.pieces.__getitem__, ps))) for w, ps in split.items())

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        known = self.words.get
        found: list[list[bytes | None]] = []
        missing: list[tuple[list[bytes | None], list[str]]] = []
        new: set[str] = set()
        for text in texts:
            if not text:
                found.append([])
            elif not self.by_word or "<|" in text or _PLAIN.fullmatch(text) is None:
                found.append([self._encode([text])[0].tobytes()])
            else:
                words = unicodedata.normalize("NFC", text).lower().split()
                ids = list(map(known, words))
                found.append(ids)
                if None in ids:
                    unknown = [w for w, x in zip(words, ids, strict=True) if x is None]
                    missing.append((ids, unknown))
                    new.update(unknown)
        self._learn(new)
        for ids, unknown in missing:
            at = 0
            for w in unknown:
                at = ids.index(None, at)
                ids[at] = self.words[w]
        if len(self.words) > _MEMO:
            self.words.clear()
        yield from map(b"".join, found)


@cache
def _word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


remembers(__name__, _word_tokens.cache_clear)


class _Windows:
    """Open windows of one partition; pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, count: int, slack: int, first_id: int):
        self.size, self.count, self.slack, self.next_id = size, count, slack, first_id
        self.open: list[list] = []  # [tokens held, pieces]

    def emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        at, sequence = 0, self.next_id
        self.next_id += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, sequence, at, ids
            at += n

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, width, start = len(ids) // 4, self.size, 0
        while total - start >= width:
            yield from self.emit([(doc, start, ids[4 * start : 4 * (start + width)], total)])
            start += width
        if start < total:
            yield from self.place(doc, start, ids[4 * start :], total)

    def place(self, doc, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        n = len(ids) // 4
        fitting = [w for w in self.open if w[0] + n <= self.size]
        if not fitting and len(self.open) >= self.count:
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            free = self.size - fullest[0]
            if free > self.slack:
                fullest[1].append((doc, start, ids[: 4 * free], total))
                start, ids, n = start + free, ids[4 * free :], n - free
            yield from self.emit(fullest[1])
            fitting = [w for w in self.open if w[0] + n <= self.size]
        if fitting:
            best = max(fitting, key=lambda w: w[0])
        else:
            self.open.append(best := [0, []])
        best[0] += n
        best[1].append((doc, start, ids, total))
        if best[0] == self.size:
            self.open.remove(best)
            yield from self.emit(best[1])


def _merge(windows: list[list[tuple]], size: int, slack: int, first_id: int) -> Iterator[tuple]:
    """Emit nearly full windows as they are, cut the others' pieces into whole ones, and the rest by powers of two."""
    out = _Windows(size, 1, slack, first_id)
    held = lambda pieces: sum(len(p[2]) // 4 for p in pieces)
    rest: list[tuple] = []
    for pieces in windows:
        if held(pieces) >= size - slack:
            yield from out.emit(pieces)
        else:
            rest += pieces
    left = held(rest)
    sizes = [size] * (left // size) + [1 << b for b in reversed(range(size.bit_length())) if left % size >> b & 1]
    at = 0
    for want in sizes:
        taken = []
        while want:
            doc, start, ids, total = rest[at]
            n = min(want, len(ids) // 4)
            taken.append((doc, start, ids[: 4 * n], total))
            want -= n
            if 4 * n == len(ids):
                at += 1
            else:
                rest[at] = (doc, start + n, ids[4 * n :], total)
        yield from out.emit(taken)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, open_windows: int = 64, slack: int = 32, end_id: int | None = 2, merge_fan: int = 8, keep_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most ``window`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian
    unsigned 32-bit) when ``keep_ids``. ``tokenizer`` is the path of a tokenizer file that each executor can read.
    Pieces of the first pass are written to the shared folder before the open windows are merged, so that a lost
    executor cannot give the two passes different pieces.
    """

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        tokens = _word_tokens(tokenizer)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        windows = _Windows(window, open_windows, slack, part << 32)
        for b in slices(batches, 256):
            texts = b.column(1).to_pylist()
            for doc, ids in zip(b.column(0).to_pylist(), tokens(texts), strict=True):
                for row in windows.add(doc, ids + end):
                    yield row if keep_ids else (*row[:-1], None)
        for k, (_, pieces) in enumerate(windows.open):
            for at, (doc, start, ids, total) in enumerate(pieces):
                yield doc, start, len(ids) // 4, -1, total, -1 - (part << 16 | k), at, ids

    def second(key, rows):
        windows: dict[int, list[tuple]] = {}
        rows = rows.sort_by([("sequence_id", "descending"), ("offset", "ascending")])
        for r in zip(*(rows.column(c).to_pylist() for c in ("sequence_id", "doc_id", "start", "ids", "doc_tokens")), strict=True):
            windows.setdefault(r[0], []).append(r[1:])
        merged = list(_merge(list(windows.values()), window, slack, 1 << 62 | key[0].as_py() << 32))
        columns = list(zip(*merged, strict=True)) or [[]] * 8
        if not keep_ids:
            columns[7] = [None] * len(columns[7])
        return pa.table({f.name: pa.array(c, type=t) for f, c, t in zip(_SCHEMA, columns, [pa.int64()] * 7 + [pa.binary()], strict=True)})

    ship(docs.sparkSession)
    placed = cut(arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), first, _SCHEMA), "packed")
    closed, opened = placed.where("sequence_id >= 0"), placed.where("sequence_id < 0")
    merged = opened.groupBy(_fan(F.col("sequence_id"), merge_fan).alias("part")).applyInArrow(second, _SCHEMA)
    out = closed.unionByName(merged)
    return out if keep_ids else out.drop("ids")


def _fan(sequence: Column, fan: int) -> Column:
    """The merge group of an open window: its partition, which its provisional id holds, over ``fan``."""
    return F.floor(F.shiftright(-1 - sequence, 16) / fan).cast("long")
