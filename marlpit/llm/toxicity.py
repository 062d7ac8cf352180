"""Toxicity by a convolutional text classifier.

A word's vector is the sum of two hashed embeddings, of the word and of its first letters, so a word that training
lacked has the vector of its buckets. Filters of several widths run over the whole text, each filter's greatest
activation is kept, and a logistic layer gives the probability. Everything starts from random weights and is trained in
numpy on a bounded sample of labelled rows; words are left out at random, so that each word gets its turn as a text's
greatest. A threshold is calibrated for each language on rows of the sample held back from training, the language being
told from the words themselves (naive Bayes over the same hashed words, in a table of bounded size; languages of few
sampled rows are one, with the common threshold); scores are shifted so that the language's
threshold lies at ``cut_off``.

In prediction the filters' products with every word vector are computed once, so a text costs gathers and sums.

Defined results: a null, empty or wordless text has the score of a text of zero vectors; a null id is carried; repeated
rows are scored each for itself; of equally likely languages the alphabetically first sets the threshold; other
columns are dropped by ``scores`` and kept by ``keep_clean``; an empty table gives an empty result; with no label of
one of the two values all scores are 0. Texts are scored whole, a very long one in one pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fitting, map_batches, slices, words

WIDTHS = (1, 2, 3)
#: A sample is read so often at least, a smaller one until there were ``STEPS`` steps, but ``MOST_EPOCHS`` times at most.
EPOCHS, STEPS, MOST_EPOCHS = 8, 800, 30
_MEMO = 120_000
#: Languages of fewer sampled rows are one, which has the common threshold; and numbers in a table of words by languages.
_OWN, _CELLS = 20, 1 << 22
_RUN = 1 << 17


def _hash(word: str, kind: int) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8, salt=bytes([kind])).digest(), "little")


def _tails(starts: np.ndarray) -> np.ndarray:
    """The last rows of each text's gap, whose windows would reach into the next text."""
    return (starts[1:, None] - np.arange(1, max(WIDTHS))).ravel()


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of a table's rows, repeats counted; of many, no more are held than there are different ones."""
    if len(rows) * table.shape[1] <= _CELLS:
        return table[rows].sum(axis=0)
    rows, times = np.unique(rows, return_counts=True)
    step = max(1, _CELLS // table.shape[1])
    return sum(times[a : a + step].astype(np.float32) @ table[rows[a : a + step]] for a in range(0, len(rows), step))


class Classifier:
    """Word table, convolution and calibration."""

    def __init__(self, buckets: int = 1 << 18, size: int = 16, filters: int = 8, beginning: int = 4, cut_off: float = 0.3, seed: int = 9):
        self.buckets, self.size, self.filters, self.beginning, self.cut_off = buckets, size, filters, beginning, cut_off
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (buckets + 1, size)).astype(np.float32)
        self.table[-1] = 0  # of no word
        self.conv = {w: rng.normal(0, 1 / np.sqrt(w * size), (w * size, filters)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(filters, dtype=np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.3, len(WIDTHS) * filters).astype(np.float32)
        self.c = np.float32(0)
        self.languages: list[str] = []
        self.folds = buckets
        self.language_rows = np.zeros((buckets + 1, 0), dtype=np.float32)
        self.prior = np.zeros(0)
        self.cuts: dict[str, float] = {}

    def features(self, word: str) -> tuple[int, int]:
        """The buckets of the word and of its beginning."""
        return _hash(word, 0) % self.buckets, _hash(word[: self.beginning], 1) % self.buckets

    # -- training ----------------------------------------------------------
    def train(self, texts: list[str], labels: np.ndarray, langs: list[str | None], epochs: int | None = None, rate: float = 0.01, table_rate: float = 0.1, left_out: float = 0.3, seed: int = 2) -> None:
        known: dict[str, tuple[int, int]] = {}
        ids = []
        for text in texts:
            if len(known) > 100_000:
                known.clear()
            ws = words(text)
            known.update((w, self.features(w)) for w in set(ws).difference(known))
            ids.append(np.array([known[w] for w in ws], dtype=np.int32).reshape(-1, 2))
        del known
        rng = np.random.default_rng(seed)
        self._fit_languages(ids, langs)
        held = rng.random(len(ids)) < 0.2
        self._descend([ids[i] for i in np.flatnonzero(~held)], labels[~held], epochs, rate, table_rate, left_out, rng)
        self._calibrate([ids[i] for i in np.flatnonzero(held)], labels[held], [ids[i] for i in np.flatnonzero(~held)], labels[~held])

    def _fit_languages(self, ids: list[np.ndarray], langs: list[str | None]) -> None:
        """What words tell of languages: a table of ``_CELLS`` numbers at most, into whose rows the words' buckets are folded where
        languages are many."""
        rows = Counter(x for x in langs if x is not None)
        few = any(n < _OWN or not x for x, n in rows.items())
        self.languages = sorted(x for x, n in rows.items() if n >= _OWN and x) + [""] * few
        place = {x: k for k, x in enumerate(self.languages)}
        self.folds = max(1, min(self.buckets, _CELLS // max(1, len(self.languages)) - 1))
        counts = np.full((self.folds + 1, len(self.languages)), 0.2)
        totals = np.ones(len(self.languages))
        for own, lang in zip(ids, langs, strict=True):
            if lang is not None:
                k = place.get(lang, len(place) - 1)
                totals[k] += 1
                np.add.at(counts[:, k], self.folded(own[:, 0]), 1)
        self.language_rows = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        self.language_rows -= self.language_rows.mean(axis=1, keepdims=True) if self.languages else 0
        self.language_rows[counts.sum(axis=1) < 0.2 * len(self.languages) + 0.5] = 0  # words never seen say nothing
        self.prior = np.log(totals / totals.sum())

    def folded(self, buckets: np.ndarray) -> np.ndarray:
        """Rows of the words' buckets in the table of languages; its last is of no word."""
        return np.where(buckets == self.buckets, self.folds, buckets % self.folds)

    def _pooled(self, vectors: np.ndarray, starts: np.ndarray):
        """Greatest activation of every filter in each text, and the position it is at; vectors hold a gap after each text."""
        best, where = [], []
        for w in WIDTHS:
            windows = np.concatenate([vectors[k : len(vectors) - max(WIDTHS) + 1 + k] for k in range(w)], axis=1)
            act = windows @ self.conv[w]
            act[_tails(starts)] = -np.inf
            top = np.maximum.reduceat(act, starts, axis=0)
            owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(act))))
            hit_row, hit_col = np.nonzero(act == top[owner])
            place = np.zeros(top.shape, dtype=np.int64)
            place[owner[hit_row], hit_col] = hit_row
            best.append(top)
            where.append(place)
        return best, where

    def _spread(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' rows one after another, each followed by zero vectors; and where each begins."""
        gap = np.full((max(WIDTHS), 2), self.buckets)
        joined = np.concatenate([x for own in ids for x in (own, gap)])
        sizes = np.array([len(x) + max(WIDTHS) for x in ids])
        return joined, np.cumsum(sizes) - sizes

    def _forward(self, ids: list[np.ndarray]):
        joined, starts = self._spread(ids)
        vectors = self.table[joined[:, 0]] + self.table[joined[:, 1]]
        vectors = np.concatenate([vectors, np.zeros((max(WIDTHS), self.size), dtype=np.float32)])
        best, where = self._pooled(vectors, starts)
        hidden = np.concatenate([np.tanh(b + self.bias[w]) for b, w in zip(best, WIDTHS, strict=True)], axis=1)
        return joined, vectors, where, hidden, _sigmoid(hidden @ self.out + self.c)

    def _descend(self, ids: list[np.ndarray], labels: np.ndarray, epochs: int | None, rate: float, table_rate: float, left_out: float, rng: np.random.Generator) -> None:
        """Adam on the filters and the output, steps scaled by past gradients on the words' rows."""
        if not len(ids):
            return
        square = np.zeros_like(self.table)
        state: dict = {}

        def adam(key, value, grad, t, slower):
            m, v = state.get(key, (np.zeros_like(value), np.zeros_like(value)))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            state[key] = m, v
            return (value - slower * rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

        heavy = np.where(labels == 1, (labels == 0).sum() / max(1, (labels == 1).sum()), 1.0) ** 0.5
        batch = max(8, min(64, len(ids) // 40))
        once = -(-len(ids) // batch)
        epochs = min(MOST_EPOCHS, max(EPOCHS, -(-STEPS // once))) if epochs is None else epochs
        steps, t = epochs * once, 0
        for _ in range(epochs):
            order = rng.permutation(len(ids))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                t += 1
                slower = 1 - 0.9 * t / steps
                seen = [np.where((rng.random(len(ids[i])) < left_out)[:, None], self.buckets, ids[i]) for i in rows]
                joined, vectors, where, hidden, p = self._forward(seen)
                delta = ((p - labels[rows]) * heavy[rows] / len(rows)).astype(np.float32)
                g_hidden = delta[:, None] * self.out[None, :] * (1 - hidden**2)
                out, c = hidden.T @ delta, delta.sum()
                touched, pushed = [], []
                for n, w in enumerate(WIDTHS):
                    g = g_hidden[:, n * self.filters : (n + 1) * self.filters]
                    at = where[n]
                    conv = np.empty_like(self.conv[w])
                    for k in range(w):
                        block = slice(k * self.size, (k + 1) * self.size)
                        conv[block] = np.einsum("bf,bfs->sf", g, vectors[at + k])
                        spread = (g[:, :, None] * self.conv[w][block].T[None]).reshape(-1, self.size)
                        touched.append(joined[np.minimum(at + k, len(joined) - 1).ravel()])
                        pushed.append(spread)
                    self.conv[w] = adam(("w", w), self.conv[w], conv, t, slower)
                    self.bias[w] = adam(("b", w), self.bias[w], g.sum(axis=0), t, slower)
                self.out = adam("out", self.out, out, t, slower)
                self.c = adam("c", np.asarray(self.c), np.asarray(c), t, slower)
                both, grad = np.concatenate(touched), np.concatenate(pushed)
                rows_, back = np.unique(both.ravel(), return_inverse=True)
                total = np.zeros((len(rows_), self.size), dtype=np.float32)
                np.add.at(total, back.reshape(-1), np.repeat(grad, 2, axis=0))
                rows_, total = rows_[rows_ < self.buckets], total[rows_ < self.buckets]
                square[rows_] += total**2
                self.table[rows_] -= slower * table_rate * total / (np.sqrt(square[rows_]) + 1e-6)

    def _predict(self, ids: list[np.ndarray]) -> tuple[np.ndarray, list[str]]:
        p, langs = [], []
        for a in range(0, len(ids), 64):
            p.append(self._forward(ids[a : a + 64])[-1])
            for own in ids[a : a + 64]:
                langs.append(self._language(_summed(self.language_rows, self.folded(own[:, 0]))))
        return np.concatenate(p) if p else np.zeros(0), langs

    def _language(self, evidence: np.ndarray) -> str:
        return self.languages[int(np.argmax(evidence + self.prior))] if self.languages else ""

    def _calibrate(self, ids, labels, more_ids, more_labels) -> None:
        """The threshold of each language: the middle of the probabilities between which most rows are told right."""
        p, langs = self._predict(ids)
        if len(np.unique(labels)) < 2:
            p, langs = self._predict([*ids, *more_ids])
            labels = np.concatenate([labels, more_labels])
        langs_of = np.array(langs)
        for lang in ["", *self.languages]:
            own = langs_of == lang if lang else np.ones(len(p), dtype=bool)
            if lang and (labels[own].sum() < 10 or (labels[own] == 0).sum() < 10):
                continue
            q, y = p[own], labels[own]
            if not len(q):
                continue
            order = np.argsort(q, kind="stable")
            q, y = q[order], y[order]
            wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[(y == 0).sum()], (y == 0).sum() - np.cumsum(y == 0)])
            least = np.flatnonzero(wrong == wrong.min())
            edges = np.concatenate([[1e-4], q, [1 - 1e-4]])
            logit = np.log(np.clip(edges, 1e-6, 1 - 1e-6) / (1 - np.clip(edges, 1e-6, 1 - 1e-6)))
            widest = least[int(np.argmax(logit[least + 1] - logit[least]))]
            self.cuts[lang] = float((logit[widest] + logit[widest + 1]) / 2)

    def shifted(self, logit: np.ndarray, langs: list[str]) -> np.ndarray:
        cut = np.array([self.cuts.get(x, self.cuts.get("", 0.0)) for x in langs])
        return _sigmoid(logit - cut + np.log(self.cut_off / (1 - self.cut_off)))


class Scorer:
    """Scores whole texts, remembering the combined row of every word."""

    def __init__(self, classifier: Classifier | None):
        self.c = c = classifier
        self.row_of: dict[str, int] = {}
        if c is None:
            return
        # row 0 is of no word; room for more is made in steps, so that nothing of this size is copied often
        self.rows = 1
        self.products = np.zeros((1 << 15, sum(WIDTHS) * c.filters), dtype=np.float32)
        self.fold = np.full(1 << 15, c.folds, dtype=np.int32)
        self.weights = np.concatenate([c.conv[w][k * c.size : (k + 1) * c.size] for w in WIDTHS for k in range(w)], axis=1)

    def _learn(self, new: list[str]) -> None:
        c, end = self.c, self.rows + len(new)
        if end > len(self.products):
            more = max(end - len(self.products), 1 << 15)
            self.products = np.concatenate([self.products, np.zeros((more, self.products.shape[1]), dtype=np.float32)])
            self.fold = np.concatenate([self.fold, np.full(more, c.folds, dtype=np.int32)])
        self.row_of.update(zip(new, range(self.rows, end), strict=True))
        at = np.array([c.features(w) for w in new], dtype=np.int64).reshape(-1, 2)
        self.products[self.rows : end] = (c.table[at[:, 0]] + c.table[at[:, 1]]) @ self.weights
        self.fold[self.rows : end] = c.folded(at[:, 0])
        self.rows = end

    def __call__(self, texts: list[str | None]) -> list[float]:
        c = self.c
        if c is None:
            return [0.0] * len(texts)
        split = [words(t) for t in texts]
        if len(self.row_of) > _MEMO:
            self.row_of.clear()
            self.rows = 1
        if new := list(set(chain.from_iterable(split)).difference(self.row_of)):
            self._learn(new)
        scores: list[float] = []
        a = 0
        while a < len(split):
            b, held = a + 1, len(split[a])
            while b < len(split) and held + len(split[b]) <= _RUN:
                held += len(split[b])
                b += 1
            scores += self._run(split[a:b])
            a = b
        return scores

    def _run(self, split: list[list[str]]) -> list[float]:
        c, gap = self.c, max(WIDTHS)
        sizes = np.array([len(x) + gap for x in split])
        starts = np.cumsum(sizes) - sizes
        at = np.zeros(int(sizes.sum()) + gap, dtype=np.int64)
        total = int(sizes.sum()) - gap * len(split)
        inside = np.repeat(starts - np.cumsum(sizes - gap) + (sizes - gap), sizes - gap) + np.arange(total)
        at[inside] = np.fromiter(map(self.row_of.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=total)
        hidden, block, n = [], 0, int(sizes.sum())
        for w in WIDTHS:
            act = self.products[at[:n], block * c.filters : (block + 1) * c.filters]
            for k in range(1, w):
                act = act + self.products[at[k : n + k], (block + k) * c.filters : (block + k + 1) * c.filters]
            block += w
            act[_tails(starts)] = -np.inf
            hidden.append(np.tanh(np.maximum.reduceat(act, starts, axis=0) + c.bias[w]))
        logit = np.concatenate(hidden, axis=1) @ c.out + c.c
        rows = self.fold[at[:n]]
        if n * len(c.languages) <= _CELLS:
            evidence = np.add.reduceat(c.language_rows[rows], starts, axis=0)
        else:
            evidence = [_summed(c.language_rows, x) for x in np.split(rows, starts[1:])]
        return c.shifted(logit, [c._language(x) for x in evidence]).tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", sample_docs: int = 6000, sample_bytes: int = 20 << 20, cut_off: float = 0.3) -> Classifier | None:
    """A classifier from a bounded sample: of each label the rows with the least hashes of their ids, whole texts within the bytes.

    Each label gets up to half of the rows and bytes, and at least one row; texts that do not fit are passed over. Ids are chosen from ``labels`` alone, four times as many as rows
    are wanted, in case some have no document, and broadcast; so no text is shuffled but those of the sample. Of
    documents with one id the least text counts, and an id with both labels counts as toxic.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").isNotNull())
    chosen: dict[int, int] = {}
    for y in (0, 1):
        ids = [r["id"] for r in marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(2 * sample_docs).select("id").collect()]
        wanted = F.broadcast(spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, k int"))
        sizes = own.join(wanted, "id").groupBy("k", "id").agg(F.max(F.octet_length("text")).alias("n")).orderBy("k").collect()
        for i in fitting([r["n"] for r in sizes], sample_bytes // 2, sample_docs // 2, sample_bytes // 32):
            chosen[sizes[i]["id"]] = y
    if len(set(chosen.values())) < 2:
        return None
    wanted = F.broadcast(spark.createDataFrame(sorted(chosen), "long").toDF("id"))
    rows = own.join(wanted, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("lang").alias("lang")).collect()
    rows.sort(key=lambda r: r["id"])
    classifier = Classifier(cut_off=cut_off)
    classifier.train([r["text"] for r in rows], np.array([chosen[r["id"]] for r in rows]), [r["lang"] for r in rows])
    return classifier


def scores(docs: DataFrame, classifier: Classifier | None, id_col: str = "doc_id", text_col: str = "text", cut_off: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        score = Scorer(classifier)
        for b in slices(batches, 256):
            for i, s in zip(b.column(0).to_pylist(), score(b.column(1).to_pylist()), strict=True):
                yield i, s, int(s >= cut_off)

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


def keep_clean(docs: DataFrame, classifier: Classifier | None, text_col: str = "text", cut_off: float = 0.3) -> DataFrame:
    """``docs`` with all columns, without the rows whose score reaches ``cut_off``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(classifier)
        for b in slices(batches, 256):
            yield b.filter(pa.array([s < cut_off for s in score(b.column(at).to_pylist())], pa.bool_()))

    return map_batches(docs, run, docs.schema)
