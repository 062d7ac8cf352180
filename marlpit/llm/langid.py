"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read whole, lower-cased, as UTF-8 bytes, one GRU from each side; both states at a byte together give that
byte's probability of every language, so every position is labelled, white space and digits too, and a word's labels
depend on the words beside it. A document's probability of a language is the mean over all its bytes.

A text stands between ``CONTEXT`` spaces and is read in pieces of ``PIECE`` bytes side by side; each direction starts
``CONTEXT`` bytes before its piece with a zero state. Labels so depend on the text alone, and differ from those of one
pass over the whole text by what a state keeps beyond ``CONTEXT`` bytes.

The network is trained in numpy by backpropagation through time on windows of a bounded sample of labelled documents
(about ``sample_docs`` of them in all, spread evenly over the languages, and ``sample_chars`` characters of each). One
more output, learned from windows whose letters are shuffled or random, stands for no language at all: it is never
predicted, but lowers the score of what reads like none. The weights, some 50 kB, are sent to the executors.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a null id is carried; repeated rows are
labelled each for itself; of equally probable languages the alphabetically first is taken; other columns are dropped by
``identify`` and kept by ``keep_identified``; an empty table gives an empty result. With no labelled row there is no
network: ``identify`` says ``und`` of every text, ``keep_identified`` keeps every text with a letter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, map_batches, slices

UNKNOWN = "und"
PIECE, CONTEXT = 384, 64
_LATIN = re.compile(r"[a-zA-Z]")
_GATES = "zrn"


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Network:
    """Parameters: for either direction input table i (256, 3h), recurrent u (h, 3h), bias b; output w (2h, outputs), c.

    The outputs are the languages and, last, none of them.
    """

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["i" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.p["b" + d] = np.zeros(3 * hidden, dtype=np.float32)
        self.p["w"] = rng.normal(0, 0.3, (2 * hidden, len(languages) + 1)).astype(np.float32)
        self.p["c"] = np.zeros(len(languages) + 1, dtype=np.float32)

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """States (steps, rows, h) of one direction over bytes (steps, rows); what backpropagation needs, if kept."""
        h, u = self.hidden, self.p["u" + d]
        table = self.p["i" + d] + self.p["b" + d]
        state = np.zeros((x.shape[1], h), dtype=table.dtype)
        states, kept = [], []
        for step in x:
            g = table[step]
            rec = state @ u
            gates = _sigmoid(g[:, : 2 * h] + rec[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(g[:, 2 * h :] + r * rec[:, 2 * h :])
            if keep:
                kept.append((state, z, r, n, rec[:, 2 * h :]))
            state = n + z * (state - n)
            states.append(state)
        return np.stack(states), kept

    def whole(self, data: bytes) -> np.ndarray:
        """The outputs' probabilities at every byte, from one pass over the whole text in either direction."""
        x = np.frombuffer(b" " * CONTEXT + data + b" " * CONTEXT, dtype=np.uint8)[:, None]
        end = CONTEXT + len(data)
        both = np.concatenate([self.states(x, "f")[0], self.states(x[::-1], "b")[0][::-1]], axis=2)
        return _softmax(both[CONTEXT:end, 0] @ self.p["w"] + self.p["c"])

    def gradients(self, x: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions; x (rows, steps), target (rows, outputs)."""
        h, x = self.hidden, x.T
        forward, kept_f = self.states(x, "f", True)
        backward, kept_b = self.states(x[::-1], "b", True)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        p = _softmax(both @ self.p["w"] + self.p["c"])
        delta = ((p - target) / x.size).astype(p.dtype)
        grads = {"w": np.tensordot(both, delta, ([0, 1], [0, 1])), "c": delta.sum(axis=(0, 1))}
        back = delta @ self.p["w"].T
        for d, steps, kept, into in (("f", x, kept_f, back[:, :, :h]), ("b", x[::-1], kept_b, back[::-1][:, :, h:])):
            u = self.p["u" + d]
            g_u = np.zeros_like(u)
            carry = np.zeros((x.shape[1], h), dtype=u.dtype)
            pres = np.empty((len(steps), x.shape[1], 3 * h), dtype=u.dtype)
            for t in range(len(steps) - 1, -1, -1):
                state, z, r, n, rec = kept[t]
                ds = carry + into[t]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (state - n) * z * (1 - z)
                dr = dn * rec * r * (1 - r)
                pres[t] = np.concatenate([dz, dr, dn], axis=1)
                through = np.concatenate([dz, dr, dn * r], axis=1)
                g_u += state.T @ through
                carry = ds * z + through @ u.T
            flat = pres.reshape(-1, 3 * h)
            order = np.argsort(steps, axis=None, kind="stable")
            values, starts = np.unique(steps.reshape(-1)[order], return_index=True)
            g_i = np.zeros_like(self.p["i" + d])
            g_i[values] = np.add.reduceat(flat[order], starts, axis=0)
            grads |= {"u" + d: g_u, "i" + d: g_i, "b" + d: flat.sum(axis=0)}
        return grads

    def train(self, texts: list[tuple[bytes, int]], batches: int = 400, rows: int = 128, width: int = 96, rate: float = 0.012, noise: float = 0.12, seed: int = 3) -> None:
        """Adam on windows of ``width`` bytes at random places of texts (bytes, language) of languages drawn evenly.

        In a share ``noise`` of the windows letters are shuffled or random; they belong to no language.
        """
        rng = np.random.default_rng(seed)
        of: dict[int, list[bytes]] = defaultdict(list)
        for data, k in texts:
            of[k].append(data)
        kinds = sorted(of)
        ends = {k: np.cumsum([len(x) for x in of[k]]) for k in kinds}
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        target = np.eye(len(self.languages) + 1, dtype=np.float32)
        for step in range(1, batches + 1):
            x = np.full((rows, width), 32, dtype=np.uint8)
            label = rng.choice(kinds, rows)
            for i, k in enumerate(label.tolist()):
                at = int(rng.integers(ends[k][-1]))
                t = int(np.searchsorted(ends[k], at, "right"))
                at -= int(ends[k][t]) - len(of[k][t]) + int(rng.integers(width // 2))  # some begin before the text
                own = np.frombuffer(of[k][t][max(0, at) : max(0, at + width)], dtype=np.uint8)
                x[i, max(0, -at) : max(0, -at) + len(own)] = own
            for i in np.flatnonzero(rng.random(rows) < noise).tolist():
                label[i] = len(self.languages)
                letters = x[i] > 63  # digits, marks and white space stay
                x[i, letters] = rng.permutation(x[i, letters]) if rng.random() < 0.5 else rng.integers(97, 123, int(letters.sum()))
            grads = self.gradients(x, target[label])
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = rate * (1 - step / (batches + 1)) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                self.p[k] = (self.p[k] - move).astype(np.float32)


class Identifier:
    """Labels every byte of texts with a trained network."""

    def __init__(self, network: Network | None, rows: int = 1024):
        self.network = network
        if network is None:
            return
        h, self.outputs = network.hidden, len(network.languages) + 1
        # what a batch holds of outputs is bounded also with very many languages
        self.rows = max(16, min(rows, (1 << 25) // ((PIECE + 2 * CONTEXT) * self.outputs)))
        self.tables, self.recurrent, self.out = {}, {}, {}
        for n, d in enumerate("fb"):
            table = network.p["i" + d] + network.p["b" + d]
            for k, gate in enumerate(_GATES):
                half = 1.0 if gate == "n" else 0.5  # a logistic gate is (1 + tanh(x / 2)) / 2
                self.tables[d + gate] = np.ascontiguousarray(table[:, k * h : (k + 1) * h] * np.float32(half))
                self.recurrent[d + gate] = np.ascontiguousarray(network.p["u" + d][:, k * h : (k + 1) * h] * np.float32(half))
            self.out[d] = np.ascontiguousarray(network.p["w"][n * h : (n + 1) * h])

    def _sweep(self, x: np.ndarray, d: str, starts: np.ndarray, logits: np.ndarray, step_of: int) -> None:
        """Add one direction's share of the logits: x (steps, rows), row i begins at step starts[i] (ascending)."""
        rows, h = x.shape[1], self.network.hidden
        z, r, n, rec, state = (np.zeros((rows, h), dtype=np.float32) for _ in range(5))
        part = np.empty((rows, self.outputs), dtype=np.float32)
        (tz, tr, tn), (uz, ur, un) = ([of[d + g] for g in _GATES] for of in (self.tables, self.recurrent))
        begun = int(np.searchsorted(starts, 0, "right"))
        for s in range(len(x)):
            if begun < rows and starts[begun] == s:
                upto = int(np.searchsorted(starts, s, "right"))
                state[begun:upto] = 0
                begun = upto
            step = x[s]
            for gate, table, u in ((z, tz, uz), (r, tr, ur)):
                np.take(table, step, axis=0, out=gate, mode="clip")
                np.matmul(state, u, out=rec)
                np.add(gate, rec, out=gate)
                np.tanh(gate, out=gate)
                np.multiply(gate, 0.5, out=gate)
                np.add(gate, 0.5, out=gate)
            np.matmul(state, un, out=rec)
            np.multiply(rec, r, out=rec)
            np.take(tn, step, axis=0, out=n, mode="clip")
            np.add(n, rec, out=n)
            np.tanh(n, out=n)
            np.subtract(state, n, out=state)
            np.multiply(state, z, out=state)
            np.add(state, n, out=state)
            if s >= CONTEXT:
                np.matmul(state, self.out[d], out=part)
                logits[(s - CONTEXT) if step_of > 0 else len(x) - 1 - s] += part

    def _batch(self, stream: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Logits (steps, rows, outputs) of pieces of descending lengths that begin at these places of the stream."""
        width = int(lengths[0])
        logits = np.empty((width, len(at), self.outputs), dtype=np.float32)
        logits[:] = self.network.p["c"]
        steps = np.arange(width + CONTEXT)[:, None]
        none = np.zeros(len(at), dtype=np.int64)
        last = len(stream) - 1
        self._sweep(stream[np.minimum(at - CONTEXT + steps, last)], "f", none, logits, 1)
        back = at + width + CONTEXT - 1 - steps  # shorter pieces begin later
        self._sweep(stream[np.minimum(back, last)], "b", width - lengths, logits, -1)
        return logits

    def _pieces(self, data: list[bytes]):
        """(text, start, logits) of runs of pieces of all texts; a piece's logits beyond its length mean nothing."""
        gap = b" " * CONTEXT
        stream = np.frombuffer(gap + gap.join(data) + gap, dtype=np.uint8).astype(np.intp)
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        begins = CONTEXT + np.cumsum(sizes + CONTEXT) - (sizes + CONTEXT)
        counts = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(data)), counts)
        start = PIECE * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
        length = np.minimum(PIECE, sizes[text] - start)
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(order), self.rows):
            own = order[a : a + self.rows]
            yield text[own], start[own], length[own], self._batch(stream, begins[text[own]] + start[own], length[own])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Language, mean probability of it, and the number of positions whose own label it is."""
        out: list[tuple[str, float, int]] = [(UNKNOWN, 0.0, 0)] * len(texts)
        there = [i for i, t in enumerate(texts) if has_letter(t)]
        if self.network is None or not there:
            return out
        data = [texts[i].lower().encode("utf-8", "surrogatepass") for i in there]
        total = np.zeros((len(there), self.outputs))
        hits = np.zeros((len(there), self.outputs), dtype=np.int64)
        for text, _, length, logits in self._pieces(data):
            best = logits[:, :, 0].copy()
            for k in range(1, self.outputs):
                np.maximum(best, logits[:, :, k], out=best)
            valid = np.arange(len(logits))[:, None] < length
            p = np.subtract(logits, best[:, :, None], out=logits)
            top = p == 0
            np.exp(p, out=p)
            scale = valid / np.matmul(p, np.ones(self.outputs, dtype=np.float32))
            np.add.at(total, text, np.einsum("trk,tr->rk", p, scale))
            np.add.at(hits, text, np.einsum("trk,tr->rk", top, valid, dtype=np.int64, casting="unsafe"))
        mean = total / np.array([len(x) for x in data])[:, None]
        named = mean[:, :-1].argmax(axis=1)
        for i, k, m, n in zip(there, named.tolist(), mean, hits, strict=True):
            out[i] = (self.network.languages[k], float(min(1.0, m[k])), int(n[k]))
        return out

    def positions(self, text: str) -> list[str]:
        """The label of every byte of the lower-cased text; ``und`` where it reads like no language."""
        data = text.lower().encode("utf-8", "surrogatepass")
        names = np.array([*(self.network.languages if self.network else []), UNKNOWN], dtype=object)
        label = np.full(len(data), len(names) - 1)
        if self.network is not None and data:
            for _, start, length, logits in self._pieces([data]):
                for s, n, own in zip(start.tolist(), length.tolist(), logits.argmax(axis=2).T, strict=True):
                    label[s : s + n] = own[:n]
        return names[label].tolist()


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 4_000, sample_chars: int = 2_500, most_languages: int = 10_000, hidden: int = 12, batches: int = 400) -> Network | None:
    """A network from a bounded sample: distinct texts whose hashes are low, about ``sample_docs`` in all and as many of each
    language, but at least its text of least hash. Of a longer text ``sample_chars`` characters are taken, from a place
    that its hash tells.

    More than ``most_languages`` different labels are an error.
    """
    own = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    hashed = own.withColumn("h", F.xxhash64("text", "lang"))
    known = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).limit(most_languages + 1).collect()
    if len(known) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not known:
        return None
    each = max(1, sample_docs // len(known))
    limits = own.sparkSession.createDataFrame([(r["lang"], min(1.0, each / max(1, r["n"])), r["least"]) for r in known], "lang string, share double, least long")
    low = F.pmod("h", F.lit(1 << 30)) < F.col("share") * float(1 << 30)
    chosen = hashed.join(F.broadcast(limits), "lang").where(low | (F.col("h") == F.col("least")))
    spare = F.greatest(F.length("text") - sample_chars, F.lit(0))
    part = F.substr("text", 1 + F.pmod(F.shiftrightunsigned("h", 8), spare + 1).cast("int"), F.lit(sample_chars))
    # one row for each hash: copies of a text meet only as parts of it, and combine before they are sent
    rows = chosen.select("lang", "h", part.alias("part")).groupBy("lang", "h").agg(F.min("part").alias("part")).collect()
    languages = sorted({r["lang"] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    texts = [(r["part"].lower().encode("utf-8", "surrogatepass"), number[r["lang"]]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"])) if has_letter(r["part"])]
    if not texts:
        return None
    network = Network(languages, hidden)
    network.train(texts, batches)
    return network


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, and the number of byte positions that lang_pred labels, of every row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("positions", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        label = Identifier(network)
        for b in slices(batches):
            for i, (lang, score, positions) in zip(b.column(0).to_pylist(), label(b.column(1).to_pylist()), strict=True):
                yield i, lang, score, positions

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


def keep_identified(docs: DataFrame, network: Network | None, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """``docs`` with all columns, without rows that are ``und`` or whose score is below ``least``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Identifier(network)
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            kept = [has_letter(t) for t in texts] if network is None else [lang != UNKNOWN and score >= least for lang, score, _ in label(texts)]
            yield b.filter(pa.array(kept, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))
