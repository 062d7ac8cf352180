"""The metric-space join against all pairs."""

import random
import re

import numpy as np
import pytest

from marlpit.llm.jaccardjoin import Cell, join

SCHEMA = "doc_id long, text string, cell int, label string"


def plain_sets(texts, width=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def components_of(sets, percent=80):
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                top[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def plain(docs, percent=80):
    sets = plain_sets([t for _, t in docs])
    of = components_of(sets, percent)
    least = {}
    for (i, _), c in zip(docs, of, strict=True):
        least[c] = min((x for x in (i, least.get(c)) if x is not None), default=None)
    return [(i, len(s), least[c]) for (i, _), s, c in zip(docs, sets, of, strict=True)]


def drifting(rng, n, families, length, passage):
    """Families of texts that drift apart word by word, so that links chain, some with a passage that all share."""
    words = [f"w{k}" for k in range(4000)]
    shared = [rng.choice(words) for _ in range(passage)]
    bases = [[rng.choice(words) for _ in range(length)] for _ in range(families)]
    docs = []
    for i in range(n):
        f = rng.randrange(families + 1)
        if f == families:
            text = [rng.choice(words) for _ in range(length // 3)] + shared
        else:
            text = list(bases[f])
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                text[rng.randrange(length)] = rng.choice(words)
            if rng.random() < 0.3:
                bases[f] = text
        docs.append((i, " ".join(text)))
    rng.shuffle(docs)
    return docs


def same(spark, docs, percent=80, **settings):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA).repartition(5)
    got = sorted(map(str, (tuple(r) for r in join(frame, percent=percent, **settings).collect())))
    want = sorted(map(str, plain(docs, percent)))
    assert got == want
    return {w.rsplit(",", 1)[1] for w in want}


@pytest.mark.parametrize("seed", [0])
def test_like_all_pairs(spark, seed):
    docs = drifting(random.Random(seed), 250, 6, 120, 60)
    parts = same(spark, docs, block=4_000)
    assert 6 < len(parts) < 200


@pytest.mark.parametrize(("percent", "length", "most"), [(80, 60, 12), (60, 40, 20)])
def test_regions_over_the_limit(spark, percent, length, most):
    docs = drifting(random.Random(7), 220, 3, length, length)
    limit = {"most": most} if percent == 80 else {"most_shingles": 40 * most}
    same(spark, docs, percent, block=2_000, pivots=3, **limit)


@pytest.mark.parametrize("seed", range(6))
def test_cells_like_all_pairs(seed, monkeypatch):
    monkeypatch.setattr(Cell, "leaf", 20)
    rng = random.Random(seed)
    sets = []
    for f in range(12):  # families that share a part, and drift
        base = set(rng.sample(range(f * 200, f * 200 + 400), rng.choice([10, 40, 100])))
        for _ in range(25):
            one = set(base)
            for x in rng.sample(sorted(one), min(len(one) - 1, rng.randrange(0, 8))):
                one.discard(x)
                one.add(rng.randrange(5000))
            sets.append(one)
            if rng.random() < 0.4:
                base = one
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    cell = Cell(np.array([len(s) for s in sets]), arrays, np.arange(len(sets)), np.ones(len(sets), dtype=bool), 80)
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in cell.join():
        common = len(sets[i] & sets[j])
        assert 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common)
        top[find(i)] = find(j)
    want = components_of(sets)
    groups = lambda of: sorted(sorted(i for i, y in enumerate(of) if y == x) for x in set(of))
    assert groups([find(i) for i in range(len(sets))]) == groups(want)


def test_exactly_at_the_threshold(spark):
    # 84 words have 80 shingles; 104 words that begin with them have 100
    words = [f"a{k}" for k in range(104)]
    docs = [(1, " ".join(words[:84])), (2, " ".join(words)), (3, " ".join(words + ["more"] * 1)), (4, "b " + " ".join(words[:83]))]
    same(spark, docs)


def test_nulls_empties_repeats_ties_and_clashing_names(spark):
    long = " ".join(f"x{k % 9973}" for k in range(60_000))
    docs = [(1, None), (2, ""), (3, " \t\n "), (4, "one TWO"), (5, "ONE two"), (5, "one two"), (None, "one two"), (None, "alone here"), (6, long), (7, long + " end"), (8, "two one"), (9, "a b c d e"), (10, "a b c d"), (11, "Ä b c d e"), (12, "ä b c d e"), (13, "a b c d e f")]
    same(spark, docs)


def test_many_copies_and_empty_tables(spark):
    docs = [(i, "the same words in every one of these texts, " + "again and again " * 3) for i in range(500)] + [(1000 + i, f"unlike {i} " * 6) for i in range(40)]
    same(spark, docs, block=100, most=5)
    assert join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_texts_and_partitions_do_not_matter(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    one = sorted(map(tuple, join(docs.coalesce(1)).collect()))
    assert one == sorted(map(tuple, join(docs.repartition(9), block=5_000, most=4, pivots=2).collect()))
    assert one == sorted(plain([(r.doc_id, r.text) for r in docs.collect()]))
