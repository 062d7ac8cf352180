"""Near-duplicates and containment against brute force."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlpit.llm import components as comp
from marlpit.llm import containment, probminhash
from marlpit.llm.common import words
from marlpit.llm.shingles import Shingler


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(docs, least=0.8):
    sets = [grams(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            same = docs[i][1] is not None and docs[i][1] == docs[j][1]
            if same or (sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return {d: (min(g), len(g)) for g in groups.values() for d in g}


def test_shingles_are_those_of_the_text():
    one, at = Shingler()(["a b c d e f", "A, b!", None, "", "b a", "x a b c d e"])
    assert list(np.diff(at)) == [2, 1, 0, 0, 1, 2]
    assert one[0] == one[at[6] - 1] and one[2] != one[3]


def test_registers_agree_with_probability_jaccard():
    rng = random.Random(1)
    base = [f"w{rng.randrange(400)}" for _ in range(600)]
    other = [w if rng.random() > 0.03 else "q" + w for w in base] + base[:120]
    sh = Shingler()(([" ".join(base), " ".join(other)]))
    text, element, weight = probminhash.weighted(*sh)
    got = probminhash.sketch(text, element, weight, 2, 4096)
    split = [(element[text == i], weight[text == i]) for i in (0, 1)]
    plain, exact = probminhash.similarities(*split)
    slow = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {**x, **y}) for x, y in [tuple(dict(zip(a.tolist(), b.tolist())) for a, b in split)] for i in x if i in y)
    assert exact == pytest.approx(slow)
    assert (got[0] == got[1]).mean() == pytest.approx(exact, abs=4 * (exact * (1 - exact) / 4096) ** 0.5)
    assert plain == pytest.approx(len(grams(" ".join(base)) & grams(" ".join(other))) / len(grams(" ".join(base)) | grams(" ".join(other))))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=40), st.lists(st.sampled_from("abcde"), min_size=1, max_size=40))
def test_similarity_properties(a, b):
    text, element, weight = probminhash.weighted(*Shingler()([" ".join(a), " ".join(b), " ".join(a)]))
    part = [(element[text == i], weight[text == i]) for i in range(3)]
    assert probminhash.similarities(part[0], part[1]) == pytest.approx(probminhash.similarities(part[1], part[0]))
    assert probminhash.similarities(part[0], part[2]) == pytest.approx((1, 1))


def _near_copies(seed, groups=6, size=12):
    rng = random.Random(seed)
    docs = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 20))):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(copy)))
    return docs


def test_classes_equal_brute_force(spark):
    docs = _near_copies(3) + [(1000 + i, f"alone {i} x y z w") for i in range(5)]
    docs += [(2000 + i, docs[0][1]) for i in range(4)]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in probminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


_OPEN = "bucket long, band int, key long, component long, size long, prints binary, largest long, rest long"


def _pairs(tiles):
    found = [(min(p), max(p)) for r in tiles.collect() for p in zip(r["a"], r["b"], strict=True)]
    assert len(found) == len(set(found))
    return set(found)


def test_blocks_of_a_large_bucket_lose_no_pair(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 65536, 240).astype("<u2")
    rows = []
    for k in range(60):
        p = base.copy()
        p[rng.random(240) < 0.1] = k
        rows.append((7, 0, k, k // 20, 60, p.tobytes(), 2, 40))
    df = spark.createDataFrame(rows, _OPEN)
    pairs = lambda *block: _pairs(probminhash._likely(df, 0.8, 240, 3.0, 6, block))
    mats = [np.frombuffer(r[5], dtype="<u2") for r in rows]
    first = lambda i, j: (mats[i] == mats[j]).reshape(40, 6).all(axis=1)
    enough = 240 * (0.8 - 3 * (0.16 / 240) ** 0.5)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if i // 20 != j // 20 and (mats[i] == mats[j]).sum() >= enough and first(i, j)[0]}
    assert pairs(512, 8192) == pairs(16, 16) == pairs(1, 7) == want


def _repeated(name, distinct, repeated, times):
    """A text of ``distinct`` shingles, and one in which a line of it comes ``times`` times more."""
    text = [f"{name}x{i}" for i in range(distinct + 4)]
    return " ".join(text), " ".join(text + text[40 : 40 + repeated] * times)


def test_lines_repeated_in_one_copy_only(spark):
    docs, weighted = [], []
    for k in range(16):
        one, other = _repeated(f"a{k}", 100, 20, 1000)
        docs += [(2 * k, one), (2 * k + 1, other)]
        text, element, weight = probminhash.weighted(*Shingler()([one, other]))
        plain, jp = probminhash.similarities(*[(element[text == i], weight[text == i]) for i in (0, 1)])
        assert plain > 0.9
        weighted.append(jp)
    assert max(weighted) < 0.6
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in probminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs) == {i: (i - i % 2, 2) for i in range(32)}


def test_pairs_near_by_equal_weights_pass_the_prefilter(spark):
    found = 0
    for k in range(12):
        rows = []
        for key, (buckets, prints) in enumerate(probminhash.Sketcher(40, 6, 5)(list(_repeated(f"b{k}", 200, 30, 50)))):
            rows += [(b, place % 40, key, key, 2, prints) for place, b in enumerate(buckets) if b is not None]
        shared = {r[0] for r in rows if r[2] == 0} & {r[0] for r in rows if r[2] == 1}
        df = spark.createDataFrame([(*r, 1, 1) for r in rows if r[0] in shared], _OPEN)
        found += _pairs(probminhash._likely(df, 0.8, 240, 3.0, 6)) == {(0, 1)}
    assert found == 12


def test_near_edges(spark):
    docs = [(1, None), (2, None), (3, ""), (4, ""), (5, "..."), (6, "one"), (7, "One!"), (None, "one"), (8, "w " * 60_000), (8, "w " * 60_000), (9, "w " * 59_999)]
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in docs], "doc_id long, text string, key int, bucket int")
    got = [(r["doc_id"], r["class_id"], r["class_size"]) for r in probminhash.classes(df).collect()]
    by = {d: (c, n) for d, c, n in got}
    assert len(got) == len(docs)
    assert by[1] == (1, 1) and by[2] == (2, 1) and by[3] == by[4] == (3, 2) and by[5] == (5, 1)
    assert by[6] == by[7] == by[None] == (6, 3) and by[8] == by[9] == (8, 3)
    kept = probminhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "5", "6", "8"]
    assert probminhash.classes(df.limit(0)).count() == 0 and probminhash.keep_first(df.limit(0)).count() == 0


def test_pairs_of_tiles_are_verified_exactly(spark):
    docs = _near_copies(11, groups=3, size=10)
    texts = spark.createDataFrame(docs, "key long, text string")
    ids = range(len(docs))
    lists = lambda rows: tuple(map(list, zip(*[(a, b, a, b) for a, b in rows])))
    every = [(a, b) for a in ids for b in ids if a < b]
    tiles = spark.createDataFrame([(k, 0, 0, *lists(every[k::1])) for k in range(1)], "bucket long, low long, high long, a array<long>, b array<long>, x array<long>, y array<long>")
    got = probminhash._linking(tiles, texts, 0.8, 5)
    near = {(a, b) for a, b in every if len(grams(docs[a][1]) & grams(docs[b][1])) >= 0.8 * len(grams(docs[a][1]) | grams(docs[b][1]))}
    links = {tuple(r) for r in got.collect()}
    assert links <= near and len(links) < len(near)
    joined = {r["key"]: r["component"] for r in comp.components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    want = brute_classes(docs)
    assert all(joined.get(i, i) == want[i][0] for i in ids)


def test_columns_named_like_internal_ones(spark):
    names = ["doc_id", "_key", "_id", "text", "c0", "_kept_key", "key"]
    df = spark.createDataFrame([(i, "k", i, "the same text of a few words", 1, "x", None) for i in (3, 1, 2)] + [(4, "k", 1, None, 1, "x", None)], "doc_id int, _key string, _id int, text string, c0 int, _kept_key string, key string")
    kept = probminhash.keep_first(df)
    assert kept.columns == names and kept.dtypes == df.dtypes and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_a_repeated_passage_lowers_only_the_weighted_similarity(spark):
    """Texts that differ by how often a passage stands in them: no pair is lost (plain 0.85, weighted 0.5)."""
    rng = random.Random(8)
    docs = []
    for k in range(40):
        text = [f"t{k}w{rng.randrange(10**6)}" for _ in range(200)]
        passage = [f"p{k}w{i}" for i in range(30)]
        docs += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text + passage * 200))]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in probminhash.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["key"]: r["component"] for r in comp.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert comp.components(links.limit(0)).count() == 0


def test_containment_equals_sql(spark, tiny):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    want = {(a, b): (s, n) for a, b, s, n, _ in c.execute(containment.find_sql()).fetchall()}
    docs, items = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    for size in (8 << 20, 2000):  # one block of items, and several
        got = {(r["doc_id"], r["item_id"]): (r["shared"], r["item_shingles"]) for r in containment.find(docs, items, block_bytes=size).collect()}
        assert got == want


def test_planted_passages_are_found():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 9, 14, 30, 60, 200, 700])]
    finder = containment.Finder(items)
    texts, want = [], set()
    for i, (_, t) in enumerate(items):
        for at in (0, 17, 5000):
            own = t.split()
            if len(own) > 60:
                own[len(own) // 2] = "changed"
            doc = [word() for _ in range(at)] + own + [word() for _ in range(50 if len(own) >= 5 else 0)]
            if len(own) >= 5 or at == 0:
                want.add((len(texts), i))
            texts.append(" ".join(doc))
    assert {(d, i) for d, i, _ in finder.find(texts)} == want


def test_containment_edges(spark):
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (4, "x y"), (None, "q r s t u"), (5, "k " * 300)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "z a b c d e f z", 1), (None, "A b, c d e f", 1), (2, None, 1), (3, "", 1), (4, "x Y", 1), (5, "x y z", 1), (6, "q r s t u", 1), (7, "k k k k k k", 1)], "doc_id long, text string, shared int")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in containment.find(docs, items).collect())
    assert got == [("1", "1"), ("4", "4"), ("6", "None"), ("7", "5"), ("None", "1")]
    kept = containment.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]
    assert containment.find(docs.limit(0), items).count() == 0 and containment.find(docs, items.limit(0)).count() == 0


def test_containment_in_a_very_long_text_and_repeated_rows(spark):
    rng = random.Random(9)
    item = " ".join(f"i{k}" for k in range(40))
    filler = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, f"{filler} {item} {filler}"), (2, filler), (3, item), (3, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["shared"]) for r in containment.find(docs, items).collect())
    assert got == [(1, 7, 36)] * 2 + [(3, 7, 36)] * 4  # each pair of rows for itself
    assert [r["doc_id"] for r in containment.drop_contaminated(docs, items).collect()] == [2]
