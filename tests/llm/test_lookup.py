"""Shard table, licence digests and nearest neighbours."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.llm import colhash, licences, shardtable


def slow_fill(names, slots):
    """Turn by turn, with every shard's whole permutation written out."""
    import hashlib

    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "little") % slots, int.from_bytes(d[8:16], "little") % (slots - 1) + 1
        orders.append([(offset + j * skip) % slots for j in range(slots)])
        assert sorted(orders[-1]) == list(range(slots))
    table = {}
    while len(table) < slots:
        for i, order in enumerate(orders):
            if len(table) < slots:
                table[next(s for s in order if s not in table)] = i
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 7), (3, 31), (7, 101)])
def test_table_equals_brute_force(n, slots):
    names = [f"s{i}" for i in range(n)]
    assert shardtable.fill(names, slots) == slow_fill(names, slots)


def test_table_is_even_and_steady():
    names = [f"s{i}" for i in range(20)]
    one, two = shardtable.fill(names, 65_537), shardtable.fill(names[:-1], 65_537)
    counts = np.bincount(one)
    assert counts.max() - counts.min() <= 1
    assert sum(a != b for a, b in zip(one, two, strict=True) if a != 19) < 0.15 * 65_537
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            shardtable.fill(bad, 7)
    with pytest.raises(ValueError):
        shardtable.fill(["a"], 8)


def test_place(spark, tmp_path):
    names = ["x", "y", "z"]
    df = spark.createDataFrame([(1, 9, "p"), (1, 8, "q"), (None, 7, "r"), (2, None, "s")], "k long, Slot int, v string")
    got = shardtable.place(df, "k", names, 101).collect()
    table = shardtable.fill(names, 101)
    assert len(got) == 4 and all(r["shard"] == table[r["slot"]] and r["shard_name"] == names[r["shard"]] for r in got)
    assert len({r["shard"] for r in got if r["k"] == 1}) == 1
    assert shardtable.place(df.limit(0), "k", names, 101).count() == 0
    assert "xxhash64" in shardtable.place(df, "k", names, 101)._jdf.queryExecution().executedPlan().toString()
    shardtable.write_shards(df, f"file://{tmp_path}/o", "k", names, 101)
    assert spark.read.parquet(f"file://{tmp_path}/o").count() == 4


def test_long_and_hot_keys(spark, tmp_path):
    long = "k" * 1_000_000
    df = spark.createDataFrame([(long if i % 3 == 0 else str(i), i, {"a": i}) for i in range(300)], "k string, v int, m map<string,int>")
    got = shardtable.place(df, "k", ["x", "y"], 101)
    assert len({r["shard"] for r in got.where(F.length("k") > 10).select("shard").collect()}) == 1 and got.count() == 300
    shardtable.write_shards(df, f"file://{tmp_path}/o", "k", ["x", "y"], 101)
    assert spark.read.parquet(f"file://{tmp_path}/o").select("v").distinct().count() == 300


def test_licences_in_long_and_repeated_texts(spark):
    mit = licences.KNOWN["MIT"][1]
    long = "word, " * 300_000
    df = spark.createDataFrame([(1, mit), (1, mit), (2, long), (3, mit + "\n" * 500_000 + " "), (4, mit.replace("\n", "\r\n"))], "doc_id long, text string")
    got = sorted((r["doc_id"], r["licence"] or "") for r in licences.scan(df).collect())
    assert got == [(1, "MIT"), (1, "MIT"), (2, ""), (3, "MIT"), (4, "MIT")]


def test_placement_query_equals_table(spark, tiny):
    from marlpit.llm.queries import queries

    names = [f"shard-{i:04d}" for i in range(256)]
    table = shardtable.fill(names)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    slots = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(65_537))).collect()}
    got = queries()["op5_shard_table"](spark, tiny).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == {d: table[s] for d, s in slots.items()}


def test_licences_in_other_dress(spark):
    mit = licences.KNOWN["MIT"][1]
    texts = [
        (1, mit),
        (2, "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace(" ", "   ").replace("SUBLICENSE", "SUBLICENCE")),
        (3, "// " + mit.replace("\n", "\n// ").replace('"', "”")),
        (4, mit + " And more."),
        (5, None),
        (6, ""),
        (None, licences.KNOWN["0BSD"][1]),
        (7, licences.KNOWN["BSD-3-Clause"][1].replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b in texts], "doc_id long, text string, licence string")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert [got[i]["licence"] for i in (1, 2, 3, 4, 5, 6, None, 7)] == ["MIT", "MIT", "MIT", None, None, None, "0BSD", "BSD-3-Clause"]
    assert got[5]["canonical_digest"] is None and got[6]["canonical_digest"] is not None
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    full = licences.full_texts()["GPL-3.0"][1]
    df = df.unionByName(spark.createDataFrame([(90, full, "x"), (91, "/* " + full.replace("\n", "\n * ") + " */", "x")], df.schema))
    got |= {r["doc_id"]: r for r in licences.scan(df.where("doc_id >= 90")).collect()}
    assert got[90]["licence"] == got[91]["licence"] == "GPL-3.0"
    c.executemany("INSERT INTO documents VALUES (?, ?)", [*texts, (90, full), (91, "/* " + full.replace("\n", "\n * ") + " */")])
    assert {tuple(r) for r in c.execute(licences.scan_sql()).fetchall()} == {(r["doc_id"], r["canonical_digest"], r["licence"]) for r in got.values()}
    assert licences.scan(df.limit(0)).count() == 0
    assert len(licences.known_digests()) == sum(1 + len(t) for t, _ in licences.KNOWN.values())


def test_full_licences_notices_without_years_and_bullets(spark):
    import textwrap

    full = licences.full_texts()
    mit, bsd = licences.KNOWN["MIT"][1], licences.KNOWN["BSD-3-Clause"][1]
    end = "END OF TERMS AND CONDITIONS"
    wrapped = mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS OR\nCOPYRIGHT HOLDERS")
    bulleted = bsd
    for i in "123":
        bulleted = bulleted.replace(f"\n{i}. ", "\n * " if i != "2" else "\n - ")
    cases = [
        *((x[1], name) for name, x in full.items()),
        (textwrap.fill(full["Apache-2.0"][1].split(end)[0] + end, 60), "Apache-2.0"),
        *((textwrap.indent(full[name][1].split(end)[0], " * ", lambda line: True), name) for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1")),
        (full["GPL-2.0"][1].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"), "GPL-2.0"),
        ("MIT License\n\nCopyright Jane Doe\n\n" + wrapped, "MIT"),
        ("Copyright The Foo Authors. All rights reserved.\n\n" + mit, "MIT"),
        ("Copyright The Foo Authors. All rights reserved.\n" + bulleted, "BSD-3-Clause"),
        (bsd.replace("1. R", "(a) R").replace("2. R", "(b) R").replace("3. N", "(c) N"), "BSD-3-Clause"),
        (full["GPL-3.0"][1] + "\nAnd one condition more.", None),
        (full["GPL-3.0"][1].replace("you may not", "you may", 1), None),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Licensed under the Apache License, Version 2.", None),
        ("1.", None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == [name for _, name in cases]
    own = {"Own": (("The own licence",), "Do what you like.\n1. Or not.")}
    asked = spark.createDataFrame([(1, "The Own Licence\nCopyright Me\n* Do what you like. * Or not."), (2, mit)], "doc_id long, text string")
    assert {r["doc_id"]: r["licence"] for r in licences.scan(asked, known=own).collect()} == {1: "Own", 2: None}


def brute(ids, vectors, query, k):
    score = (vectors * vectors[ids == query][0]).sum(axis=1)
    keep = ids != query
    order = np.lexsort((ids[keep], -score[keep]))[:k]
    return list(zip(ids[keep][order].tolist(), score[keep][order].tolist(), strict=True))


@pytest.mark.parametrize("kind", ["unit", "lengths", "copies"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 32)).astype(np.float32)
    if kind == "unit":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lengths":
        v *= rng.lognormal(0, 0.6, (3000, 1)).astype(np.float32)
    if kind == "copies":
        v[rng.random(3000) < 0.33] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in colhash.search(df, F.col("id") % 100 == 0, shard_rows=800).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ids, wide = np.arange(3000), v.astype(np.float64)
    hit = 0
    for q in range(0, 3000, 100):
        want = brute(ids, wide, q, 20)
        hit += len({i for i, _ in got[q]} & {i for i, _ in want})
        exact = {i: (wide[i] * wide[q]).sum() for i, _ in got[q]}
        assert all(s == exact[i] for i, s in got[q]) and [(-s, i) for i, s in got[q]] == sorted((-s, i) for i, s in got[q])
    assert hit / (30 * 20) >= 0.9
    if kind == "copies":
        assert [i for i, _ in got[0]] == [i for i, _ in brute(ids, wide, 0, 20)]


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (8, [1.0]), (None, [9.0, 9.0]), (9, [2.0, 5.0]), (9, [2.0, 5.0]), (40, None)]
    df = spark.createDataFrame([(a, b, 1) for a, b in data], "vec_id long, embedding array<float>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in colhash.search(df, F.col("id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 2.0), (20, 2, 9, 2.0)]
    assert colhash.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert colhash.search(df, F.col("id") < 0).count() == 0


def test_recall_over_many_shards(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((6000, 48)) + 2 * rng.standard_normal((12, 48))[rng.integers(0, 12, 6000)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    hit = total = 0
    for shard_rows in (300, 20_000):
        got = {}
        for r in colhash.search(df, F.col("id") % 20 == 0, shard_rows=shard_rows).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert set(got) == set(range(0, 6000, 20)) and all(len(x) == 20 for x in got.values())
        for q in range(0, 6000, 20):
            hit += len(got[q] & {i for i, _ in brute(np.arange(6000), v, q, 20)})
            total += 20
    assert hit / total >= 0.95


@pytest.mark.parametrize("size", [1e-300, 1e-310, 1e200])
def test_huge_and_tiny_components(spark, size):
    v = [[1.0, 0.5], [2.0, 1.0], [-1.0, 0.25], [4.0, -4.0], [0.5, 8.0]]
    df = spark.createDataFrame([(20 * i, [x * size for x in row] if i else row) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"]) for r in colhash.search(df, F.col("id") == 0).orderBy("rank").collect()]
    scores = {20 * i: sum(x * size * y for x, y in zip(v[i], v[0], strict=True)) for i in range(1, 5)}
    assert got == sorted(scores, key=lambda i: (-scores[i], i))


def test_of_one_id_with_two_vectors_the_least_counts(spark):
    df = spark.createDataFrame([(20, [1.0, 1.0]), (1, [3.0, 0.0]), (1, [2.0, 9.0]), (2, [4.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in colhash.search(df, F.col("id") == 20).orderBy("rank").collect()] == [(20, 1, 1, 11.0), (20, 2, 2, 4.0)]
