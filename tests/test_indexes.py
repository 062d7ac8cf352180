"""Indexes that skip what cannot be among the best, against plain search."""

import random

import numpy as np
import pytest

from marlpit.operators import blockmax, lexical, vector, vectorindex
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.select("request_id", "key", "rank", F.round(df.columns[2], 6)).collect())


def texts(rng, n, rare):
    out = []
    for i in range(n):
        words = ["the"] * rng.randrange(1, 5) + [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 20, 80, 200]))] + (["rare"] if i in rare else [])
        rng.shuffle(words)
        out.append((i, " ".join(words)))
    return out


def test_block_max_equals_plain_search(spark, tmp_path):
    rng = random.Random(4)
    docs = spark.createDataFrame([*texts(rng, 700, range(20)), (1000, None), (1001, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the rare"), (2, "the the w1 w2 w3"), (3, "nowhere"), (4, None), (5, " ".join(f"w{k}" for k in range(120))), (6, "the"), (7, "rare w5 rare")], "request_id long, query string")
    index = lexical.build(docs)
    for k in (1, 900):
        want = rows(lexical.search(index, asked, k))
        built = blockmax.build(index, documents=16)
        assert rows(blockmax.search(built, asked, k)) == want
        built.write(f"file://{tmp_path}/blocks{k}")
        assert rows(blockmax.search(blockmax.BlockIndex.read(spark, f"file://{tmp_path}/blocks{k}"), asked, k)) == want
    empty = blockmax.build(lexical.build(docs.limit(0)))
    assert blockmax.search(empty, asked).count() == 0


def test_frequent_terms_read_few_blocks(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame(texts(rng, 3_000, range(0, 3_000, 150)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the rare")], "request_id long, query string")
    index = lexical.build(docs)
    built = blockmax.build(index, documents=32)
    _, left, scored = blockmax.plan(built, asked, 12)
    holding = built.tops.where("term = 'the'").count()
    assert holding > 90 and left.count() + blockmax.FIRST < holding / 3
    assert rows(blockmax.search(built, asked, 12)) == rows(lexical.search(index, asked, 12))
    assert scored.count() > 0


def test_a_search_does_not_read_other_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"t{k}x{j}" for j in range(20))) for k in range(400)], "doc_id long, text string")
    blockmax.build(lexical.build(docs)).write(f"file://{tmp_path}/b")
    stored = blockmax.BlockIndex.read(spark, f"file://{tmp_path}/b")
    asked = spark.createDataFrame([(1, "t5x1 t5x2")], "request_id long, query string")
    weights, left, _ = blockmax.plan(stored, asked, 12)
    plan = blockmax.bounds(stored, weights)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan
    assert left.count() == 0 and [tuple(r) for r in blockmax.search(stored, asked).select("key", "rank").collect()] == [(5, 1)]


def clustered(rng, clusters, each, size=16):
    centres = rng.normal(0, 10, (clusters, size))
    return np.concatenate([c + rng.normal(0, 0.2, (each, size)) for c in centres])


@pytest.mark.parametrize("shape", ["clustered", "uniform", "ties"])
def test_vector_index_equals_plain_search(spark, tmp_path, shape):
    rng = np.random.default_rng(6)
    made = clustered(rng, 12, 60) if shape == "clustered" else rng.random((600, 16)) if shape == "uniform" else rng.integers(0, 2, (600, 4)).astype(float)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(3, [float(x) for x in made[3]]), (None, [1.0] * made.shape[1]), (9001, None), (9002, [float("nan")] * made.shape[1]), (9003, [1.0, 2.0]), (9004, [1.5, 2.0])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 7 = 0 or vec_id = 9003").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("vector"))
    index = vectorindex.build(vectors, f"file://{tmp_path}/v", pivots=20, sample=200)
    for k in (12, 700):
        assert rows(vectorindex.search(index, asked, k)) == rows(vector.top_k(vectors, asked, k))
    assert rows(vectorindex.search(index, asked, 5, most=3)) == rows(vector.top_k(vectors, asked, 5))
    none = vectorindex.build(vectors.limit(0), f"file://{tmp_path}/none")
    assert vectorindex.search(none, asked).count() == 0 and vectorindex.search(index, asked.limit(0)).count() == 0


def test_clustered_vectors_skip_most_folders(spark, tmp_path):
    rng = np.random.default_rng(7)
    made = clustered(rng, 30, 40)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "vec_id long, embedding array<double>")
    index = vectorindex.build(vectors, f"file://{tmp_path}/v", pivots=30, sample=1200)
    asked = vectorindex.Asked(index, np.arange(0, 1200, 40), made[::40])
    found, read = vectorindex.nearest(index, asked, 12)
    assert read.mean() < 0.1 and read.any(axis=1).all() and found.count() >= 30 * 12
    one = vectorindex.Asked(index, np.array([0]), made[:1])
    _, read = vectorindex.nearest(index, one, 12)
    plan = vectorindex._read(index, one, read, np.array([1.0]), 12)._jdf.queryExecution().toString()
    scan = plan[plan.rindex("PartitionFilters") :]
    assert "pivot" in scan[:120] and "away" in scan.split("PushedFilters")[1][:200]


def test_only_new_texts_are_embedded(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def counting(texts, folder=str(seen)):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def embedded():
        found = sorted(t for p in seen.iterdir() for t in p.read_text().split("\n"))
        for p in seen.iterdir():
            p.unlink()
        return found

    rows = [(1, "a", 0), (2, "bb", 0), (3, "bb", 0), (4, None, 0), (5, "", 0)]
    df = spark.createDataFrame(rows, "key long, text string, digest int")
    where = f"file://{tmp_path}/store"
    first = {r["key"]: r["embedding"] for r in vector.kept(df, "text", counting, where).collect()}
    assert first == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [2.0, 1.0], 4: [0.0, 1.0], 5: [0.0, 1.0]} and embedded() == ["", "a", "bb"]
    more = spark.createDataFrame([*rows, (6, "ccc", 0)], "key long, text string, digest int")
    assert len(vector.kept(more, "text", counting, where).collect()) == 6 and embedded() == ["ccc"]
    assert vector.kept(more, "text", counting, where).count() == 6 and embedded() == []
    assert vector.kept(df.limit(0), "text", counting, f"{where}2").count() == 0


def test_long_conversations_are_spread(spark):
    from marlpit.operators import context

    talk = [(7, k, "user" if k % 2 else "assistant", f"t{k}" if k % 9 else None) for k in range(900)] + [(c, k, "user", f"{c}-{k}") for c in range(20, 40) for k in range(c % 4)] + [(None, 1, "user", "x"), (None, 2, "assistant", "y")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").repartition(3)
    key = lambda r: str(tuple(r))
    for turns in (0, 1, 3, 70):
        want = context.answered_question(context.history(df, turns)).select("conv_id", "turn", "recent", "question")
        got = context.long_history(df, turns, pieces=7).select("conv_id", "turn", "recent", "question")
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    pieces = context.in_pieces(df, "conv_id", "turn", 3, 7).where("not _guest")
    assert pieces.count() == len(talk) and pieces.where("conv_id = 7").select("_piece").distinct().count() > 1
    assert context.long_history(df.limit(0), 3).count() == 0
