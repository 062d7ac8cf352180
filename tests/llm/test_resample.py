"""Importance resampling against a plain Python version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from marlpit.llm.resample import resample

SCHEMA = "doc_id long, text string, rank int, place string"
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(docs, target, buckets=10_000, percent=25, least=20, seed=7):
    def words(text):
        return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))

    def hashed(w):
        return [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    split = [(i, words(t)) for i, t in docs]
    own, aim = Counter(b for _, w in split for b in hashed(w)), Counter(b for t in target for b in hashed(words(t)))
    all_s, all_t = sum(own.values()), sum(aim.values())
    rows = []
    for i, w in split:
        b = hashed(w)
        total = sum(math.floor(1000 * math.log((aim[x] + 1) * (all_s + buckets) / ((own[x] + 1) * (all_t + buckets)))) for x in b)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = total // len(b) if b else 0
        rows.append((i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = len(fit) * percent // 100
    return sorted(((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(fit)), key=str) + sorted(((*r[:4], None) for r in rows if not r[4]), key=str)


def key(r):
    return str(tuple(r))


def test_like_the_plain_version(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    got = resample(spark.read.parquet(f"{tiny}/documents.parquet").repartition(7), spark.read.parquet(f"{tiny}/benchmark.parquet"))
    assert sorted(map(key, got.collect())) == sorted(map(key, plain(docs, target)))
    assert sum(r.rank is not None for r in got.collect()) > 10


def test_nulls_ties_repeats_and_clashing_names(spark):
    long = "Ärger über 12 cafés " * 30_000
    words = " ".join(f"w{i}" for i in range(25))
    docs = [(1, None), (2, ""), (3, "-- !! --"), (4, words), (4, words), (None, words), (5, long), (6, "ONE two"), (7, "x\x00y z" * 20)]
    frame = spark.createDataFrame([(i, t, 9, "there") for i, t in docs], SCHEMA)
    target = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    got = [tuple(r) for r in resample(frame, target, percent=60).collect()]
    assert sorted(map(key, got)) == sorted(map(key, plain(docs, ["w1 w2 w3", None], percent=60)))
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, len(ranks) + 1))
    assert {r[2] for r in got if r[1] == 0} == {0}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "a b " * 20, 0, "")], SCHEMA)
    assert resample(none, one).collect() == []
    assert [tuple(r) for r in resample(one, none, percent=100).collect()] == plain([(1, "a b " * 20)], [], percent=100)


@pytest.mark.parametrize("parts", [1, 9])
def test_ranks_do_not_hang_on_partitions(spark, parts):
    rows = [(i, " ".join(f"t{i % 3}{k}" for k in range(20)), 0, "") for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sorted((r.rank, r.doc_id) for r in resample(frame, spark.createDataFrame([("t11 t12",)], "text string")).collect() if r.rank)
    want = sorted((r[4], r[0]) for r in plain([(i, t) for i, t, _, _ in rows], ["t11 t12"]) if r[4])
    assert got == want and len(got) == 75


def test_no_python_in_the_plan(spark, tiny):
    plan = resample(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
