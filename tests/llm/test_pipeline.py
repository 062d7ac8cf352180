"""Stages keep the columns and the clean documents, and take what was planted."""

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from marlpit.session import cut


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The small tables with planted rows: no letters, toxic, a copy, a near copy, a benchmark passage."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 150").orderBy("item_id").first()["text"]
    long = docs.where("length(text) between 3000 and 4000 and lang = 'en'").orderBy("doc_id").first()
    words = long["text"].split(" ")
    words[len(words) // 2] = "changedword"
    rows = [
        (9001, "12345 !!! ---", None, "p", 13),
        (9002, None, "en", "p", None),
        (9003, " ".join(words[:60]) + " you stupid idiot, moron and loser, worthless trash " + " ".join(words[60:120]), "en", "p", 1),
        (9004, long["text"], "en", "p", 1),
        (9005, " ".join(words), "en", "p", 1),
        (9006, " ".join(reversed(words[:200])) + " " + item + " " + " ".join(reversed(words[200:400])), "en", "p", 1),
    ]
    out = f"file://{tmp_path_factory.mktemp('sf')}"
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return out, long["doc_id"]


def test_stages(spark, planted):
    sf, original = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    gone = {}
    for name, stage in cp.STAGES[:-1]:
        after = cut(stage(spark, docs, sf), "stage")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        gone[name] = ids(docs) - ids(after)
        assert after.exceptAll(docs).count() == 0
        docs = after
    assert gone["language identification"] == {9001, 9002}
    assert 9003 in gone["toxicity"] and len(gone["toxicity"]) < 200
    assert {9004, 9005} <= gone["near-duplicates"] and original not in gone["near-duplicates"]
    assert 9006 in gone["decontamination"] and len(gone["decontamination"]) < 60
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert ids(packed) == ids(docs)


def test_junk_goes_and_clean_texts_stay(spark, planted):
    sf, _ = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null and doc_id < 9000")
    rng = np.random.default_rng(3)
    junk = [(20_000 + i, " ".join("".join(map(chr, rng.integers(97, 123, int(rng.integers(4, 11))))) for _ in range(120)), None, "p", 1) for i in range(10)]
    kept = {r["doc_id"] for r in cp.identify_language(spark, docs.unionByName(spark.createDataFrame(junk, docs.schema)), sf).select("doc_id").collect()}
    assert len([i for i in kept if i >= 20_000]) <= 1
    clean = {r["doc_id"] for r in docs.where("text rlike '[a-zA-Z]'").collect()}
    assert len(clean - kept) <= len(clean) / 500


def test_without_labels_nothing_is_rejected(spark, planted, tmp_path):
    sf, _ = planted
    out = f"file://{tmp_path}"
    spark.read.parquet(f"{sf}/labels.parquet").withColumn("toxic", F.lit(0)).write.parquet(f"{out}/labels.parquet")
    docs = spark.createDataFrame([(1, "some words", None), (2, "12", None), (3, None, None), (None, "other words", None)], "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="language"):
        kept = cp.identify_language(spark, docs, out)
    assert {r["doc_id"] for r in kept.collect()} == {1, None}
    with pytest.warns(UserWarning, match="toxicity"):
        assert cp.drop_toxic(spark, docs, out).count() == 4


def test_extra_columns_with_names_of_internals(spark, planted):
    sf, _ = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for c in ("_key", "_id", "key", "id", "h", "bucket", "c0", "score", "lang_pred", "_kept_id", "number"):
        docs = docs.withColumn(c, F.lit(c))
    docs = cut(docs, "named")
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.count() > 0
    assert cp.STAGES[-1][1](spark, docs, sf).count() >= 40


def test_empty_documents(spark, planted):
    sf, _ = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.lit(False))
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["language identification", "toxicity", "near-duplicates", "decontamination", "packing"]
