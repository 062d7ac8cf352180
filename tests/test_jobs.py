"""The jobs over growing copies of their inputs."""

import json
import shutil
import sys

import pytest
from pyspark.sql import functions as F

from jobs import answer_review, chunk_feed
from jobs.common import config

DOCS = "doc_id long, source string, text string, batch string"
TALK = "conv_id long, turn long, role string, text string, key string"


def put(spark, folder, name, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{name}")


def state(spark, folder):
    return sorted((r["key"], r["chunk_id"], r["source_class"], r["text"]) for r in chunk_feed.current(spark, f"{folder}/table").collect())


def feed(spark, folder, **more):
    # one folder a delivery, so the source is a pattern
    return chunk_feed.run(spark, f"{folder}/in/*", f"{folder}/table", f"{folder}/checkpoint", config(None, "chunk_feed.json") | more)


def test_feed_takes_only_what_is_new(spark, tmp_path):
    long = "word " * 400
    put(spark, tmp_path, "a", [(1, "official_md/x.md", "first text", None), (2, "faq_output_md/y.md", long, None), (3, "z.md", "---\ndoc_type: internal_rule\n---\nrule", None), (4, None, "", None)])
    first = feed(spark, tmp_path)
    assert first["batches"] == 1 and first["read"] == 4
    before = state(spark, tmp_path)
    assert {(k, c) for k, _, c, _ in before} == {("1", "official"), ("2", "faq"), ("3", "internal_rule")}
    assert [t for k, _, _, t in before if k == "3"] == ["rule"]
    assert feed(spark, tmp_path) == {"batches": 0, "read": 0, "written": 0}
    assert state(spark, tmp_path) == before
    put(spark, tmp_path, "b", [(1, "official_md/x.md", "second text", None), (2, "faq_output_md/y.md", "", None), (5, "kms_output_md/k.md", "new", None), (5, "kms_output_md/k.md", "new", None), (None, "n.md", "lost", None), (6, "s.md", None, None)])
    second = feed(spark, tmp_path)
    assert second["batches"] == 1 and second["read"] == 5 and second["written"] == 2  # the repeated row is one
    after = state(spark, tmp_path)
    assert after == sorted([("1", 1, "official", "second text"), ("5", 1, "kms", "new"), *[r for r in before if r[0] == "3"]])
    ledger = spark.read.schema(chunk_feed.DOCUMENTS).parquet(f"{tmp_path}/table/documents")
    assert {(r["key"], r["error"]) for r in ledger.where("error is not null").collect()} == {(None, "no key"), ("6", "no text")}
    assert {r["pieces"] for r in ledger.where("key = '2'").collect()} == {0, max(c for k, c, _, _ in before if k == "2")}


def test_same_table_in_one_run_or_in_several(spark, tmp_path, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "source", "text")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).write.parquet(f"{tmp_path}/one/in/p{k}")
    feed(spark, tmp_path / "one", files_a_batch=1)
    for k in range(3):
        shutil.copytree(tmp_path / "one" / "in" / f"p{k}", tmp_path / "many" / "in" / f"p{k}")
        assert feed(spark, tmp_path / "many")["batches"] == 1
    assert state(spark, tmp_path / "one") == state(spark, tmp_path / "many") != []


def test_a_failed_batch_is_repeated(spark, tmp_path, monkeypatch):
    put(spark, tmp_path, "a", [(k, "x.md", f"text {k}", None) for k in range(20)])
    write = chunk_feed._write

    def failing(docs, batch, target, settings):
        write(docs, batch, target, settings)
        raise RuntimeError("lost")

    monkeypatch.setattr(chunk_feed, "_write", failing)
    with pytest.raises(Exception, match="lost"):
        feed(spark, tmp_path)
    monkeypatch.setattr(chunk_feed, "_write", write)
    assert feed(spark, tmp_path) == {"batches": 1, "read": 20, "written": 20}
    table = spark.read.schema(chunk_feed.CHUNKS).parquet(f"{tmp_path}/table/chunks")
    assert table.count() == 20 == len(state(spark, tmp_path))


def test_feed_of_an_empty_table(spark, tmp_path):
    put(spark, tmp_path, "a", [])
    done = feed(spark, tmp_path)
    assert done["read"] == done["written"] == 0


def test_review(spark, tmp_path):
    docs = spark.createDataFrame([(1, "src", "alpha beta gamma delta", None), (2, "src", "epsilon zeta", None), (2, "src", "zeta eta", None), (None, "src", "alpha", None)], DOCS)
    talk = [(1, 0, "user", "alpha beta ?", "k"), (1, 1, "assistant", "alpha gamma omega", "k"), (1, 2, "user", None, "k"), (1, 3, "assistant", "zeta", "k"), (2, 0, "assistant", "opens", "k"), (3, 5, "user", "zeta hf", "k"), (3, 9, "assistant", None, "k"), (3, 9, "assistant", None, "k"), (None, 1, "assistant", "x", "k"), (4, 0, "user", "eta", ""), (4, 1, "assistant", "eta eta", "")]
    target = f"file://{tmp_path}/review"
    messages = spark.createDataFrame(talk, TALK)
    for _ in range(2):
        assert answer_review.run(spark, messages, docs, target) == {"read": 4, "written": 4}
    got = {(r["conv_id"], r["turn"]): r for r in answer_review.reviewed(spark, target).collect()}
    assert set(got) == {(1, 1), (1, 3), (3, 9), (4, 1)}
    assert (got[1, 1]["ref_documents"], got[1, 1]["words"], got[1, 1]["supported"], got[1, 1]["grade"]) == ("1", 3, 2, "good")
    assert (got[1, 3]["question"], got[1, 3]["ref_documents"], got[1, 3]["support"], got[1, 3]["grade"]) == (None, None, 0.0, "none")
    assert (got[3, 9]["words"], got[3, 9]["grade"], got[3, 9]["official_score"], got[3, 9]["recent"]) == (0, "none", 1, "Q: zeta hf\n")
    assert got[4, 1]["support"] == 1.0
    folders = {p.name for p in (tmp_path / "review" / "answers").iterdir() if p.is_dir()}
    assert folders == {"grade=good", "grade=none"}


def test_review_of_empty_tables(spark, tmp_path):
    none = answer_review.run(spark, spark.createDataFrame([], TALK), spark.createDataFrame([], DOCS), f"file://{tmp_path}/r")
    assert none == {"read": 0, "written": 0} and answer_review.reviewed(spark, f"file://{tmp_path}/r").count() == 0


def test_command_lines_and_config(tmp_path, monkeypatch, spark):
    (tmp_path / "own.json").write_text(json.dumps({"text": "upper(text)"}))
    assert config(str(tmp_path / "own.json"), "chunk_feed.json")["text"] == "upper(text)"
    (tmp_path / "bad.json").write_text(json.dumps({"txet": "text"}))
    with pytest.raises(ValueError, match="txet"):
        config(str(tmp_path / "bad.json"), "chunk_feed.json")
    put(spark, tmp_path, "a", [(1, "x.md", "some text", None)])

    class Kept:
        def __getattr__(self, name):
            return getattr(spark, name)

        def stop(self):
            stopped.append(1)

    stopped = []
    monkeypatch.setattr(chunk_feed, "session", lambda name: Kept())
    monkeypatch.setattr(sys, "argv", ["chunk_feed", "--source", f"{tmp_path}/in/*", "--target", f"{tmp_path}/table", "--checkpoint", f"{tmp_path}/checkpoint", "--config", str(tmp_path / "own.json")])
    chunk_feed.main()
    assert stopped and [t for *_, t in state(spark, tmp_path)] == ["SOME TEXT"]


def test_jobs_do_not_change_settings(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    put(spark, tmp_path, "a", [(1, "x.md", "some text", None)])
    feed(spark, tmp_path)
    assert before == {k: spark.conf.get(k) for k in before}
