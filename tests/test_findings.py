"""What a review found on larger tables, each on small ones."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from marlpit.functions import markup
from marlpit.operators import blockmax, chunking, lexical, metadata
from marlpit.plans import queries as plans
from marlpit.plans import refresh
from marlpit.sources import mdfiles
from tests.conftest import rows


@pytest.mark.parametrize("name", ["page_line_dedup", "page_merge_by_title"])
def test_references_that_a_cut_title_leaves_open(spark, tmp_path, name):
    pages = spark.createDataFrame([(1, "u1", "<html><head><title>a &amp;&amp; b&amp</title></head><body><p>x &lt; y &copy; &amp;lt; &ampx; &am</p></body></html>"), (2, "u2", "<head><title>t</title></head><p>a&amp</p><p>a&amp;</p>")], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert rows(plans.queries()[name](spark, str(tmp_path)).select(*names).orderBy(*names)) == sorted(want.fetchall())


def test_merged_pages_are_one_document_with_every_url(spark, tmp_path):
    made = ["id AS page_id", "concat('u', id % 4) AS url", "concat('<head><title>t', if(id < 5003, 0, id), '</title></head><p>l', id, '</p>') AS html"]
    spark.range(5_010).selectExpr(*made).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(f"SELECT title, part, pages, text FROM ({plans.oracle_sql()['page_merge_by_title']})").fetchall()
    got = rows(plans.queries()["page_merge_by_title"](spark, str(tmp_path)).select("title", "part", "pages", "text"))
    assert sorted(got) == sorted(want) and max(r[2] for r in got) == 5_003


def test_search_makes_no_row_for_a_request_and_a_document(spark):
    rng = random.Random(3)
    data = [(f"k{i}", " ".join(["the", *(f"w{rng.randrange(40)}" for _ in range(rng.randrange(30)))])) for i in range(300)]
    asked = [(f"r{i}", " ".join(["the", *(f"w{rng.randrange(60)}" for _ in range(9))])) for i in range(40)]
    docs, requests = spark.createDataFrame(data, "doc_id string, text string"), spark.createDataFrame(asked, "request_id string, query string")
    index = lexical.build(docs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # requests go on from one batch to the next
    try:
        found = lexical.search(index, requests, 5)
        assert not re.search(r"hashpartitioning\(request_id#\d+L?, key#", found._jdf.queryExecution().toString())
        got = {(r["request_id"], r["rank"]): (r["key"], round(r["score"], 6)) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    idf, average = {r["term"]: r["idf"] for r in index.terms.collect()}, index.stats.first()["avgdl"]
    want = {}
    for request, query in asked:
        score = {}
        for key, text in data:
            words = text.split()
            parts = [idf[t] * words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * len(words) / average)) for t in query.split() if t in words]
            if parts:
                score[key] = round(sum(parts), 8)
        for rank, key in enumerate(sorted(score, key=lambda k: (-score[k], k))[:5]):
            want[request, rank + 1] = (key, round(score[key], 6))
    assert got == want


def test_lists_of_postings_need_no_row_for_each(spark):
    data = [*((i, f"the w{i % 7} the x{i}") for i in range(400)), (3, "the again"), (3, "w3"), (500, None), (501, "  "), (None, "the null")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    want = {}
    for key, text in data:
        for word in (text or "").split():
            want[word, key] = want.get((word, key), 0) + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        for words in (1, 200, 10**6):
            lists, shards = lexical.listed(docs, words=words)
            got = {}
            found = lists.collect()
            for r in found:
                if r["term"] is not None:
                    assert len(r["keys"]) == len(r["tfs"]) == len(r["dls"])
                    for key, tf in zip(r["keys"], r["tfs"], strict=True):
                        assert (r["term"], key) not in got
                        got[r["term"], key] = tf
            assert got == want
            counts, stats = lexical.summed(spark.createDataFrame(found, lists.schema), shards)
            assert tuple(stats.select("n", "avgdl", "first").first()) == (405, sum(len((x or "").split()) for _, x in data) / 404, 0)
            assert counts.where("term = 'the'").first()["df"] == 401
        assert sum(r["term"] == "the" for r in found) == shards
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lists_are_stored_by_the_tasks_that_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD", 20)
    rng = random.Random(5)
    data = [(i, " ".join(["the", *(f"w{rng.randrange(200)}" for _ in range(rng.randrange(30)))])) for i in range(400)]
    docs = spark.createDataFrame([*data, (7, "the again"), (401, None)], "doc_id long, text string")
    stored = lexical.store(docs, f"file://{tmp_path}/i")
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("part")
    written = stored.lists.select("bucket", part).distinct().groupBy("part").count().collect()
    assert len(written) == 16 and min(r["count"] for r in written) > 1  # a task has its own rows for many folders, and some count two shards
    assert stored.stats.first()["shards"] == 21
    asked = spark.createDataFrame([(i, f"the w{i} w{i + 9} w{i}") for i in range(50)], "request_id long, query string")
    shown = lambda index: sorted(map(tuple, lexical.search(index, asked, 5).select("request_id", "key", "rank", "score").collect()))
    assert shown(stored) == shown(lexical.build(docs))


def test_block_max_makes_no_row_for_a_request_and_a_document(spark):
    rng = random.Random(8)
    data = [(i, " ".join(["the", *(f"w{rng.randrange(40)}" for _ in range(rng.randrange(60)))])) for i in range(2_500)]
    asked = spark.createDataFrame([(i, " ".join(["the", *(f"w{rng.randrange(60)}" for _ in range(9))])) for i in range(10)], "request_id long, query string")
    docs = spark.createDataFrame(data, "doc_id long, text string")
    index = blockmax.of(docs, documents=32)
    _, left, scored = blockmax.plan(index, asked, 5, first=1_000)
    assert left.count() == 0 and scored.count() <= 10 * 5 * index.stats.first()["shards"]
    shown = lambda df: sorted(map(tuple, df.select("request_id", "key", "rank", "score").collect()))
    assert shown(blockmax.search(index, asked, 5)) == shown(lexical.search(lexical.build(docs), asked, 5))


def _planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_split_once_for_a_row(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s")], "doc_id long, text string, lang string, source string")
    assert _planned(plans._kb(docs)).count("split(") == 1
    plan = _planned(docs.select(metadata.front_matter(F.col("text")).alias("f")))
    assert plan.count("regexp_replace(text") <= 1 and "split(text" not in plan


def test_pieces_of_more_rows_than_are_taken_at_once(spark):
    texts = [None if i % 5 == 0 else "" if i % 7 == 0 else f"# h{i}\n" + "word " * (i * 3) for i in range(3 * chunking.ROWS + 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {}
    for r in chunking.child_chunks(docs, "doc_id").orderBy("parent_id", "child_id").collect():
        got.setdefault(r["parent_id"], []).append(r["child"])
    want = {i: chunking.recursive_split(x, *chunking.CHILD, chunking.CHILD_SEPARATORS) for i, x in enumerate(texts) if x}
    assert got == {i: x for i, x in want.items() if x}
    lines = docs.select("doc_id", markup.body_text_column(F.col("text")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in lines} == {i: None if x is None else markup.body_text(x) for i, x in enumerate(texts)}


def test_exported_files_are_moved_by_tasks(spark, tmp_path):
    rows = spark.range(50).repartition(4).select(F.concat(F.lit("k"), "id").alias("pk"), F.lit("t").alias("text"))
    tracker, group = spark.sparkContext.statusTracker(), f"export-{tmp_path.name}"
    spark.sparkContext.setJobGroup(group, "export")
    try:
        mdfiles.export_markdown(rows, f"file://{tmp_path}/out")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"k{i}.md" for i in range(50))
    names = [tracker.getStageInfo(s).name for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    assert any(x.startswith("collect") for x in names)


def test_more_terms_asked_than_are_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    data = [*((i, f"the w{i % 7} x{i} the") for i in range(300)), (301, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"the w{i} x{i + 9}") for i in range(40)], "request_id long, query string")
    shown = lambda index: sorted(map(tuple, lexical.search(index, asked, 5).select("request_id", "key", "rank", "score").collect()))
    few = shown(lexical.build(docs))
    monkeypatch.setattr(lexical, "SENT", 3)
    assert few and shown(lexical.build(docs)) == few == shown(lexical.store(docs, f"file://{tmp_path}/i"))


def test_exported_files_are_listed_by_a_task(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    mdfiles.export_markdown(spark.createDataFrame([("a", "one"), ("b/c d", "zwei ä"), (".p", "x"), ("_q", "y"), ("e", "")], "pk string, text string"), path)
    (tmp_path / "out" / "other.txt").write_text("no")
    (tmp_path / "out" / "folder.md").mkdir()
    (tmp_path / "out" / "k.md").write_bytes("두 글자".encode("cp949"))
    found = mdfiles.scan_markdown(spark, path)
    got = {r["source"].rpartition("/")[2]: (r["text"], r["error"]) for r in found.collect()}
    assert got == {"a.md": ("one", None), "b%2Fc%20d.md": ("zwei ä", None), ".p.md": ("x", None), "_q.md": ("y", None), "e.md": ("", None), "k.md": ("두 글자", None)}
    assert found.inputFiles() == [] and "FileIndex" not in plans.queries()["markdown_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert mdfiles.scan_markdown(spark, f"file://{tmp_path}/none").count() == 0


def test_a_refresh_takes_postings_for_gone_only_from_older_parts(spark, tmp_path, monkeypatch):
    seen = []
    cut = refresh.cut
    monkeypatch.setattr(refresh, "cut", lambda df, name: (seen.append(_planned(df)) if name == "terms" else None, cut(df, name))[1])
    made = lambda *texts: spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(texts) if x], "source string, text string")
    path = f"file://{tmp_path}/i"
    for texts in (("a b", "a c", "d"), ("a b", "a e", None), ("a b", "a e", "b b f")):
        found = refresh.refresh(spark, made(*texts), path)
    assert ["LeftSemi" in x for x in seen] == [False, True, False] and "(held#" in seen[1] and " < 1)" in seen[1]
    assert sorted(map(tuple, found.index.bm25.terms.select("term", "df").collect())) == [("a", 2), ("b", 2), ("e", 1), ("f", 1)]
