from pyspark.sql import functions as F

from marlpit.operators import context, logs
from marlpit.plans import answer, index
from marlpit.sources import sinks
from marlpit.streaming import feedback


def _corpus(tmp_path):
    folder = tmp_path / "official_md"
    folder.mkdir()
    (folder / "one.md").write_text("---\nsection_title: 대출한도\n---\nHUG 전세자금대출 한도 는 최대 2억원", encoding="utf-8")
    (folder / "two.md").write_text("unrelated words about gardens", encoding="utf-8")
    return [f"file://{tmp_path}"], [f"file://{folder}"]


def test_answer_end_to_end(spark, tmp_path):
    _, paths = _corpus(tmp_path)
    where = f"file://{tmp_path}/index"
    built = index.build_or_load(spark, paths, where)
    again = index.build_or_load(spark, paths, where)
    assert built.chunks.count() == again.chunks.count() == 2
    asked = spark.createDataFrame([(1, "HUG 한도 얼마", None), (2, "gardens", None), (3, None, None)], "request_id long, message string, recent string")
    out = answer.answer(again, asked, system="")
    got = {r["request_id"]: r for r in out.results.collect()}
    assert got[1]["ref_documents"].split("|")[0] == "one.md#1" and "최대 2억원" in got[1]["prompt"]
    assert got[2]["answer"] == got[2]["prompt"] and "gardens" in got[2]["prompt"] and len(got) == 3
    record = out.diagnostics.where("request_id = 1").first()
    assert [x["bm25_rank"] for x in record["bm25_top"]] == [1] and len(record["final_context"]) == 2
    loud = answer.answer(again, asked.where("request_id = 2"), model=lambda prompts: [p.upper() for p in prompts])
    assert loud.results.first()["answer"].startswith("ANSWER FROM THE GIVEN")
    assert {r["list_name"] for r in out.debug.collect()} == {"bm25_docs", "vector_docs", "top_hybrid_docs"}
    assert answer.answer(again, asked.limit(0)).results.count() == 0


def test_errors_stay_with_their_request(spark, tmp_path):
    _, paths = _corpus(tmp_path)
    built = index.build(spark, paths, f"file://{tmp_path}/index")

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return ["fine"] * len(prompts)

    asked = spark.createDataFrame([(1, "good", "Q: x\n", 1), (2, "bad", "Q: x\n", 0), (3, "other", "Q: bad\n", 2), (4, "more", None, 2)], "request_id long, message string, recent string, turns int")
    got = {r["request_id"]: r for r in answer.answer(built, asked, rewrite=model, model=model).results.collect()}
    assert [got[i]["search_query"] for i in (1, 2, 3, 4)] == ["fine", "bad", "other", "more"]  # no turns, a failure, no history
    assert [got[i]["answer"] for i in (1, 2, 3, 4)] == ["fine", None, "fine", "fine"]
    assert got[1]["error"] is None and got[2]["error"] == "RuntimeError: no" == got[3]["error"]


KB = "---\n분류: \"a > b\"\n첨부파일:\n - \"f (ID: 1)\"\n---\n\n# T\nalpha beta\n## U\ngamma delta"


def test_split_index_and_its_answers(spark, tmp_path):
    _, paths = _corpus(tmp_path)
    kb = tmp_path / "kms_output_md"
    kb.mkdir()
    (kb / "1.md").write_text(KB, encoding="utf-8")
    where = f"file://{tmp_path}/split"
    for _ in range(2):  # built, then loaded
        split = index.build_or_load_split(spark, [f"file://{kb}"], paths, where)
    parents = split.parents.chunks.orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["meta"]["title"], r["meta"].get("section")) for r in parents] == [(1, "T", None), (2, "T", "U")]
    assert parents[0]["meta"]["category_depth2"] == "b" and parents[0]["meta"]["file_name"] == "1.md" and parents[0]["source_group"] == "kms"
    assert {r["source_group"] for r in split.others.chunks.collect()} == {"non_kms"} and split.chunks.count() == 4
    asked = spark.createDataFrame([(1, "gamma gardens")], "request_id long, query string")
    found = split.search(asked)
    assert set(found.lists) == {"kms_docs", "non_kms_bm25_docs", "non_kms_vector_docs", "non_kms_hybrid_docs", "top_hybrid_docs"}
    assert found.lists["kms_docs"].orderBy("rank").first()["key"] == parents[1]["key"]
    out = answer.answer(split, asked.selectExpr("request_id", "query as message", "cast(null as string) as recent"))
    got = out.results.first()
    assert "1.md#2" in got["ref_documents"] and "two.md#1" in got["ref_documents"] and "gamma delta" in got["prompt"]
    assert {r["list_name"] for r in out.debug.collect()} == set(found.lists)


def test_split_index_without_other_documents(spark, tmp_path):
    parents = index.parent_table(spark.createDataFrame([("k/1.md", KB), ("k/2.md", None), ("k/3.md", "")], "source string, text string"))
    alone = index.build_split(spark, parents, ["file:///nowhere"], f"file://{tmp_path}/alone")
    asked = spark.createDataFrame([(1, "alpha")], "request_id long, query string")
    assert alone.others is None and set(alone.search(asked).lists) == {"kms_dense_docs", "kms_bm25_docs", "top_hybrid_docs"}
    got = answer.answer(alone, asked.selectExpr("request_id", "query as message")).results.first()
    assert got["ref_documents"].split("|")[0] == "1.md#1"


def test_feedback_rows_and_log(spark, tmp_path):
    messages = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "user", "q"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string")
    events = spark.createDataFrame([(1, 0, False), (1, 2, True)], "conv_id long, turn long, liked boolean")
    results = spark.createDataFrame([(1, 2, 3, "sq", "d", "r", "0.5", "1", "2.0")], "conv_id long, turn long, context_turns int, searched_query string, ref_documents string, search_reasons string, vector_similarities string, bm25_ranks string, rrf_final_scores string")
    got = logs.feedback_rows(events, messages, results, F.lit("2024-01-01").cast("timestamp"))
    assert got.columns == list(logs.FEEDBACK)
    by = {r["ai_response"]: r for r in got.collect()}
    assert by["hi"]["original_question"] == "N/A" and by["hi"]["feedback"] == "DISLIKE" and by["hi"]["context_turns"] == 0
    assert by["a"]["original_question"] == "q" and by["a"]["searched_query"] == "sq"
    for kind in ("parquet", "csv"):
        for _ in range(2):
            sinks.append_feedback(got, f"file://{tmp_path}/{kind}", kind)
    assert spark.read.parquet(f"file://{tmp_path}/parquet").count() == 4
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 4


def test_feedback_stream(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "event_id long, ts timestamp, liked boolean"
    spark.createDataFrame([(1, "2024-01-01 00:00:00", True), (1, "2024-01-01 00:00:00", True), (2, "2024-01-01 00:01:00", False)], "event_id long, ts string, liked boolean").write.json(src)
    for _ in range(2):  # the second run finds nothing new
        feedback.append(feedback.follow(spark, src, schema), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert feedback.counts(spark.read.parquet(out)).select("likes", "dislikes").first() == (1, 1)


def test_history_of_any_length(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}", 70 if k == 80 else 0) for k in range(81)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, asked int")
    got = {r["turn"]: r["recent"] for r in context.history(df, F.col("asked")).collect()}
    assert len(got[80].splitlines()) == 70 and got[80].startswith("Q: m10\n") and got[79] is None
    assert context.history(df.limit(0), F.col("asked")).count() == 0


def test_a_batch_that_is_delivered_twice_counts_once(spark, tmp_path):
    from marlpit.sources import sinks

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    for batch in ("x", "y", "x"):
        sinks.append_feedback(rows, f"file://{tmp_path}/log", batch=batch)
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 4
