import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlpit.operators import context, fusion, lexical, metadata, profile, rerank, vector
from tests.conftest import rows
from pyspark.sql import functions as F


def test_fusion_golden(spark):
    one = spark.createDataFrame([(1, k, i + 1) for i, k in enumerate("ABC")], "request_id long, key string, rank int")
    two = spark.createDataFrame([(1, k, i + 1) for i, k in enumerate("BDA")], "request_id long, key string, rank int")
    got = [(r["key"], round(r["rrf_score"], 8), r["rank"]) for r in fusion.fuse([(one, 0.3), (two, 0.7)]).orderBy("rank").collect()]
    assert got == [("B", 0.01631412, 1), ("A", 0.01602914, 2), ("D", 0.01129032, 3), ("C", 0.0047619, 4)]


def test_fusion_ties_keep_first_appearance_and_ignore_row_order(spark):
    one = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "request_id long, key string, rank int")
    two = spark.createDataFrame([(1, "y", 2), (1, "z", 1), (1, "a", 1)][::-1], "request_id long, key string, rank int")
    both = rows(fusion.fuse([(one, 0.5), (two, 0.5)]).select("rank", "key"), "rank")
    assert both == rows(fusion.fuse([(one.orderBy(F.desc("key")), 0.5), (two.repartition(3), 0.5)]).select("rank", "key"), "rank")
    assert [k for _, k in both] == ["z", "y", "a"]
    assert fusion.fuse([(one.limit(0), 1.0)]).count() == 0


def test_similarity_and_contribution(spark):
    df = spark.createDataFrame([(0.5, True, False), (None, False, False)], "d double, a boolean, b boolean")
    got = df.select(vector.similarity(F.col("d")), fusion.contribution(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.6667, "Keyword-Only"), (0.0, "Vector-Only")]


def test_bm25_common_terms_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, "a"), (4, ""), (5, None)], "doc_id long, text string")
    index = lexical.build(docs)
    idf = {r["term"]: r["idf"] for r in index.terms.collect()}
    assert idf["a"] > 0 and idf["a"] < idf["b"]
    asked = spark.createDataFrame([(1, "b b"), (2, "b"), (3, "zzz"), (4, None)], "request_id long, query string")
    got = {r["request_id"]: r["score"] for r in lexical.search(index, asked).collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx(2 * got[2])


def test_bm25_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x y"), (2, "y z")], "doc_id long, text string")
    index = lexical.build(docs)
    index.write(str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "y z")], "request_id long, query string")
    back = lexical.Bm25Index.read(spark, str(tmp_path / "i"))
    assert rows(lexical.search(index, asked), "key") == rows(lexical.search(back, asked), "key")
    postings, terms = back.holding(spark.createDataFrame([(1, "y", 1)], "request_id long, term string, times long"))
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "In(term" in plan or "EqualTo(term" in plan
    assert postings.select("term").distinct().count() == 1 == terms.count()
    lexical.build(docs.limit(0)).write(str(tmp_path / "e"))
    assert lexical.search(lexical.Bm25Index.read(spark, str(tmp_path / "e")), asked).count() == 0


def test_vector_top_k_skips_nulls_and_other_sizes(spark):
    vecs = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "request_id long, vector array<double>")
    assert rows(vector.top_k(vecs, asked, 2).select("key", "distance", "rank"), "rank") == [(2, 0.0, 1), (3, 0.0, 2)]
    assert vector.top_k(vecs, asked.limit(0), 2).count() == 0


def test_vector_top_k_equals_brute_force_either_way(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = np.round(rng.standard_normal((500, 6)), 1)
    v[rng.random(500) < 0.33] = v[0]  # many ties
    vecs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, [float("nan")] * 6), (901, [None] * 6), (902, []), (None, [0.0] * 6), (903, [1.0, 2.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 500, 7)] + [(904, [0.0, 0.0]), (905, None)], "request_id long, vector array<double>")
    want = [(i, int(j), rank + 1) for i in range(0, 500, 7) for rank, j in enumerate(np.lexsort((np.arange(500), ((v - v[i]) ** 2).sum(axis=1)))[:5])] + [(904, 903, 1)]
    for most in (1000, 10):
        assert rows(vector.top_k(vecs, asked, 5, broadcast_rows=most, shard_rows=120).select("request_id", "key", "rank"), "request_id", "rank") == want
    assert vector.top_k(vecs.limit(0), asked, 5, broadcast_rows=10).count() == 0


def test_parent_expansion_keeps_first_hit(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 11, 3)], "request_id long, key long, rank int")
    kids = spark.createDataFrame([(10, 7), (11, 7), (20, 8)], "child_key long, parent_id long")
    assert rows(fusion.parents_of(hits, kids), "rank") == [(1, 7, 1), (1, 8, 2)]


QUESTION = "HUG 전세자금대출 한도 얼마"


def _candidates(spark):
    data = [
        (1, 0, "a.md", "internal_rule", "internal_rule", "최대 2억원", "대출한도", None, "10.1", "HUG 전세자금대출"),
        (1, 1, "official_md/HUG_x.md", None, "official", "한도 안내", None, None, None, None),
        (1, 2, "kms_output_md/1.md", None, "kms", "전세자금대출 대출한도 안내", None, None, None, None),
    ]
    schema = "request_id long, idx int, source string, doc_type string, source_class string, text string, section_title string, parent_section_title string, parent_section_no string, doc_title string"
    return spark.createDataFrame(data, schema).withColumn("message", F.lit(QUESTION)).withColumn("profile", profile.profile(F.lit(QUESTION)))


def test_profile_golden(spark):
    p = spark.range(1).select(profile.profile(F.lit(QUESTION)).alias("p")).first()["p"]
    assert (p["rule_score"], p["official_score"], p["institutions"], p["normalized_properties"], p["is_compare"]) == (4, 1, ["HUG"], ["대출한도"], False)
    two = spark.range(1).select(profile.profile(F.lit("hf sgi")).alias("p")).first()["p"]
    assert two["is_compare"] and two["compare_score"] == 2
    none = spark.range(1).select(profile.profile(F.lit(None).cast("string")).alias("p")).first()["p"]
    assert none["raw_text"] == "" and none["institutions"] == []


def test_lexicon_of_a_table(spark):
    table = spark.createDataFrame([("rule", None, "limit"), ("rule", None, "rate"), ("asked_institutions", "A", "aaa"), ("properties", "p", "rate")], "kind string, name string, word string")
    lex = profile.Lexicon.of(table)
    p = spark.range(1).select(profile.profile(F.lit("AAA rate limit"), lex).alias("p")).first()["p"]
    assert (p["rule_score"], p["institutions"], p["normalized_properties"]) == (2, ["A"], ["p"])
    with pytest.raises(ValueError):
        profile.Lexicon.of(table, most=3)


def test_rerank_golden_and_reasons_add_up(spark):
    got = rerank.rerank(rerank.score(_candidates(spark))).orderBy("idx").collect()
    assert [r["rerank_score"] for r in got] == [18.3, 9.08, 2.26]
    for r in got:
        assert sum(float(x.rsplit("+", 1)[1]) for x in r["reasons"]) == pytest.approx(r["rerank_score"], abs=0.006)


def test_compare_selection_golden(spark):
    data = [("a", 1, "official", ["HUG", "HF"]), ("b", 2, "internal_rule", ["HUG"]), ("c", 3, "official", ["HF"]), ("d", 4, "other", ["HF"])]
    rows_ = spark.createDataFrame(data, "key string, rerank_rank int, source_class string, institutions array<string>").withColumn("request_id", F.lit(1))
    asked = rows_.withColumn("profile", F.struct(F.lit(True).alias("is_compare"), F.array(F.lit("HUG"), F.lit("HF")).alias("institutions")))
    assert [r["key"] for r in context.select_context(asked).orderBy("position").collect()] == ["b", "a", "c", "d"]
    assert [r["key"] for r in context.select_context(asked, 2).orderBy("position").collect()] == ["b", "a"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from(context.ORDER)), min_size=1, max_size=12))
def test_selection_is_bounded_and_unique(spark, items):
    data = [(k, i + 1, c, ["HF"]) for i, (k, c) in enumerate(items)]
    df = spark.createDataFrame(data, "key int, rerank_rank int, source_class string, institutions array<string>").withColumn("request_id", F.lit(1))
    asked = df.withColumn("profile", F.struct(F.lit(True).alias("is_compare"), F.array(F.lit("HF")).alias("institutions")))
    got = [r["key"] for r in context.select_context(asked).collect()]
    assert len(got) == len(set(got)) <= 6


def test_history_and_pairs(spark):
    m = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "system", "x" * 60), (1, 3, "user", "q2")], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: r["recent"] for r in context.history(m, 2).collect()}
    assert got == {0: None, 1: "Q: q1\n", 2: "Q: q1\nA: a1\n", 3: "A: a1\nA: " + "x" * 50 + "\n"}
    assert context.history(m, 0).where("recent is not null").count() == 0
    own = context.history(m, (F.col("turn") - 1).cast("int"))
    assert {r["turn"]: r["recent"] for r in own.collect()} == {0: None, 1: None, 2: "A: a1\n", 3: "A: a1\nA: " + "x" * 50 + "\n"}
    assert [r["question"] for r in context.answered_question(m).orderBy("turn").collect()][:2] == ["N/A", "q1"]


def test_render_does_not_reread_values(spark):
    got = spark.range(1).select(context.render("<{a}|{b}|{c}>", a=F.lit("{b}"), b=F.lit(None))).first()[0]
    assert got == "<{b}||{c}>"


def test_source_class_and_display(spark):
    df = spark.createDataFrame([("./faq_output_md/10.1.md", None), ("x\\official_md\\a.md", None), ("kms_output_md/1.md", None), (None, "internal_rule"), ("z", None)], "source string, doc_type string")
    assert [r[0] for r in df.select(metadata.source_class(F.col("source"), F.col("doc_type"))).collect()] == ["internal_rule", "official", "kms", "internal_rule", "other"]
    lit = F.lit
    shown = spark.range(1).select(
        metadata.display(lit("internal_rule"), lit("LD10"), lit("10.1"), lit("한도"), lit("론"), lit("a"), lit(1)),
        metadata.display(lit("internal_rule"), lit("LD10"), lit("10.1"), lit("한도"), lit("한도"), lit("a"), lit(1)),
        metadata.display(lit("internal_rule"), lit(""), lit("10.1"), lit(None), lit(None), lit("a"), lit(1)),
        metadata.display(lit(None), lit("x"), lit("x"), lit("x"), lit("x"), lit("p/q.md"), lit(3)),
    )
    assert list(shown.first()) == ["LD10 10.1 론 > 한도", "LD10 10.1 한도", "10.1", "q.md#3"]
