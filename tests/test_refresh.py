"""A refreshing index against one built anew, and a large lexicon against plain tests."""

from pyspark.sql import functions as F

from marlpit.operators import lexical, lexicon
from marlpit.plans import refresh

LONG = " ".join(f"word{k}" for k in range(400))


def state(index):
    return sorted((r["source"], r["chunk_id"], r["text"]) for r in index.chunks.collect())


def docs_of(spark, texts):
    return spark.createDataFrame([(f"official_md/{k}.md", t, 1) for k, t in texts.items()], "source string, text string, held int")


def asked(spark):
    return spark.createDataFrame([(1, "alpha word7 word399"), (2, "beta gamma")], "request_id long, query string")


def same_as_new(spark, path, texts, tmp_path):
    got = refresh.load(spark, path)
    new = refresh.refresh(spark, docs_of(spark, texts), f"{path}-new-{len(list(tmp_path.iterdir()))}").index
    assert state(got) == state(new)
    for one, other in ((got.bm25.terms, new.bm25.terms), (got.bm25.stats, new.bm25.stats), (got.search(asked(spark)), new.search(asked(spark)))):
        rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
        assert rounded(one) == rounded(other)


def test_only_changes_are_split(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    texts = {k: f"alpha text{k} {LONG if k % 4 == 0 else 'beta'}" for k in range(20)}
    first = refresh.refresh(spark, docs_of(spark, texts), path)
    assert (first.split, first.kept, first.dropped, first.index.generation) == (20, 0, 0, 0)
    again = refresh.refresh(spark, docs_of(spark, texts), path)
    assert (again.split, again.kept, again.dropped, again.index.generation) == (0, 20, 0, 0)
    texts = {k: (f"gamma {t}" if k % 5 == 0 else t) for k, t in texts.items() if k % 7} | {99: "alpha beta new"}
    third = refresh.refresh(spark, docs_of(spark, texts), path)
    assert (third.split, third.kept, third.dropped) == (4, 14, 6)  # three changed and a new one; three gone
    parts = {r["held"]: r["n"] for r in spark.read.schema(refresh.CHUNKS).parquet(f"{path}/chunks").groupBy("held").agg(F.countDistinct("source").alias("n")).collect()}
    assert parts == {0: 20, 1: 4}
    same_as_new(spark, path, texts, tmp_path)
    packed = refresh.compact(spark, path)
    assert packed.generation == 2 and {r["held"] for r in packed.sources.select("held").distinct().collect()} == {2}
    same_as_new(spark, path, texts, tmp_path)
    texts[3] = "back to gamma"
    assert refresh.refresh(spark, docs_of(spark, texts), path).split == 1
    same_as_new(spark, path, texts, tmp_path)


def test_a_refresh_that_fails_is_repeated(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/i"
    texts = {k: f"alpha text{k} beta" for k in range(8)}
    refresh.refresh(spark, docs_of(spark, texts), path)
    texts[2] = "gamma now"
    write = refresh._write

    def failing(rows, where, by):
        if where.endswith("/sources"):
            raise RuntimeError("lost")
        write(rows, where, by)

    monkeypatch.setattr(refresh, "_write", failing)
    try:
        refresh.refresh(spark, docs_of(spark, texts), path)
    except RuntimeError:
        pass
    monkeypatch.setattr(refresh, "_write", write)
    assert ("official_md/2.md", 1, "alpha text2 beta") in state(refresh.load(spark, path))
    assert refresh.refresh(spark, docs_of(spark, texts), path).split == 1
    same_as_new(spark, path, texts, tmp_path)


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    rows = spark.createDataFrame([("a.md", "one", 1), ("a.md", "two", 1), ("b.md", None, 1), (None, "lost", 1)], "source string, text string, key int")
    found = refresh.refresh(spark, rows, path)
    assert found.split == 2 and state(found.index) == [("a.md", 1, "two")]
    gone = refresh.refresh(spark, rows.limit(0), path)
    assert (gone.split, gone.kept, gone.dropped) == (0, 0, 2) and state(gone.index) == [] and gone.index.search(asked(spark)).count() == 0


def test_lexicon_hits_like_contains(spark):
    words = [f"w{a}{b}" for a in range(60) for b in range(20)] + ["w1", "w12", "Ä", "a b", "", None, "한도", "W3"]
    texts = [(k, f"x W{k % 60}{k % 20}y ä 최대한도 a b" * (k % 3)) for k in range(50)] + [(7, None), (None, "w11"), (8, "w100 w1000 " * 20_000)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, word string")
    lex = spark.createDataFrame([(w, k) for w in words for k in ("rule", "case" if w and "1" in w else "rule")], "word string, kind string")
    want = sorted((str(i), sorted({w.lower() for w in words if w and w.lower() in t.lower()})) for i, t in texts if t and any(w and w.lower() in t.lower() for w in words))
    assert sorted((str(r["id"]), r["words"]) for r in lexicon.hits(docs, lex).collect()) == want
    merged = {}
    for r in lexicon.hits(docs, lex, block_chars=900).collect():
        merged.setdefault(r["row"], (str(r["id"]), set()))[1].update(r["words"])
    assert sorted((i, sorted(w)) for i, w in merged.values()) == want
    counted = {(str(r["id"]), r["kind"], r["n"]) for r in lexicon.counts(docs, lex).collect()}
    for i, found in want:
        assert (i, "rule", len(found)) in counted
        if some := [w for w in found if "1" in w]:
            assert (i, "case", len(some)) in counted
    assert lexicon.hits(docs, lex.limit(0)).count() == 0 and lexicon.counts(docs.limit(0), lex).count() == 0


def test_lexicon_and_profile_agree(spark):
    from marlpit.operators import profile

    lex = profile.Lexicon()
    table = spark.createDataFrame([(k, w) for k in ("system", "case", "official") for w in getattr(lex, k)], "kind string, word string")
    docs = spark.createDataFrame([(1, "전산 화면 hug HF 가능한가"), (2, "none")], "doc_id long, text string")
    got = {(r["id"], r["kind"]): r["n"] for r in lexicon.counts(docs, table).collect()}
    for r in docs.select("doc_id", profile.profile(F.col("text")).alias("p")).collect():
        for kind in ("system", "case", "official"):
            assert got.get((r["doc_id"], kind), 0) == r["p"][f"{kind}_score"]


def test_weights_are_the_same_as_of_a_built_index(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c")], "doc_id long, text string")
    built = lexical.build(docs)
    assert sorted(r["term"] for r in built.terms.collect()) == ["a", "b", "c"]
