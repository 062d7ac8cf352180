"""Language identification and toxicity: gradients, held-out accuracy, edge cases."""

import numpy as np
import pytest

from marlpit.llm import langid, toxicity

EDGE = [None, "", "123 ---", "a", "wort " * 50_000]


def test_gradients_match_finite_differences():
    net = langid.Network(["a", "b"], hidden=3)
    x = np.frombuffer(b"abcdzqrstuvwxyz ", dtype=np.uint8).reshape(4, 4)
    target = np.array([[1.0, 0, 0], [0.25, 0.75, 0], [0, 1.0, 0], [0, 0, 1.0]])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        f = net.states(x.T, "f")[0]
        b = net.states(x.T[::-1], "b")[0][::-1]
        p = langid._softmax(np.concatenate([f, b], axis=2) @ net.p["w"] + net.p["c"])
        return -(np.log(p) * target).sum(axis=2).mean()

    grads = net.gradients(x, target)
    rng = np.random.default_rng(0)
    for k, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in g.shape) if k[0] != "i" else (int(x[rng.integers(4), rng.integers(4)]), int(rng.integers(g.shape[1])))
            old, step = net.p[k][at], 1e-5
            net.p[k][at] = old + step
            up = loss()
            net.p[k][at] = old - step
            down = loss()
            net.p[k][at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-7)


@pytest.fixture(scope="module")
def network(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.fit(docs.where(langid.fold("doc_id", 5) != 0))


def test_held_out_language(spark, network):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(langid.fold("doc_id", 5) == 0)
    got = langid.identify(docs, network).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, network):
    df = spark.createDataFrame([(i if i else None, t, 1, 2) for i, t in enumerate(EDGE)], "doc_id long, text string, lang_pred int, score int")
    got = {r["doc_id"]: r for r in langid.identify(df, network).collect()}
    assert [got[i if i else None]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[3]["lang_pred"] in network.languages and got[4]["lang_pred"] in network.languages
    assert langid.keep_identified(df, network).columns == df.columns and langid.keep_identified(df, network).count() == 2
    assert langid.identify(df.limit(0), network).count() == 0
    assert langid.fit(df.limit(0).selectExpr("text", "'x' as lang")) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.keep_identified(df, None).count() == 2


@pytest.mark.parametrize("text", ["½", "²", "Ⅳ", "１２", "\u0301", "№ 12", "___"])
def test_texts_without_a_letter(network, text):
    assert langid.Identifier(network)([text]) == [("und", 0.0, 0)]


def test_pieces_equal_one_pass_over_the_whole_text(spark, network):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 2000").orderBy("doc_id").limit(25).collect()
    texts = [r["text"] for r in rows] + ["A", "été 12", "x" * langid.PIECE, "ab " * 300, "y" * (langid.PIECE + 1)]
    states_last = {"ab " * 300, "y" * (langid.PIECE + 1)}  # one run of equal letters is remembered from its start on
    got = langid.Identifier(network, rows=16)(texts)
    other = langid.Identifier(network)(texts[::-1])[::-1]  # other neighbours in a batch
    for text, (lang, score, positions), again in zip(texts, got, other, strict=True):
        p = network.whole(text.lower().encode())
        assert again[0] == lang and again[1] == pytest.approx(score, abs=1e-5)
        if text in states_last:
            continue
        assert score == pytest.approx(p.mean(axis=0)[:-1].max(), abs=5e-3)
        assert lang == network.languages[int(p.mean(axis=0)[:-1].argmax())]
        assert positions == pytest.approx((p.argmax(axis=1) == network.languages.index(lang)).sum(), abs=2 + len(p) / 100)


def test_every_byte_has_a_label_that_its_neighbours_sway(network):
    label = langid.Identifier(network)
    for text in ("Der Hund, 12 éà the", "", "½", "ß" * 1000):
        assert len(label.positions(text)) == len(text.lower().encode())
    left, right = "la maison de une la que les pour ", " le dans une pour les que la"
    before, after = "nicht auch der und die ein ", " und nicht die der auch ein"
    word = "des"  # French and German have it
    one = label.positions(left + word + right)[len(left) : len(left) + 3]
    two = label.positions(before + word + after)[len(before) : len(before) + 3]
    assert one != two and set(two) == {"de"}


def test_repeated_rows_and_ties(network):
    label = langid.Identifier(network)
    one, two, three = label(["und der die", "the of and", "und der die"])
    assert one == three and one != two
    flat = langid.Network(["a", "b"])
    flat.p = {k: np.zeros_like(v) for k, v in flat.p.items()}
    assert langid.Identifier(flat)(["text"])[0][:2] == ("a", pytest.approx(1 / 3))


def test_letters_of_no_language_score_low(network):
    label = langid.Identifier(network)
    rng = np.random.default_rng(1)
    junk = [" ".join("".join(map(chr, rng.integers(97, 123, 7))) for _ in range(60)) for _ in range(20)]
    assert np.mean([score < 0.05 for _, score, _ in label(junk)]) > 0.9


def test_a_hot_text_and_many_languages(spark):
    rows = [("lorem ipsum dolor", "aa")] * 3000 + [(f"{chr(97 + i % 26)}{i} wort", f"l{i:03d}") for i in range(300)]
    found = langid.fit(spark.createDataFrame(rows, "text string, lang string"), batches=1)
    assert len(found.languages) == 301


@pytest.fixture(scope="module")
def classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels.where(langid.fold("doc_id", 4) != 2), sample_docs=3000, sample_bytes=8 << 20)


def test_held_out_toxicity(spark, classifier):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels.where(langid.fold("doc_id", 4) == 2).select("doc_id", "toxic"), "doc_id")
    got = toxicity.scores(held, classifier).join(held.select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit / sum(r["toxic"] for r in got) > 0.85 and hit / sum(r["predicted"] for r in got) > 0.85
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_training_beats_the_untrained_network(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").where("toxic is not null and text is not null").orderBy("doc_id").collect()
    learn, held = rows[: 3 * len(rows) // 4], rows[3 * len(rows) // 4 :]
    found = []
    for epochs in (0, None):
        c = toxicity.Classifier()
        c.train([r["text"] for r in learn], np.array([r["toxic"] for r in learn]), [r["lang"] for r in learn], epochs=epochs)
        score = np.array(toxicity.Scorer(c)([r["text"] for r in held]))
        toxic = np.array([r["toxic"] for r in held]) == 1
        found.append(((score >= 0.3)[toxic].mean(), (score >= 0.3)[~toxic].mean()))
    assert found[1][0] > 0.8 and found[1][1] < 0.02 and found[0][0] < 0.3


def test_words_never_seen_have_the_vectors_of_their_buckets(classifier):
    at = classifier.features("neverseenwordofanykind")
    assert np.abs(classifier.table[list(at)]).sum(axis=1).min() > 0 and classifier.features("neverseen")[1] == at[1]
    scorer = toxicity.Scorer(classifier)
    assert scorer(["neverseenwordofanykind"]) != scorer([""])


def test_scorer_equals_the_plain_network(classifier):
    texts = ["the stupid idiot", "", None, "a", "thea the of " * 30, "moron", "moron"]
    got = toxicity.Scorer(classifier)(texts)
    assert got[-1] == got[-2]
    for t, s in zip(texts, got, strict=True):
        ids = np.array([classifier.features(w) for w in toxicity.words(t)], dtype=np.int64).reshape(-1, 2)
        p = classifier._forward([ids])[-1][0]
        lang = classifier._language(classifier.language_rows[ids[:, 0]].sum(axis=0))
        assert s == pytest.approx(classifier.shifted(np.log(p / (1 - p)), [lang])[0], abs=1e-3)


def test_labels_with_clashing_columns(spark, classifier):
    docs = spark.createDataFrame([(i, f"{'wretched vermin' if i % 2 else 'pleasant walk'} number{i}", "en", i % 2) for i in range(60)], "doc_id long, text string, lang string, toxic int")
    labels = spark.createDataFrame([(i, i % 2, "x", "y") for i in range(60)] + [(None, 1, "x", "y"), (1, None, "x", "y")], "doc_id long, toxic int, text string, lang string")
    found = toxicity.fit(docs, labels)
    assert {r["doc_id"] for r in toxicity.scores(docs, found).where("predicted = 1").collect()} == set(range(1, 60, 2))


def test_toxicity_edges(spark, classifier):
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(EDGE)], "doc_id long, text string, predicted int")
    got = toxicity.scores(df, classifier).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scores(df.limit(0), classifier).count() == 0
    assert {r["score"] for r in toxicity.scores(df, None).collect()} == {0.0}
    assert toxicity.keep_clean(df, classifier).columns == df.columns
    no = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert toxicity.fit(no, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")) is None


def test_one_huge_labelled_text_does_not_end_the_toxicity_sample(spark):
    from pyspark.sql import functions as F

    order = [r["id"] for r in spark.range(80).orderBy(F.xxhash64("id"), "id").collect()]
    toxic = set(order[::2])
    huge = order[0]  # drawn first of its label
    text = lambda i: f"{'wretched vermin scum' if i in toxic else 'pleasant morning walk'} number{i} and some more words"
    docs = spark.createDataFrame([(i, text(i) * (2000 if i == huge else 1), "en") for i in range(80)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(80)], "doc_id long, toxic int")
    found = toxicity.fit(docs, labels, sample_bytes=40_000)
    assert found is not None
    small = docs.where(F.col("doc_id") != huge)
    assert {r["doc_id"] for r in toxicity.scores(small, found).where("predicted = 1").collect()} == toxic - {huge}
    assert {r["doc_id"] for r in toxicity.keep_clean(small, found).collect()} == set(range(80)) - toxic
    alone = docs.where((F.col("doc_id") == huge) | ~F.col("doc_id").isin(*toxic))  # the label has no other row
    assert toxicity.fit(alone, labels, sample_bytes=40_000) is not None


def test_one_huge_text_in_the_language_sample(spark):
    docs = spark.createDataFrame([(f"{w} {i} {w}wort", lang) for lang, w in (("aa", "lorem"), ("bb", "kannu")) for i in range(6)] + [("ipsum " * 300_000, "cc")], "text string, lang string")
    assert langid.fit(docs, batches=2).languages == ["aa", "bb", "cc"]


def test_fitting_passes_over_what_does_not_fit():
    from marlpit.llm.common import fitting

    assert fitting([99, 3, 4, 50, 5], 60, 9, 10) == [1, 2, 4]
    assert fitting([99, 3, 4, 48, 5], 60, 9, 10) == [1, 2, 4, 3]
    assert fitting([99, 3, 4, 5], 60, 2, 10) == [1, 2]
    assert fitting([99, 98], 60, 2, 10) == [1] and fitting([], 60, 2, 10) == []


def test_many_languages_take_bounded_memory():
    import tracemalloc

    from marlpit.llm.toxicity import Classifier, Scorer

    rng = np.random.default_rng(3)
    texts, langs, labels = [], [], []
    for k in range(6000):
        lang = k % 500 if k < 5500 else 500 + k  # 500 languages of eleven rows, and many of one
        texts.append(" ".join(f"l{lang}w{x}" for x in rng.integers(0, 50, 30)) + (" bad" if k % 2 else ""))
        langs.append(f"l{lang}" if lang else None)
        labels.append(k % 2)
    more = [" ".join(f"big{b}w{x}" for x in rng.integers(0, 50, 30)) + (" bad" if k % 2 else "") for b in range(60) for k in range(40)]
    langs += [f"big{b}" for b in range(60) for _ in range(40)]
    tracemalloc.start()
    c = Classifier(buckets=1 << 14)
    c.train(texts + more, np.array(labels + [k % 2 for _ in range(60) for k in range(40)]), langs, epochs=1)
    got = Scorer(c)([more[1], more[-1], "", None, "unknown words " * 300_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.languages[-1] == "" and len(c.languages) == 61 and c.language_rows.size <= 1 << 22
    assert peak < 600e6 and len(got) == 5
    full = Classifier()
    full._fit_languages([np.array([[k % 8_000, 0]]) for k in range(16_000)], [f"x{k % 500}" for k in range(16_000)])
    assert len(full.languages) == 500 and full.language_rows.nbytes <= 4 << 22
    assert full._language(full.language_rows[full.folded(np.array([7]))].sum(axis=0)) == "x7"
