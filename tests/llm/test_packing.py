"""Packing: exact tokens, exact pieces, little padding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlpit.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abz 'sS'TÉé²½_\n\t.9ΣςİßÁ \x1c<|>endoftext")), max_size=40))
def test_ids_are_the_tokenizers(tokenizer, t):
    own = packing._word_tokens(PATH)
    want = np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert list(own([t, None, t])) == [want, b"", want]


def test_other_tokenizers_encode_whole_texts():
    assert packing._word_tokens(PATH).by_word
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = packing._word_tokens(path), Tokenizer.from_file(path)
    assert not own.by_word
    for t in ("Some words, and  spaces\n", "Größe 12", "", None):
        want = np.array(plain.encode(t, add_special_tokens=False).ids if t else [], dtype="<u4").tobytes()
        assert list(own([t])) == [want]


def test_a_word_tokenizer_that_splits_otherwise(tmp_path):
    import json

    data = json.loads(open(PATH, encoding="utf-8").read())
    data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+"
    (tmp_path / "t.json").write_text(json.dumps(data), encoding="utf-8")
    own, plain = packing.WordTokens(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not own.by_word and list(own(["it's 12 o'clock"])) == [np.array(plain.encode("it's 12 o'clock", add_special_tokens=False).ids, dtype="<u4").tobytes()]


def check(rows, docs, tokenizer, window):
    """Every id in exactly one piece, sequences gapless and at most the window; returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, t in docs:
        ids = tokenizer.encode(t, add_special_tokens=False).ids if t else []
        data = np.array([*ids, 2], dtype="<u4").tobytes()
        pieces = sorted(by_doc.pop(d), key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p["length"] for p in pieces) * 4 == len(data) and {p["doc_tokens"] for p in pieces} == {len(data) // 4}
        for p in pieces:
            part = data[4 * p["start"] : 4 * (p["start"] + p["length"])]
            assert p["ids_crc32"] == zlib.crc32(part) and p["length"] > 0
            if "ids" in p:
                assert bytes(p["ids"]) == part
    assert not by_doc
    padding = total = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
        n = sum(p["length"] for p in pieces)
        assert n <= window
        total += n
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding / max(1, total)


def test_round_trip(spark, tiny, tokenizer):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").repartition(3)
    rows = [r.asDict() for r in packing.pack(docs, PATH, keep_ids=True).collect()]
    assert check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, 4096) < 0.01


def test_many_partitions_small_windows(spark, tokenizer):
    rng = random.Random(0)
    docs = [(i, "word " * rng.randrange(0, 300)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(19)
    rows = [r.asDict() for r in packing.pack(df, PATH, window=128, open_windows=4, slack=2, merge_fan=4).collect()]
    assert check(rows, docs, tokenizer, 128) < 0.02
    assert len({r["sequence_id"] for r in rows}) < 1.1 * sum(r["length"] for r in rows) / 128 + 5 * 8


def test_edges(spark, tokenizer):
    docs = [(1, None), (2, ""), (None, "a"), (3, "long " * 60_000), (4, "日本語 <|endoftext|> x")]
    df = spark.createDataFrame([(d, t, 0, 0) for d, t in docs], "doc_id long, text string, start int, offset int")
    rows = [r.asDict() for r in packing.pack(df, PATH).collect()]
    check(rows, docs, tokenizer, 4096)
    twice = [r.asDict() for r in packing.pack(df.where("doc_id = 1").union(df.where("doc_id = 1")), PATH).collect()]
    assert sorted((r["start"], r["length"]) for r in twice) == [(0, 1), (0, 1)] or len(twice) == 2
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_ties_between_windows_go_to_the_first():
    windows = packing._Windows(10, 4, 0, 0)
    data = lambda n: np.arange(n, dtype="<u4").tobytes()
    for doc in ("a", "b", "c"):
        assert list(windows.place(doc, 0, data(6), 6)) == []
    assert list(windows.place("d", 0, data(3), 3)) == []
    assert [[p[0] for p in w[1]] for w in windows.open] == [["a", "d"], ["b"], ["c"]]


def test_a_worker_forgets_the_words_before_tasks_of_other_modules():
    from marlpit.llm import common

    own = packing._word_tokens(PATH)
    for module in (packing.__name__, packing.__name__):
        common._begin(module)
        assert packing._word_tokens(PATH) is own
    common._begin("marlpit.llm.langid")
    assert packing._word_tokens(PATH) is not own
