import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlpit.functions import kms, markup, text
from marlpit.operators import chunking, metadata
from marlpit.sources import files, sinks
from tests.conftest import rows


def test_strip_and_tokens_know_unicode_space(spark):
    got = spark.range(1).select(text.strip(F.lit("　x\t")), text.tokens(F.lit("a b　 c")), text.tokens(F.lit(""))).first()
    assert list(got) == ["x", ["a", "b", "c"], []]


def test_front_matter_golden(spark):
    one = "---\ndoc_code: \"LD10\"\nsection_no: 10.1.8\nratio: 3:7\nk: 1\nk: 2\nf:\n - \"f (ID: 3)\"\n---\n\nbody"
    df = spark.createDataFrame([(one,), ("no header",), ("---\nopen: 1",), ("",), (None,), (one.replace("\n", "\r\n"),)], "t string")
    got = [r[0] for r in df.select(metadata.front_matter(F.col("t"))).collect()]
    assert got[0]["meta"] == {"doc_code": "LD10", "section_no": "10.1.8", "ratio": "3:7", "k": "2", "f": ""}
    assert got[0]["lists"] == {"f": ["f (ID: 3)"]} and got[0]["body"] == "body"
    assert got[1]["meta"] == {} and got[1]["body"] == "no header"
    assert got[2]["meta"] == {} and got[2]["body"] == "---\nopen: 1"
    assert got[3]["body"] == "" and got[4]["body"] is None
    assert got[5]["meta"] == got[0]["meta"] and got[5]["body"] == "body"


def test_front_matter_lists_belong_to_their_keys(spark):
    one = "---\na:\n - \"x: 1\"\n - y\nb: 2\n - stray\nc:\n- 'z'\nc:\n- w\nd: [p, \"q\", ]\ne: []\nno colon\n---\nbody"
    got = spark.createDataFrame([(one,)], "t string").select(metadata.front_matter(F.col("t")).alias("f")).first()["f"]
    assert got["lists"] == {"a": ["x: 1", "y"], "c": ["w"], "d": ["p", "q"]}
    assert got["meta"]["b"] == "2" and got["body"] == "body"


def test_category_depths(spark):
    df = spark.createDataFrame([({"분류": "a >  b > c", "x": "1"},), ({"분류": "분류 없음"},), ({},)], "m map<string,string>")
    got = [r[0] for r in df.select(metadata.category_depths(F.col("m"))).collect()]
    assert got[0] == {"분류": "a >  b > c", "x": "1", "category_depth1": "a", "category_depth2": "b", "category_depth3": "c"}
    assert got[1] == {"분류": "분류 없음"} and got[2] == {}


def test_numbered_rules_golden():
    lines = ["개정이력", "10.1 알파론", "소개 문장", "1. 개요", "본문A", "", "2. 시기", "10.1.8 한도", "최대 2억원"]
    got = [(s["major_no"], s["sub_no"], s["body"]) for s in chunking.numbered_sections("\n".join(lines))]
    assert got == [("10.1", "1", "본문A"), ("10.1", "2", ""), ("10.1", None, "소개 문장"), ("10.1.8", None, "최대 2억원")]
    assert chunking.numbered_sections("1. no heading before") == [] == chunking.numbered_sections("") == chunking.numbered_sections("text\n")
    assert [(s["sub_no"], s["body"]) for s in chunking.numbered_sections("1. early\n10.1 T\r\n\r\n1. A\n10.2 U\n")] == [("1", "")]


def test_paragraph_pack_golden():
    got = chunking.pack_paragraphs("aaaa\n\nbbbb\n\n" + "c" * 22, 10, 3)
    assert got[0] == "aaaa\n\nbbbb" and [len(x) for x in got] == [10, 10, 10, 8, 1]
    assert chunking.pack_paragraphs("", 10, 3) == [""]
    with pytest.raises(ValueError):
        chunking.pack_paragraphs("x" * 30, 5, 5)


@given(st.lists(st.text(alphabet="ab ", max_size=25), max_size=20), st.integers(4, 20), st.integers(0, 3))
def test_packed_paragraphs_are_the_greedy_ones(paragraphs, most, overlap):
    text = "\n\n".join(paragraphs)
    got = chunking.pack_paragraphs(text, most, overlap)
    if len(text) <= most:
        assert got == [text]
        return
    assert all(0 < len(x) <= most and x == x.strip() for x in got)
    whole = [x.strip() for x in paragraphs if x.strip()]
    if all(len(x) <= most for x in whole):
        assert "\n\n".join(got) == "\n\n".join(whole)
        for one, two in zip(got, got[1:], strict=False):
            assert len(one) + 2 + len(two.split("\n\n")[0]) > most


@given(st.text(alphabet="ab \n", max_size=200), st.integers(5, 30), st.integers(0, 4))
def test_recursive_pieces_fit_and_lose_no_letter(t, size, overlap):
    got = chunking.recursive_split(t, size, overlap)
    assert all(0 < len(x) <= size and x == x.strip() for x in got)
    if not overlap:
        assert "".join("".join(got).split()) == "".join(t.split())


def test_recursive_overlap():
    assert chunking.recursive_split("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]


def test_header_sections():
    t = "intro\n# A\nx\n## B\ny\n```\n# not\n```\n### C\n# D\nz"
    got = [(s["title"], s["section"], s["subsection"]) for s in chunking.header_sections(t)]
    assert got == [(None, None, None), ("A", None, None), ("A", "B", None), ("A", "B", "C"), ("D", None, None)]


def test_route_by_folder_and_rule(spark):
    rule, faq = "./내규소수2_md/10.1.md", "./faq_output_md/a.md"
    data = [("whole", rule, None, "x" * 3000), ("long", rule, None, "y " * 2000), ("faq", faq, None, "z " * 1100), ("null", faq, None, None), ("elsewhere", "rules/10.1.md", "internal_rule", "w " * 500), ("name", "./misc/faq.md", None, "v " * 500), ("empty", rule, None, ""), ("none", None, None, "a"), ("kind", "./내규소수2_md/b.md", None, "u" * 2900)]
    df = spark.createDataFrame(data, "key string, source string, doc_type string, text string")
    got = chunking.route(df).groupBy("key").agg(F.min("chunk_id"), F.max("chunk_id"), F.max(F.length("text"))).orderBy("key").collect()
    assert [tuple(r) for r in got] == [("elsewhere", 1, 2, 799), ("empty", 1, 1, 0), ("faq", 1, 2, 1999), ("kind", 1, 1, 2900), ("long", 1, 2, 2999), ("name", 1, 2, 799), ("none", 1, 1, 1), ("whole", 1, 1, 3000)]


def test_section_chunks(spark):
    docs = spark.createDataFrame([(1, "10.1 T\n1. I\n" + "\n\n".join("p" * 50 for _ in range(4)))], "doc_id long, text string")
    got = chunking.section_chunks(chunking.sections(docs), "LD10", most=110, overlap=20).orderBy("chunk_id").collect()
    assert [r["part_no"] for r in got] == [1, 2] and [r["chunk_id"] for r in got] == [1, 2]
    assert got[0]["text"].startswith("[문서] LD10\n[대분류] 10.1 T\n[세부항목] 1. I\n\npp") and got[0]["text_len"] == len(got[0]["text"])


def test_table_markdown_golden():
    html = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>x<table><tr><td>n</td></tr></table></td></tr></table>"
    assert markup.body_text(html) == "| A | B |\n| --- | --- |\n| 1 | x |\n\n| n |\n| --- |"


def test_deep_and_nested_markup():
    deep = "<div>" * 20_000 + "text" + "<table><tr><td>" * 300 + "cell"
    assert markup.body_text(deep).startswith("text\n") and "cell" in markup.body_text(deep) and markup.page_lines("<b>" * 20_000 + "x") == ["x"]
    nested = "<table><tr><td>a<table><tr><td>b<table><tr><td>c</td></tr></table></td></tr></table></td><td>d<table><tr><td>e</td></tr></table></td></tr></table>"
    assert markup.body_text(nested).split("\n\n") == ["| a | d |\n| --- | --- |", "| b |\n| --- |", "| c |\n| --- |", "| e |\n| --- |"]
    assert markup.body_text("<a href='/x'>one <a href='/y'>two</a></a><table><tr><td><a href='z'>l</a></td></tr></table>", "B") == "[one[two](B/y)](B/x)\n| [l](z) |\n| --- |"


def test_links_and_lines():
    assert markup.body_text('<p>see <a href="/x"> here </a><a href="http://y">z</a><a>w</a></p>', "https://b") == "see\n[here](https://b/x)\n[z](http://y)\nw"
    assert markup.page_lines("<title>t</title><p>a<br>b</p><script>no</script><p>a</p>") == ["a", "b"]
    assert markup.body_text("<td>loose<b>bold") == "loose\nbold" and markup.body_text(None) == ""


def _model(**kw):
    import json

    base = {"gid": 1, "id": 1, "title": "T", "author": {"displayName": "A"}, "lastUpdt": 1600000000000, "trnsSrc": "x", "attachments": [{"filename": "f", "id": 3}], "content": "<p>c</p>"}
    return f'<body catalog="/p/SVC/catalog.xml.jsp">var model = {json.dumps(base | kw)};</body>'


def test_knowledge_markdown(spark):
    data = [
        (None, "kms", "m1", _model(folders=[{"path": ["a", "b"]}])),
        (None, "kms", "m2", _model(folders=[{"path": ["c"]}])),
        ("1", "kms", "p1", _model()),
        ("2", "kms", "p2", _model(id=2)),
        ("3", "doc", "p3", "nothing"),
        ("4", "doc", "p4", "model = {oops};"),
    ]
    got = {r["pk"]: r for r in files.knowledge_markdown(spark.createDataFrame(data, "id string, type string, pk string, result string")).collect()}
    assert got["p1"]["path"] == "c" and got["p1"]["shown_id"] == "svc_1" and got["p2"]["shown_id"] == "svc_1_2"
    assert got["p1"]["text"].split("\n")[0] == "---" and '첨부파일:\n - "f (ID: 3)"\n---\n\n# T\n\nc' in got["p1"]["text"]
    assert got["p3"]["error"] == "no model" and got["p3"]["text"] is None and got["p4"]["error"] == "malformed model"


def test_legacy_and_no_date(spark):
    got = spark.range(1).select(kms.legacy(F.lit(kms.LEGACY_CODES[0])), kms.legacy(F.lit(None).cast("string")), kms.updated_at(F.lit(0))).first()
    assert list(got) == [True, False, "N/A"]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ndoc_type: internal_rule\n---\nx", encoding="utf-8")
    (tmp_path / "b.md").write_bytes(b"\x81\x00\xff bad")
    (tmp_path / "c.md").write_bytes("한글".encode("cp949"))
    (tmp_path / "d.md").write_bytes("wide".encode("utf-16"))
    (tmp_path / "e.md").write_bytes(b"\xef\xbb\xbfmark")
    (tmp_path / "f.txt").write_text("no")
    got = {r["source"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in files.scan_texts(spark, [f"file://{tmp_path} ", "file:///nowhere"]).collect()}
    assert got == {"a.md": ("---\ndoc_type: internal_rule\n---\nx", None), "b.md": (None, "unknown encoding"), "c.md": ("한글", None), "d.md": ("wide", None), "e.md": ("mark", None)}
    assert files.scan_texts(spark, ["file:///nowhere"]).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_text(spark, "file:///nowhere")
    with pytest.raises(ValueError):
        files.read_text(spark, f"file://{tmp_path}/b.md")
    df = spark.createDataFrame([(2, "b" * 900), (1, "a")], "chunk_id int, text string")
    assert rows(sinks.preview(df, 1)) == [(1, "a")]
    for _ in range(2):
        sinks.append_diagnostics(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_markdown_replaces_by_key_and_keeps_the_others(spark, tmp_path):
    path, wrong = f"file://{tmp_path}/md", f"file://{tmp_path}/wrong"
    schema = "pk string, shown_id string, path string, text string, error string"
    made = lambda *rows_: spark.createDataFrame([(pk, "s", "p", text, error) for pk, text, error in rows_], schema)
    sinks.write_markdown(made(("1", "a", None), ("2", "b", None), (None, "n", None), ("4", None, "bad")), path, wrong)
    sinks.write_markdown(made(("2", "c", None), ("3", "d", None), ("3", "e", None), (None, "m", None), ("5", None, "worse")), path, wrong)
    assert {(r["pk"], r["text"]) for r in spark.read.parquet(path).collect()} == {("1", "a"), ("2", "c"), ("3", "e"), (None, "m")}
    assert spark.read.parquet(path).count() == 4
    assert {(r["pk"], r["error"]) for r in spark.read.parquet(wrong).collect()} == {("4", "bad"), ("5", "worse")}
    sinks.write_markdown(made().limit(0), path, wrong)
    assert spark.read.parquet(path).count() == 4


def test_pages_of_one_title(spark):
    data = [(i, f"u{i}", "t", [f"l{i}"]) for i in range(25)] + [(30, "u30", "", ["x"]), (31, "u31", None, ["y"]), (32, "u32", "t2", [])]
    pages = spark.createDataFrame(data, "page_id long, url string, title string, lines array<string>")
    got = files.merge_by_title(pages, "I", "D", most_pages=10).collect()
    parts = sorted((r["part"], r["pages"]) for r in got if r["title"] == "t")
    assert [p for p, _ in parts] == [1, 2, 3] and sum(n for _, n in parts) == 25
    assert sum(r["title"] == "" for r in got) == 2 and sum(r["text"].count("\nl") for r in got) == 25
    whole = {r["title"]: r for r in files.merge_by_title(pages, "I", "D").collect()}
    assert whole["t"]["pages"] == 25 and whole["t"]["text"].endswith("\n".join(f"l{i}" for i in range(25)))
    assert files.merge_by_title(pages.limit(0), "I", "D").count() == 0


def test_corpus_header(spark):
    doc = "# 상품명: t\n기관명: I\n원본 URL: http://a | http://b\n수집일: 2026-03-23 17:47:50\n출처유형: WEB\n\n## 기타\nl1\nl2"
    got = spark.range(1).select(files.corpus_header(F.lit(doc)).alias("h")).first()["h"]
    assert got["urls"] == ["http://a", "http://b"] and got["title"] == "t" and got["body"] == "l1\nl2"


def test_trim_front(spark):
    got = spark.createDataFrame([("x\n\n10.1 T\ny ",), (" none ",)], "t string").select(chunking.trim_front(F.col("t"))).collect()
    assert [r[0] for r in got] == ["10.1 T\ny", "none"]


SAID = {
    "euc-kr": "주택도시보증공사의 전세보증금 반환보증 한도는 최대 2억원입니다. 신청 대상과 금리를 확인하십시오.",
    "gbk": "中国人民银行今天宣布，将从下个月起调整住房贷款利率。这项政策对购房者有利，但是需要注意风险。",
    "shift_jis": "住宅ローンの金利は来月から変更されます。詳しくは窓口にお問い合わせください。カタカナも使います。",
    "windows-1251": "Банк сообщил, что ставки по ипотеке изменятся со следующего месяца. Подробности в отделении.",
    "latin-1": "L'évaluation des prêts à été modifiée; les intérêts, déjà élevés, pourraient être réduits. Größe über Straße.",
}


def test_encodings_are_told_or_unknown():
    import random

    from marlpit.sources.encodings import detect

    for name, text in SAID.items():
        for data in (text[:8].encode(name), text.encode(name), (text * 4_000).encode(name), ("plain words before it " * 20 + text).encode(name)):
            assert detect(data)[1] == data.decode(name), name
        for wide in ("utf-16-le", "utf-16-be", "utf-16", "utf-32", "utf-8-sig", "utf-8"):
            assert detect(text.encode(wide))[1] == text, (name, wide)
    assert detect("plain words only".encode("utf-16-le"))[1] == "plain words only"
    rng = random.Random(2)
    for size in (2, 10, 50, 200, 3_000):
        for _ in range(40):
            assert detect(bytes([0x98, 0x81, 0xFF] + [rng.randrange(256) for _ in range(size)])) is None
    declared = f'<meta charset="euc-kr"><p>{SAID["euc-kr"][:1]} {"x" * 50}</p>'.encode("euc-kr")
    assert detect(declared) is None or detect(declared)[1] == declared.decode("euc-kr")
    lying = f'<meta charset="euc-kr">{SAID["windows-1251"]}'.encode("windows-1251")
    assert detect(lying)[0] == "windows-1251"


def test_scan_of_all_encodings(spark, tmp_path):
    for k, (name, text) in enumerate(SAID.items()):
        (tmp_path / f"{k}.md").write_bytes(text.encode(name))
    (tmp_path / "wide.md").write_bytes("no mark, plain words".encode("utf-16-be"))
    (tmp_path / "bad.md").write_bytes(b"\x98\x81\xff\x8d")
    (tmp_path / "empty.md").write_bytes(b"")
    got = {r["source"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in files.scan_texts(spark, [f"file://{tmp_path}"]).collect()}
    assert got == {**{f"{k}.md": (t, None) for k, t in enumerate(SAID.values())}, "wide.md": ("no mark, plain words", None), "bad.md": (None, "unknown encoding")}


YAML = """# head
title: |
  two
  lines

k: >-
  folded
  text here

  para
nested:
  a: 1   # one
  b:
    c: "q\\"uo\\n te \\u00e9"
    d: 'it''s'
list:
- x
- "y: z"
-   key: v
    other: w
-
  - inner
  - 2
flow: [a, "b, c", {k: v, m: [1, 2]}, d]
url: http://e.x/a:b#c
empty:
tilde: ~
"quoted key": yes it is
last: end # comment
more: >
  a
    indented
  b


  c
keep: |+
  a

"""


def test_yaml_headers():
    from marlpit.functions import yaml

    assert yaml.load(YAML) == {
        "title": "two\nlines\n", "k": "folded text here\npara", "nested": {"a": "1", "b": {"c": 'q"uo\n te é', "d": "it's"}},
        "list": ["x", "y: z", {"key": "v", "other": "w"}, ["inner", "2"]], "flow": ["a", "b, c", {"k": "v", "m": ["1", "2"]}, "d"],
        "url": "http://e.x/a:b#c", "empty": None, "tilde": None, "quoted key": "yes it is", "last": "end", "more": "a\n  indented\nb\n\nc\n", "keep": "a\n\n",
    }
    assert yaml.load("") is None and yaml.load("a:\n  - b: 1\n    c:\n      - d\n  - e: 2\nf: 1\n") == {"a": [{"b": "1", "c": ["d"]}, {"e": "2"}], "f": "1"}
    for bad in ("a: [1, 2", "a\n b", "- x\ny: 1", "a: 'x", "a: b\n   c: d", "\ta: b", "a: &x 1", 'a: "\\q"', "a: x\n- y", 'a: "b" c', "a: " + "[" * 3000):
        assert yaml.read(bad)["error"], bad
    meta, lists = yaml.flat(yaml.load("a: {b: c}\nl: [x, ~]\nm:\n- k: v\n- [y]"))
    assert meta == {"a.b": "c", "m.0.k": "v"} and lists == {"l": ["x", ""], "m.1": ["y"]}


def test_yaml_front_matter(spark):
    rows = [(1, f"---\n{YAML}---\n body \n"), (2, "no header"), (3, None), (4, "---\na: [1\n---\nrest"), (5, "---\n---\nrest"), (6, "---\na: 1\n---"), (7, "---\na: 1\nnever ends"), (8, "")]
    df = spark.createDataFrame(rows, "id long, t string").select("id", metadata.yaml_front_matter(F.col("t")).alias("y"))
    got = {r["id"]: r["y"] for r in df.collect()}
    assert got[1]["meta"]["nested.b.d"] == "it's" and got[1]["lists"]["list.3"] == ["inner", "2"] and got[1]["body"] == " body \n" and got[1]["error"] is None
    assert [got[k]["body"] for k in range(2, 9)] == ["no header", None, "rest", "rest", "", "---\na: 1\nnever ends", ""]
    assert got[4]["error"] == "] is missing" and got[6]["meta"] == {"a": "1"} and got[7]["meta"] == {} == got[2]["meta"]


def test_stray_tags_are_read_in_linear_time():
    import time

    from marlpit.functions import markup

    began = time.time()
    markup.page_lines("<div>" * 50_000 + "</span>" * 100_000 + "x" + "<table><tr>" * 20_000 + "</div>" * 50_000)
    assert time.time() - began < 5
    assert markup.body_text("<table><tr><td>a</b></div>b</td></tr></table><p>c</table></p>d", "") == "| a b |\n| --- |\nc\nd"
