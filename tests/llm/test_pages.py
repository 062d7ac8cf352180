"""Main text: the cut against brute force, and page shapes."""

import itertools

import numpy as np
import pytest

from marlpit.llm import htmlcut
from marlpit.llm.htmlcut import DEFAULT, blocks_of, label, main_text, minimum_cut


def test_minimum_cut_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        content, boiler = rng.random(n) * 3, rng.random(n) * 3
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda y: sum(content[i] if y[i] else boiler[i] for i in range(n)) + sum(w for u, v, w in edges if y[u] != y[v])  # noqa: E731, B023
        assert cost(minimum_cut(content, boiler, edges)) == pytest.approx(min(map(cost, itertools.product([0, 1], repeat=n))))


def test_series_parallel_networks_equal_augmenting_paths():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(2, 30))
        content, boiler = rng.integers(0, 8, n) / 4, rng.integers(0, 8, n) / 4  # ties are common
        edges = [(i - 1, i, float(rng.integers(0, 5)) / 4) for i in range(1, n)]
        last: dict[int, int] = {}
        for i in range(n):  # nested groups never cross
            if (j := last.get(k := int(rng.integers(1, 4)))) is not None and all(last.get(x, -1) <= j for x in range(1, k)):
                edges.append((j, i, float(rng.integers(0, 5)) / 4))
            last[k] = i
        near: list[dict] = [{} for _ in range(n)]
        for u, v, c in edges:
            if c:
                near[u][v] = near[v][u] = near[u].get(v, 0.0) + c
        assert minimum_cut(content, boiler, edges).tolist() == htmlcut._augmented(list(range(n)), (content - boiler).tolist(), near)


def test_the_cut_overrules_the_labels_of_single_blocks():
    long = "This is a sentence, which goes on for a while, as prose does. And here is another one, just as long as the first."
    page = f"<body><div><div><a href='/'>Home</a></div><div><a href='/n'>News</a></div></div><div><p>{long}</p><p>{long}</p><div>So be it</div><p>{long}</p><p>{long}</p></div></body>"
    blocks, elements = blocks_of(page)
    alone = htmlcut.shape(blocks, elements) @ DEFAULT + htmlcut.evidence(blocks, elements) @ htmlcut.EVIDENCE > 0
    together = label(blocks, elements, DEFAULT)
    at = [b.text for b in blocks].index("So be it")
    assert not alone[at] and together[at] and (alone != together).sum() == 1
    assert main_text(page, DEFAULT) == f"{long}\n{long}\nSo be it\n{long}\n{long}"


def test_pages_of_many_blocks_and_deep_pages_take_seconds():
    import time

    began = time.time()
    weak = "<div>Some words here, and there.</div><div><a href='/'>some link</a></div>"
    got = main_text("<body>" + "".join(f"<div>{weak}<p>Text {i}, of a few words.</p></div>" for i in range(20_000)), DEFAULT)
    assert got.count("Text ") == 20_000
    assert main_text("<article>" + "<div>x " * 20_000, DEFAULT).count("x") == 20_000
    main_text("<p>" + "</div>" * 50_000 + "<title>" * 50_000 + "<p a='" * 3 + "<b>" * 50_000, DEFAULT)
    assert time.time() - began < 30


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="nav-open">
<header><p>Site name and slogan of the whole site.</p></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, as everyone does. Please agree.</p></div>
<article><header><h1>The  title &amp; more</h1></header><p><b>First   paragraph,
with&nbsp;space.<br>and a line<p>Second &lt;one&gt;, unclosed<div class="ad">Buy this now, it is very cheap.</div><ul><li>item one</li><li>item two</li></ul>
<section id="comments"><p>I, a reader, think that this is a good article.</p></section></article>
<aside><p>Other articles that you may like to read some time.</p></aside><form><p>Write your name here, and your address.</p><input></form>
<footer>&copy; all rights</footer></body></html>"""


def test_page():
    assert main_text(PAGE, DEFAULT) == "The title & more\nFirst paragraph, with space. and a line\nSecond <one>, unclosed\nitem one\nitem two"
    assert main_text(PAGE, htmlcut.train([PAGE] * 5)) == main_text(PAGE, DEFAULT)


def test_page_without_telling_elements():
    body = "".join(f"<p>This is sentence {i}, which goes on for a while, as prose does. And here is another one, just as long as the first.</p>" for i in range(4))
    links = "".join(f'<div><a href="/{i}">Link {i}</a></div>' for i in range(6))
    got = main_text(f"<body><div>{links}</div><div>{body}</div><div>{links}</div></body>", DEFAULT)
    assert len(got.split("\n")) == 4 and "Link" not in got


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!--", "<script>x", "&#0;", "<nav>only</nav>", "<p title=\"open>x</p>" * 50])
def test_odd_pages(html):
    assert isinstance(main_text(html, DEFAULT), str)
    if html and "only" in html:
        assert main_text(html, DEFAULT) == ""


PROSE = [f"This is sentence {i}, which goes on for a while, as prose does. And here is another one, just as long as the first." for i in range(4)]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'><article>{}</article><div class='sidebar'>{links}</div></div>",
        "<div class='layout has-sidebar'><main>{}</main><div class='sidebar'>{links}</div></div>",
        "<div class='no-sidebar'><div>{}</div><nav>{links}</nav></div>",
        "<div class='content-sidebar-wrap'><div>{}</div><div id='sidebar'>{links}</div></div>",
        "<article class='post category-social'>{}</article><footer>{links}</footer>",
        "<article class='post social'>{}</article><footer>{links}</footer>",
        "<form id='form1' class='form'><div class='nav'>{links}</div><article>{}</article></form>",
        "<form><nav>{links}</nav><div>{}</div></form>",
        "<div class='search'><nav>{links}</nav><main>{}</main></div>",
    ],
)
def test_wrappers_do_not_lose_the_article(page):
    links = "".join(f'<div><a href="/{i}">Link {i}</a></div>' for i in range(6))
    assert main_text(f"<body>{page.replace('{links}', links).replace('{}', BODY)}</body>", DEFAULT) == "\n".join(PROSE)


ONE = "A long paragraph, as prose has it, with commas and a full stop. It goes on and on, for some sentences more than one."


@pytest.mark.parametrize(
    "page",
    ["<div class='page has-sidebar'>{}</div>", "<div class='content-sidebar wrap'>{}</div>", "<form id='aspnet'>{}</form>", "<div class='topic social-science'>{}</div>", "<div class='comments-open'>{}</div>"],
)
def test_telling_wrappers_of_an_article(page):
    for inner in ("<article><h1>Heading</h1><p>{}</p></article>", "<main class='comments-open'><h1>Heading</h1><p>{}</p></main>", "<article class='topic social-science'><h1>Heading</h1><p>{}</p></article>"):
        assert main_text(f"<body>{page.format(inner.format(ONE))}</body>", DEFAULT) == f"Heading\n{ONE}"


def test_long_attributes_and_embedded_text():
    for n in (60_000, 70_000, 1_000_000):
        assert main_text(f'<article><p data-x="a>{"b" * n}">{ONE}</p></article>', DEFAULT) == ONE
    assert main_text(f"<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds. {ONE}</p></article>", DEFAULT) == f"Energy E=m holds. {ONE}"
    kept = main_text(f"<article><p>{ONE}</p><p>See <svg><text>label</text><style>x</style></svg> and <object>fallback</object>, <noscript>plain</noscript>.</p></article>", DEFAULT)
    assert kept == f"{ONE}\nSee label and fallback, plain."


def test_attributes_that_only_look_like_names():
    assert main_text(f"<article><div data-id='comments' alt=\"class='comments'\"><p>{ONE}</p></div></article>", DEFAULT) == ONE
    assert main_text(f"<article><p title=\"it's\">{ONE}</p><p don't>{ONE}</p></article>", DEFAULT) == f"{ONE}\n{ONE}"
    assert main_text(f"<article><p>{ONE}</p><p title='open>{ONE}</p></article>", DEFAULT) == f"{ONE}\n{ONE}"


def test_articles_beside_the_article():
    teaser = "<article><h3>Other news</h3><p>A teaser of a few words, no more than that.</p></article>"
    assert main_text(f"<body><div class='sidebar'>{teaser}</div><article>{BODY}</article><aside>{teaser}</aside></body>", DEFAULT) == "\n".join(PROSE)


def test_title_in_the_header_of_main():
    got = main_text(f"<body><header><p>Site name and its slogan.</p></header><main><header class='page-header'><h1>The title</h1></header>{BODY}</main></body>", DEFAULT)
    assert got == "\n".join(["The title", *PROSE])


@pytest.mark.parametrize("part", ["<div id='comments' class='comments-area'>{}</div>", "<div class='comment-list'>{}</div>", "<div id='disqus_thread'><article>{}</article></div>", "<div class='ad-slot'>{}</div>", "<aside>{}</aside>", "<form>{}</form>"])
def test_boilerplate_inside_the_article_goes(part):
    said = "I, a reader, think that this is a good article, and I say so. " * 4
    assert main_text(f"<body><article class='post category-social'>{BODY}{part.format(f'<p>{said}</p>')}</article></body>", DEFAULT) == "\n".join(PROSE)
    long = part.format(f"<p>{said * 9}</p>") if "comments" in part or "disqus" in part else ""
    assert main_text(f"<body><div class='has-sidebar'><article>{BODY}</article>{long}</div></body>", DEFAULT) == "\n".join(PROSE)


def parts(inner):
    return f"<body><nav><a href='/'>Home</a> <a href='/n'>News</a></nav><article><h1>Title</h1><p>{ONE}</p>{inner}<p>{PROSE[0]}</p></article><footer>All rights</footer></body>"


@pytest.mark.parametrize("name", ["search-algorithms", "search", "form-and-style", "copyright", "share", "notice", "related", "alert-levels", "menu"])
@pytest.mark.parametrize("text", [PROSE[1], "Short text here.", "A few words, no more."])
def test_sections_with_telling_ids_stay(name, text):
    for inner in (f"<section id='{name}'><h2>Of {name}</h2><p>{text}</p></section>", f"<h2 id='{name}'>Of {name}</h2><p>{text}</p>", f"<div id='{name}'><h2>Of {name}</h2><p>{text}</p><p>{text}</p></div>"):
        for page in (parts(inner), parts(inner).replace("article>", "main>")):
            got = main_text(page, DEFAULT)
            assert got.startswith(f"Title\n{ONE}\nOf {name}\n{text}") and got.endswith(PROSE[0]) and "News" not in got and "rights" not in got


@pytest.mark.parametrize(
    "inner",
    [
        "<div id='related'><ul><li><a href='/1'>Other text</a></li><li><a href='/2'>Another one</a></li></ul></div>",
        "<div id='newsletter'><p>Your address, please, and we write.</p><input><button>Go</button></div>",
        "<aside id='x'><p>{}</p></aside>",
        "<div class='notice'><p>{}</p></div>",
        "<div id='comments'><p>{}</p></div>",
        "<nav id='toc'><p>{}</p></nav>",
    ],
)
def test_telling_elements_with_a_second_sign_go(inner):
    assert main_text(parts(inner.replace("{}", "I, a reader, say so, and so on. " * 3)), DEFAULT) == f"Title\n{ONE}\n{PROSE[0]}"


def test_an_id_outside_the_article_is_outvoted_by_prose_only():
    assert main_text(f"<body><div id='search'>{BODY}</div></body>", DEFAULT) == "\n".join(PROSE)
    page = "<body><div id='{}'><p>We use cookies, as all do. Agree.</p></div><div>" + BODY + "</div></body>"
    for name in ("cookie-notice", "banner", "footer"):
        assert main_text(page.format(name), DEFAULT) == "\n".join(PROSE)


def test_training_pages_are_bounded_in_bytes(spark):
    rows = [(k, "u", f"<article><p>{k} {ONE}</p></article><nav><p>menu {k}</p></nav>" + ("x" * 300_000 if k < 5 else "")) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    train = htmlcut.train
    htmlcut.train = lambda pages: seen.append(pages) or train(pages)
    try:
        htmlcut.fit(df, sample_pages=20, sample_bytes=400_000)
    finally:
        htmlcut.train = train
    assert len(seen[0]) == 20 and sum(map(len, seen[0])) <= 400_000


def test_blocks():
    got = blocks_of("a<div>b<i>c</i> d<script>no</script></div>e &amp;amp; f<!-- g --><![CDATA[h & i]]>")
    assert [b.text for b in got[0]] == ["a", "bc d", "e &amp; fh & i"]
    assert blocks_of('<p><a href="x">all link</a></p>')[0][0].linked == 8


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 1), (2, "u", "<article><p>" + "é" * 200_000, 1)], "page_id long, url string, html string, text int")
    weights = htmlcut.fit(df)
    got = htmlcut.extract(df, weights).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] is None} == {""} and max(r["n_chars"] for r in got) == 200_000
    assert htmlcut.extract(df.limit(0), htmlcut.fit(df.limit(0))).count() == 0


def test_articles_of_the_pages(spark, tiny):
    import html
    import re

    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in htmlcut.extract(pages, htmlcut.fit(pages)).collect()}
    for r in pages.collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
        assert texts[r["page_id"]] == "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
