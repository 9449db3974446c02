import html as html_lib
import itertools
import re
import time

import numpy as np
import pytest

from merchlens.llm import html

PRIOR = html.model_of(np.zeros((3, 3)), [np.zeros((3, n)) for n in html.LOOKS])
LONG = "The first paragraph of the story is quite long and has many words in it, so nobody doubts it."
PAGE = f"""<!doctype html><html><head><title>T</title><style>p{{x}}</style><script>var a="<p>no</p>";</script></head><body>
<div id="header"><a href=/>Home</a> <a href=/b>Shop</a></div><div class="cookie-notice">We use cookies on this
site to give you the best experience. Accept them now.</div><div class="wrap"><OPEN><h1>Real title</h1><p>{LONG}</p>
<p>Short one &amp; done.<ul><li>item one of the story<li>item two</ul><aside>Ask us anything about the story today.</aside>
<table><tr><td>cell<td>other</table><form><label>Name</label><input></form><div class="ad">Buy this thing now, it is
very cheap.</div><section class="comments"><p>I really loved this article, thank you so much for writing it, it has
changed my life.</p></section><CLOSE><div class="sidebar"><p>Other stories you may like to read today.</p></div></div>
<footer>&copy; all</footer></body></html>"""
WANT = f"Real title {LONG} Short one & done. item one of the story item two cell other"


@pytest.fixture(scope="module")
def model(spark):
    return html.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post-content"', "div", 'section id="story"'])
def test_article_of_unseen_layouts(model, tag):
    page = PAGE.replace("<OPEN>", f"<{tag}>").replace("<CLOSE>", f"</{tag.split()[0]}>")
    assert html.extract(page, model)[0] == WANT
    if tag != "div":
        assert html.extract(page, PRIOR)[0] == WANT


def test_given_pages_without_their_semantic_tags(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        want = re.sub(r"</?[bi]>", "", re.sub(r"<(?!/?[bi]>)[^>]*>", " ", inside))
        assert html.extract(r.html, model)[0] == " ".join(html_lib.unescape(want).split())


def test_messages_give_the_marginals_of_all_states(model):
    page = html.Page("<div><p>one two three</p><ul><li><a href=x>l</a></ul></div><p class=ad>x<h2>t</h2>")
    seen, n = html.looks(page), len(page.parent)
    total = np.zeros((n, 3))
    for states in itertools.product(range(3), repeat=n - 1):
        states = (2, *states)
        log = sum(model.looks[k][states[i], seen[i, k]] for i in range(1, n) for k in range(len(html.LOOKS)))
        log += sum(model.moves[states[page.parent[i]], states[i]] for i in range(1, n))
        for i in range(n):
            total[i, states[i]] += np.exp(log)
    want = total / total.sum(axis=1, keepdims=True)
    assert np.allclose(html.marginals(page, model), want, atol=1e-9)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain words &lt;b&gt; only", "plain words <b> only"),
        ("<p>a<b>b</b>c<br>d<p>e&nbsp; f\n\tg", "abc d e f g"),
        ("<p>open <!-- never <p>closed", "open"),
        ("<p>one</p></div></p><p>two &eacute;&#233;&#x41;", "one two ééA"),
        ("<script>x</script><p>seen</p><script>never closed <p>hidden", "seen"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ('<p title="x > y">kept</p><textarea>typed</textarea><select><option>o</select>', "kept"),
    ],
)
def test_markup(model, page, want):
    assert html.extract(page, model)[0] == want


def test_deep_and_long_pages(model):
    deep = "<div>" * 3000 + "<p>bottom words of it all</p>"
    assert isinstance(html.extract(deep, model)[0], str)
    many = "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(3000)) + "</article>"
    assert html.extract(many, model)[0] == " ".join(f"{LONG} {i}" for i in range(3000))


def test_rows(spark, model):
    rows = [(1, "u", f"<p>{LONG}</p>", "x"), (1, "u", f"<p>{LONG}</p>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_text(df, model).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, ""), (1, LONG), (1, LONG)]
    assert [b.text for b in got[0].blocks] == [LONG] and got[0].blocks[0].content > 0.5
    assert html.main_text(df.limit(0), model).count() == 0
    empty = html.fit(df.limit(0))
    assert np.allclose(empty.moves, PRIOR.moves)


@pytest.mark.parametrize(
    "page",
    [
        "<head><title>T</title><p>ARTICLE</p>",
        "<head><title>T</title>ARTICLE",
        "<head><title>T</title><script>var s = '<body>';</script><style>x</style></head><body><p>ARTICLE</p></body>",
        "<head><script>for(i=0;i<n;i++){x = \"it's\"}</script></head><body><p>ARTICLE</p></body>",
        "<head><noscript><link rel=x></noscript><title>T</title></head><p>ARTICLE</p>",
        *[f"<body><{t}>hidden<p>ARTICLE</p></body>" for t in ("button", "noscript", "object", "svg", "select", "video")],
        *[f"<body><div><{t}>hidden</div>ARTICLE</body>" for t in ("button", "noscript", "object", "svg", "select")],
        "<body><button>hidden<p>ARTICLE</p><button>hidden</button></body>",
        "<body><button><div>hidden</div></button><p>ARTICLE</p></body>",
        "<body><object><object>hidden</object>hidden</object><noscript><div>hidden</div></noscript><p>ARTICLE</p></body>",
        "<body><select><option>hidden<option>hidden</select><p>ARTICLE</p></body>",
    ],
)
def test_unclosed_hidden_elements_end_where_their_surroundings_do(page):
    read = html.Page(page.replace("ARTICLE", LONG))
    assert " ".join("".join(t or " " for _, t in read.runs).split()) == LONG


WRAPPERS = [
    "site search-enabled", "wrap form-page", "layout share-bar-left", "page related-posts-layout",
    "content widget-area-none", "social-story", "has-sidebar sidebar-right",
]


def hinted_page(shape, name):
    body = "<h1>Real title</h1>" + "".join(f"<p>{LONG} Part {i}.</p>" for i in range(4))
    menu = '<header class="masthead"><h1>Site</h1><a href=/>Home</a></header><nav><a href=/a>A</a><a href=/b>B</a></nav>'
    end = '<div class="comments"><h2>Comments</h2><p>I loved it, thank you so much for writing this, it is great.</p></div><footer>&copy; all</footer>'
    if shape == "wrapper":
        return f'<body><div class="{name}">{menu}<div>{body}</div>{end}</div></body>'
    if shape == "child":
        return f'<body>{menu}<div class="{name}">{body}</div>{end}</body>'
    return f'<body>{menu}<article class="{name}">{body}</article>{end}</body>'


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("shape", ["wrapper", "child", "article"])
def test_articles_inside_wrappers_with_names_of_boilerplate(model, shape, name):
    want = "Real title " + " ".join(f"{LONG} Part {i}." for i in range(4))
    for own in (PRIOR, model):
        assert html.extract(hinted_page(shape, name), own)[0] == want


@pytest.mark.parametrize("n", [3, 30, 1000])
def test_long_comments_are_no_wrapper(model, n):
    comments = "".join(f"<p>Reader {i} says that this is by far the best text that I have read in a long time, really.</p>" for i in range(n))
    page = f'<body><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class="comments"><h2>Comments</h2>{comments}</div></body>'
    for own in (PRIOR, model):
        assert html.extract(page, own)[0] == f"Title {LONG} {LONG}"


def test_mathematics_stays_in_its_sentence(model):
    page = f"<article><h1>T</h1><p>{LONG} Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> hold.</p></article>"
    assert html.extract(page, model)[0] == f"T {LONG} Let x=2 hold."


def test_stray_end_tags_take_linear_time(model):
    page = "<div>" * 60_000 + f"<p>{LONG}</p>" + "</span>" * 60_000 + "</p>" * 20_000
    begun = time.time()
    html.Page(page)
    assert time.time() - begun < 2
