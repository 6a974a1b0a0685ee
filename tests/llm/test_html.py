import numpy as np
import pytest
from pyspark.sql import types as T

from sluice.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    return H.train(H.labelled_pages())


def test_held_out_pages(model):
    pages = [H.parse(p) for p in H.labelled_pages(60, seed=1234)]
    right = (model.marginals(pages) >= 0.5) == np.concatenate([H.labels_of(p) for p in pages])
    assert right.mean() > 0.99


@pytest.mark.parametrize("shape", H.SHAPES)
def test_held_out_shapes(model, shape):
    sources = H.labelled_pages(80, seed=1234, shapes=(shape,))
    pages = [H.parse(p) for p in sources]
    labels = [H.labels_of(p) for p in pages]
    assert ((model.marginals(pages) >= 0.5) == np.concatenate(labels)).mean() > 0.99
    whole = ["\n\n".join(t for n, t in p.blocks if n >= 0 and y[n]) for p, y in zip(pages, labels, strict=True)]
    assert sum(a == b for a, b in zip(H.texts(sources, model), whole, strict=True)) >= 0.9 * len(sources)


def test_articles_without_a_wrapper_or_with_their_own_header(model):
    part = "This is a long paragraph of the story, and it says many things about the world and its people. " * 4
    part = part.strip()
    menu = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>"
    bare = f"<html><body>{menu}<h1>Title here</h1><p>{part}</p><p>{part}</p><p>{part}</p><footer>&copy; Me 2020</footer></body></html>"
    own = (f"<html><body>{menu}<article><header><h1>Title here</h1><p>By someone</p></header><p>{part}</p>"
           "<footer>Posted in <a href=/x>News</a></footer></article><footer>&copy; Me</footer></body></html>")
    one = f"<html><body>{menu}<p>{part} {part}</p><footer>&copy; Me 2020</footer></body></html>"
    assert H.texts([bare, own, one], model) == [f"Title here\n\n{part}\n\n{part}\n\n{part}", f"Title here\n\nBy someone\n\n{part}", f"{part} {part}"]


def test_marginals_are_exact():
    """Against the sum over all labellings of a small tree."""
    page = H.parse("<div>a<p>b <b>c</b></p><ul><li>d</ul></div>")
    n = len(page.tag)
    draw = np.random.default_rng(0)
    unary, pairwise = draw.normal(size=(n, 2)), draw.normal(size=(3, 2, 2))
    forest = H.Forest.of([page])
    p, edge = H.sum_product(forest, unary, pairwise)
    total, node, pair = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        w = np.exp(sum(unary[i, y[i]] for i in range(n)) + sum(pairwise[forest.kind[i], y[page.parent[i]], y[i]] for i in range(n) if page.parent[i] >= 0))
        total += w
        for i in range(n):
            node[i, y[i]] += w
            if page.parent[i] >= 0:
                pair[i, y[page.parent[i]], y[i]] += w
    assert np.abs(p - node / total).max() < 1e-9 and np.abs(edge - pair / total).max() < 1e-9


def test_pages_of_the_table(spark, model):
    """The article element's own blocks, found plainly."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = H.texts([r["html"] for r in rows], model)
    for r, text in zip(rows, got, strict=True):
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", article)]
        assert text == "\n\n".join(b for b in blocks if b)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><div class=logo>Site</div></header>
<div class="cookie-notice"><p>We use cookies here to measure things.</p></div><nav><a href=/>Home</a> <a href=/a>About us</a></nav>
<article><h1>Head &amp; line</h1><p>First  <i>part</i>
of it.<p>Tiny.<script>x("<p>no</p>")</script><!-- <p>gone</p> --><div class="ad">Buy now</div><ul><li>one<li>two &lt;3</ul>
<aside class="related"><a href=/1>Other story</a><a href=/2>More</a></aside><p>Last&nbsp;one</article>
<form><label>Name</label><input></form><section id="comments" class="comments"><div class="comment"><b>Bo</b><p>I like it a lot, thanks.</p></div></section>
<div class="sidebar"><ul><li><a href=/p>Popular</a></ul></div><footer>&copy; me</footer></body></html>"""


def test_clutter_goes(model):
    assert H.texts([PAGE], model) == ["Head & line\n\nFirst part of it.\n\nTiny.\n\none\n\ntwo <3\n\nLast one"]


def test_deep_pages(model):
    deep = "<article>" + "<div>" * 3000 + "<p>x</p>" + "</i>" * 20_000 + "</div>" * 3000 + "<td>" * 2000
    assert H.texts([deep, "<div>" * 2000 + "<li>" * 2000], model)[0] in ("x", "")
    page = H.parse("<p>a <b>b<p>c</b> d<ul><li>e<li>f</ul></p>g")
    assert [t for _, t in page.blocks] == ["a b", "c d", "e", "f", "g"]


def test_odd_pages(spark, model):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    long = "<article>" + "".join(f"<p>w{i} text</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None, "x", 5), (2, None, "", "x", 5), (None, "u", "<p", "x", 5), (3, "u", "</div></p><article><b><p>x", "x", 5), (4, "u", long, "x", 5), (4, "u", long, "x", 5), (5, "u", "<" * 1000 + "article>" * 50, "x", 5),
            (6, "u", "<article>" + "<b>" * 3000 + "deep", "x", 5)]
    got = H.extract(spark.createDataFrame(rows, schema), model).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == "" and by[3] == "x" and by[4].count("\n\n") == 19_999
    assert H.extract(spark.createDataFrame([], schema), model).count() == 0


def test_unclosed_elements_hide_nothing(model):
    article = "<article><h1>Head of it</h1><p>First part of the text.</p>{}<p>Second part of the text, a longer one.</p></article>"
    whole = "Head of it\n\nFirst part of the text.\n\nSecond part of the text, a longer one."
    for tag in ("svg", "math", "select", "object", "template", "noscript"):
        for page in (f"<div><{tag}>" + article.format("") + "</div>", article.format(f"<{tag}>"), article.format(f"<{tag}>") + f"<div><{tag}></{tag}></div>"):
            assert H.texts([f"<html><body>{page}</body></html>"], model) == [whole], page
    assert H.texts([article.format("<svg><path d='x'/><g>") + "</svg>"], model) == [whole]


def test_math_and_objects_are_text(model):
    def article(inside):
        return H.texts([f"<html><body><article><h1>Head of it</h1><p>The sum {inside} is known to all of us.</p><p>Second part of the text.</p></article></body></html>"], model)[0].split("\n\n")[1]

    assert article("<math><mi>x</mi><mspace/><mo>+</mo><mn>1</mn></math>") == "The sum x+1 is known to all of us."
    assert article("<object data=a.pdf><param name=b>of <b>this</b> file</object>") == "The sum of this file is known to all of us."
    for hidden in ("<svg><title>T</title><path d='M0'/><text>label</text><svg><text>inner</text></svg><text>after</text></svg>", "<select><option>one<option>two</select>",
                   "<template><b>copy</b></template>", "<noscript><img src=x>No script</noscript>", "<svg/>"):
        assert article(hidden) == "The sum is known to all of us.", hidden


@pytest.mark.parametrize("piece", ['<i title="y', "<a '", "<p>x<i title=\"y", "</textarea ", "<!x", "<textarea></textarea", "<b a=\"'", "<", "<!--", "<svg", "<x/"])
def test_malformed_pages_take_linear_time(piece):
    import time

    began = time.perf_counter()
    for start in ("", "<p>x", "<textarea>"):
        H.parse(start + piece * (300_000 // len(piece)))
    assert time.perf_counter() - began < 10


def test_tags_with_odd_quotes():
    def seen(source):
        return [(b, c + t, a) for b, c, t, a, _ in H.tokens(source)]

    assert seen('a<b c="x>y">d</b>e') == [("a", "b", ' c="x>y"'), ("d", "/b", ""), ("e", "", "")]
    assert seen("<i t=\"y>z") == [("<i t=\"y>z", "", "")]
    assert seen("<i t=\"y'>z'\">w") == [("", "i", " t=\"y'>z'\""), ("w", "", "")]
    assert seen("1 < 2 <b>x") == [("1 < 2 ", "b", ""), ("x", "", "")]
    assert seen("<script>a<b></script >c") == [("", "script", ""), ("c", "", "")]
    assert seen("<!-- <p> -->x<!doctype html>y<?z>") == [("", "", ""), ("x", "", ""), ("y", "", "")]
    assert seen("x<!-- open") == [("x", "", "")]
