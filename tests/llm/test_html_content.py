import itertools

import numpy as np
import pytest

from wardlake.llm import html_content as hc


@pytest.fixture(scope="module")
def model():
    return hc.train(hc.labelled_pages())


def test_marginals_are_exact_on_a_small_tree():
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2])
    depth = np.array([0, 1, 1, 2, 2, 2])
    features = rng.normal(size=(6, 3))
    model = hc.Model(rng.normal(size=3), rng.normal(size=(2, 2)))
    p, pairs = model.marginals(parent, depth, features)
    total, node, edge = 0, np.zeros(6), np.zeros((6, 2, 2))
    for labels in itertools.product((0, 1), repeat=6):
        y = np.array(labels)
        weight = np.exp((features @ model.weights) @ y + sum(model.pair[y[parent[k]], y[k]] for k in range(1, 6)))
        total += weight
        node += weight * y
        for k in range(1, 6):
            edge[k, y[parent[k]], y[k]] += weight
    assert np.allclose(p, node / total) and np.allclose(pairs[1:], edge[1:] / total)


def test_held_out_layouts(model):
    good = 0
    pages = hc.labelled_pages(120, seed=99)
    for html, marker in pages:
        wanted = sum(len(p.split()) for n in hc.parse(html) for p in n.pieces if isinstance(p, str) and marker in p)
        truth = [" ".join(p.replace(marker, "").split()) for n in hc.parse(html) for p in n.pieces if isinstance(p, str) and marker in p]
        got = hc.main_text(html.replace(marker, ""), model)
        good += all(t in got for t in truth) and len(got.split()) == wanted
    assert good >= 0.9 * len(pages)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><!-- x --><div class="ad">Buy now.</div>
<article><h1>Title &amp; more</h1><p><b>First   one.<br>next<p>Sec&eacute;nd&nbsp;&#x41; <a href=x>link</a> end.</p><ul><li>item</ul>
<pre>code
 here</pre></article><div class="comments"><p>I think so too.</p></div><form><p>Search</p><input></form><footer>&copy; us</footer>"""


def test_a_page_by_eye(model):
    assert hc.main_text(PAGE, model).split("\n\n") == [
        "Title & more", "First one. next", "Secénd A link end.", "item", "code here"]


def test_broken_and_extreme_pages(model):
    deep = "<div>" * 3000 + "<article><p>deep text of the page.</p></article>"
    for html in ("", None, "<", "<p", "</p></p>", "plain", "<!--", "<script>x", "<a<b>c</a>", deep, "<article>" + "<p>a b c.</p>" * 20_000):
        assert isinstance(hc.main_text(html, model), str)
    assert "deep text" in hc.main_text(deep, model)
    assert hc.main_text("<article>" + "<p>a b c.</p>" * 5000 + "</article>", model).count("a b c.") == 5000


def test_table(spark, model):
    pages = spark.createDataFrame(
        [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t"), (3, "v", "", "t")],
        "page_id long, url string, html string, text string")
    rows = hc.extract(pages, model).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert sorted(r.n_chars > 0 for r in rows) == [False, False, True, True]
    assert hc.extract(pages.limit(0), model).count() == 0


@pytest.mark.parametrize("tag, marks, hidden", [
    ('<a href="/the-hidden-cost">', (), False),
    ("<p title='A hidden gem'>", (), False),
    ('<p data-hidden="false" x-id=menu>', (), False),
    ("<a href=/guide?id=menu>", (), False),
    ('<a href="/guide?id=menu" data-class="ad">', (), False),
    ('<p title="class=ad role=nav style=display:none">', (), False),
    ('<p title = "a" hidden>', (), True),
    ('<p hidden="">', (), True),
    ('<p HIDDEN class="ad">', ("ad",), True),
    ("<p title=x aria-hidden=true>", (), True),
    ('<p style="display: none">', (), True),
    ("<p class=story id='main' role = navigation/>", ("story", "main", "navigation"), False),
    ('<p a="1"class="story">', ("story",), False),
])
def test_attributes_are_whole_names(tag, marks, hidden):
    node = hc.parse(tag + "text")[1]
    assert (node.marks, node.hidden) == (marks, hidden)


def test_links_and_paragraphs_about_hidden_things_stay(model):
    page = ('<article><h1>Costs</h1><p title="A hidden gem">One is here to read.</p><p data-hidden="false">Two is'
            ' <a href="/the-hidden-cost">linked</a> here.</p></article>')
    assert hc.main_text(page, model).split("\n\n") == ["Costs", "One is here to read.", "Two is linked here."]
