import html
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import boosting, extraction

SENTENCES = ["One small step was taken.", "Rain & wind kept on, all day long.", "Was it so? It was.", "Nobody saw the old ship leave the harbour at night."] * 5


@pytest.fixture(scope="module")
def model():
    return boosting.fit(*extraction.training_rows(SENTENCES, 700, 1))


def test_trees_learn_what_no_single_feature_shows():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000], trees=40, depth=3)
    assert ((trees.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    assert len(trees.log_odds(np.zeros((0, 5)))) == 0


def blocks(page):
    return [t for _, t in extraction.parse(page)[1]]


def test_markup_is_read_as_browsers_do():
    assert blocks("<p><b>One<br><p>two</p>three") == ["One", "two", "three"]
    assert blocks("<div>a<p>b</div>c") == ["a", "b", "c"]
    assert blocks("<ul><li>a<li>b <i>c</i>d</ul>") == ["a", "b cd"]
    assert blocks("<p>a &amp; b&nbsp;&copy;x &am <script>var t='</p>';</script> c</p>") == ["a & b ©x &am c"]
    assert blocks("<!-- <p>no</p> --><p title='a>b'>x</p><style>p{}</style><p>y") == ["x", "y"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert blocks("1 < 2 <p>a</b></p></div>b<!-- open") == ["1 < 2", "a", "b"]
    assert blocks("") == [] and blocks("<") == ["<"] and blocks("x <p") == ["x"]
    assert len(blocks("<div>" * 3000 + "deep")) == 1


@pytest.mark.parametrize("seed", range(8))
def test_decoding_is_the_best_consistent_choice(seed):
    rng = np.random.default_rng(seed)
    nodes = [extraction.Node("body", None)]
    nodes[0].order = 0
    for i in range(1, 9):
        up = nodes[rng.integers(0, i)]
        node = extraction.Node("div", up)
        node.order = i
        up.children.append(node)
        nodes.append(node)
    odds, sizes = rng.normal(0, 2, 9), rng.random(9) * 50
    weight = 1 + np.log1p(sizes)

    def value(keep):
        return sum(w * -np.logaddexp(0, -o if k else o) for w, o, k in zip(weight, odds, keep))

    legal = (k for k in itertools.product([False, True], repeat=9) if all(not k[i] or k[nodes[i].parent.order] for i in range(1, 9)))
    best = max(legal, key=value)
    assert extraction.decode(nodes, odds, sizes).tolist() == list(best)


def test_main_text_of_pages_made_by_other_seeds(model):
    make = extraction._Maker(random.Random(77), SENTENCES)
    right = 0
    for _ in range(150):
        page = make.page()
        nodes, found = extraction.parse(page)
        right += extraction.extract(model, [page])[0] == "\n\n".join(t for i, t in found if nodes[i].main)
    assert right >= 0.9 * 150


def test_odd_pages_and_columns(spark, model):
    article = "<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav><article><h1>Title</h1>" + "<p>It was a long day, and nobody saw it end.</p>" * 400 + "</article></body>"
    rows = [(1, None), (2, ""), (3, "<nav></nav><script>x</script>"), (4, article), (4, article)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    got = extraction.main_text(df, model).orderBy("page_id").collect()
    assert [r.text for r in got[:3]] == ["", "", ""]
    assert got[3].text == "\n\n".join(["Title", *["It was a long day, and nobody saw it end."] * 400]) == got[4].text
    assert got[3].n_chars == len(got[3].text)
    empty = df.limit(0)
    assert extraction.main_text(empty, extraction.learn(empty, pages=30)).count() == 0


def test_pages_of_the_small_data_set(spark, sf):
    def article(page):
        inside = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", inside[1]) if inside else []
        texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts)
        return "\n\n".join(t for t in texts if t)

    pages = {r.page_id: article(r.html) for r in extraction.table(spark, sf, "pages").collect()}
    got = {r.page_id: r.text for r in extraction.op9_dom_trees(spark, sf).collect()}
    assert set(got) == set(pages) and np.mean([got[i] == t for i, t in pages.items()]) >= 0.95
