import math
import random
import time

import pytest

from codeloom.llm import html_marginals as h
from tests.llm.helpers import PAGES


def test_marginals_are_those_of_all_labellings():
    model, rng = h.trained(), random.Random(3)
    pages = [p for p in (h.parse(h.labelled_page(rng)) for _ in range(60)) if 2 < len(p.nodes) < 11]
    assert pages
    for page in pages:
        n, total, content = len(page.nodes), 0.0, [0.0] * len(page.nodes)
        for labels in range(2**n):
            y = [labels >> i & 1 for i in range(n)]
            w = sum(y[i] * sum(model.node.get(f, 0.0) for f in h.node_features(page, i)) for i in range(n))
            w += sum(model.edge[h.edge_kind(page.nodes[i]), y[page.nodes[i].parent], y[i]] for i in range(1, n))
            total += (p := math.exp(w))
            content = [c + p * b for c, b in zip(content, y)]
        got, _ = model.marginals(page)
        assert all(abs(g - c / total) < 1e-9 for g, c in zip(got, content))


def test_unseen_labelled_pages():
    model, rng, right, n = h.trained(), random.Random(77), 0, 0
    for _ in range(150):
        page = h.labelled(h.labelled_page(rng))
        for node, p in zip(page.nodes, model.marginals(page)[0]):
            if node.chars:
                right, n = right + ((p > 0.5) == (node.label == 1)), n + 1
    assert right / n > 0.98


def test_parts_of_pages():
    x = h.trained().extract
    body = "This is the first paragraph of the story, which has several words. It goes on for a while."
    page = f"""<html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Head&shy;line</h1><p>{body}<p>A&nbsp;&amp;&#66;<br>c <b>bo</b>ld</p><!-- no --><div class=ad>Buy now</div></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>First comment, it is here.</p></div></section><aside><ul><li><a href=x>Other</a></li></ul></aside>
<form><label>Mail</label></form><footer>&copy; me</footer></body></html>"""
    assert x(page) == f"Head\u00adline {body} A &B c bold"
    assert x(f"<div class='content'><p>{body}</p></div><div id=sidebar><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>") == body
    assert x(f"<p>{body}") == body


def test_bad_markup_is_read_in_linear_time():
    x = h.trained().extract
    for bad in ("<" * 50_000, "<p " * 50_000, "<!--" * 50_000, "<a href=\"" * 50_000, "<div>" * 50_000, "</p>" * 50_000, "<b><p>" * 30_000, "&" * 100_000, "<script>" * 50_000, "<p>x</p>" * 30_000):
        x(bad)
    assert x(None) == x("") == ""


def test_rows(spark):
    table = [(1, "u", None), (2, None, ""), (3, "v", "<article><p>Some words stand here, and then some more of them.</p></article>"), (3, "v", "<p>twice</p>")]
    df = spark.createDataFrame(table, PAGES).withColumn("text", h.F.lit(1))
    got = h.extract_text(df, h.trained()).select("row.page_id", "text").collect()
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert got[2].text == "Some words stand here, and then some more of them."
    assert h.extract_text(df.limit(0), h.trained()).count() == 0


def test_open_heads_and_formulas():
    x = h.trained().extract
    body = "This is the first paragraph of the story, which has several words. It goes on for a while."
    assert x(f"<html><head><title>T</title><meta charset=utf-8><noscript><p>none</p></noscript><article><p>{body}</p></article>") == body
    assert x(f"<head><title>T</title><style>p {{}}</style>\n{body}") == body
    assert x(f"<article><p>{body} Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == f"{body} Here x=2 holds."


@pytest.mark.parametrize("opening", [
    'class="post type-post hentry category-news tag-rome"', 'class="hentry tag-rome"', 'class="post author-bob"', 'class="meta-post"', 'class="entry-content more"', 'data-role="share"', 'data-title="Hidden treasures of Rome"',
])
def test_names_of_articles(opening):
    said = "The city was not built in a day, and its walls still stand. Many came to see them, year after year."
    page = f'<html><body><nav class="menu"><ul><li><a href="/">Home</a></li></ul></nav><article {opening}><p>{said}</p><p title="the hidden valley">{said}</p><p data-id="footer">{said}</p><p aria-label="hidden">{said}</p></article><footer>&copy; us</footer></body></html>'
    assert h.trained().extract(page) == " ".join([said] * 4)


def test_end_tags_without_start_are_read_in_linear_time():
    start = time.time()
    for bad in ("<div>" * 100_000 + "</section>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<a><section>" + "<span>" * 100_000 + "</a>" * 100_000):
        h.parse(bad)
    assert time.time() - start < 30
