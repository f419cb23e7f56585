from itertools import product

import numpy as np
import pytest

from procsight.llm import html
from procsight.llm.queries import op4_html_extraction
from tests.conftest import SF

PAGES = "page_id bigint, url string, html string, text string, n_chars bigint"

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";x()</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">About us</a></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p>First <b>paragraph</b>,<br>with a&nbsp;break.<p>Second   one
goes on.</p><div class="advert">Buy this now!</div><ul><li>Item one<li>Item two</ul></article>
<div class="comments"><p>I disagree.</p></div><aside>Related</aside><form><input><label>Mail</label></form>
<footer>&copy; somebody</footer>"""


def learned(spark):
    rows = [(i, "u", PAGE.replace("Second", f"Second {i}"), "x", 1) for i in range(20)]
    return html.learn(spark.createDataFrame(rows, PAGES))


def test_main_text_of_a_page(spark):
    model = learned(spark)
    assert html.text_of(PAGE, model) == "Title & more\nFirst paragraph, with a break.\nSecond one goes on.\nItem one\nItem two"


def test_messages_give_the_marginals_of_all_states(spark):
    model = learned(spark)
    nodes = html.Page("<body><div><p>some text here</p><a>x</a></div><nav><a>y</a></nav></body>").nodes
    seen = [sum(model.see(f) for f in fs) for fs in html.features(nodes)]
    weights = {}
    for states in product((0, 1), repeat=len(nodes)):
        logp = model.prior()[states[0]] + seen[0][states[0]]
        for i in range(1, len(nodes)):
            logp += model.step(nodes[i].tag)[states[nodes[i].parent], states[i]] + seen[i][states[i]]
        weights[states] = np.exp(logp)
    total = sum(weights.values())
    want = [sum(w for s, w in weights.items() if s[i]) / total for i in range(len(nodes))]
    assert np.allclose(model.marginals(nodes), want)


@pytest.mark.parametrize("page", ["", "no markup at all", "<p", "</div></p>", "<a><b><a></i>", "<!-- open", "<script>x", "<div>" * 3000 + "deep"])
def test_broken_pages_do_not_fail(spark, page):
    assert isinstance(html.text_of(page, html.Model({})), str)


def test_awkward_rows(spark):
    model = learned(spark)
    rows = [(1, "u", None, "x", 0), (2, None, "", "x", 0), (None, "u", PAGE, "x", 0), (3, "u", PAGE, "x", 0), (3, "u", PAGE, "x", 0)]
    rows.append((4, "u", "<article>" + "<p>word " * 5000 + "</article>", "x", 0))
    found = html.extract(spark.createDataFrame(rows, PAGES), model).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == 6 and by[1].text == by[2].text == "" and by[2].url is None
    assert by[3].text == by[None].text and all(r.n_chars == len(r.text) for r in found)
    assert by[4].text == "\n".join(["word"] * 5000)
    assert html.extract(spark.createDataFrame([], PAGES), html.learn(spark.createDataFrame([], PAGES))).count() == 0


def test_whole_table_against_its_markup(spark):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = op4_html_extraction(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)
