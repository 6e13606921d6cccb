import html
import itertools
import random
import re

import pytest

from tidemark.llm import mincut_html as mh
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def cut_value(label, source, sink, edges):
    return (sum(t if keep else s for keep, s, t in zip(label, source, sink)) + sum(c for a, b, c in edges if label[a] != label[b]))


@pytest.mark.parametrize("seed", range(25))
def test_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 10)
    source, sink = ([rng.random() * 4 for _ in range(n)] for _ in range(2))
    edges = [(a, b, rng.random() * 2) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
    best = min(cut_value(x, source, sink, edges) for x in itertools.product([False, True], repeat=n))
    assert cut_value(mh.minimum_cut(source, sink, edges), source, sink, edges) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body>
<header><h1>Site name</h1><a href=/>Home</a></header><div id="cookie-notice">We use cookies to make this site work for you. Accept them.</div>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><main><h1>Title &lt;here&gt;</h1>
<p>First   paragraph &eacute;t&eacute;,&nbsp;with <b>bold</b> and <a href="x">a link</a> in it.<p>Second one<br>goes on, it is longer than the first one.
<div class="ad">Buy now! It is cheap and good for you, say all of our customers today.</div><!-- <p>no</p> -->
<script>document.write("<p>never</p>")</script><ul><li>An item of the article.</li><li>And one more item.</li></ul>
<section id="comments"><p>Reader: this is a long and winding comment about the article. I liked it.</p></section></main>
<aside><p>Related things that one could read as well, if one had the time.</p></aside>
<form>Search <input name=q><button>Go</button></form><footer>&copy; 2024 Nobody. All rights reserved.</footer></body></html>"""


def test_page():
    assert mh.main_text(PAGE) == ("Title <here>\nFirst paragraph été, with bold and a link in it.\nSecond one goes on, it is longer than the first one.\n"
                                  "An item of the article.\nAnd one more item.")


def test_page_without_article_tags():
    body = "".join(f"<p>Sentence number {i} is here, and it has quite a number of words in it. So has this one.</p>" for i in range(4))
    page = f"<div><a href=1>Home</a> <a href=2>News</a></div><div>{body}</div><div><a href=3>Imprint</a></div>"
    assert mh.main_text(page).count("\n") == 3 and "Home" not in mh.main_text(page) and "Imprint" not in mh.main_text(page)


def test_smoothness_keeps_a_short_paragraph():
    long = "<p>" + "This is a sentence of the text with many words. " * 3 + "</p>"
    page = f"<div>{long}<p>Yes.</p>{long}</div>"
    assert "\nYes.\n" in mh.main_text(page)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<", "<"), ("<!-- open", ""), ("<script>x", ""), ("<p", "<p"), ("<article>a < b & c &am</article>", "a < b & c &am"),
    ("<article><p title='a>b'>x</article>", "x"), ("<article><p title=\"open>x</p></article>", "x"), ("<article></p></b>y</article>", "y")])
def test_odd_pages(page, text):
    assert mh.main_text(page) in (text, "" if page in ("<", "<p") else text)


def test_long_and_deep_pages():
    assert mh.main_text("<article>" + "<p>A sentence with some words.</p>" * 5000 + "</article>").count("\n") == 4999
    assert mh.main_text("<article>" + "<div>" * 3000 + "<p>deep words</p>" + "</div>" * 3000 + "</article>") == "deep words"


def expected(page):
    """The test pages hold their text in one article of headings and paragraphs."""
    article = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", article)]
    return "\n".join(p for p in parts if p)


def test_query_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    found = QUERIES["op6_mincut_html"](spark, FOLDER).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == expected(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_edges(spark):
    rows = spark.createDataFrame([(1, "u", None, "z"), (1, "u", None, "z"), (None, None, "<article>x</article>", None)], "page_id long, url string, html string, text2 string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in mh.extract_text(rows).collect()) == [("1", "", 0), ("1", "", 0), ("None", "x", 1)]
    assert mh.extract_text(rows.limit(0)).count() == 0
