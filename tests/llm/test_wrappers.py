import html
import itertools
import random
import re

import pytest

from barloom.llm import wrappers as W
from barloom.llm.queries import op13_wrappers

SCHEMA = "page_id long, url string, html string, host string, text int"


def article_text(page):
    """What stands in the article element, block by block, for pages whose blocks are p and h1."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


@pytest.mark.parametrize("most", [None, 0])
def test_query_equals_the_articles(spark, most, monkeypatch):
    if most is not None:  # the way for wrappers that are too large to broadcast
        monkeypatch.setattr(W, "BROADCAST", most)
    path = "/root/testdata/sf0.01"
    pages = {r[0]: r[1] for r in spark.read.parquet(f"{path}/pages.parquet").select("page_id", "html").collect()}
    got = op13_wrappers(spark, path).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    assert [r["page_id"] for r in got if r["text"] != article_text(pages[r["page_id"]]) or r["n_chars"] != len(r["text"])] == []


def site(k, body, menu="Home News About"):
    """A page without an article element: only what varies tells the content."""
    return f'<html><body><div><ul><li><a href="/">{menu}</a></li></ul></div><div id="top">Our daily site, since 1999</div><div><h2>Title {k}</h2><div>{body}</div><div>Read more on our other sites</div></div><div>All rights belong to us</div></body></html>'


def test_constant_nodes_are_template_and_varying_slots_content(spark):
    rows = [(k, f"http://Host.example/{k}", site(k, f"<p>Body {k} says<br>this.</p><p>Always the same word.</p>"), "x", 1) for k in range(20)]
    rows += [(100, "http://other.example/", site(100, "<p>Alone on its host.</p>"), "x", 1)]
    got = {r["page_id"]: r for r in W.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3]["text"] == "Title 3\nBody 3 says this.\nAlways the same word." and got[3]["host"] == "x" and got[3]["n_chars"] == len(got[3]["text"])
    assert "Alone on its host." in got[100]["text"] and "Home" not in got[100]["text"]
    assert sorted(got[3].asDict()) == ["host", "n_chars", "page_id", "text", "url"]


def test_copies_are_no_template(spark):
    page = "<body><article><h1>One</h1><p>text of it</p></article></body>"
    rows = [(k, "http://a.example/1", page, "", 1) for k in range(30)]  # all pages of the host are equal
    rows += [(100 + k, f"http://b.example/{k}", f"<body><nav>{k}</nav><article><h1>One</h1><p>text of it</p></article></body>", "", 1) for k in range(30)]  # all articles are
    rows += [(200 + k, f"http://c.example/{k}", f"<body><article><h1>One</h1><div>Like us</div><p>text {k}</p><p>Licence: CC BY</p></article></body>", "", 1) for k in range(30)]
    got = {r["page_id"]: r["text"] for r in W.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == got[100] == "One\ntext of it"
    assert got[203].endswith("text 3\nLicence: CC BY") and "Like us" not in got[203]


ODD = """<!DOCTYPE html><title>t</title><script>var a = "<p>no</p>";</script><body class="has-comments"><header>Site</header><nav>m</nav><div class="cookie-notice">We use</div>
<main><article class="post"><header><h1>A &amp; B &lt;x&gt; &copy; &#233;&eacute;</h1></header><p>one<b> two<br>three<p>four   \n five<script>x()</script>six<ul><li>a<li>b</ul>
<form>Name <input></form><div class="ad-box">Buy</div><span class="advert">Buy</span><aside>side</aside><p hidden>gone</p><!-- c --><table><tr><td>1<td>2<tr><td>3</table>
<section class="comments"><article class="comment"><p>First!</p></article></section></article></main><footer>f</footer><style>p{}</style>"""


def test_elements_that_are_no_article(spark):
    want = "A & B <x> © éé\none two three\nfour fivesix\na\nb\n1\n2\n3"
    assert W.Extractor().text(ODD, None) == want
    assert W.extract(spark.createDataFrame([(1, None, ODD, "", 1)], SCHEMA)).first()["text"] == want


def test_nulls_empty_broken_deep_and_long_pages(spark):
    deep = "<div>" * 20000 + "<p>deep</p>"
    long = "<article>" + "".join(f"<p>w{k}</p><hr><ul><li>i{k}</ul>" for k in range(20000)) + "</article>"
    texts = [None, "", " ", "plain text", "<", "<p", "<p>a<", "</p></div>x", '<a "', "<p>&amp;&am &#xD800; &#0;</p>", deep, long, "<article></article>rest"]
    rows = [(k, u, t, None, None) for k, t in enumerate(texts) for u in (None, "nonsense", "http:///x", "http://u:p@H.example:80/y?x#z")] + [(None, None, None, None, None)]
    got = W.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    alone = {}
    for r in got:
        if r["url"] is None:
            alone[r["page_id"]] = r["text"]
    assert [alone[k] for k in (0, 1, 2, 3, 7, 10, 12)] == ["", "", "", "plain text", "x", "deep", "rest"]
    assert alone[9] == "&&am � �" and alone[11].count("\n") == 39999
    assert W.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.with_host(spark.createDataFrame([("http://u:p@H.example:80/y?x#z",)], "u string"), "u", "h").first()["h"] == "h.example"


def random_tree(rng, size):
    kids = []
    left = size - 1
    while left > 0:
        n = rng.randint(1, left)
        kids.append(random_tree(rng, n))
        left -= n
    return W.Node(rng.choice("ab"), 0, [1, 0, 0, 0, 0, 1, 0], kids)


def exhaustive(a, b):
    """The most paired nodes, over all order-keeping pairings of children."""
    if a.mark != b.mark:
        return 0
    m, n, best = len(a.children), len(b.children), 0
    for k in range(min(m, n) + 1):
        for x in itertools.combinations(range(m), k):
            for y in itertools.combinations(range(n), k):
                best = max(best, sum(exhaustive(a.children[i], b.children[j]) for i, j in zip(x, y)))
    return best + 1


def test_tree_matching_is_the_best_there_is():
    rng = random.Random(5)
    for _ in range(300):
        a, b = random_tree(rng, rng.randint(1, 9)), random_tree(rng, rng.randint(1, 9))
        a.mark = b.mark = "r"
        score, pairs = W.matching(a, b)
        assert score == exhaustive(a, b)
        assert score == 1 + sum(W.matching(a.children[i], b.children[j])[0] for i, j in pairs) and pairs == sorted(pairs)


def test_merging_counts_pages_and_does_not_grow():
    rng = random.Random(6)
    root = random_tree(rng, 8)
    root.mark = "r"
    for _ in range(400):
        other = random_tree(rng, rng.randint(1, 12))
        other.mark = "r"
        W.merge(root, other)
    assert root.stats[0] == 401 and all(len(n.children) <= W.WIDE for n in W.numbered(root))
    assert sum(n.stats[5] for n in W.numbered(root)) > 401


def test_wrappers_do_not_depend_on_how_pages_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(W, "FAN", 3)
    rows = [(k, f"http://h{k % 3}.example/{k}", site(k, f"<p>Body {k}</p>" + "<ul><li>x</ul>" * (k % 4)), "", 1) for k in range(120)] + [(k, "http://h0.example", None, "", 1) for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = [sorted((r["host"], r["pages"]) for r in W.induce(df.repartition(n)).collect()) for n in (1, 20)]
    assert seen[0] == seen[1] == [("h0.example", 40), ("h1.example", 40), ("h2.example", 40)]
    texts = [sorted((r["page_id"], r["text"]) for r in W.extract(df.repartition(n)).collect()) for n in (1, 20)]
    assert texts[0] == texts[1]


BROKEN = {
    "angles": "<" * 200000, "tags": "<a " * 100000, "comments": "<!--" * 100000, "ampersands": "&" * 200000, "quotes": '<a "' * 100000, "values": '<a x="' * 100000, "sections": "<![CDATA[" * 50000,
    "scripts": "<script>" * 50000, "ends": "</" * 100000, "divs": "<div>" * 100000, "items": "<ul><li>" * 100000, "attributes": "<a " + "x=1 " * 100000 + ">", "open attributes": "<a " + "x=1 " * 100000,
    "spans and rules": "<p>" + "<span>" * 50000 + "<hr>" * 50000, "names": "".join(f"<x{k}>" for k in range(50000)), "siblings": "".join(f"<x{k}></x{k}>" for k in range(50000)), "cells": "<table><tr><td>" * 30000,
    "classes": "".join(f'<div class="c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}">x</div>' for k in range(20000)),
}


@pytest.mark.parametrize("name", BROKEN)
def test_no_page_takes_longer_than_its_length(name):
    import time

    began = time.perf_counter()
    W.Extractor().text(BROKEN[name], None)
    shape, stats = W.summary(W.Page(BROKEN[name]))
    W.content_nodes(W.tree(__import__("json").loads(shape), iter(stats)), False)
    assert time.perf_counter() - began < 20


def test_tags_are_read_as_written():
    text = lambda page: W.Extractor().text(page, None)
    assert text('<p title="a > b" class=x>one</p><P\nid=\'c"d\'>two</P >') == "one\ntwo"
    assert text("a < b <c>d</c> 3<4 &lt;p&gt;") == "a < b d 3<4 <p>"
    assert text("<p>x<!-- > --> y<!---->z<!DOCTYPE a><?php x ?></p>") == "x yz"
    assert text('<p hidden>no</p><div class="a" class="ad">yes</div><div style="display : none">no</div><div class=\'big sidebar\'>no</div>') == "yes"
    assert text("<script>if (a</b) { </scr }</script ><p>after</p><style>p</style>") == "after"
    assert text('<p>before<a href="unclosed>never ends</p>') == "before"
    assert text("<title>open<p>text") == "" and text("<textarea><p>x</textarea><p>y") == "y"
    assert text("<p/>x<br/>y<img alt='z'/>w") == "x y w"
