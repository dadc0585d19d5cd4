"""Main text of pages: parser cases, the network's arithmetic, held-out and written pages."""

from __future__ import annotations

import numpy as np
import pytest

from usagelens.llm import html_extract, html_model, html_samples, queries
from usagelens.llm.html_blocks import blocks

PAGES = "page_id long, url string, html string"
# Pages written by hand: what is marked with § belongs to the article.
WRITTEN = [
    """<html><body><header id="masthead"><h1>The Observer</h1><p>News since 1901</p></header>
    <nav class="main-nav"><a href=/>Home</a> <a href=/p>Politics</a> <a href=/s>Sport</a></nav>
    <main><article class="post"><h1>§Storm closes harbour</h1>
    <p>§The harbour was closed on Monday after a storm damaged two piers and several boats.</p>
    <div class="ad-slot">Buy new boots today</div>
    <p>§Officials said that repairs would take &lt;two&gt; weeks &amp; cost a lot.</p><p>§It may rain.</p>
    <form class="newsletter"><label>E-mail</label><input><button>Subscribe</button></form>
    </article><aside class="sidebar"><h3>Most read</h3><ul><li><a href=1>Cup final</a><li><a href=2>New mayor</a></ul></aside>
    <section id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I was there and it was very windy all day long.</p></div>
    <div class="comment"><b>Bob</b><p>Me too.</p></div></section></main>
    <footer><p>&copy; 2020 The Observer</p><a href=/privacy>Privacy</a></footer></body></html>""",
    """<body><div class="cookie-banner">We use cookies on this website. <button>Accept</button></div>
    <div id="header"><a href="/">My small blog</a></div><ul class="menu"><li><a href="a">About</a></li><li><a href="b">Archive</a></li></ul>
    <div id="content"><h2>§How to bake bread</h2><p>§Mix flour, water and salt, and let the dough rest for an hour.
    <p>§Then bake it:<ul><li>§heat the oven to 240 degrees</li><li>§wait for forty minutes</li></ul>
    <blockquote>§Bread is the staff of life.</blockquote></div>
    <div class="share">Share this post: <a href=t>Twitter</a> <a href=f>Facebook</a></div>
    <div class="comments"><p>Mia: It worked well for me, thank you for the recipe!</p></div>
    <div id="footer">Powered by Press. All rights reserved.</div>""",
    """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">un</a></li></ul></nav>
    <div class="advert">Grosses soldes, profitez-en !</div><article><p><b>§Le conseil a voté le budget.<br><p>§Oui.</p><p>§La séance
    a duré trois heures, et le public était nombreux dans la salle.</p></article><footer>&copy; Mairie</footer>""",
]


def wanted(page):
    return "\n\n".join(b.text.replace("§", "") for b in blocks(page) if "§" in b.text)


def test_blocks_of_a_page():
    texts = lambda page: [b.text for b in blocks(page)]
    assert texts("plain  text\n only") == ["plain text only"]
    assert texts("<p>a<b>b</b>c<br>d<p>e&nbsp;&eacute;&#65;") == ["abc d", "e éA"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<table><tr><td>a<td>b<tr><td><p>c</table>d") == ["a", "b", "c", "d"]
    assert texts('<a title="x>y">z</a> 1 < 2 <!-- <p>no --> 3<!--> 4') == ["z 1 < 2 3 4"]
    assert texts("<script>'<p>x</p>'</script>a<style>b</style><title>c</title><SCRIPT>d</Script >e") == ["ae"]
    assert texts("a<script>never closed <p>b") == ["a"] and texts("a<!-- never closed <p>b") == ["a"]
    assert texts("a<p class='never closed") == ["a"] and texts("a</div></p>b") == ["a", "b"]
    assert texts("<div>a<p>b</div>c") == ["a", "b", "c"]
    assert texts('a<ins class="ads">b</ins>c <ins>d</ins>') == ["a", "b", "c d"]
    assert blocks(None) == [] and blocks("") == [] and blocks("<p> <br> </p>") == []


def test_paths_tell_elements_and_names():
    a, b, c = blocks('<div class="sideBar-x"><p>a</p></div><p>b</p><div id="sidebar"><p>c')
    assert set(a.path) & set(c.path) > set(b.path) & set(a.path)
    deep = blocks("<div>" * 300 + "a")[0]
    assert len(deep.path) == 2 * 24 and blocks("<div>a" * 3000)[-1].text == "a"


def slow_scores(model, x, sizes):
    """One page and one block at a time."""
    p, hidden = model.p, html_model.HIDDEN
    v, out, at = model.vectors(x).astype(np.float64), [], 0
    sig = lambda z: 1 / (1 + np.exp(-z))
    for n in sizes:
        own, states = v[at : at + n], []
        for side, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            h, c, seen = np.zeros(hidden), np.zeros(hidden), {}
            for t in order:
                z = own[t] @ p[f"x{side}"] + h @ p[f"h{side}"] + p[f"c{side}"]
                i, f, o, g = sig(z[:hidden]), sig(z[hidden : 2 * hidden]), sig(z[2 * hidden : 3 * hidden]), np.tanh(z[3 * hidden :])
                c = f * c + i * g
                h = seen[t] = o * np.tanh(c)
            states.append(np.array([seen[t] for t in range(n)]))
        out.append(np.concatenate([*states, own], axis=1) @ p["out"] + p["bias"])
        at += n
    return np.concatenate(out)


def test_network_against_single_steps_and_differences():
    model = html_model.Labeller(3)
    rng = np.random.default_rng(1)
    model.p["word"] = rng.normal(0, 0.3, model.p["word"].shape).astype(np.float32)
    found = [blocks(p) for p in html_samples.pages(5, 11)]
    x, sizes = html_model._joined([html_model.inputs(p) for p in found]), np.array([len(p) for p in found])
    assert np.allclose(model.scores(x, sizes)[0], slow_scores(model, x, sizes), atol=1e-3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    roles = rng.integers(0, len(html_model.ROLES), x.n)
    _, grad = model._gradients(x, sizes, roles)
    for name, g in grad.items():
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        losses = []
        for step in (1e-2, -1e-2):
            model.p[name][place] += step
            losses.append(model._gradients(x, sizes, roles)[0])
            model.p[name][place] -= step
        assert np.isclose((losses[0] - losses[1]) / 2e-2, g[place], rtol=0.05, atol=1e-4), name


def test_held_out_pages():
    found = [p for p in (blocks(p) for p in html_samples.pages(250, 4321)) if p]
    roles = np.concatenate([r.argmax(axis=1) for r in html_model.trained().label(found)])
    marks = np.array([html_model.ROLES.index(b.mark) for p in found for b in p])
    assert (roles == marks).mean() > 0.97 and ((roles == 0) == (marks == 0)).mean() > 0.98


@pytest.mark.parametrize("k", range(len(WRITTEN)))
def test_written_pages(k):
    found = blocks(WRITTEN[k].replace("§", ""))
    got = html_extract.main_text(found, html_model.trained().label([found])[0])
    assert got == wanted(WRITTEN[k])


def test_labels_do_not_depend_on_the_batch():
    found = [blocks(p) for p in html_samples.pages(60, 77)]
    model = html_model.trained()
    together = model.label(found)
    for own, page in zip(together, found, strict=True):
        assert np.allclose(own, model.label([page])[0], atol=1e-4)


def test_query_over_the_given_pages(spark):
    """The given pages keep their text in one article element: an independent way to it."""
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op12_html_extraction(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = "\n\n".join(b.text for b in blocks(inner))
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_very_long_page(spark):
    """30,000 paragraphs between a menu and comments."""
    inner = "".join(f"<p>Paragraph {i} of a very long text, with some words in it.</p>" for i in range(30_000))
    page = f"<nav><a href=1>Home</a></nav><article><h1>Long</h1>{inner}</article><div class=comments><p>Thanks!</p></div>"
    text = html_extract.extract(spark.createDataFrame([(1, "u", page)], PAGES)).first().text
    assert text == "\n\n".join(b.text for b in blocks(f"<h1>Long</h1>{inner}"))


def test_odd_rows(spark):
    rows = [(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, None, "<nav><a href=1>Home</a></nav>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_extract.extract(pages).collect()), key=str)
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0)], key=str)
    assert [r.role for r in html_extract.label_blocks(pages).collect()] == ["menu"]
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0
