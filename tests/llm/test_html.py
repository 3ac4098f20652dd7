import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import block_labeller as L
from glossweave.llm.html_blocks import WIDTH, blocks, features
from glossweave.llm.html_extract import extracted


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize("tag", ["video", "svg", "iframe", "object", "select", "noscript", "template", "head"])
def test_unclosed_elements_keep_what_follows(tag):
    assert texts(f"<p>a<{tag} id=x><p>b<{tag}><p>c") == ["a", "b", "c"]
    assert texts(f"<p>a<{tag}>no</{tag}><p>b<{tag}><p>c") == ["a", "b", "c"]


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title"])
def test_unclosed_raw_text_goes_on_to_the_end(tag):
    assert texts(f"<p>a<{tag}><p>no") == ["a"]


def test_blocks():
    assert texts(None) == texts("") == []
    assert texts("<p>a <b>b</b>c<br>d &amp; &eacute;&#33;\n e</p>f") == ["a bc", "d & é! e", "f"]
    assert texts("<p>one<p>two<ul><li>x<li>y</ul>") == ["one", "two", "x", "y"]
    assert texts('<head><title>t</title></head><script>var a="</p><p>no";</script><style>p{}</style><!-- <p>no</p> -->yes<script>no') == ["yes"]
    assert texts("a < b > c <") == ["a < b > c <"]
    assert texts('<p title="a>b">x</p></div></p><div') == ["x", "<div"]


def test_deep_and_long():
    assert texts("<div>" * 30_000 + "x") == ["x"]
    assert len(texts("<p>a" * 30_000)) == 30_000
    assert texts("<a title='" * 300) != []


@given(st.lists(st.sampled_from(["<p>", "</p>", "<a href=x>", "</a>", "<li>", "<ul>", "</ul>", "<br>", "t", " ", "<", ">", "&amp;", "<!--", "-->", "<script>", "</script>", "<td>", '"']), max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_any_input(page):
    found = blocks(page)
    assert all(b.text and b.text == " ".join(b.text.split()) for b in found)
    assert features(found).shape == (len(found), WIDTH)


def test_gradients_are_right():
    w = {k: v.astype(np.float64) for k, v in L.start(3).items()}
    r = np.random.default_rng(0)
    x, mask = L.padded([r.normal(size=(4, WIDTH)), r.normal(size=(2, WIDTH))])
    y = (r.random(mask.shape) < 0.5).astype(np.float32)
    _, g = L.gradients(w, x, y, mask)
    for k in w:
        i = tuple(int(r.integers(n)) for n in w[k].shape)
        if k in ("fx", "bx"):
            i = (int(np.abs(g[k]).sum(axis=1).argmax()), i[1])
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        slope = (L.gradients(up, x, y, mask)[0] - L.gradients(down, x, y, mask)[0]) / 2e-2
        assert slope == pytest.approx(float(g[k][i]), abs=2e-3), k


#: Pages in the manner of well-known programs, which the maker of training pages doesn't copy: (page, main text).
OTHERS = [
    ("""<!doctype html><html><body><div id="mw-page-base"></div><div id="mw-head"><ul><li><a href="/t">Talk</a></li><li><a href="/e">Edit</a></li></ul></div>
<div id="content" class="mw-body"><h1 id="firstHeading">River otter</h1><div id="mw-content-text"><p>The <b>otter</b> lives by rivers and lakes in most of the north.</p>
<h2>Diet</h2><p>It eats fish, crabs and frogs, mostly at night.<sup><a href="#c1">[1]</a></sup></p></div></div>
<div id="footer"><ul><li>This page was last edited in May.</li><li><a href="/p">Privacy policy</a></li></ul></div></body></html>""",
     "River otter\nThe otter lives by rivers and lakes in most of the north.\nDiet\nIt eats fish, crabs and frogs, mostly at night.[1]"),
    ("""<body class="home blog"><header id="masthead"><a href="/">My travel notes</a><nav class="primary-navigation"><a href="/a">About</a> <a href="/c">Contact</a></nav></header>
<article id="post-12" class="hentry"><h1 class="entry-title">Two days in the hills</h1><div class="entry-content"><p>We left early and walked until noon without a rest.</p>
<blockquote><p>Nothing is as quiet as snow.</p></blockquote><p>The hut was full, so we slept in the barn.</p></div></article>
<div id="comments" class="comments-area"><h2>3 thoughts</h2><ol class="comment-list"><li>Great pictures, thank you!</li><li>Where is the hut?</li></ol></div>
<aside id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">A day at sea</a></li></ul></aside><footer id="colophon">Proudly powered by a program</footer></body>""",
     "Two days in the hills\nWe left early and walked until noon without a rest.\nNothing is as quiet as snow.\nThe hut was full, so we slept in the barn."),
    ("""<html><body><div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><main role="main"><h1>Council votes on the new bridge</h1>
<div itemprop="articleBody"><p>The council voted for the bridge on Monday, after a debate of five hours.</p><div class="ad-slot">Advertisement</div>
<p>Work is to begin in spring, said the mayor.</p></div><div class="social-share"><a href="#">Share</a> <a href="#">Tweet</a></div></main>
<section class="related-articles"><h2>Related</h2><a href="/x">Old bridge closed again</a></section><footer><p>&copy; The Daily</p></footer></body></html>""",
     "Council votes on the new bridge\nThe council voted for the bridge on Monday, after a debate of five hours.\nWork is to begin in spring, said the mayor."),
    ("""<html><body><table><tr><td class="menu"><a href="1.html">Chapter 1</a><br><a href="2.html">Chapter 2</a></td><td class="text"><h2>Chapter 1</h2>
<p>It was late when the train came in, and nobody was waiting.</p><p>She took her bag and went out into the rain.</p></td></tr></table><div class="footer">Terms of use</div></body></html>""",
     "Chapter 1\nIt was late when the train came in, and nobody was waiting.\nShe took her bag and went out into the rain."),
    ("""<body><nav><ul><li><a href=/docs>Docs</a></li><li><a href=/api>API</a></li></ul></nav><div class="document"><div class="body" role="main"><h1>Install</h1>
<p>Unpack the file and run the script as any user.</p><pre>tar xf file.tar</pre><ul><li>It needs two gigabytes.</li><li>It needs no network.</li></ul></div></div>
<div class="sphinxsidebar" role="navigation"><h3>Navigation</h3><a href=/next>Next topic</a></div><div class="footer">Created with a program</div></body>""",
     "Install\nUnpack the file and run the script as any user.\ntar xf file.tar\nIt needs two gigabytes.\nIt needs no network."),
]


def test_pages_of_other_makers():
    right = all_blocks = 0
    for page, main in OTHERS:
        found = blocks(page)
        keep = L.label(L.trained(), [features(found)])[0]
        kept = main.split("\n")
        assert set(kept) <= {b.text for b in found}
        right += sum(k == (b.text in kept) for b, k in zip(found, keep, strict=True))
        all_blocks += len(found)
    print(f"{right} of {all_blocks} blocks of other makers")
    assert right >= 0.85 * all_blocks


def test_open_inline_elements_take_linear_time():
    began = time.perf_counter()
    assert len(blocks("<b>x</i><p>y" * 30_000)) == 30_001
    assert time.perf_counter() - began < 10


def test_held_out_accuracy():
    made = [e for e in (L.example(s) for s in range(10**6, 10**6 + 200)) if len(e[0])]
    found = L.label(L.trained(), [e[0] for e in made])
    right = sum(int((p == (e[1] > 0)).sum()) for p, e in zip(found, made, strict=True))
    assert right / sum(len(e[1]) for e in made) > 0.97


def test_extraction(spark):
    menu, foot = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>", "<footer>&copy; 2020 a site</footer>"
    body = "".join(f"<p>Sentence number {i} of the story goes on and on, as stories do.</p>" for i in range(4))
    said = "\n".join(f"Sentence number {i} of the story goes on and on, as stories do." for i in range(4))
    ad, talk = '<div class="ad">Buy now!</div>', '<section id="comments"><h3>2 comments</h3><p>I liked this one.</p></section>'
    pages = [(1, "u", f"<html><body>{menu}{ad}<article><h1>The title &amp; more</h1>{body}</article>{talk}{foot}</body></html>", f"The title & more\n{said}"), (2, None, None, ""), (None, "u", "", ""), (1, "u", f"{menu}{foot}", "")]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c, _ in pages], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in extracted(df).collect())
    assert got == sorted((str(a), str(b), t, len(t)) for a, b, _, t in pages)
    assert extracted(df.where("false")).collect() == []
