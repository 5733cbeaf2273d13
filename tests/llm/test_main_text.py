import itertools
import re
import time

import numpy as np
import pytest

from corpuskit.llm.labelled_pages import labelled_pages
from corpuskit.llm.main_text import ROOT, Page, default_model, extract, kept_text
from corpuskit.llm.page_tree import parse


def text(page):
    p = Page(page)
    return kept_text(p, default_model().marginals([p])[0])


LONG = "This is the story of a long day in the city, and of those who were there. " * 3


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article><h1>Title &amp; more</h1><p>{LONG}<p>a\n\t b&nbsp;c</article><footer>&copy; us</footer>", f"Title & more {LONG}a b c"),
        (f"<div class=header>Site</div><div class=content><p>{LONG}</p><div class=ad>Buy now</div><p>{LONG}</div><div id=comments><div class=comment><p>First of all, no.</p></div></div>", f"{LONG}{LONG}"),
        (f"<main><p>{LONG}in<b>side</b> one<br>two</p></main><form><label>Search</label><input><button>Go</button></form><script>var t='</p>'</script>", f"{LONG}inside one two"),
        (f"<div class=cookie-banner>We use cookies, please accept them all.</div><article><p>{LONG}</p></article><aside><h3>Related</h3><ul><li><a href=x>More here</a></ul></aside>", LONG),
    ],
)
def test_pages(page, want):
    assert text(page) == want.strip()


A = "The council met on Tuesday to discuss the new bridge over the river."
B = "Several members said that the costs were far too high for a small town."
C = "A vote is expected next week, after the public has been heard."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div><div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div><p>{A}</p><p>{B}</p><p>{C}</p></div><div>Copyright 2020 by us</div></div>", f"{A} {B} {C}"),
        (f"<div><div><div><a href=/>Home</a><a href=/n>News</a></div></div><div><div><div>{A}</div><div>{B}</div></div></div><div><div>All rights reserved</div></div></div>", f"{A} {B}"),
        (f"<article><p>{A}</p><div class=alert>Please sign up now.</div><p>{B}</p></article>", f"{A} {B}"),
        (f"<nav><a href=/>Home</a></nav><article>{A}<div class=notice>Offer ends soon</div>{B}</article>", f"{A} {B}"),
        (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><p>{A}</p><ul><li><a href=/1>The first report</a></li><li><a href=/2>The second report</a></li></ul><p>{B}</p></article><footer>x</footer>", f"{A} The first report The second report {B}"),
        ("<nav>Home</nav><article>Yes</article>", "Yes"),
        ("<nav><a href=/>Home</a></nav><article><p>Word</p></article><footer>us</footer>", "Word"),
        (f"<p>{A}</p><p>{B}</p>", f"{A} {B}"),
        (f"<header><h1>Site</h1></header><main><h1>Bridge</h1><p>{A}</p><aside>Related things here</aside><p>{B}</p><form><input><button>Go</button></form></main><footer>c</footer>", f"Bridge {A} {B}"),
        (f"<article><h1>Bridge</h1><p>{A}</p><p>{B}</p><section class=comments><h3>Comments</h3><div class=comment><p>{C}</p></div></section></article>", f"Bridge {A} {B}"),
        (f"<div class=topbar><a href=/>Start</a></div><section><h2>Bridge</h2><p>{A}</p><blockquote>{B}</blockquote><p>{C}</p></section><section class=newsletter><p>Leave us your address.</p></section>", f"Bridge {A} {B} {C}"),
        (f"<div class=css-1x><div class=css-2y><p>{A}</p><p>{B}</p></div><div class=css-3z><a href=/a>A</a><a href=/b>B</a><a href=/c>C</a></div></div>", f"{A} {B}"),
        (f"<div class='d-flex p-2 navbar'>Menu <a href=/>Home</a></div><div class='p-2 story'>{A}<p>{B}</p><pre>x = 1</pre></div><div class='p-2 replies'><p>{C}</p></div>", f"{A} {B} x = 1"),
    ],
)
def test_short_pages_of_other_layouts(page, want):
    assert text(f"<html><body>{page}</body></html>") == want


def test_marginals_against_enumeration():
    model = default_model()
    page = Page(f"<article><p>{A}</p><div class=ad>Buy <b>now</b></div></article><nav>x</nav>")
    n = len(page.nodes)
    alone = np.array([model.evidence(page.seen(i)) for i in range(n)])
    sums = np.zeros((n, 3))
    for state in itertools.product(range(3), repeat=n):
        score = ROOT[state[0]] + sum(alone[i, s] for i, s in enumerate(state)) + sum(model.across[page.tie[i], state[page.parent[i]], state[i]] for i in range(1, n))
        sums[np.arange(n), state] += np.exp(score)
    assert n >= 8
    np.testing.assert_allclose(model.marginals([page])[0], sums / sums.sum(axis=1, keepdims=True), rtol=1e-8)


def test_all_names_of_an_element_count():
    utilities = "auto bg border col d-flex gap grid items-center justify lg-block m-auto md-inline mt-auto p-auto"
    menu = Page(f"<div class='{utilities} sidebar widget'><p>{LONG}</p></div>")
    seen = menu.seen(1)
    assert {"name:sidebar", "name:widget", "name:auto"} <= set(seen)
    alone = Page(f"<div class='sidebar widget'><p>{LONG}</p></div>")
    known = lambda names: {f for f in names if f in default_model().features}
    assert known(alone.seen(1)) <= known(seen)


def test_held_out_pages():
    right = []
    for page in labelled_pages(60, seed=99):
        want = set(re.findall(r"\w+", "".join(kept_text(p := Page(page), __import__("numpy").eye(3)[__import__("corpuskit.llm.main_text", fromlist=["states"]).states(p)]))))
        got = set(re.findall(r"\w+", text(re.sub(r' data-main=["\']\w+["\']', "", page))))
        right.append(len(want & got) / max(1, len(want | got)))
    assert sum(right) / len(right) > 0.85


def test_never_fails():
    for page in ("", "<", "plain words", "<div" * 500, "<b>" * 3000 + "x", "</p></div>", "<a href='", "<script>", "<!-- ", "&#xZZ; &am", "\x00<p>\x00"):
        parse(page)
        text(page)


def test_deep_and_long_pages_in_linear_time():
    n = 20_000
    began = time.time()
    for page in ("<div>" * n + "</x>" * n, "<ul>" * n + "<li>x" * n, "<b>" * n + "<div></div>" * n, "<table>" + "<b>" * n + "</div>" * n):
        parse(page)
    text("<div>" * n + "word " + "</x>" * n)
    assert time.time() - began < 20
    tag = parse("<p " + " ".join(f"a{i}='>'" for i in range(4000)) + ">x</p>").parts[0]
    assert tag.tag == "p" and tag.attribute("a3999") == ">" and tag.parts == ["x"]


def test_frames(spark):
    page = f"<article><p>{LONG}</p></article>"
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, None), (None, "u", "", "y")], "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, LONG.strip(), len(LONG.strip()))] * 2 + [(2, "", 0), (None, "", 0)]
    assert extract(df.limit(0)).count() == 0
