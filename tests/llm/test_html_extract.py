import time

import numpy as np
import pytest

from spanmill.llm.html_extract import Page, extract, extract_pages, path_scores

LONG = "This is a sentence of the article, with commas, and it goes on for a while. " * 4
CASES = [
    (None, ""), ("", ""), ("plain text, no markup", "plain text, no markup"), ("<html><body></body></html>", ""),
    ("<body><nav><ul><li>Home</ul></nav><div class='ad'>Buy now, today.</div><article><h1>A&amp;B</h1><p><b>One<br>two<p>Three\n\n four&nbsp;five</article><footer>(c)</footer>", "A&B\n\nOne two\n\nThree four five"),
    ("<script>var t='</p><p>no'</script><style>p{}</style><!-- <p>x</p> --><main><p>yes</p><form><p>name</p></form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main>", "yes\n\na\n\nb\n\nc\n\nd"),
    (f"<div id=top class=header>Site name</div><div class=sidebar><p>{LONG[:80]}</p></div><div class=content><h2>T</h2><p>{LONG}</p><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>", f"T\n\n{LONG.strip()}\n\n{LONG.strip()}"),
    ("<article><header><h1>Title</h1><p>by me</p></header><p>Text, text.</p><section class='comments'><p>First!</p></section></article>", "Title\n\nText, text."),
    ("<p>a < b and c > d &lt;p&gt;</p>", "a < b and c > d <p>"),
    ("<article><p>x<script>unclosed <p>y</article>", "x"),
    ("<article><p>in<b>ter</b>words<i> go</i></p><p></p><blockquote>q<p>r</p></blockquote><pre>a\n  b</pre></article>", "interwords go\n\nq\n\nr\n\na b"),
]


def test_cases():
    for page, want in CASES:
        assert extract(page) == want, page


def test_pages(spark, sf_dir):
    df = spark.createDataFrame([(i, None, p, "x") for i, (p, _) in enumerate(CASES)], "page_id long, url string, html string, text string")
    assert {r.page_id: (r.text, r.n_chars) for r in extract_pages(df).collect()} == {i: (t, len(t)) for i, (_, t) in enumerate(CASES)}
    assert extract_pages(df.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    import html
    import re

    for r, p in zip(extract_pages(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect()):
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


BODY = f"<p>{LONG}</p><p>{LONG}</p>"
WANT = f"{LONG.strip()}\n\n{LONG.strip()}"
LINKS = "<div><a href=a>One thing</a><a href=b>Another</a><a href=c>More of it</a></div>"
SHAPES = {
    "two articles in main": (f"<main><article><h2>A</h2>{BODY}</article><article><h2>B</h2>{BODY}</article></main>", f"A\n\n{WANT}\n\nB\n\n{WANT}"),
    "heading and paragraphs beside the content": (f"<body>{LINKS}<h1>Title</h1><p>{LONG}</p><div class=text>{BODY}</div><p>{LONG}</p>{LINKS}</body>", f"Title\n\n{LONG.strip()}\n\n{WANT}\n\n{LONG.strip()}"),
    "a heading alone beside it": (f"<body>{LINKS}<h1>Title</h1><div class=text>{BODY}</div>{LINKS}</body>", f"Title\n\n{WANT}"),
    "a form around the page": (f"<form><nav>Menu</nav><div class=text>{BODY}</div></form>", WANT),
    "a marked wrapper": (f"<div class='widget social'><h2>T</h2>{BODY}</div><div class=related><p>See also this.</p></div>", f"T\n\n{WANT}"),
    "an advert longer than the article": ("<div class=ad><p>Buy this, and that, and all of it now.</p></div><article><p>Short.</p></article>", "Short."),
    "links in the text": (f"<article><p>{LONG} See <a href=x>this, and that</a>.</p>{LINKS}</article>", f"{LONG.strip()} See this, and that."),
    "references in an article's list": (f"<article>{BODY}<ul><li>One, 2001.</li><li>Two, 2002.</li></ul></article>", f"{WANT}\n\nOne, 2001.\n\nTwo, 2002."),
    "formulas, objects, noscript": (f"<article><p>Energy <math><mi>E</mi>=m</math> is <object>shown</object>.</p><noscript><p>Still, text.</p></noscript><p>{LONG}</p></article>", f"Energy E=m is shown.\n\nStill, text.\n\n{LONG.strip()}"),
    "an unterminated tag": (f"<article><p>{LONG}</p></article><a <a <a ", LONG.strip()),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    page, want = SHAPES[name]
    assert extract(page) == want


def test_paths_decide_without_words_to_go_by():
    """No article, no class names: the same page but for its texts; the paths with prose are taken, whichever they are."""
    make = lambda a, b: f"<body><div><section>{a}</section></div><table><tr><td>{b}</td></tr></table></body>"
    prose, chaff = BODY, "".join(f"<p>Item {i}</p>" for i in range(9))
    assert extract(make(prose, chaff)) == WANT and extract(make(chaff, prose)) == WANT


def test_scores_equal_brute_force():
    texts = Page("<div><p>One, two.</p><p>Three.</p><b>x</b></div><ul><li>Four, five; six.<li>7</ul>").texts
    paths = [n.path for n, _, _ in texts]
    mean = lambda v: [sum(x for x, p in zip(v, paths) if p == q) / paths.count(q) for q in paths]
    length, marks = mean([len(t.strip()) for _, t, _ in texts]), mean([sum(c in ".,;" for c in t) for _, t, _ in texts])
    w = np.exp([-0.5, 0, -0.5]) / np.exp([-0.5, 0, -0.5]).sum()
    smooth = lambda v: [sum(w[d + 1] * v[i + d] for d in (-1, 0, 1) if 0 <= i + d < len(v)) for i in range(len(v))]
    want = mean([a * (1 + b) for a, b in zip(smooth(length), smooth(marks))])
    assert len(texts) == 5 and path_scores(texts).tolist() == pytest.approx(want)


@pytest.mark.parametrize("page", ["<div>x" * 10_000, "<a " * 100_000, "<b>" * 20_000 + "<p>x" * 20_000, "</b>" * 50_000 + "<b>" * 30_000 + "</i>" * 30_000])
def test_reading_is_linear(page):
    began = time.time()
    extract(page)
    assert time.time() - began < 5
