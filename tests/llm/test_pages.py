import html
import re

import numpy as np
import pytest

from concordia.llm import pages
from concordia.llm.queries import op3_pages


@pytest.fixture(scope="module")
def trees():
    return pages.model()


def article(source):
    """Text between the article's tags, by plain replacement."""
    body = re.search(r"<article[^>]*>(.*?)</article>", source, re.S)[1]
    body = re.sub(r"</?(?:b|em|i|a|span)\b[^>]*>", "", body)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def labelled(source):
    """Text of a generated page's nodes that are labelled I."""
    p = pages.Page(source)
    return " ".join("".join(t if n < 0 or p.label[n] == "I" else "" for n, t in p.pieces).split())


def test_test_data(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = op3_pages(spark, sf).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.text == article(rows[r.page_id].html) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_held_out_generated_pages(trees):
    rng = np.random.default_rng(7)
    sources = [pages.training_page(rng) for _ in range(300)]
    bare = [re.sub(r' data-y="."', "", s) for s in sources]
    got, want = pages.main_texts(bare, trees), [labelled(s) for s in sources]
    exact = np.mean([a == b for a, b in zip(got, want)])
    shared = [len(set(a.split()) & set(b.split())) / max(1, len(set(a.split()) | set(b.split()))) for a, b in zip(got, want)]
    assert exact >= 0.85 and np.mean(shared) >= 0.95, (exact, np.mean(shared))


def test_unlike_parts_are_cut(trees):
    text = "".join(f"<p>Paragraph {i} of the story, with some words in it.</p>" for i in range(6))
    cuts = ['<nav class="x"><ul><li><a href="/">Home</a><li><a>About</a></ul></nav>', '<header><a href="/">Site</a></header>',
            '<aside class="sidebar"><h3>Most read</h3><ul><li><a>One</a></ul></aside>', '<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>',
            '<form action="/s"><input name=q><button>Search</button></form>', '<footer>&copy; 2020 Site</footer>',
            '<section class="comments"><h2>Comments</h2><div class="comment"><p>Nice article, thanks a lot for it.</p></div></section>',
            '<div class="ad"><p>Buy this now, it is cheap.</p></div>']
    want = " ".join(f"Paragraph {i} of the story, with some words in it." for i in range(6))
    sources = [f"<html><body>{c}<article>{text}</article></body></html>" for c in cuts] + [f"<body><article>{text}</article>{c}" for c in cuts]
    sources += [f'<div id="page">{cuts[0]}<div class="post-content">{text}</div>{cuts[6]}{cuts[5]}</div>']
    got = pages.main_texts(sources, trees)
    assert sum(g == want for g in got) >= len(sources) - 1, [(s[:60], g[:80]) for s, g in zip(sources, got) if g != want]


def test_decoding_by_enumeration():
    rng = np.random.default_rng(1)
    parent = [-1, 0, 1, 1, 0, 4]
    for _ in range(30):
        score = rng.normal(size=(6, 3))
        best = None
        for code in range(3 ** 6):
            y = [(code // 3 ** i) % 3 for i in range(6)]
            if y[0] < 2 and all(y[i] >= y[parent[i]] for i in range(1, 6)):
                value = sum(score[i, y[i]] for i in range(6))
                if best is None or value > best[0]:
                    best = (value, y)
        assert pages.decode(parent, score).tolist() == best[1]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text &amp; more"), (4, "u", "<p>a<p>b<b>c</b>d<br>e"), (5, "u", "<" * 3000), (6, "u", "<div>" * 5000 + "x"),
            (7, "u", '<article><p title="a>b">q  r'), (8, "u", "<script>x</scrip"), (9, "u", "<a href='x>y <p>z"), (4, "u", "<p>a<p>b<b>c</b>d<br>e"),
            (10, "u", "<article><p>" + "long text of words. " * 50_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, text string")
    out = pages.extract(df).collect()
    by = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and by[1] == by[2] == by[8] == "" and by[4] in ("a bcd e", "") and by[7] == "q r"
    assert len(by[10]) == 50_000 * 20 - 1
    assert pages.extract(df.limit(0)).count() == 0
