"""Exact top-k against all pairs, page extraction against known pages and cuts against all labellings."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import html, topk

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, block int"


def run_top_k(spark, rows, every=5, k=3):
    df = spark.createDataFrame([(i, v, 1, "s", 2) for i, v in rows], SCHEMA).repartition(3)
    vectors = topk.whole_vectors(df)
    found = topk.top_k(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


def plain_top_k(rows, every=5, k=3):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in fine:
        if q % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in fine if i != q and len(v) == len(qv))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(7, 3), (1000, 1000)])
def test_top_k_equals_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "VECTORS_PER_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", blocks[1])
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(60)] + [(100 + i, [0.5] * 20) for i in range(30)] + [(200, [0.5] * 20)] * 2
    rows += [(300, None), (301, [None] + [1.0] * 19), (302, [float("nan")] * 20), (303, [float("inf")] * 20), (None, [1.0] * 20), (305, [1.0] * 4), (306, [2.0] * 4), (310, []), (311, [])]
    rows += [(50, rng.normal(size=20).tolist()), (50, rng.normal(size=20).tolist())]  # three queries under one id
    assert run_top_k(spark, rows) == plain_top_k(rows) and sum(r[0] == 50 for r in plain_top_k(rows)) == 9


def test_top_k_with_huge_components(spark):
    rng = np.random.default_rng(4)
    plain = [(i, rng.normal(size=3).tolist()) for i in range(1, 12)]
    huge = [(20, [1e307, 0.0, 0.0]), (21, [-1e307, 1.0, 0.0]), (22, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(plain + huge, "vec_id long, embedding array<double>")
    vectors = topk.whole_vectors(df)
    got = topk.top_k(vectors, vectors.filter("vec_id % 5 = 0"), 2).orderBy("query_id", "rank").collect()
    whole = {i: [min(max(math.floor(256 * x) if abs(x) < 1e300 else int(math.copysign(topk._LARGEST, x)), -int(topk._LARGEST)), int(topk._LARGEST)) for x in v] for i, v in plain + huge}
    want = []
    for q in (5, 10, 20):
        scores = sorted((-max(min(sum(a * b for a, b in zip(whole[q], v)), 2**63 - 1), -2**63), i) for i, v in whole.items() if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:2], 1)]
    assert [tuple(r) for r in got] == want


def test_top_k_of_few_and_none(spark):
    assert run_top_k(spark, []) == []
    assert run_top_k(spark, [(5, [1.0, 2.0])]) == []
    assert run_top_k(spark, [(5, [1.0, 2.0]), (6, [1.0, -2.0])]) == [(5, 1, 6, -196608)]


def test_cell_prunes_without_loss():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(64, 3000)) * np.linspace(4, 0.1, 64)[:, None])
    q = np.floor(256 * rng.normal(size=(300, 64)) * np.linspace(4, 0.1, 64))
    ids, q_ids = np.arange(3000), np.arange(300)
    got = sorted(zip(*(a.tolist() for a in topk.cell_topk(q, q_ids, x, ids, 5))))
    s = q @ x
    s[q_ids, q_ids] = -np.inf
    want = sorted((i, int(c), int(s[i, c])) for i in range(300) for c in np.lexsort((ids, -s[i]))[:5])
    assert got == want


def test_cell_beyond_double_precision():
    x = np.array([[2.0 ** 40, 2.0 ** 40 + 2.0 ** -12 * 2 ** 13], [1.0, -1.0]])
    got = topk.cell_topk(np.array([[2.0 ** 20, 1.0]]), np.array([9]), x, np.array([1, 2]), 2)
    assert got[1].tolist() == [2, 1] and got[2].tolist() == [2 ** 60 + 2 ** 21 - 1, 2 ** 60 + 1]


def cut_cost(labels, gain, edges):
    return sum(-g if on and g < 0 else g if not on and g > 0 else 0 for on, g in zip(labels, gain)) + sum(c for a, b, c in edges if labels[a] != labels[b])


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 9)
        gain = [rng.choice([0.0, rng.uniform(-3, 3)]) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        best = min(cut_cost(x, gain, edges) for x in itertools.product([False, True], repeat=n))
        assert cut_cost(html.minimum_cut(gain, edges), gain, edges) == pytest.approx(best, abs=1e-6)


def pages(n=120):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    sentence = lambda k: " ".join(word() for _ in range(k)) + "."
    rows, want = [], []
    for i in range(n):
        body = [sentence(3)] + [sentence(rng.randrange(2, 30)) for _ in range(rng.randrange(1, 6))]
        text = "".join(f"<p>{b}</p>" if j else f"<h1>{b}</h1>" for j, b in enumerate(body))
        page = (f"<html><head><title>{sentence(2)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header><p>{sentence(2)}</p></header>"
                f"<nav><ul><li><a href='/x'>{word()}</a><li><a href='/y'>{word()}</a></ul></nav><div class='ad'>{sentence(8)}</div><article>{text}</article>"
                f"<section id='comments'><p>{sentence(12)}</p></section><form>{word()}<input></form><aside><p>{sentence(20)}</p></aside><footer>&copy; {word()}</footer></body></html>")
        rows.append((i, f"u{i}", page))
        want.append((i, "\n".join(body)))
    return rows, want


def test_extraction_learns_and_finds_articles(spark):
    rows, want = pages()
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long").repartition(3)
    weights = html.train(html.page_rows(df))
    assert not np.array_equal(weights, html.FIXED_WEIGHTS)
    got = sorted((r["page_id"], r["text"]) for r in html.extract(html.page_rows(df), weights).collect())
    assert got == want
    soup = ("<div class=menu><a href=a>Home</a> <a href=b>News</a></div><div class=post><p>A first paragraph of text, with some words in it.<p>And a second&nbsp;one,"
            "<br>with  a &lt;break&gt; and\nmore words.</div><div class='cookie-notice'>We use cookies.</div>")
    want_soup = "A first paragraph of text, with some words in it.\nAnd a second one, with a <break> and more words."
    assert html.main_text(soup, weights) == html.main_text(soup, html.FIXED_WEIGHTS) == want_soup


@pytest.mark.parametrize("before, after", [
    ('<div class="with-sidebar"><article>', "</article></div>"), ('<article class="post has-comments">', "</article>"), ('<main class="no-ads">', "</main>"),
    ('<div class="page-with-menu menu"><main>', "</main></div>"), ("<form action=x><article>", "</article></form>"), ('<div id="sidebar"><div><article>', "</article></div></div>")])
def test_names_of_wrappers_hide_no_article(before, after):
    title, body = "A title of some words", "A paragraph with words, enough of them to be read as text. And a second sentence, for good measure."
    page = f'<body><nav><a href=x>Home</a></nav>{before}<div class="article-header"><h1>{title}</h1></div><p>{body}</p>{after}<footer>Imprint</footer></body>'
    rows, _ = pages(40)
    x = [(html.features(b), t) for _, _, h in rows for b in html.blocks_of(h) if (t := html.label(b)) is not None]
    trained = html.fit_weights(np.array([f for f, _ in x]), np.array([t for _, t in x]))
    for weights in (html.FIXED_WEIGHTS, trained):
        assert html.main_text(page, weights) == f"{title}\n{body}"


def test_comments_that_are_articles_go_and_formulas_stay():
    body = "Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> as is well known, in <object data=x>fallback words</object> and <noscript>plain</noscript> form."
    comment = "<article class='comment-body'><p>First! What a nice text this is, thank you for it.</p></article>"
    page = f"<main><article><p>{body}</p></article><section id='comments'><ol class='comment-list'><li class='comment'>{comment}</li></ol></section></main>"
    assert html.main_text(page, html.FIXED_WEIGHTS) == "Energy is E=mc2 as is well known, in fallback words and plain form."


def test_deep_nesting_takes_linear_time():
    def seconds(n):
        page = "<body><article>" + "<div>some words, here.\n" * n + "</div>" * n + "<p>end of the text.</p></article>"
        began = time.process_time()
        blocks = html.blocks_of(page)
        edges = html.smoothness(blocks)
        assert len(blocks) == n + 1 and len(edges) <= 2 * n + 2
        return time.process_time() - began

    seconds(1_000)
    assert seconds(50_000) < 50 * max(seconds(5_000), 0.02)
    assert html.main_text("<article>" + "<div>" * 50_000 + "text in the end, at last.", html.FIXED_WEIGHTS) == "text in the end, at last."
    crossed = "<article>" + "<section><div></section>" * 20_000 + "<p>all the same, a text.</p>"
    assert html.main_text(crossed, html.FIXED_WEIGHTS) == "all the same, a text."


def test_extraction_of_odd_pages(spark):
    odd = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>cut off te"), (None, "u", "<article>no id, but text</article>"), (3, "u", "<article><p>cut off te"),
           (4, "u", "<!-- <p>never closed"), (5, "u", "<article><p>a < b & c &amp; d</p></b></div></article>"), (6, "u", "<script>x</script>" * 3000), (7, "u", "<div " * 20_000),
           (8, "u", "<article><p>open <button>Go<p>closed <button>Go</button> end</article>"), (9, "u", "<article><p>" + "<button>" * 20_000 + "x y z, w.</article>")]
    df = html.page_rows(spark.createDataFrame(odd, "page_id long, url string, html string"))
    weights = html.train(df)
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df, weights).collect()}
    assert {(1, "", 0), (2, "", 0), (3, "cut off te", 10), (None, "no id, but text", 15), (4, "", 0), (5, "a < b & c & d", 13), (6, "", 0), (8, "open Go\nclosed end", 18), (9, "x y z, w.", 9)} <= got
    assert html.extract(df, weights).count() == len(odd)
    empty = df.filter("false")
    assert html.extract(empty, html.train(empty)).count() == 0
