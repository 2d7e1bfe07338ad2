import itertools
import random
import time

import pytest
from loomwork.llm import html_content as H

WEIGHTS = {"w:p": 2.0, "w:h1": 2.0, "w:li": -1.0, "w!": -3.0, "p": -0.5, "/p": -0.5, "div": -1.0, "/div": -1.0}


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<p>a", "a"), ("<p>one <b>t</b>wo &amp; three<br>four</p>", "one two & three four"),
    ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<script>var t='</p>';</script><p>x y</p>", "x y"),
    ("<p title='a > b'>q</p><scr", "q"), ("<article><h1>T</h1><p>b</p></article><div><p>other words of a list</p></div>", "T b"),
    ("<nav><p>menu</p></nav><main><header><h1>Head</h1></header><p>body</p><form><p>sign</p></form><p>end</p></main><footer><p>f</p></footer>", "Head body end"),
    ("<article><p>a b</p><div class='ad-box'>buy</div><aside>s</aside><section id=comments><p>nice</p></section><p>c</p></article>", "a b c"),
    ("<p>&nbsp;x&#233;&lt;b&gt;</p>", "xé<b>"), ("<article></article>", ""), ("plain < text", "plain < text"),
    ("<article><p>one<p>two</article>", "one two"), ("<div role=navigation>menu</div><p>z</p>", "z"),
])
def test_extract(page, text):
    assert H.extract(page, WEIGHTS) == text


LONG, SHORT = " ".join(f"word{i}" for i in range(60)), " ".join(f"tale{i}" for i in range(30))


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class='layout with-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='has-sidebar'><article><p>{LONG}</p></article><div class='sidebar'><p>{SHORT}</p></div></div>", LONG),
    (f"<body class='page-with-comments'><div class='sidebar-left'><main><h1>A</h1><p>{LONG}</p></main></div></body>", "A " + LONG),
    (f"<main><p>{LONG}</p><p class='notice-period'>{SHORT}</p></main>", LONG + " " + SHORT),
    (f"<form action='/x'><div><article><p>{LONG}</p></article></div></form>", LONG),
    (f"<article><p>{LONG}</p></article><div>a few words between</div><article><p>{SHORT}</p></article>", LONG + " " + SHORT),
    (f"<article><p>{LONG}</p><article class='comment'><p>{SHORT}</p></article></article>", LONG),
    (f"<h1>A longer title</h1><div><p>{LONG}</p></div><div id='comments'><article><p>{SHORT}</p></article><article><p>{SHORT}</p></article></div>", "A longer title " + LONG),
    (f"<h1>A longer title</h1><div><p>{LONG}</p><p>{LONG}</p></div>" + "<div>" + "<article><ul><li>a card</li></ul></article>" * 4 + "</div>", "A longer title " + LONG + " " + LONG),
    (f"<article title='a hidden gem' data-class='ad'><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}<math><mi>x</mi></math> <object>a chart</object></p></article>", LONG + "x a chart"),
    (f"<nav>menu<p>x</p><article><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><div class='post-comments'><p>{LONG} {LONG}</p></div><p>end</p></article>", LONG + " end"),
])
def test_wrappers_marks_and_names(page, text):
    assert H.extract(page, WEIGHTS) == text


def brute_runs(scores):
    """The best run, then the best ones of what is left on either side, by all pairs of ends."""
    best = max(((sum(scores[i:j]), i - j, -i) for i, j in itertools.combinations(range(len(scores) + 1), 2)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    # Of equal sums the shortest run that is whole: no part of it before or after sums to nothing.
    total = best[0]
    i, j = min(((i, j) for i, j in itertools.combinations(range(len(scores) + 1), 2) if sum(scores[i:j]) == total), key=lambda x: (x[1] - x[0], x[0]))
    return [*brute_runs(scores[:i]), total, *brute_runs(scores[j:])]


@pytest.mark.parametrize("n", [1, 5, 20, 39, 45])
def test_no_marked_article_is_too_short(n):
    links = "<ul>" + "".join(f"<li><a href=x>link{i}</a></li>" for i in range(60)) + "</ul>"
    first, second = " ".join(f"long{i}" for i in range(400)), " ".join(f"short{i}" for i in range(n))
    assert H.extract(f"<article><p>{first}</p></article>{links}<article><p>{second}</p></article>", WEIGHTS | {"w:a": -2.0}) == f"{first} {second}"


def test_an_unmarked_page_keeps_both_halves():
    links = "<ul>" + "".join(f"<li><a href=x>link{i}</a></li>" for i in range(60)) + "</ul>"
    assert H.extract(f"<div><p>{LONG}</p>{links}<p>{SHORT}</p></div>", WEIGHTS | {"w:a": -2.0}) == LONG + " " + SHORT


def test_all_runs_against_all_pairs():
    draw = random.Random(5)
    for _ in range(300):
        # Powers of distinct sizes: no two stretches have the same sum.
        scores = [float(draw.choice((-1, 1)) * (1000 + 2**k)) for k in draw.sample(range(14), draw.randint(0, 9))]
        assert [sum(scores[a:b]) for a, b in H.best_runs(scores)] == brute_runs(scores)


@pytest.mark.parametrize("piece", ["<b>x ", "</i>x ", "<p><b>x", "<div>x ", "<div class='ad'>x ", "<article>x </article>", "<a href='"])
def test_hostile_pages_are_linear(piece):
    began = time.perf_counter()
    H.extract("<article>" + piece * 100_000, WEIGHTS)
    H.extract(piece * 100_000, WEIGHTS)
    assert time.perf_counter() - began < 10


def test_best_run_against_all_runs():
    draw = random.Random(3)
    for _ in range(300):
        scores = [draw.randint(-4, 4) for _ in range(draw.randint(0, 12))]
        a, b = H.best_run([float(s) for s in scores])
        best = max((sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2)), default=0)
        assert sum(scores[a:b]) == max(0, best)


def test_long_page_is_linear():
    page = "<p>" + "word <b>x</b> " * 100_000 + "</p>"
    assert len(H.extract(page, WEIGHTS)) == len("word x " * 100_000) - 1
    assert H.extract("<p " + "a='" * 50_000, WEIGHTS) == ""


def test_fit_and_extract_in_spark(spark):
    page = "<body><nav><a>m</a></nav><article><h1>T</h1><p>body {} text</p></article><div class=ad>ad words</div></body>"
    rows = [(i, f"u{i}", page.format(i), 1) for i in range(20)] + [(None, None, None, 2), (3, "u3", page.format(3), 1), (99, "u", "<p>no marks here</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    weight = H.fit(pages)
    assert weight["w:p"] > 0 > weight["w!"]
    got = [(r.page_id, r.text, r.n_chars) for r in H.extract_pages(pages, weight).collect()]
    assert (5, "T body 5 text", 13) in got and (None, "", 0) in got and (99, "no marks here", 13) in got and len(got) == 23
    assert H.extract_pages(pages.limit(0), H.fit(pages.limit(0))).count() == 0
