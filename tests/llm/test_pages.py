import base64
import hashlib
import html
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import html_text, warc
from plumbline.llm.common import read_table

FOLDER = "/root/testdata/sf0.1"
PAGES = "page_id long, url string, html string"


# Main text ----------------------------------------------------------------


@given(st.lists(st.integers(-5, 5), max_size=30))
@settings(max_examples=200, deadline=None, database=None)
def test_best_run_has_the_largest_sum(values):
    start, end = html_text.best_run(np.array(values, float))
    sums = [sum(values[i:j]) for i in range(len(values) + 1) for j in range(i, len(values) + 1)]
    assert sum(values[start:end]) == max(sums)


def article_text(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(" ".join(b.split()) for b in blocks if b.split())


def test_pages_give_their_articles(spark):
    pages = read_table(spark, FOLDER, "pages")
    got = {r.page_id: r for r in html_text.page_texts(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article_text(r.html), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


WEIGHTS = {"": 0.5, "p": -0.02, "h1": -0.02, "div": -4.0, "li": -4.0, "ul": -4.0, "a": -4.0, "body": -5.0, "html": -5.0, "head": -5.0}
STORY = "words of the story go on and on until the end of it"


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("   ", ""),
        ("<p>", ""),
        ("no tags at all", "no tags at all"),
        (f"<body><div class='sidebar'>{STORY} {STORY}</div><h1>T</h1><p>{STORY}</p></body>", f"T\n\n{STORY}"),
        (f"<p>{STORY}</p><div id=comments><p>{STORY}</p><p>{STORY}</p></div>", STORY),
        (f"<nav>{STORY}</nav><p>a &lt;b&gt; &amp;amp; &#233;&nbsp; x\n\ty</p><form>{STORY}</form>", "a <b> &amp; é x y"),
        (f"<p>{STORY}<br>{STORY}<p>unclosed <i>in</i>line", f"{STORY} {STORY}\n\nunclosed inline"),
        (f"<script>if (a<b) '</p>'; {STORY}</script><!-- {STORY} --><p>{STORY}</p><style>p{{}}", STORY),
        (f"<p>{STORY}</p><aside>never closed <p>{STORY}</p>", f"{STORY}\n\nnever closed\n\n{STORY}"),
        ("<p>" + "long " * 100_000 + "</p>", ("long " * 100_000).strip()),
    ],
)
def test_edges_of_pages(page, text):
    assert html_text.main_text(page, WEIGHTS) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<svg-icon name='x'></svg-icon><article><p>{STORY}</p></article>", STORY),
        (f"<template-x></template-x><p>{STORY}</p><object-y>", STORY),
        (f"<svg viewBox='0 0 1 1'/><p>{STORY}</p>", STORY),
        (f"<object data=x><canvas><template><p>{STORY}</p>", STORY),
        (f"<svg><p>{STORY}</p><svg><text>{STORY}</text></svg>", STORY),
        (f"<svg><svg></svg>{STORY}</svg><p>{STORY}</p><noscript>{STORY}</noscript>", STORY),
        (f"<p>{STORY} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <math/>on</p>", f"{STORY} x=1 and on"),
        (f"<p>{STORY}</p><textarea>{STORY}", STORY),
    ],
)
def test_only_whole_embedded_elements_go(page, text):
    assert html_text.main_text(page, WEIGHTS) == text


LONG = " ".join([STORY] * 6)


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='has-sidebar'><article><p>{STORY}</p></article></div>", STORY),
        (f"<div class=content-sidebar-wrap><p>{LONG}</p></div><div class=x_widget_y><p>few words</p></div>", LONG),
        (f"<div class='widget'><main><p>{STORY}</p></main></div><p>{STORY} {STORY}</p>", f"{STORY}\n\n{STORY} {STORY}"),
        (f"<form><div id='sidebar'><p>{LONG}</p></div></form><div>few words</div>", LONG),
        (f"<article><p>{LONG}</p><h2 id='related-work'>Work</h2><p>{LONG}</p><h2 id=social>S</h2></article>", f"{LONG}\n\nWork\n\n{LONG}\n\nS"),
        (f"<p>{LONG} <a title='the hidden cost'>link</a> <span class='notice'>too</span></p>", f"{LONG} link too"),
        (f"<div class='hidden md:block' data-class='ad' title='display:none'><p>{STORY}</p></div><p>{STORY}</p>", f"{STORY}\n\n{STORY}"),
        (f"<p>{LONG}</p><div hidden><p>{STORY}</p></div><p style='color:red; display : none'>{STORY}</p>", LONG),
        (f"<p>{LONG}</p><p>{LONG} <span hidden>{STORY}</span>on</p>", f"{LONG}\n\n{LONG} on"),
        (f"<p>{LONG}</p><div id=related_posts><article>{STORY}</article><article>{STORY}</article><article>{STORY}</article></div>", LONG),
    ],
)
def test_marks_of_elements(page, text):
    assert html_text.main_text(page, {"": 0.5, "p": -0.02, "h2": -0.02, "div": -0.5, "article": -0.02}) == text


def test_weights_from_labelled_pages(spark):
    page = f"<nav><a>x</a><a>y</a></nav><main><p>{STORY}</p><ul><li>{STORY}</li></ul></main><div>z</div>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "<p>no label</p>")], PAGES)
    weights = html_text.learn_weights(pages)
    assert weights[""] > 0 > weights["p"] > weights["a"] and weights["li"] > weights["div"]
    got = {r.page_id: r.text for r in html_text.page_texts(pages).collect()}
    assert got == {1: f"{STORY}\n\n{STORY}", 2: "", 3: "no label"}
    assert html_text.page_texts(pages.where("page_id > 3")).count() == 0


def words(n, start=0):
    return " ".join(f"word{start + i}" for i in range(n))


MENU = "<nav><ul>" + "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(6)) + "</ul></nav>"
SIDE = "<ul>" + "".join(f"<li><a href='/{i}'>see {i}</a></li>" for i in range(8)) + "</ul>"
SHAPES = {
    "list of three": (f"<h1>Title</h1><p>{words(40)}</p><ul><li>one thing</li><li>two things</li><li>three</li></ul><p>{words(40, 50)}</p>",
                      ["Title", words(40), "one thing", "two things", "three", words(40, 50)]),
    "list of eight": (f"<p>{words(60)}</p><ol>{''.join(f'<li>item {i}</li>' for i in range(8))}</ol><p>{words(60, 70)}</p>",
                      [words(60), *(f"item {i}" for i in range(8)), words(60, 70)]),
    "paragraphs in divs": ("".join(f"<div><div><p>{words(25, 30 * i)}</p></div></div>" for i in range(6)),
                           [words(25, 30 * i) for i in range(6)]),
    "links": ("<h2>On links</h2>" + "".join(f"<p>{words(12, 20 * i)} <a href='x'>link {i}</a></p>" for i in range(6)) + f"<p>{words(40, 200)}</p>",
              ["On links", *(f"{words(12, 20 * i)} link {i}" for i in range(6)), words(40, 200)]),
    "table": (f"<p>{words(30)}</p><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table><p>{words(30, 40)}</p>",
              [words(30), "a", "b", "c", "d", words(30, 40)]),
    "own header": (f"<header><h1>The title</h1><p>by someone</p></header><p>{words(30)}</p>", ["The title", "by someone", words(30)]),
    "figure": (f"<p>{words(30)}</p><figure><img src=x><figcaption>What is seen</figcaption></figure><blockquote>said</blockquote><p>{words(30, 40)}</p>",
               [words(30), "What is seen", "said", words(30, 40)]),
    "few words": ("<p>short</p>", ["short"]),
}


@pytest.fixture(scope="module")
def learned(spark):
    """Weights of the given pages, where lists and links occur in menus only."""
    return html_text.learn_weights(read_table(spark, FOLDER, "pages"))


@pytest.mark.parametrize("label", ["article", "main"])
@pytest.mark.parametrize("shape", SHAPES)
def test_whole_articles_of_many_shapes(learned, shape, label):
    inner, blocks = SHAPES[shape]
    page = f"<html><head><title>T</title></head><body>{MENU}<div>{SIDE}</div><{label}>{inner}</{label}><div>{SIDE}</div><footer>f</footer></body></html>"
    assert html_text.main_text(page, learned).split("\n\n") == blocks


@pytest.mark.parametrize("shape", ["list of eight", "paragraphs in divs", "links", "table", "figure"])
def test_articles_without_a_label(learned, shape):
    inner, blocks = SHAPES[shape]
    page = f"<html><body>{MENU}<div>{SIDE}</div><div class='content'>{inner}</div><div>{SIDE}</div><footer>f</footer></body></html>"
    assert html_text.main_text(page, learned).split("\n\n") == blocks


def test_repeated_rows_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{STORY}</p></article>")] * 3 + [(1, "u", None)], PAGES)
    pages = pages.selectExpr("*", "'x' AS text", "1 AS n_chars", "'y' AS _page")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.page_texts(pages).collect())
    assert got == [(1, "", 0)] + [(1, STORY, len(STORY))] * 3


# Archives -----------------------------------------------------------------


def base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows):
    first = {}
    for i, _, page in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(page or "", i)
    seen, out = set(), []
    for i, _, page in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (page or "").encode()
        again = (page or "") in seen
        seen.add(page or "")
        out.append((i, len(data), base32(data), "revisit" if again else "response", first[page or ""] if again else None))
    return sorted(out, key=str)


def embedded(body):
    return f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


def page_rows():
    rows = [
        (1, "http://a/\r\nX: 1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "a\r\n\r\nb\r\n"),
        (6, "u", "magic WARC/1.0\r\n inside"), (7, "u", "x" + embedded("whole record") + "y"), (8, "u", embedded("first")),
        (9, "u", "WARC/1.0\r\n"), (10, "u", "\r\n\r\n"), (11, "u", "z" * 300_000), (12, "u", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc"),
        (None, "u", "null id"), (14, "u", "null id"), (15, "u", embedded("first")), (15, "u", embedded("first")),
    ]
    rng = random.Random(1)
    return rows + [(100 + i, f"u{i}", f"page {rng.randrange(40)} {embedded('n')}") for i in range(120)]


@pytest.mark.parametrize("compression, file_records", [("gzip", 20_000), ("none", 7)])
def test_archives_round_trip(spark, tmp_path, compression, file_records):
    rows, path = page_rows(), f"file://{tmp_path}/warc"
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS uid", "'p' AS payload", "2 AS id").repartition(4)
    warc.write_warc(df, path, compression=compression, file_records=file_records)
    got = warc.page_records(spark, path)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    payloads = sorted(r.payload for r in warc.read_warc(spark, path).collect() if "response" in r["head"].split("\r\n")[0])
    assert payloads == sorted({page or "" for _, _, page in rows})


def test_files_are_valid_records(spark, tmp_path):
    rows = page_rows()[:8]
    warc.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/w", compression="none")
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*")))
    at, n = 0, 0
    while at < len(data):
        assert data.startswith(b"WARC/1.0\r\n", at)
        head = data[at : data.index(b"\r\n\r\n", at)]
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        at += len(head) + 4 + size
        assert data[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(rows)


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    warc.write_warc(spark.createDataFrame(rows, PAGES), f"file://{tmp_path}/w", least_bytes=3)
    got = {r.page_id: r.record_type for r in warc.page_records(spark, f"file://{tmp_path}/w").collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], PAGES)
    warc.write_warc(empty, f"file://{tmp_path}/w")
    assert warc.page_records(spark, f"file://{tmp_path}/w").count() == 0
