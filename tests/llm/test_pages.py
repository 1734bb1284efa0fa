"""Main texts of invented sites with different mark-up."""

from __future__ import annotations

import itertools
import random

from docledger.llm import pages

SCHEMA = "page_id long, url string, html string, host string, part int"


def texts(spark, rows):
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)
    return {x["page_id"]: x["text"] for x in pages.main_texts(frame.repartition(3)).collect()}


def page(i: int, body: str) -> str:
    return (f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style>"
            f"<script>var a='</p><article>no';</script></head><body>"
            f"<nav><ul><li><a href='/{i}'>Link {i}</a></li></ul></nav>"
            f"<div class='cookie-notice'>We use cookies {i}</div>{body}"
            f"<footer>&copy; {i}</footer></body></html>")


def test_article_without_other_parts(spark):
    body = ("<article><header>By A</header><h1>Head &amp; {i}</h1><p>One\n <b>bold {i}<p>Two&nbsp;x<br>y{i}"
            "<div class=\"ad-slot\">Buy {i}</div><ul><li>item {i}<li>more {i}</ul>"
            "<form>Mail <input></form><!-- <p>no</p> --><section id=comments><p>nice {i}</section>"
            "<blockquote>said &lt;p&gt; {i}</blockquote></article>")
    got = texts(spark, [(i, f"http://a.org/{i}", page(i, body.replace("{i}", str(i)))) for i in range(20)])
    for i in range(20):
        assert got[i] == f"Head & {i}\n\nOne bold {i}\n\nTwo x y{i}\n\nitem {i}\n\nmore {i}\n\nsaid <p> {i}"


def test_main_slot_is_found_without_an_article(spark):
    body = ("<div class='top'>Site of things</div><div><div class='body'><h2>Title {i}</h2>"
            "<p>long text number {i} with many words in it</p><p>and another {i}</p></div></div>"
            "<div class='low'><a href='x'>more pages of this site {i}</a></div>")
    got = texts(spark, [(i, f"http://b.org/{i}", page(i, body.replace("{i}", str(i)))) for i in range(12)])
    assert got[3] == "Title 3\n\nlong text number 3 with many words in it\n\nand another 3"


def test_what_all_pages_say_is_template(spark):
    body = "<article><p class='x'>Subscribe now</p><p>text {i}</p></article>"
    got = texts(spark, [(i, "http://c.org/", page(i, body.replace("{i}", str(i)))) for i in range(12)])
    assert set(got.values()) == {f"text {i}" for i in range(12)}
    same = texts(spark, [(i, "http://c.org/", page(1, "<article><p>equal</p></article>")) for i in range(12)])
    assert set(same.values()) == {"equal"}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, None, ""), (3, "http://d.org/", "plain < text"), (4, "x", "<p>a</b></p>b"),
            (5, "http://e.org", "<div>" * 3000 + "deep"), (6, "http://f.org", "<article>" + "<p>w</p>" * 5000),
            (6, "http://f.org", "<article><p>again</p></article>"), (None, "http://f.org", "<p>no id"),
            (7, "http://g.org", "<"), (8, "http://g.org", "<a href='>"), (9, "http://g.org", "<script>never closed")]
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)
    got = [(x["page_id"], x["text"], x["n_chars"]) for x in pages.main_texts(frame).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    told = dict((i, t) for i, t, _ in got if i != 6)
    assert (told[1], told[2], told[3], told[4], told[5], told[None]) == (
        "", "", "plain < text", "a\n\nb", "deep", "no id")
    assert {t for i, t, _ in got if i == 6} == {"again", "\n\n".join(["w"] * 5000)}
    assert pages.main_texts(frame.where("false")).collect() == []


def test_large_hosts_are_split(spark, monkeypatch):
    monkeypatch.setattr(pages, "GROUP_PAGES", 10)
    body = "<article><p>text {i}</p></article>"
    got = texts(spark, [(i, "HTTP://Big.org/", page(i, body.replace("{i}", str(i)))) for i in range(95)])
    assert got == {i: f"text {i}" for i in range(95)}


def test_deep_pages_of_one_host_are_aligned(spark):
    rows = [(i, "http://deep.org/", "<div>" * (1500 + i) + f"deep {i}") for i in range(3)]
    rows += [(3, "http://deep.org/", "<div>" + "<font>" * 1200 + "deep 3")]
    assert texts(spark, rows) == {i: f"deep {i}" for i in range(4)}


def test_wrappers_with_names_of_other_parts(spark):
    long = "long text number {i} with many words in it, and some more of them"
    bodies = [
        "<html><body class='has-sidebar'><div><p>{t}</p></div></body></html>",
        "<html class='no-sidebar'><body><div class='content no-sidebar'><p>{t}</p></div></body></html>",
        "<body><article class='post comments-open'><p>{t}</p></article></body>",
        "<body><div class='page has-sidebar'><article><p>{t}</p></article></div></body>",
        "<body><div id='search-result-main'><p>{t}</p></div><div class='sidebar'>side {i}</div></body>",
        "<table><tr><td class='content no-sidebar'><p>{t}</p></td><td class='menu'>m {i}</td></tr></table>",
        "<body><main role='search'><p>{t}</p><section id='comments'>nice {i}</section></main></body>",
    ]
    rows = [(100 * k + i, f"http://w{k}.org/{i}", b.replace("{t}", long).replace("{i}", str(i)))
            for k, b in enumerate(bodies) for i in range(1 + 6 * (k % 3))]
    assert texts(spark, rows) == {i: long.replace("{i}", str(i % 100)) for i, _, _ in rows}


def test_long_comments_beside_an_article_stay_out(spark):
    body = ("<article><p>text {i}</p></article><section class='comments'>"
            "<article>a comment that is longer than the text {i}</article></section>")
    got = texts(spark, [(i, "http://l.org/", page(i, body.replace("{i}", str(i)))) for i in range(8)])
    assert got == {i: f"text {i}" for i in range(8)}


def test_all_varying_blocks_are_kept_without_an_article(spark):
    body = ("<div class='top'>Site of things</div><div class='all'><h1>Title {i}</h1><div class='mid'>"
            "<section class='a'><p>the long section number {i} with very many words in it, of course</p>"
            "</section><section class='b'><p>short {i}</p></section></div></div>")
    got = texts(spark, [(i, "http://k.org/", page(i, body.replace("{i}", str(i)))) for i in range(8)])
    assert got == {i: f"Title {i}\n\nthe long section number {i} with very many words in it, of course"
                      f"\n\nshort {i}" for i in range(8)}


def test_template_does_not_depend_on_page_length(spark, monkeypatch):
    body = "<div class='top'>Site of things</div><div class='body'><p>text number {i} of many</p></div>"
    rows = [(i, "http://m.org/", page(i, body.replace("{i}", str(i)))) for i in range(12)]
    want = {i: f"text number {i} of many" for i in range(12)}
    assert texts(spark, rows) == want
    monkeypatch.setattr(pages, "GROUP_CHARS", 500)
    assert texts(spark, rows) == want


def test_names_of_headings_inline_words_and_sections_made_from_headings(spark):
    body = ("<article><h2 id='related-work'>Related work {i}</h2><p>To <span class='share'>share {i}</span>"
            " is <em class='ad'>good</em>.</p><section id='search-trees'><p>On trees {i}</p></section>"
            "<div id='comment-form-2'>Say {i}</div><div class='share'>Share {i}</div></article>")
    for pages_of in (8, 1):
        got = texts(spark, [(i, f"http://n.org/{i}", page(i, body.replace("{i}", str(i)))) for i in range(pages_of)])
        for i in range(pages_of):
            assert got[i] == f"Related work {i}\n\nTo share {i} is good.\n\nOn trees {i}"


def test_articles_side_by_side_and_their_headers(spark):
    two = ("<main><article><header><p>By A {i}</p><div><h1>First {i}</h1></div></header><p>long one {i}</p></article>"
           "<article><h2>Second {i}</h2><p>short {i}</p></article></main><aside><article>Not {i}</article></aside>")
    one = "<main><article><h1>Alone {i}</h1><p>with text {i}</p></article></main>"
    rows = [(i, f"http://m.org/{i}", page(i, (one if i % 3 == 0 else two).replace("{i}", str(i)))) for i in range(9)]
    for some in (rows, rows[1:2], rows[1:]):
        got = texts(spark, some)
        for i, *_ in some:
            assert got[i] == (f"Alone {i}\n\nwith text {i}" if i % 3 == 0 else
                              f"First {i}\n\nlong one {i}\n\nSecond {i}\n\nshort {i}")


def test_matching_finds_the_most_pairs_of_small_trees():
    r = random.Random(6)

    def tree(depth):
        inner = "".join(tree(depth - 1) for _ in range(r.randint(0, 3))) if depth else ""
        tag = r.choice(["div", "section", "ul"])
        return f"<{tag}>{inner}</{tag}>"

    def most(a, b):
        """All ways to pair children in order, one by one."""
        if a.tag != b.tag:
            return 0
        xs, ys, best = a.nodes(), b.nodes(), 0
        for k in range(min(len(xs), len(ys)) + 1):
            for left in itertools.combinations(xs, k):
                for right in itertools.combinations(ys, k):
                    pairs = [most(x, y) for x, y in zip(left, right)]
                    if all(pairs):
                        best = max(best, sum(pairs))
        return 1 + best

    for _ in range(60):
        a, b = pages.parsed(tree(3)), pages.parsed(tree(3))
        seen = {}
        pages._matched([a], [b], seen)
        assert seen[a.shape, b.shape] == most(a, b)
        for at, node in enumerate(every(b)):
            node.at = at
        pages.aligned(a, b, seen)
        paired = [n.at for n in every(a) if n.at >= 0]
        assert len(set(paired)) == len(paired) == seen[a.shape, b.shape]


def every(node):
    return [node, *(x for c in node.nodes() for x in every(c))]
