"""Operator 2 on pages of known articles."""

import html
import re
import time

from stakewatch.llm.html_text import extracted, main_text, op2_html_text

LAYOUT = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
<header class="top"><h1>Site name</h1><nav><a href="/">Home</a></nav></header>
<div class="cookie-notice">We use cookies, and so on, and on. Accept them, please, all of them, now.</div>
<div id="wrap"><div class="post-body">{article}<div class="share-bar">Share this, please.</div></div>
<section id="comments"><h3>Comments</h3><p>A reader wrote this very long comment, with commas, and dots. And so on, and on, for a long time, as readers do, here.</p></section></div>
<div class="sidebar"><p>More stories, with text, and more text.</p></div><aside>Aside, too.</aside>
<form><label>Your name, please</label><input></form><footer>&copy; someone, somewhere.</footer></body></html>"""
ARTICLE = """<h2>Heading</h2><p>First paragraph, with &eacute;nough text;  it
goes on.<p>Second one, with a <a href=x>link</a> and <b>more text.<ul><li>item one<li>item two</ul>
<blockquote>Quoted words, here.</blockquote><!-- no --><p>5 &lt; 6 &#x26; 7<br>next"""
TEXT = "Heading\nFirst paragraph, with \u00e9nough text; it goes on.\nSecond one, with a link and more text.\nitem one\nitem two\nQuoted words, here.\n5 < 6 & 7 next"


def test_article_without_its_surroundings():
    assert main_text(LAYOUT.format(article=ARTICLE)) == TEXT


def test_layout_words_and_sections():
    body = "<p>Long text of the first section, with commas, and more. It goes on, and on, and on, for a while, as it should.</p>"
    page = f'<body><div class="content with-sidebar" data-id="ad-1"><article><section><h2>One</h2>{body * 9}</section><section><h2>Two</h2><p>Short.</p></section></article></div><div id="sidebar"><p>Other, side, text.</p></div></body>'
    lines = main_text(page).split("\n")
    assert lines[0] == "One" and lines[-2:] == ["Two", "Short."] and len(lines) == 12


def test_awkward_pages(spark):
    pages = [None, "", "   ", "<p></p>", "plain words, no tags", "<script>var x = '<p>no</p>'", "<div>" * 3000 + "deep, text." + "</div>" * 10, "a < b, c > d", "<p>open <b>tags, <i>never closed", LAYOUT.format(article="<p>" + "word, and word. " * 30_000)]
    frame = spark.createDataFrame([(i, p, "x") for i, p in enumerate(pages)] + [(4, pages[4], "x")], "page_id long, html string, text string")
    got = {row.page_id: row.text for row in extracted(frame).collect()}
    assert [got[i] for i in range(9)] == ["", "", "", "", "plain words, no tags", "", "deep, text.", "a < b, c > d", "open tags, never closed"]
    assert got[9] == ("word, and word. " * 30_000).strip()
    assert extracted(frame.limit(0)).count() == 0


def test_query(spark, sf_dir):
    pages = {row.page_id: row for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op2_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for row in rows:
        inner = re.search("<article>(.*)</article>", pages[row.page_id].html, re.S)[1]
        blocks = re.split("</?(?:p|h1)>", re.sub("</?b>", "", re.sub("<br>", " ", inner)))
        want = [" ".join(html.unescape(block).split()) for block in blocks]
        assert row.text == "\n".join(filter(None, want)) and row.n_chars == len(row.text) and row.url == pages[row.page_id].url


def test_attributes_are_names_and_values():
    for odd in ('style="overflow:hidden"', 'title="a hidden gem"', "title='class=sidebar'", "href=/p?id=search", 'data-x="role=navigation"', "data-hidden"):
        assert main_text(f"<body {odd}><div {odd}><p {odd}>Text, of the page.</p></div></body>") == "Text, of the page.", odd
    for named in ("hidden", "hidden=''", "ID = search", "class='x sidebar'", 'title="a \'b" role=navigation'):
        assert main_text(f"<body><p>Text, of the page.</p><div {named}>Other text, left out.</div></body>") == "Text, of the page.", named


def test_nothing_of_the_article_goes_outside_its_largest_part():
    body = "<p>Long text of the story, with commas, and more. It goes on, and on, and on, for a while, as it should.</p>"
    lines = main_text(f"<body><div id=content><h1>Headline</h1><p>The lede.</p><div class=body>{body * 30}</div></div></body>").split("\n")
    assert lines[:2] == ["Headline", "The lede."] and len(lines) == 32
    lines = main_text(f"<body><div class=head><h1>Headline</h1></div><div class=story>{body * 30}</div><p>Last words.</p></body>").split("\n")
    assert lines[0] == "Headline" and lines[-1] == "Last words." and len(lines) == 32
    sections = "".join(f"<div class=part><h2>Part {i}</h2>{body * n}</div>" for i, n in enumerate((30, 20, 1)))
    lines = main_text(f"<body><div>{sections}</div></body>").split("\n")
    assert [line for line in lines if line.startswith("Part")] == ["Part 0", "Part 1", "Part 2"] and len(lines) == 54


def test_nested_hidden_inline_elements():
    assert main_text("<article><p>a <span hidden>x<span>y</span> z</span> b</p></article>") == "a b"
    assert main_text("<article><p>a <b>x<b>y</b> z</b> c</p></article>") == "a xy z c"


def test_text_at_every_depth_and_tags_without_end_are_linear():
    pages = {"depth": "<div>a. " * 60_000, "open": "<a " * 300_000, "ends": "<p>" + "<div>x " * 40_000 + "</p>" * 40_000, "own tags": "<b-x>t " * 20_000 + "<li>u " * 20_000}
    for page in pages.values():
        start = time.perf_counter()
        assert main_text(page)
        assert time.perf_counter() - start < 6
    assert main_text(pages["depth"]) == "\n".join(["a."] * 60_000)


def test_comments_that_never_end():
    assert main_text("<p>a</p><!-- b > c") == "a"
    assert main_text("<p>a</p> d <!-- b") == "a\nd"
