import html
import re
import time

import pytest

from tablewright.llm.html_text import extracted, main_text

LONG = "This paragraph has a good number of words, so that it counts as text."


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("<p>x", "x"),
    ("plain &amp; simple", "plain & simple"),
    (f"<body><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>{LONG}<br>and  more<p>Short.</article><footer>f</footer>",
     f"Title\n{LONG} and more\nShort."),
    (f"<div class=menu><a>m</a></div><div class='post'><h1>T</h1><p>{LONG}</p><ul><li>one<li>two</ul></div>"
     f"<div class=comments><p>{LONG} {LONG}</p></div>", f"T\n{LONG}\none\ntwo"),
    (f"<body><div><div><a href=1>x y</a> <a href=2>z</a></div><div><div><p>{LONG}</p><p>A.</p><p>{LONG}</p></div></div></div>",
     f"{LONG}\nA.\n{LONG}"),
    (f"<main><p>a &lt;b&gt; c&nbsp;d&#233;&copy</p><script>if (a < b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}",
     f"a <b> c dé©\n{LONG}"),
    (f"<article><p>{LONG}</p><aside>s</aside><form>f <input></form><div id=cookie-notice>c</div><div class='ad'>b</div><p>1 < 2</p></article>",
     f"{LONG}\n1 < 2"),
    ("<article><h1>A</h1><p>B</p></article><footer>a footer that is much longer than the article itself, by far</footer>", "A\nB"),
    (f"<p><b>{LONG}<p>next</b></p><table><tr><td>1<td>2</table>", f"{LONG}\nnext\n1\n2"),
])
def test_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<body><form action=/><div class=menu><a href=1>m</a></div><article><h1>T</h1><p>{LONG}</p></article><input></form>", f"T\n{LONG}"),
    (f"<body><form><nav><a href=1>m</a></nav><div><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><input></form></body>", f"{LONG}\n{LONG}\nShort."),
    (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><form><p>Your name and your address, please.</p><input></form></body>", f"{LONG}\n{LONG}"),
    ("<body><form><label>Name</label><input><label>Pass</label><input></form></body>", ""),
])
def test_forms_around_pages_and_in_them(page, text):
    assert main_text(page) == text


def test_nested_inline_elements_take_linear_time():
    begin = time.process_time()
    assert main_text("<article><p>" + "<b>" * 16_000 + LONG + "</b>" * 16_000 + "</article>") == LONG
    assert time.process_time() - begin < 2


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert main_text("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>").count("\n") == 4999


def test_articles_of_the_table(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    given = {r.page_id: r.html for r in pages.collect()}
    for row in extracted(pages).collect():
        article = re.search("<article>(.*?)</article>", given[row.page_id], re.DOTALL)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert row.text == "\n".join(p for p in parts if p) and row.n_chars == len(row.text)


def test_rows(spark):
    rows = [(1, "u", "<p>é"), (1, "u", "<p>é"), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = extracted(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extracted(pages.where("false")).collect() == []


@pytest.mark.parametrize("page, text", [
    (f"<div class='content with-sidebar'><article><p>{LONG}</p></article><div class='leftSidebar'>x</div></div>", LONG),
    (f"<article><div class='post-header'><h1>T</h1></div><p>{LONG}</p></article>"
     f"<section class=comments><article class='comment'><p>{LONG}</p></article></section>", f"T\n{LONG}"),
    (f"<div id='header'><p>Site</p></div><div><div><p>{LONG}</p><p>{LONG}</p></div><div class='topnav'>a b c</div></div>", f"{LONG}\n{LONG}"),
])
def test_layouts(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<article><p>{LONG}</p><section id='discussion'><h2>Discussion</h2><p>{LONG} {LONG}</p></section></article>",
     f"{LONG}\nDiscussion\n{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><section id='related-work'><h2>Related</h2><p>{LONG}</p></section>"
     f"<section id='cookies'><p>{LONG}</p></section></article>", f"{LONG}\nRelated\n{LONG}\n{LONG}"),
    (f"<body><div><div class='elementor-widget'><h2>T</h2></div><div class='elementor-widget'><p>{LONG}</p></div></div></body>", f"T\n{LONG}"),
    (f"<body><div class='content no-sidebar'><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),
    (f"<body><div class='widget'><p>{LONG}</p></div><div class='menu'><a href=1>{LONG}</a></div></body>", LONG),
    (f"<article><p>{LONG}</p><div class='related'><a href=1>{LONG}</a></div><div class='comments'><p>{LONG}</p></div></article>", LONG),
    (f"<article><p>{LONG}</p><div class='site-footer'>x</div><div class='share-buttons'>Tell</div></article>", LONG),
])
def test_names_only_mark_candidates(page, text):
    assert main_text(page) == text
