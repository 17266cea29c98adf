import time

import pytest
from pyspark.sql import functions as F

from strataline.llm import html_extract as X

LONG = "The quick fox was on the hill and it was not the only one that we saw there in the morning."


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""),
    (f"<p>{LONG}</p>", LONG),
    (f"<nav><a href=/>Home</a></nav><article><h1>On &amp; on</h1><p>{LONG}<br>It&nbsp;is&#32;so.<p>Short.</article><footer>&copy; us</footer>", f"On & on\n\n{LONG} It is so.\n\nShort."),
    (f"<article><p>{LONG}</p><aside>{LONG}</aside><div class='ad'>{LONG}</div><form><p>{LONG}</p></form><script>var a='<p>{LONG}</p>'</script></article>", LONG),
    (f"<article><p>{LONG}</p></article><section id='comments'><p>{LONG}</p></section><div class=\"cookie-notice\">{LONG}</div>", LONG),
    (f"<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>{LONG}</p></main><div role=navigation>{LONG}</div>", f"Title\n\n{LONG}"),
    (f"<div><h2>Head</h2><p>{LONG}</p><p>So.</p><p>{LONG}</p></div><div><a href=1>About</a> | <a href=2>Terms</a></div>", f"Head\n\n{LONG}\n\nSo.\n\n{LONG}"),
    (f"<style>p {{}}</style><title>T</title><!-- <p>{LONG}</p> --><p>a&lt;b {LONG}", f"a<b {LONG}"),
    (f"<article><ul><li>{LONG}<li>And &eacute;t&eacute; x &#x41; &bogus; &am</ul></article>", f"{LONG}\n\nAnd été x A &bogus; &am"),
    (f"<ul class=menu><li><a>One</a><li><a>Two</a></ul><div><p>{LONG}</p>\n\t<p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    (f"<article><p>{LONG}</p><div hidden>{LONG}</div><p style='display: none'>{LONG}</p></article>", LONG),
    (f"<div class='content-sidebar-wrap'><article><p>{LONG}</p><figure><img src=x><figcaption>As seen in the morning on the hill.</figcaption></figure></article><div class=sidebar><p>{LONG}</p></div></div><p>{LONG}</p>", f"{LONG}\n\nAs seen in the morning on the hill."),
    (f"<div class='sidebar'><p>{LONG}<p>{LONG}</div><div id=content><p>{LONG}</p></div><div class='reader-comments'><div><p>{LONG}</p></div></div><ins class=adsbygoogle>{LONG}</ins><p>{LONG}", f"{LONG}\n\n{LONG}"),
    (f"<article></article><div><p>{LONG}</p></div>", LONG),
    (f"<article><p>unclosed <b>bold {LONG}", f"unclosed bold {LONG}"),
])
def test_main_text(page, text):
    assert X.main_text(page) == text


def test_neighbours_decide_short_blocks():
    links = "<p><a href=1>One</a> <a href=2>Two</a></p>"
    assert X.main_text(f"{links}<p>Tiny.</p>{links}<div><p>{LONG}</p></div>") == LONG


def test_long_page_and_table(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"
    rows = [(1, "u", page), (2, None, None), (3, "v", "<p>"), (3, "v", "<p>"), (None, "w", f"<p>{LONG}</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = X.extract(df).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", 3000 * (len(LONG) + 2) - 2), (2, None, 0), (3, "v", 0), (3, "v", 0), (None, "w", len(LONG))]
    assert all(r.n_chars == len(r.text) for r in got) and X.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", ["<div>", "<div class='related'>", "<div class=list>"])
def test_teaser_cards_do_not_hide_the_story(wrapper):
    cards = "<article class='card'><h3>More</h3><p>The other fox was seen on the hill and it was not alone there at all.</p></article>" * 2
    story = "<div class='content'>" + f"<p>{LONG}</p>" * 6 + "</div>"
    got = X.main_text(f"{story}{wrapper}{cards}</div>")
    assert got.count(LONG) == 6 and ("related" not in wrapper or "other fox" not in got)
    assert X.main_text(f"<article>{story}</article>{wrapper}<p>{LONG}</p></div>") == "\n\n".join([LONG] * 6)


RU = "Вчера вечером на берегу реки собрались жители города чтобы обсудить планы новой дороги."
JA = "昨日の夕方、町の住民が新しい道路の計画について話し合うために川のほとりに集まりました。"


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><p title=it's>{LONG}</p><p>So.</p></article>", f"{LONG}\n\nSo."),
    (f"<p><a href=x\">link</a> {LONG}</p><p data-x='a>b'>{LONG}</p>", f"link {LONG}\n\n{LONG}"),
    (f'<p title="never closed>{LONG}</p><p>{LONG}</p>', f"{LONG}\n\n{LONG}"),
    (f"<!-->{LONG}<p>{LONG}", f"{LONG}\n\n{LONG}"),
    (f"<div><h1>Дорога</h1><p>{RU}</p><p>{RU}</p></div>", f"Дорога\n\n{RU}\n\n{RU}"),
    (f"<div><p>{JA}</p><p>{JA}</p></div><div class=comments><p>{JA}</p></div>", f"{JA}\n\n{JA}"),
    (f"<article><p class='related-work'>{LONG}</p><p class='copyright-history'>{LONG}</p><div class='login-flow'>{LONG}</div></article>", "\n\n".join([LONG] * 3)),
    ("<article><p>So <math><mi>a</mi>+<mi>b</mi></math> is it.</p><p><a href=1>Read it all</a></p></article>", "So a+b is it.\n\nRead it all"),
    (f"<div id='footer-wrap'><h1>Top</h1><p>{LONG}</p><p>{LONG}</p></div>", f"Top\n\n{LONG}\n\n{LONG}"),
    (f"<div class='site-footer'><p>{LONG}</p></div><p>{LONG}</p><p>So.</p>", f"{LONG}\n\nSo."),
    (f"<p><a href=1>One and two and more of it <p>{LONG}</p>", LONG),
    (f"<div title='class=ad'><p>{LONG}</p></div>", LONG),
    ("<div class='ad'>Buy this.</div><article><h1>Tiny</h1><p>So.</p></article>", "Tiny\n\nSo.")])
def test_marks_and_markup_lose_no_article(page, text):
    assert X.main_text(page) == text


def test_each_pass_changes_results():
    links = "<p><a href=1>One</a> <a href=2>Two</a></p>"
    dull = "<p>" + "Lorem ipsum dolor amet consectetur adipiscing elit tempor incididunt labore. " * 2 + "</p>"
    for page, kept in ((f"<p>{LONG}</p>{dull}<p>{LONG}</p>", [LONG, LONG]), (f"<article><p>{LONG}</p><p>{LONG}</p></article><p>{LONG}</p>", [LONG, LONG])):
        found = X.blocks(page)
        first, named = X.judged(found)
        assert X.BAD in first and X.settled(found, first, named) == first and X.main_text(page) == "\n\n".join(kept)
    for page, kept in ((f"{links}<p>Tiny.</p>{links}<p>{LONG}</p>", [LONG]), (f"<p>{LONG}</p><p>Tiny.</p>{links}", [LONG, "Tiny."]), (f"<h2>Head</h2><p>{LONG}</p>{links}<p>x</p>", ["Head", LONG])):
        found = X.blocks(page)
        first, named = X.judged(found)
        assert X.UNSURE in first and X.UNSURE not in X.settled(found, first, named) and X.main_text(page) == "\n\n".join(kept)


def test_the_tag_is_only_evidence():
    story = "".join(f"<p>{LONG} {k}</p>" for k in range(5))
    assert X.main_text(f"<article>{story}</article>") == X.main_text(f"<div>{story}</div>") == X.main_text(f"<section class='login-flow'>{story}</section>")
    links = "<ul>" + "<li><a href=1>Some other story of the day that was told here</a>" * 4 + "</ul>"
    assert X.main_text(f"<article>{story}{links}</article>").count("other story") == 4 and "other story" not in X.main_text(f"<div>{story}{links}</div>")


@pytest.mark.parametrize("page", ["<b>" * 50000 + "<p>x</p>" * 30000, "<div class=ad>x" * 30000, "<ul><li class=ad>x" * 30000, "<p a='" * 50000 + '<p a="' * 50001, "<div class='related'>" * 20000 + "x</div>" * 20000, "<table>" + "<tr><td>x" * 20000, "<" * 300000, "<!--" * 50000])
def test_time_grows_with_the_page(page):
    began = time.perf_counter()
    X.main_text(page)
    assert time.perf_counter() - began < 5
