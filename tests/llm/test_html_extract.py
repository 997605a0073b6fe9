from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import html_extract

LONG = "Stones lie in the river, and the water runs over them, quietly, all day long. " * 3


def page(body: str, head: str = "<title>Site</title><style>p{}</style><script>var t='</p>';</script>") -> str:
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


MENU = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
FOOT = "<footer>&copy; Site &middot; All rights reserved</footer>"


@pytest.mark.parametrize(
    "body,want",
    [
        # article with unclosed elements, references and inner white space
        (f"{MENU}<article><h1>A &amp; B</h1><p><b>One\n  two&nbsp;three<br>four<p>Five &lt;six&gt; &#233;&#x1F600;</article>{FOOT}",
         ["A & B", "One two three four", "Five <six> é😀"]),
        # no article: the container of the paragraphs wins over menu, sidebar, notice and advert
        (f"<div id=page><div class='top-menu'><a href=x>Home</a></div><div id=content><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div>"
         f"<div class='sidebar'><p>{LONG}</p></div><div class='cookie-notice'><p>We use cookies, many, of them</p></div>"
         f"<div class='adBox ad'>Buy, buy, buy</div></div>{FOOT}", ["Head", LONG, LONG]),
        # paragraphs straight in body, a form and a link list between them
        (f"{MENU}<p>{LONG}</p><form><p>Name, please, now</p><input name=q></form><ul class='related'><li><a href=1>More, here</a></li></ul><p>Short one.</p>",
         [LONG, "Short one."]),
        # reader comments go, inside the article too
        (f"<main><p>{LONG}</p><section id='comments'><h3>Comments</h3><p>{LONG}{LONG}</p></section></main>", [LONG]),
        (f"<article><p>{LONG}</p><div class='commentList'><p>First, {LONG}</p></div><aside>Aside, {LONG}</aside></article>", [LONG]),
        # text in nested sections of one article
        (f"<article><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>Small text.</p></section></article>",
         ["One", LONG, "Two", "Small text."]),
        # lists, tables, quotes and preformatted text in the article
        ("<article><p>Intro, here.</p><ul><li>First <i>it</i>em<li>Second</ul><table><tr><td>a<td>b</table><blockquote>Quote</blockquote><pre>x  =\n1</pre></article>",
         ["Intro, here.", "First item", "Second", "a", "b", "Quote", "x = 1"]),
        # hidden parts and raw elements
        ("<article><p>Seen.</p><p hidden>Not seen</p><div style='display: none'>Nor this</div><noscript>Nor that</noscript><!-- <p>no</p> --><svg><text>no</text></svg></article>",
         ["Seen."]),
        # a very short article beside a longer advert and footer
        (f"{MENU}<div class=ad>{LONG}</div><article><p>Hi.</article>{FOOT}", ["Hi."]),
        # a short paragraph without anything else
        ("<p>alone", ["alone"]),
        ("a &unknown; &amp b < c", ["a &unknown; & b < c"]),
    ],
)
def test_main_text(body, want):
    assert html_extract.main_text(page(body)) == "\n\n".join(" ".join(w.split()) for w in want)


@pytest.mark.parametrize("text", [None, "", "<", "<<>>", "</p></div>", "<!--", "<script>x", "<p", "<a href='", page(""), page(MENU + FOOT), "<p>" * 3000, "<div>" * 3000 + "deep" + "</div>" * 3000])
def test_broken_pages_do_not_crash(text):
    assert html_extract.main_text(text) in ("", "deep", "<", "<<>>", "<p", "<a href='")


def test_link_density_loses_against_text():
    links = "<div>" + "".join(f"<p><a href='/{i}'>Link, number, {i}, with, many, commas</a></p>" for i in range(20)) + "</div>"
    assert html_extract.main_text(page(f"<div>{links}<div><p>{LONG}</p></div></div>")) == " ".join(LONG.split())


def test_whole_long_pages_are_read():
    blocks = [f"Block {i}, of many." for i in range(20000)]
    found = html_extract.main_text(page("<article>" + "".join(f"<p>{b}" for b in blocks) + "</article>"))
    assert found == "\n\n".join(blocks)


def test_query_shape_nulls_repeats_and_empty_table(spark):
    rows = [(1, "u", page("<p>One, two"), 5), (None, None, None, 6), (1, "u", page("<p>One, two"), 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html_extract.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in found.collect()) == [(0, "", 0), (1, "One, two", 8), (1, "One, two", 8)]
    assert html_extract.extract(pages.where(F.lit(False))).collect() == []


@pytest.mark.parametrize(
    "part,kept",
    [
        ('<h2 id="related-work">Related work</h2><p>Others wrote, too.</p>', ["Related work", "Others wrote, too."]),
        ('<section id="header-files"><h2>Header files</h2><p>They declare.</p></section>', ["Header files", "They declare."]),
        ('<section id="navigation"><h2>Navigation</h2><p>By the stars.</p></section>', ["Navigation", "By the stars."]),
        ('<div id="share-prices"><p>They rose.</p></div>', ["They rose."]),
        ('<p class="notice">Read this.</p>', ["Read this."]),
        ('<section id="social-policy"><p>It changed.</p></section>', ["It changed."]),
        ('<section id="footer"><h3>The footer</h3><p>Feet, mostly.</p></section>', ["The footer", "Feet, mostly."]),
        (f'<div class="discussion"><p>{LONG}</p></div>', [LONG]),
        ('<p>See <span class="notice">this</span> one.</p>', ["See this one."]),
        ('<div class="related-posts"><ul><li><a href=1>One more, here</a></li></ul></div>', []),
        ('<div class="social-share">Share this</div><div class="main-nav">Up</div><p class="ad">Buy</p>', []),
        (f'<div class="footer"><p>{LONG}</p></div><section id="comments"><h2>Comments</h2><p>{LONG}</p></section>', []),
        ('<div class="related"><div class="notice">x</div><a href=2>A link, only</a></div>', []),
    ],
)
def test_names_with_a_word_of_boilerplate(part, kept):
    want = [LONG, *kept, LONG]
    for body in (f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>", f"<div><p>{LONG}</p>{part}<p>{LONG}</p></div>"):
        found = html_extract.main_text(page(MENU + body + FOOT))
        assert found == "\n\n".join(" ".join(w.split()) for w in want)


@pytest.mark.parametrize(
    "part,text",
    [
        ('<section class="discussion"><h2>Discussion</h2><p>We agree.</p></section>', ["Discussion", "We agree."]),
        ('<div class="market-share">Its share was 5 per cent.</div>', ["Its share was 5 per cent."]),
        ('<div class="notice-of-copyright">It was printed.</div>', ["It was printed."]),
        ('<div class="promo-code">Use ABC</div><div class="notice"><p>We use them.</p></div>', ["Use ABC", "We use them."]),
    ],
)
def test_names_with_other_meanings_inside_an_article_cut_by_links_alone(part, text):
    want = "\n\n".join(" ".join(w.split()) for w in [LONG, *text, LONG])
    assert html_extract.main_text(page(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>")) == want
    assert html_extract.main_text(page(f"<main><p>{LONG}</p>{part}<p>{LONG}</p></main>")) == want


def test_short_labels_outside_an_article_go():
    part = '<div class="promo-code">Use ABC</div><div class="notice"><p>We use them.</p></div>'
    assert html_extract.main_text(page(f"<div><p>{LONG}</p>{part}</div>")) == " ".join(LONG.split())


@pytest.mark.parametrize(
    "body,want",
    [
        ("<p title=it's>First paragraph, here.</p><p>It doesn't end.</p>", ["First paragraph, here.", "It doesn't end."]),
        ('<p class="x>First paragraph.', ["First paragraph."]),
        ("<p class='x>First one.</p><p>Second one.", ["First one.", "Second one."]),
        ('<p title="a > b" data-x = \'c > "d"\'>Text.</p>', ["Text."]),
        ("<p don't>Text.</p><p a=b'c>More.</p>", ["Text.", "More."]),
        ("<p>Let <math><mi>x</mi><annotation encoding=tex>\\x</annotation></math> be a number.</p>", ["Let x be a number."]),
        ("<p>Tick <label>the box</label> now.</p>", ["Tick the box now."]),
        ("<header><h1>Site</h1></header><article><header><h1>Story title</h1></header><p>Text, of it.</p></article>", ["Story title", "Text, of it."]),
        ("<article><p>One.<script a='>'>x</SCRIPT >two<style>y</article>", ["One.two"]),
        ("<article><p>a <3 b</p><p>c</p></article>", ["a <3 b", "c"]),
    ],
)
def test_text_that_markup_must_not_swallow(body, want):
    assert html_extract.main_text(page(body)) == "\n\n".join(want)


@pytest.mark.parametrize(
    "text",
    [
        "<div>a " * 100_000,
        "<div>" * 100_000 + "deep" + "</div>" * 100_000,
        "<b>" * 50_000 + "<hr>" * 50_000,
        "<div>" * 50_000 + "</p>" * 50_000,
        "<a><div>" + "<b>" * 50_000 + "<a></a>" * 50_000,
        "<a x='" * 100_000,
        '<a x="y' * 50_000 + ">",
        "<script>" * 100_000,
        "<!--" * 100_000,
        "<x " * 100_000,
        "<div class='related-x'>a" * 50_000,
    ],
)
def test_time_is_proportional_to_the_page(text):
    began = time.process_time()
    html_extract.main_text(text)
    assert time.process_time() - began < 15  # about 1 s; quadratic time is minutes


def test_the_first_of_equal_containers_is_the_main_one():
    one, other = "Alpha, beta, gamma.", "Delta, omega, kappa."
    found = html_extract.main_text(f"<article><p>{one}</p></article><article><p>{other}</p></article>")
    assert found.split("\n\n")[0] == one


def test_deep_suspects_are_judged_in_linear_time():
    deep = "<div class='related-x'>" * 3000 + f"<p>{LONG}" + "</div>" * 3000
    assert html_extract.main_text(page(deep)) == " ".join(LONG.split())


LINKS = "<ul><li><a href=1>One, of many</a><li><a href=2>Two, of many</a></ul>"


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<main><h1>Title</h1><p>Lead.</p><article><p>{LONG}</p><p>{LONG}</p></article>{LINKS}<p>After.</p></main>", ["Title", "Lead.", LONG, LONG, "After."]),
        (f"<main><h1>Title</h1><div><article><p>{LONG}</p><p>{LONG}</p></article>{LINKS}</div></main><p>Out, side</p>", ["Title", LONG, LONG]),
        (f"<div><section><p>{LONG}</p><p>{LONG}</p></section><section><h2>B</h2><p>Short.</p></section></div>", [LONG, LONG, "B", "Short."]),
        (f"<div>Bare text before.<div><p>{LONG}</p><p>{LONG}</p></div>Bare <a href=1>x</a> after.<a href=2>Only a link</a><hr><a href=3>Link</a></div>",
         ["Bare text before.", LONG, LONG, "Bare x after.Only a link"]),
        (f"<div><div><p>{LONG}</p><p>{LONG}</p></div><ul><li>a<li>b</ul>{LINKS}<table><tr><td>c</table><figure>d</figure><h4>e</h4><ol><li>f</ol></div>",
         [LONG, LONG, "a", "b", "c", "d", "e", "f"]),
        # parts of one text in several children of the common parent
        (f"<div><h1>Title</h1><div><div><p>{LONG}</p><p>{LONG}</p></div></div><div><div><p>{LONG}</p></div></div><div><section><p>Small.</p></section></div>{LINKS}</div>",
         ["Title", LONG, LONG, LONG, "Small."]),
        (f"<div><article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p></article><article><p>Teaser.</p></article></div>", [LONG, LONG, LONG]),
    ],
)
def test_siblings_of_the_best_container(body, want):
    assert html_extract.main_text(page(MENU + body + FOOT)) == "\n\n".join(" ".join(w.split()) for w in want)
