import pytest

from tidemark.llm.html_extract import blocks_of, extract_pages, main_text

P1, P2, P3 = "The first paragraph has more than a few words in it, as text does.", "A second one with a <a href='/x'>link &amp; some</a> words goes on for a while here.", "Short one."
T1, T2, T3 = P1, "A second one with a link & some words goes on for a while here.", P3

ARTICLE = f"<h1>A title of it</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = f"A title of it\n{T1}\n{T2}\n{T3}"
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/a'>About us</a></li></ul>"
SHELLS = {
    "article": f"<header><p>Site name</p></header><nav>{MENU}</nav><article>%s</article><aside><p>{P1}</p></aside><footer>&copy; us and some more words that go on</footer>",
    "classes": f"<div id='top-menu'>{MENU}</div><div class='cookie-notice'><p>{P1}</p></div><article>%s<div class='comments'><p>{P1}</p></div></article><div class='sidebar'>{MENU}</div>",
    "forms": f"<main>%s<form><p>{P1}</p><input><label>Name</label></form></main><script>if (a < b) {{ c('<p>x</p>') }}</script><style>p {{}}</style><noscript>{P1}</noscript>",
    "unclosed": f"<nav>{MENU}</nav><div class=ad><p>{P1}</div><article>%s</article><footer>end",
    "adverts": f"<article>%s<div class='advert'><p>{P1}</p></div></article><section class='related'>{MENU}</section><div hidden><p>{P2}</p></div>",
}


@pytest.mark.parametrize("shell", SHELLS)
@pytest.mark.parametrize("wrap", ["{}", "<!DOCTYPE html><html><head><title>No</title></head><body>{}</body></html>", "<html><body>{}"])
def test_article_in_its_shell(shell, wrap):
    assert main_text(wrap.format(SHELLS[shell] % ARTICLE)) == TEXT


@pytest.mark.parametrize(("wrap", "plain"), [("<div class='layout has-sidebar'>{}</div>", "{}"), ("<form action='x'>{}</form>", "{}"), ("<main><form>{}</form></main>", "<main>{}</main>"), ("<form><div class='with-sidebar'><div id='page-menu'>{}</div></div></form>", "{}")])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div>{}</div>"])
def test_article_in_a_wrapper_that_holds_the_page(wrap, plain, inner):
    """As if the wrapper were not there."""
    page = lambda w: f"<nav>{MENU}</nav>" + w.format(inner.format(ARTICLE) + f"<div class='sidebar'>{MENU}</div>") + "<footer><p>End</p></footer>"
    assert T2 in main_text(page(wrap)) and main_text(page(wrap)) == main_text(page(plain))


def test_comments_longer_than_the_article_stay_outside():
    comments = "<div class='comments'>" + f"<article><p>{P1}</p></article>" * 9 + "</div>"
    assert main_text(f"<article>{ARTICLE}</article>{comments}") == main_text(f"<article>{ARTICLE}{comments}</article>") == TEXT


def test_page_without_article_element():
    page = f"<div>{MENU}</div><div><h1>A title of it</h1><p>{P1}</p><p>{P2}</p><p>{P1}</p></div><div><a href=x>Next page</a></div><div>{MENU}</div>"
    assert main_text(page) == f"A title of it\n{T1}\n{T2}\n{T1}"


@pytest.mark.parametrize(("html", "text"), [("", ""), ("<", "<"), ("<p>a &lt;b&gt; &#233; &eacute;&nbsp;c<p>d", "a <b> é é c\nd"), ("<article><p>x<br>y\n\n z</p></article>", "x y z"), ("<!-- <p>no</p> --><article>1 < 2 & 3 > 2</article>", "1 < 2 & 3 > 2"), ("<article><p title='a>b'>c</p></article>", "c"), ("<article><script>never closed <p>x", ""), ("<article><p>a</p><i b='never closed <p>x</p>", "a\nx")])
def test_odd_pages(html, text):
    assert main_text(html) == text


def test_long_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for unit in ("<", "<a '", "<!--", "<p>x ", "<div>", "</div>", "&amp", "<div></span>"):
        main_text("<article>" + unit * 40_000)
    assert time.perf_counter() - began < 30


def test_blocks_have_words_links_and_signs():
    got = [(b.text, b.words, b.linked, b.heading, b.article, round(b.article_share, 2), b.aside, round(b.aside_share, 2)) for b in blocks_of("<nav><a>x y</a></nav><article><h2>T</h2>a <a>b c</a><div class='ad-box social-history'>d</div></article>")]
    assert got == [("x y", 2, 2, 0, 0, 0.71, 2.0, 0.29), ("T", 1, 0, 1, 1, 0.71, 0.0, 0.0), ("a b c", 3, 2, 0, 1, 0.71, 0.0, 0.0), ("d", 1, 0, 0, 1, 0.71, 1.0, 0.14)]


def test_words_in_a_class_that_only_sound_like_something_else():
    assert T1 in main_text(f"<article><h1>T</h1><section class='social-history'><p>{P1}</p><p>{P2}</p></section></article>")


@pytest.mark.parametrize("tag", ["button", "select", "video", "svg"])
def test_unclosed_elements_end_at_the_next_block(tag):
    assert main_text(f"<article><h1>A title of it</h1><p>{P1} <{tag}>x</p><p>{P2}</p></article>") == f"A title of it\n{T1}\n{T2}"


def test_formulas_are_text():
    assert main_text(f"<article><p>{P1} So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == f"{T1} So x=2 holds."


def test_a_teaser_in_an_article_element_is_not_the_page():
    page = f"<div class='content'><h1>A title of it</h1><p>{P1} {P1}</p><p>{P2} {P1}</p><p>{P1} {P1} {P1}</p></div><article><p>More to read here <a href=x>on this and that</a></p></article>"
    assert main_text(page) == f"A title of it\n{T1} {T1}\n{T2} {T1}\n{T1} {T1} {T1}"


def test_the_tree_decides_where_no_element_does():
    """Without article elements, hints and forms: blocks stay or go by words, links and neighbours, and a tree that is turned
    round gives the rest of the page."""
    from dataclasses import replace

    from tidemark.llm.html_extract import FEATURES, trained

    page = f"<div>{MENU}</div><div><h1>A title of it</h1><p>{P1}</p><p>{P2}</p><p>{P1}</p></div><div><a href=x>Next page</a></div><div>{MENU}</div>"
    other = replace(trained(), value=1 - trained().value)
    assert main_text(page) == f"A title of it\n{T1}\n{T2}\n{T1}" and main_text(page, other) == "Home\nNews\nAbout us\nNext page\nHome\nNews\nAbout us"
    inner = trained().left != range(len(trained().left))
    assert {"words", "links", "links_before", "words_before", "links_after"} <= {FEATURES[f] for f in trained().feature[inner]}


def test_pages(spark):
    rows = [(1, "u", SHELLS["article"] % ARTICLE, "x", 1), (None, None, None, "x", 1), (2, "u", "", "x", 1), (1, "u", SHELLS["article"] % ARTICLE, "x", 1)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.page_id, r.text, r.n_chars) for r in got), key=repr) == sorted([(1, TEXT, len(TEXT)), (None, "", 0), (2, "", 0), (1, TEXT, len(TEXT))], key=repr)
    assert extract_pages(spark.createDataFrame([], schema)).count() == 0
