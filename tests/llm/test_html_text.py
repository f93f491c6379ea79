import html
import re

import pytest

from centrum.llm.html_text import extract, main_text

LONG = "A sentence of the story, with commas, and enough words to count as a paragraph of prose. " * 3
SAY = " ".join(LONG.split())


def test_article_keeps_all_its_blocks_and_nothing_else():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/a>One</a></li></ul></nav><!-- ad --><div class="ad">Buy, buy, buy this thing now, it is really very good.</div>
    <div id="cookie-notice">We use cookies, many cookies, and you agree to them all.</div>
    <article><h1>Caf&eacute; &amp;  more&nbsp;here</h1><p><b>Lead.<br><p>{LONG}</p><p>No.</p><ul><li>item <a href=x>a</a></li><li>two</ul>
    <section><h2>Part</h2><div><p>{LONG}</div><p>Yes</section><form><input value=1>Name</form></article>
    <aside>Side text, with commas, that is long enough to score on its own merits.</aside>
    <section class="user-comments"><p>{LONG}</p></section><footer>&copy; all</footer></body></html>"""
    assert main_text(page).split("\n") == ["Café & more here", "Lead.", SAY, "No.", "item a", "two", "Part", SAY, "Yes"]


def test_containers_without_an_article_element():
    page = f"<body><div class=menu><a href=1>a</a></div><div id=wrap><div id=left><p>{LONG}</p><p>Short.</p><h3>Head</h3><p>{LONG}</p></div></div><div class='sidebar'><p>{LONG}</p></div></body>"
    assert main_text(page).split("\n") == [SAY, "Short.", "Head", SAY]
    assert main_text(f"<p>{LONG}<p>Second, short") == f"{SAY}\nSecond, short"
    assert main_text(f"<div><div><p>{LONG}</p></div><div><p>{LONG}</p></div></div>") == f"{SAY}\n{SAY}"


def test_link_lists_go_and_linked_prose_stays():
    links = "<ul>" + "<li><a href=x>Another story to read, really</a></li>" * 8 + "</ul>"
    assert main_text(f"<article><p>{LONG}</p>{links}<p>See <a href=y>this</a>.</p></article>") == f"{SAY}\nSee this."


@pytest.mark.parametrize("page", [None, "", " ", "<", "</", "<p", "<!--", "<script>x", "<div " * 3000, "<div>" * 20_000, "</div>" * 1000, "&#0;&#x110000;&bogus;", "<a b='", "\x00<p>\x00"])
def test_broken_pages_never_fail(page):
    assert isinstance(main_text(page or ""), str)


def test_truncated_page_keeps_what_is_there():
    assert main_text(f"<body><article><p>{LONG}</p><p>Cut &am") == f"{SAY}\nCut &am"
    assert main_text(f"<body><article><p>{LONG}</p><p>Cut</p><foo") == f"{SAY}\nCut"


def test_given_pages_equal_a_plain_reading_of_their_article(spark, folder):
    df = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r.text for r in extract(df, keep=["page_id", "url"]).collect()}
    assert len(got) == df.count()
    for r in df.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", inner)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", b)).split()) for b in blocks]
        assert got[r.page_id].split("\n") == [b for b in lines if b]


def test_rows_and_columns(spark):
    rows = [(1, None, "u", "x", 3), (1, None, "u", "x", 3), (None, f"<p>{LONG}", None, "x", 3)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string, extracted int")
    assert sorted((r.page_id or 0, r.text) for r in extract(df, keep=["page_id", "url"]).collect()) == [(0, SAY), (1, ""), (1, "")]
    assert extract(df.where("false"), keep=["page_id"]).collect() == []


@pytest.mark.parametrize("tag", ["svg", "math"])
def test_self_closed_foreign_elements_hide_nothing(tag):
    assert main_text(f"<body><{tag}/><article><p>{LONG}</p></article></body>") == SAY
    assert main_text(f"<div><{tag} width='1' />\n<p>{LONG}</p><p>Next</p></div>") == f"{SAY}\nNext"
    assert main_text(f"<article><p>Alpha <{tag}/> beta, {LONG}</p></article>") == f"Alpha beta, {SAY}"
    assert main_text(f"<article><p>{LONG}<{tag}><text>x</text></{tag}></p></article>") == SAY


def test_a_slash_closes_no_raw_html_element():
    for tag in ("script", "iframe", "textarea", "title"):
        assert main_text(f"<body><{tag} a='b'/>not shown</{tag}><article><p>{LONG}</p></article></body>") == SAY


def test_words_in_names_inside_an_article():
    kept = f"""<article><p class="comment-lead">Lead, in short.</p><section class="market-share"><h2 id="related-work">Work</h2><p>{LONG}</p></section>
    <div class="comment-box">Say something</div><div class="share-buttons">Share it</div><div class="ad">Buy this</div>
    <div class="related-reading"><a href=1>One more story</a> <a href=2>Two more stories</a></div>
    <div class="reply-jane">Me too, and again.</div><div class="reply-john">Me neither, at all.</div></article>"""
    assert main_text(kept).split("\n") == ["Lead, in short.", "Work", SAY]
    assert main_text(f"<body><article><p>{LONG}</p></article><div class='market-share'>Outside of it</div></body>") == SAY
