"""Main text of written pages, and of the given ones against their article element."""

import re
from html import unescape

import pytest
from llm_tables import as_rows

from alarmloom.llm import html

PAGES = [
    ("", ""),
    (None, ""),
    ("<p>", ""),
    ("<article><p>A &amp; B&#33;<br>c  d</p><p>e<b>f</b>g</p></article>", "A & B! c d efg"),
    ("<header><p>Site</p></header><main><h1>T&eacute;</h1><p>Text<!-- no --> here<aside>side</aside></main><footer>f</footer>", "Té Text here"),
    ("<nav><a href=x>Menu</a></nav><article><p>Own</p><form><input>Search</form><div class='comments'><p>Their</p></div></article>", "Own"),
    ("<script>var x='<p>no</p>'</script><style>p{}</style><article>yes<script>1<2</script></article>", "yes"),
    ("<article><p>one<div class='ad'>buy</div><p>two<article class='comment'>no</article></article>", "one two"),
    ('<article><p title="a>b">kept</p><p hidden>gone</p></article>', "kept"),
    ("<body class='sidebar'><article><div id='cookie-notice'>We use</div>plain < text</article>", "plain < text"),
]
RUSSIAN = "Старый мельник каждое утро выходил к реке и долго смотрел на воду. "
PROSE = "The cat of the house was in the garden and it is that for the of and the dog that was on it with the bird of the sea. "


@pytest.mark.parametrize("page,text", PAGES)
def test_written_pages(page, text):
    assert html.main_text(page or "") == text


def test_prose_without_landmarks():
    linked = "<div>" + "<a href=x>read more</a> " * 5 + "</div>"
    page = f"<div class='menu'>Home</div><h2>Head</h2><p>{PROSE * 3}</p><p>Short.</p><p>{PROSE * 3}</p>{linked}<p>Tail</p>"
    assert html.main_text(page) == " ".join(["Head", (PROSE * 3).strip(), "Short.", (PROSE * 3).strip()])


def test_a_marked_heading_is_no_article():
    page = f"<body><div><h1 class='main-title'>Head</h1></div><div>{PROSE * 3}</div><footer>f</footer></body>"
    assert html.main_text(page) == f"Head {PROSE * 3}".strip()


@pytest.mark.parametrize("tag", ["p", "div"])
def test_languages_without_stop_words(tag):
    menu = "<div><a href=x>Главная</a> <a href=y>Новости</a></div>"
    one = f"<body>{menu}<{tag}>{RUSSIAN * 10}</{tag}><footer>Подвал</footer></body>"
    assert html.main_text(one) == (RUSSIAN * 10).strip()
    many = f"<body>{menu}" + f"<{tag}>{RUSSIAN}</{tag}>" * 3 + f"<{tag}>{RUSSIAN * 4}</{tag}><footer>Подвал</footer></body>"
    assert html.main_text(many).endswith((RUSSIAN * 4).strip()) and "Подвал" not in html.main_text(many)


def test_long_prose_outside_of_the_article_stays_and_teasers_go():
    body = f"<article><p>{PROSE * 4}</p></article><div>{PROSE * 2}</div><div>Buy now</div><div><a href=x>{PROSE}</a></div>"
    assert html.main_text(body) == f"{PROSE * 4}{PROSE * 2}".strip()


def test_pages_without_landmarks(spark):
    """With article made div, the rules alone keep the article and leave the furniture."""
    total = kept = whole = stray = 0
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for row in rows:
        article = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        truth = " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", article))).split())
        found = html.main_text(re.sub(r"(</?)article>", r"\1div>", row["html"]))
        total, kept, whole = total + len(truth), kept + min(len(found), len(truth)), whole + (found == truth)
        stray += len(found) > len(truth)
    assert stray == 0
    assert kept >= 0.95 * total and whole >= 0.9 * len(rows)


def test_ambiguous_blocks_follow_their_neighbours():
    g, b, s, n, h = html.GOOD, html.BAD, html.SHORT_BLOCK, html.NEAR, html.HEADING
    assert html.settle([g, s, s, b]) == [True, True, False, False]
    assert html.settle([g, s, b]) == [True, False, False]
    assert html.settle([g, n, b]) == [True, True, False]
    assert html.settle([b, h, g, h]) == [False, True, True, False]
    assert html.settle([s, n]) == [True, True]
    assert html.settle([html.OUT, s, html.OUT]) == [False, True, False]
    assert html.settle([g, s, html.OUT, b]) == [True, True, False, False]
    assert html.settle([]) == []


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["page_id"]: r for r in html.extract(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        text = " ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", article))).split())
        assert found[row["page_id"]]["text"] == text
        assert found[row["page_id"]]["n_chars"] == len(text)


def test_null_columns_and_empty_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, "<article>x</article>", "t", "n"), (None, "u", None, None, None), (1, None, "<article>x</article>", "t", "n")]
    found = html.extract(spark.createDataFrame(rows, schema))
    assert as_rows(found, "page_id", "url", "text", "n_chars") == sorted([(1, None, "x", 1), (None, "u", "", 0), (1, None, "x", 1)], key=repr)
    assert html.extract(spark.createDataFrame([], schema)).collect() == []


def test_long_broken_pages_end_soon():
    assert html.main_text("<p " * 20000) == html.main_text("<p " * 20000)
    assert len(html.main_text("<article>" + "<b>x " * 20000)) == 39999
