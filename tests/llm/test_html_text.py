import html
import re
import time

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import html_text
from pricelens.llm.html_text import extract_main_text, main_text
from pricelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "This is a long sentence, with commas, that tells a story; it goes on. "


def test_query_gives_the_articles(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    rows = QUERIES["op9_tag_path_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]])[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", article)))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


AROUND = (
    "<!doctype html><html><head><title>T &amp; t</title><style>p {x: '</p>'}</style><script>if (a < b) { '<p>no</p>' }</script></head><body>"
    "<header><h1>Site</h1><ul><li>Menu one<li>Menu two</ul></header><div class='cookie-notice'>We use cookies, really. " + LONG + "</div>"
    "<nav>Home</nav><div id=content>{}</div><aside><p>Side. " + LONG * 3 + "</aside><section class='comments'><h2>3 comments</h2>"
    "<div class=comment><p>" + LONG * 4 + "</p></div></section><div class='ad-banner'>Buy. " + LONG + "</div>"
    "<form><p>Sign up<input name=x><button>Go</button></form><footer>&copy; 2024. " + LONG * 2 + "</footer></body></html>"
)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>", "{}"])
def test_content_without_what_stands_around_it(wrap):
    body = f"<h1>Title</h1><p>{LONG * 3}</p><p>Short.<p>Caf&eacute; &#x41;&#66; &lt;b&gt; a&nbsp;b &amp c<br>next\n\t line</p><ul><li>one<li>two</ul><p>{LONG * 2}"
    want = "\n".join(["Title", (LONG * 3).strip(), "Short.", "Café AB <b> a b & c next line", "one", "two", (LONG * 2).strip()])
    assert main_text(AROUND.replace("{}", wrap.replace("{}", body))) == want


def test_article_header_and_comments_inside_the_article():
    page = ("<article><header><h1>Head</h1><span>by me</span></header><p>" + LONG * 2 + "</p><div class='advert'>Ad</div><div id='comments'><article><p>"
            + LONG * 9 + "</article></div></article>")
    assert main_text(page) == "Head\n" + (LONG * 2).strip()


def test_several_articles_are_joined():
    page = "<body>" + "".join(f"<article><p>{x} {LONG * n}</p></article>" for x, n in [("A", 3), ("B", 2), ("C", 4)]) + "</body>"
    assert main_text(page) == "\n".join(f"{x} {LONG * n}".strip() for x, n in [("A", 3), ("B", 2), ("C", 4)])


def test_text_beside_teaser_articles():
    teasers = f"<article><p>Teaser, {LONG * 5}</p></article>"
    body = f"<div class=text><p>{LONG * 9}</p><p>{LONG * 8}</p></div>"
    assert main_text(f"<body>{body}<div>{teasers}</div></body>") == "\n".join([(LONG * 9).strip(), (LONG * 8).strip()])


def test_anchor_ids_of_headings_and_sections_are_no_surroundings():
    page = f"<article><h2 id='related-work'>Related work</h2><p>{LONG * 3}</p><section id=discussion><p>{LONG * 2}</p></section></article>"
    assert main_text(page) == "\n".join(["Related work", (LONG * 3).strip(), (LONG * 2).strip()])


LINKS = "<div class=list><ul>" + "<li><a href=x>Some other page of this site with a long name</a></li>" * 60 + "</ul></div>"
PROSE = f"<h2>Head</h2><p>{LONG * 3}</p><p>Short one</p><p>{LONG * 2}</p>"
PROSE_TEXT = "\n".join(["Head", (LONG * 3).strip(), "Short one", (LONG * 2).strip()])


def test_scores_choose_the_content_without_article_or_main(monkeypatch):
    page = f"<body><div>{PROSE}</div>{LINKS}</body>"
    assert main_text(page) == PROSE_TEXT
    monkeypatch.setattr(html_text, "path_scores", lambda nodes, above: {n.path: 1.0 for n in nodes})
    assert main_text(page) != PROSE_TEXT


def test_scores_choose_among_the_blocks_of_one_container(monkeypatch):
    page = f"<body><div>{PROSE}<p class=related>Elsewhere: more of it</p></div></body>"
    assert main_text(page) == PROSE_TEXT
    monkeypatch.setattr(html_text, "path_scores", lambda nodes, above: {n.path: 1.0 for n in nodes})
    assert main_text(page) != PROSE_TEXT


@pytest.mark.parametrize("name", "tags alert reply search related share toc social discussion header widget".split())
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>"])
def test_prose_under_a_doubtful_name_stays(name, wrap):
    body = f"<p>{LONG * 3}</p><div class={name}><p>{LONG * 3}</p></div><p>{LONG * 2}</p><p class={name}>one two</p>"
    assert main_text("<body><nav>Home</nav>" + wrap.replace("{}", body) + "</body>") == "\n".join([(LONG * 3).strip()] * 2 + [(LONG * 2).strip()])


def test_a_form_round_the_page_and_one_beside_the_text():
    assert main_text(f"<body><form action=x><div>{PROSE}</div></form></body>") == PROSE_TEXT
    sign = "<form><p>Leave your address, please, and your name.</p></form>"
    assert main_text(f"<body><div>{PROSE}{sign}</div></body>") == PROSE_TEXT


def test_cost_of_deep_pages_is_not_nodes_times_depth():
    page = "<article>" + "<i>" * 500 + "<b>x, y.</b> " * 20_000
    start = time.process_time()
    text = main_text(page)
    assert text == " ".join(["x, y."] * 20_000) and time.process_time() - start < 2


@pytest.mark.parametrize("page", ["", None, "   ", "<html></html>", "<nav>Home</nav>", "<script>x", "<!-- x", "<p", "<"])
def test_pages_without_text(page):
    assert main_text(page) == ""


def test_plain_text_and_broken_markup():
    assert main_text("just text, no tags") == "just text, no tags"
    assert main_text("<article><p>a < b &amp; c <b>bold<p>next</i></div> end") == "a < b & c bold\nnext end"
    assert main_text("<article>" + "<div>" * 3000 + "<p>deep, deep text.</p>") == "deep, deep text."


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/pab!-=\"' &;article.div\n"), max_size=80))
def test_any_input_is_parsed(page):
    text = main_text(page)
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n")) and "\n\n" not in text


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "<article><p>x.</article>"), (3, "<p>" + LONG * 5000)]
    pages = spark.createDataFrame([(*r, "c", "c") for r in rows], "page_id long, html string, text string, main_text string")
    got = [(r["page_id"], r["main_chars"]) for r in extract_main_text(pages).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (2, 0), (None, 2), (3, len((LONG * 5000).strip()))], key=str)
    assert extract_main_text(pages.limit(0)).count() == 0
