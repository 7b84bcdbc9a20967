"""Main text of pages: the tables' own template against a plain version, and hand-written pages."""

import html
import re

import pytest
from pyspark.sql import functions as F

from wardline.llm import line_blocks, queries
from wardline.llm.line_blocks import main_text

P1 = "The first paragraph of the article says a good deal about the matter at hand, in several words."
P2 = "The second one is as long as the first, so that windows over three lines add up to a lot of text."
SHORT = "So it is."
BODY = f"<h1>Title</h1><p>{P1}</p><p>{SHORT}</p><p>{P2}</p>"
WANT = f"Title\n{P1}\n{SHORT}\n{P2}"

BESIDE = [
    '<nav><ul><li><a href="/">Home</a></li><li>About us and what we do here every day</li></ul></nav>', "<header><h1>The Daily Site</h1><p>News and more news, from all over the country</p></header>",
    "<footer><p>Copyright 2024 The Daily Site. All rights reserved, whatever they are, by whoever has them.</p></footer>", f'<aside><h2>Also read</h2><p>{P2} Elsewhere.</p></aside>',
    '<div class="ad">Buy this wonderful thing today, it is cheaper than all the other things you could buy.</div>', "<form><label>Name</label><input name=n><p>Write to us by this form</p><button>Send</button></form>",
    "<script>document.write('<p>never</p>')</script>", "<style>p > a { color: red }</style>", f"<!-- <p>{P1}</p> -->", '<div id="cookie-notice"><p>We use cookies, as everybody else does, to make this site work.</p></div>',
    f'<section class="comments"><h2>Comments</h2><article><p>{P1} I do not agree!</p></article><div>{P2}</div></section>', f'<div class="SideBar left"><p>{P1}</p></div>',
    '<div role="navigation">Somewhere to go, and another place to go to</div>', '<div hidden><p>Not shown to anybody</p></div>', '<div style="display: none">Nor this</div>',
    '<ul class="breadcrumb"><li>Home</li><li>News</li></ul>', '<div class="newsletter-signup"><p>Get our letter once a week</p></div>', "<noscript><p>Turn on scripts</p></noscript>",
    '<div class="related-posts"><p>Another article, that is about something else</p></div>', '<dialog open><p>Sign in to read on</p></dialog>',
]


@pytest.mark.parametrize("part", BESIDE)
def test_what_is_no_article(part):
    for page in (f"<body>{part}<article>{BODY}</article></body>", f"<body><article>{BODY}</article>{part}", *(() if "<header>" in part else (f"<main>{part}{BODY}</main>", f"<article>{BODY}{part}</article>")),
                 f"<body>{part}<div>{BODY}</div></body>", f'<body><div class="has-sidebar wrap"><div class="post">{BODY}</div>{part}</div></body>'):
        assert main_text(page) == WANT, page


def test_blocks_and_references():
    assert main_text("<article><p>a &amp; b&nbsp;c&#x41;&#66; &copy &lt;p&gt;</p><P CLASS=x>one<br>two\n\n three<b>four</b>five</P>six</article>") == "a & b cAB \xa9 <p>\none two threefourfive\nsix"
    assert main_text("<article><ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2<tr><th>3</table></article>") == "x\ny\nz\n1 2\n3"
    assert main_text("<article><p><b>un closed<br><p>next</i></div></article>") == "un closed\nnext"
    assert main_text('<article title="a > b"><p data-x=\'</article>\' lang=it\'s>kept</p><p>2 < 3 and 4 > 3</p></article>') == "kept\n2 < 3 and 4 > 3"
    assert main_text("<article><p>cut o") == "cut o" and main_text("<article><p>cut<p cla") == "cut" and main_text("<article><p>cut<!-- o") == "cut"
    assert main_text("<article><a href='/x'>all of it is a link</a><h2>Ad</h2><p>x</p></article>") == "all of it is a link\nAd\nx"


def test_pages_without_marks():
    menu = "<div><ul>" + "".join(f'<li><a href="/{i}">Link number {i} of the menu of this page</a></li>' for i in range(12)) + "</ul></div>"
    assert main_text(f"<html><body>{menu}<div>{BODY}</div><div>(c) 2024</div></body></html>") == WANT
    assert main_text(f"<form id=aspnet>{menu}<div>{BODY}</div></form>") == WANT
    assert main_text(f"<body>{menu}<div>{P1}</div><div>{SHORT}</div><div>{P2}</div>{menu}</body>") == f"{P1}\n{SHORT}\n{P2}"
    assert main_text("just some words, no tags at all") == "just some words, no tags at all"
    assert main_text("<p>tiny</p>") == "tiny" and main_text(menu) == "" and main_text("<div></div>") == "" and main_text(None) == main_text("") == main_text(" \n") == ""
    assert main_text(f"<body><nav>{menu}<article>{BODY}</article>") == WANT  # a menu that is never closed


def test_long_and_deep_pages():
    many = "".join(f"<p>Paragraph {i} of a long article, with some words in it.</p>" for i in range(30_000))
    assert main_text(f"<nav>x</nav><article>{many}</article>").count("\n") == 29_999
    assert main_text("<div>" * 20_000 + P1) == P1
    assert main_text("<p>" + "<b>" * 20_000 + P1 + "<p>" + P2) == f"{P1}\n{P2}"
    assert main_text("<a '" * 5_000) == "" and main_text("<" * 5_000) == "<" * 5_000


def plain(source):
    """For the tables' template only."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", source, re.S)[1])
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def test_query(spark, sf):
    found = {r["page_id"]: r for r in queries.op12_line_blocks(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(found) == len(pages)
    for r in pages:
        assert found[r["page_id"]]["text"] == plain(r["html"]) and found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"]) and found[r["page_id"]]["url"] == r["url"]


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "u", "t", 1), (2, "", None, "t", 1), (None, f"<article>{BODY}\U0001F600</article>", "u", "t", 1)]
    df = spark.createDataFrame([*rows, rows[2]], "page_id long, html string, url string, text string, n_chars int")
    df.write.parquet(str(tmp_path / "a" / "pages.parquet"))
    got = sorted((tuple(r) for r in queries.op12_line_blocks(spark, str(tmp_path / "a")).collect()), key=repr)
    full = WANT + "\n\U0001F600"
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", full, len(full)), (None, "u", full, len(full))], key=repr)
    df.limit(0).write.parquet(str(tmp_path / "b" / "pages.parquet"))
    assert queries.op12_line_blocks(spark, str(tmp_path / "b")).collect() == []
    assert line_blocks.extracted(df, F.col("html"), {"text2": F.col("text"), "k0": F.col("n_chars")}).first().asDict().keys() == {"text2", "k0", "text"}
