from __future__ import annotations

import html as escapes
import re

import pytest

from chartloom.llm import html
from chartloom.llm.queries import QUERIES

P1 = "The first paragraph has some sentences. They are long enough, and they have marks."
P2 = "A second one follows; it says &quot;more&quot; &amp; ends&nbsp;here."
P2_TEXT = 'A second one follows; it says "more" & ends here.'
JOINED = f"Title here\n\n{P1}\n\n{P2_TEXT}"

PAGES = [
    (f"<html><body><article><h1>Title here</h1><p>{P1}</p><p>{P2}</p></article></body></html>", JOINED),
    (f"<header><h2>Site name</h2></header><nav><a href=/>Home</a></nav><main><h1>Title here</h1><p>{P1}<p>{P2}</main><footer>&copy; x</footer>", JOINED),
    (f"<div class='page has-sidebar'><aside>Side words.</aside><div id=content><h1>Title here</h1><p>{P1}</p><p>{P2}</p></div>"
     f"<div class='cookie-notice'>We use things.</div><form><p>Your name please.</p><input></form></div>", JOINED),
    (f"<article><header class=article-header><h1>Title here</h1></header><p>{P1}</p><script>var a='<p>no</p>';</script><style>p{{}}</style>"
     f"<!-- <p>no</p> --><div class=ad>Buy it now.</div><p>{P2}</p><section id=comments><h2>Comments</h2><article class=comment><p>{P1}</p></article></section></article>", JOINED),
    (f"<form action=/><div class=menu><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><main><h1>Title here</h1><p>{P1}</p>\n<p>{P2}</p></main></form>", JOINED),
    (f"<ul class=nav><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul><table><tr><td><h1>Title here</h1><p>{P1}</p><p>{P2}</p></td></tr></table>", JOINED),
    (f"<article><h1>Title\n  here</h1><p><b>{P1[:20]}</b>{P1[20:]}<br><p>{P2}<p hidden>secret</article>", JOINED),
    (f"<article><h1>Title here</h1><p>{P1}</p><p>{P2}", JOINED),
    ("<article><p>1 < 2 and a &lt;b&gt; c</p></article>", "1 < 2 and a <b> c"),
    ("<article><p title=\"a>b\">x &eacute; &#233; &#xe9;</p></article>", "x é é é"),
    ("<p class=\"open>text<p>more", ""),
    ("", ""),
    (None, ""),
    ("no markup at all", "no markup at all"),
    ("<script>only()", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    if text or not page:
        assert html.main_text(page) == text
    else:
        html.main_text(page)


def plain_article(page):
    """Blocks of the pages' one template, by another way: split at block tags."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", inner)
    texts = [" ".join(escapes.unescape(re.sub(r"<[a-z/][^>]*>", " " if False else "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_query_against_the_template(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op3_html_extraction"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == plain_article(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def test_rows_and_columns(spark):
    rows = [(1, None, "u", "old"), (1, None, "u", "old"), (2, "<article>" + "<p>x y.</p>" * 20_000, None, "old"), (3, "<b" * 3000, "u", "old"), (4, "<p a='" * 2000, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = sorted((r["page_id"], len(r["text"])) for r in html.extract_text(df).collect())
    assert got[:2] == [(1, 0), (1, 0)] and got[2] == (2, 20_000 * 4 + 19_999 * 2)
    assert html.extract_text(df).columns == ["page_id", "url", "text"]
    assert html.extract_text(df.limit(0)).count() == 0
