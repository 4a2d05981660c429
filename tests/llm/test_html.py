import html
import re
import time

import pyarrow.parquet as pq

from lexforge.llm import queries
from lexforge.llm.html import extracted, main_text
from tests.llm.fixtures import SF

PAGE = """<html><head><title>T</title><script>if(a<b){document.write("<p>x</p>")}</script><style>p{}</style></head>
<body class="no-sidebar"><header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li>menu<li>more</ul></nav>
<div id="cookie-notice">We use cookies &amp; more text here, long and longer than others, accept them please now.</div>
<div class="wrapper"><div class="content"><h2>Real   title</h2><p>First <a href="x">link</a> and &eacute;t&eacute;&nbsp;x.<br>Second line
<p>Unclosed <b>bold<p>Third.<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></div>
<div class="sidebar"><p>Side bar text side bar text side bar text</p></div></div>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Reader says a long long long long text that goes on and on and on</p></div></section>
<form><label>Name</label><input name=a></form><!-- gone --><footer>&copy; me</footer></body></html>"""


def test_page():
    assert main_text(PAGE).split("\n\n") == ["Real title", "First link and été x. Second line", "Unclosed bold", "Third.", "one", "two", "c1", "c2"]


def test_article_keeps_its_heading_and_short_paragraphs():
    page = "<body><header>Site</header><article class='post'><header><h1>Head</h1></header><p>a</p><p>" + "long text " * 50 + "</p><aside>x</aside><p>b</p><footer>by me</footer></article><div class=related-posts><p>" + "other " * 99 + "</p></div></body>"
    assert main_text(page) == "Head\n\na\n\n" + ("long text " * 50).strip() + "\n\nb"


def test_odd_pages(spark):
    odd = [None, "", " ", "plain &lt; text", "<p>a", "<div>", "<!-- x", "<script>a</script>b", "&#65;&#x42;<p>x</p><p>y", "<p>" * 3000 + "deep", "<div>" * 3000 + "deep", "<p>" + "very long " * 50_000 + "</p>"]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(odd)], "page_id long, html string, text string, n_chars string")
    got = [r.text for r in extracted(rows).orderBy("page_id").collect()]
    assert got == ["", "", "", "plain < text", "a", "", "", "b", "AB\n\nx\n\ny", "deep", "deep", ("very long " * 50_000).strip()]
    assert extracted(rows.limit(0)).count() == 0


def test_other_markup_changes_nothing():
    """The density finds the same text without an article element, and with one also without the advert's name."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    assert len(pages) == 250
    for page in pages:
        want = main_text(page)
        assert want and main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")) == want
        assert main_text(page.replace(' class="ad"', "")) == want


def test_names_alone_drop_nothing():
    long = "some words of a longer paragraph that goes on " * 4
    for name in ("notice", "social", "trending", "widget", "hidden"):
        page = f"<body><div><h1>Head</h1><p>{long}</p><p class={name}>{long}</p><p>{long}</p><div class=ad>Buy it</div></div></body>"
        assert main_text(page).split("\n\n") == ["Head", *[long.strip()] * 3]
    comments = f"<div class=comments><p>{long}</p><p>{long}</p><p>{long}</p></div>"
    page = f"<body><h1>Head</h1><div><p>{long}</p><p>short</p><p>{long}</p></div><h2>More</h2><ul><li><a href=x>{long}</a></ul>{comments}</body>"
    assert main_text(page).split("\n\n") == ["Head", long.strip(), "short", long.strip()]
    assert main_text(f"<body><div class=widget><p>{long}</p><p>{long}</p></div></body>").count("longer") == 8


def test_time_is_linear():
    n = 30_000
    for page in ("<div>" * n + "</b>" * n, "<b>" * n + "<div></div>" * n, "<title>" * n, "<b><table><td>" + "<div>" * n + "</b>" * n, "<article>" + "<header>" * n, "<li>" * n, "<p>" * n + "</i>" * n):
        began = time.time()
        main_text(page)
        assert time.time() - began < 5


def test_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op6_html_text(spark, SF).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", body))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_wrappers_of_the_whole_page():
    text = "long text " * 40
    for tag in ("form", "fieldset", "object"):
        page = f"<body><{tag} id=aspnetForm><nav>menu</nav><input name=a><select><option>x</select><article><h1>Head</h1><p>{text}</p></article><button>Go</button></{tag}></body>"
        assert main_text(page) == f"Head\n\n{text.strip()}"
        page = f"<body><{tag}><div><h1>Head</h1><p>{text}</p></div><div><label>Name</label><textarea>y</textarea></div></{tag}><p>short</p></body>"
        assert f"Head\n\n{text.strip()}" in main_text(page) and "Name" not in main_text(page)
        page = f"<body><main><p>{text}</p><{tag}><p>Write to us</p></{tag}></main></body>"
        assert main_text(page) == text.strip()
    assert main_text("<body>" + "<form><fieldset>" * 3000 + f"<main>{text}</main>") == text.strip()
