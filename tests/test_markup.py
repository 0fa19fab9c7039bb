"""Parts of pages: hand-made pages against expected values, and every query's SQL on the same pages."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import markup
from tests.test_queries import plain

FIRST = """<html><head><title>T</title><meta name="Description" content="d &amp; 1"><meta property='og:title' content=t><META NAME="description" CONTENT="d2"><meta name="" content="x"><meta name=empty content="">
<script type="application/ld+json">{"@type": "FAQPage", "mainEntity": [{"name": "Why?", "acceptedAnswer": {"text": "So."}}, {"name": "Empty?"}]}</script></head><body>
<nav aria-label="Breadcrumb"><ol><li><a href="/">Home</a></li><li><span>Docs <b>here</b></span></li><li>Now</li></ol></nav>
<h2>One  Two</h2><p>first<p>more<h2>Two</h2><p>second</p><h2>One Two</h2><p>third</p><div class="x ad y"><p>buy</p></div><div id=footer><p>bye</p></div><p data-ad="1">ad</p>
<details><summary>Open?</summary>Yes &lt;b&gt;</details><details><summary></summary>nothing</details>
<table><tr><th>h<b>1</b></th><th>h2</th></tr><tr><td>1<td>2<tr><td> <td></table><table></table>
<a href="/contact-us">c</a><a href="https://o.org/CONTACT#x">c</a></body></html>"""
SECOND = """<div itemscope itemtype="https://schema.org/FAQPage"><div itemprop="mainEntity" itemtype="https://schema.org/Question"><h3 itemprop="name">Q <i>one</i>?</h3>
<div itemprop="acceptedAnswer" itemtype="https://schema.org/Answer"><div itemprop="text">A one.</div></div></div><div itemtype="https://schema.org/Question"><h3 itemprop="name">no answer</h3></div></div>
<ol itemscope itemtype="https://schema.org/BreadcrumbList"><li itemprop="itemListElement"><a href="/"><span itemprop="name">Start</span></a></li><li><span itemprop=name>End</span></li></ol>
<nav aria-label="breadcrumbs"><a>ignored</a></nav><details><summary>not</summary>used</details><ul><li>outer<ul><li>inner</li></ul></li></ul><!-- <p>comment</p> --><style>p{}</style>"""
LONG = " ".join(f"word{k}" for k in range(30))
ARTICLE = f"""<html><head><title>Long words here</title></head><body><div class="menu"><ul>{"".join(f'<li><a href="/{k}">Menu item {k} with words</a></li>' for k in range(8))}</ul></div>
<div><h1>A heading</h1><div>{LONG} end one.</div><p>{LONG} <a href="/x">a link</a> end two.</p><p>Short.</p><p>{LONG} end three.</p><table><tr><td>cell a</td><td>cell b</td></tr></table>
<h2>Related</h2><ul><li><a href="/r1">Read another long story about it</a></li><li><a href="/r2">And one more of them</a></li></ul></div>
<div id="comments"><p>{LONG} a comment.</p></div><form><select><option>One<option>Two</select><button>Go</button></form><footer>{LONG} imprint</footer></body></html>"""
PAGES = [
    (1, "https://h.org/x/", FIRST), (2, "https://h.org/y", SECOND), (3, "https://h.org/z", ARTICLE), (4, "https://h.org/n", None), (5, "https://h.org/e", ""), (6, "https://h.org/t", "only text & more"),
    (7, "https://h.org/b", "<p title=\"a > b\" class='q'>kept</p><p>it's <b attr='<'>odd</b> < 3 </wrong></p></p><p>after"), (8, "https://h.org/c", "<!-- open <p>gone"), (9, None, "<ul><li>a<li>b</ul><h2>H</h2>"),
]
QUERIES = ["meta_map", "breadcrumbs", "faq_extract", "tables", "html_sections", "main_text", "faq_jsonld", "contact_links", "headings", "page_title", "visible_text"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_sql_on_made_pages(spark, pages, name):
    import duckdb

    from siftline.registry import ORACLES
    from siftline.registry import QUERIES as ALL

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS FROM '{pages}/pages.parquet/*.parquet' " + ("" if name not in ("headings", "contact_links", "faq_jsonld", "visible_text", "page_title") else "WHERE html IS NOT NULL AND url IS NOT NULL"))
    if name in ("headings", "contact_links", "faq_jsonld", "visible_text", "page_title"):
        some = spark.read.parquet(f"{pages}/pages.parquet").where("html is not null and url is not null")
        some.coalesce(1).write.mode("overwrite").parquet(f"{pages}/whole/pages.parquet")
        pages = f"{pages}/whole"
    df, found = ALL[name](spark, pages), c.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert sorted(df.columns) == sorted(columns) and got == plain(found.fetchall(), columns) and got


@pytest.fixture(scope="module")
def rows(spark, pages):
    return spark.read.parquet(f"{pages}/pages.parquet")


@pytest.fixture(scope="module")
def parts(rows):
    return {r["page_id"]: r for r in markup.parts(rows).collect()}


def test_every_page_has_parts(parts):
    assert sorted(parts) == list(range(1, 10))
    for k in (4, 5):
        assert [list(parts[k][c]) for c in ("meta", "breadcrumbs", "faq", "tables", "sections")] == [[]] * 5


def test_meta_and_breadcrumbs(parts):
    assert [tuple(m) for m in parts[1]["meta"]] == [("description", "d2"), ("og:title", "t")]
    assert parts[1]["breadcrumbs"] == ["Home", "Docs here", "Now"]
    assert parts[2]["breadcrumbs"] == ["Start", "End"]


def test_faq_and_tables(parts):
    assert [tuple(f) for f in parts[1]["faq"]] == [("Open?", "Yes <b>")]
    assert [tuple(f) for f in parts[2]["faq"]] == [("Q one ?", "A one.")]
    assert [(t["headers"], t["rows"]) for t in parts[1]["tables"]] == [(["h1", "h2"], [["h 1", "h2"], ["1", "2"]])]


def test_sections_outside_noise(parts):
    assert [tuple(s) for s in parts[1]["sections"]] == [("one_two", "third 1 2"), ("two", "second")]
    assert [tuple(s) for s in parts[2]["sections"]] == [("no_answer", "Start End outer inner inner")]
    assert parts[7]["sections"][0]["text"].startswith("kept it's")


def test_main_text(rows):
    text = {r["page_id"]: r["text"] for r in markup.main_text(rows).collect()}
    assert text[3].split("\n") == ["A heading", f"{LONG} end one.", f"{LONG} a link end two.", "Short.", f"{LONG} end three.", "cell a", "cell b"]
    assert text[4] == text[5] == "" and text[6] == "only text & more"


def test_tags_cost_linear_time(spark):
    """Unclosed tags, quotes and comments, ten thousand of each, in one page."""
    import time

    page = "<a " * 10_000 + '<b "' * 10_000 + "<!-" * 10_000 + "<p>" * 10_000 + "end"
    start = time.time()
    spark.createDataFrame([(1, page)], "page_id long, html string").select(F.size(markup.found(F.col("html"), markup.TOKEN))).collect()
    assert time.time() - start < 20


REFERENCES = ["&#8217;s", "&#x2019;&#X2013;", "&amp;lt; &lt;b&gt;", "a &eacute;&Eacute;&apos;&quot; b", "&nosuch; & &;", "&#128;&#150;", "&#128512;", "&#0;&#xD800;&#x110000;", "&&amp;&", "", "plain", "&nbsp;x&#160;y", "&#39;'&copy;&hellip;&rarr;"]


def test_character_references(spark):
    """As the standard library decodes them (no-break spaces as blanks), in columns and in SQL."""
    import html

    import duckdb

    from siftline import sqltext
    from siftline.functions.text import unescaped

    texts = [*REFERENCES, "&amp", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = [r["u"] for r in df.orderBy("k").select(unescaped(F.col("t")).alias("u")).collect()]
    assert got == [*(html.unescape(x).replace("\xa0", " ") for x in REFERENCES), "&amp", None]
    c = duckdb.connect()
    c.execute("CREATE TABLE x(k BIGINT, t VARCHAR)")
    c.executemany("INSERT INTO x VALUES (?, ?)", list(enumerate(texts)))
    assert [r[0] for r in c.execute(f"SELECT {sqltext.unescaped('t')} FROM x ORDER BY k").fetchall()] == got
