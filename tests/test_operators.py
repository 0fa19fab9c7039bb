"""Hand-made cases of the reference's operators."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import html as H
from siftline.functions import lexicon
from siftline.functions import text as T
from siftline.functions.stem import stem
from siftline.operators import answer, chunks, crawl, index, query, retrieve, sections


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def column(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


def words(n, word="word"):
    return " ".join([word] * n)


def pack(spark, sizes):
    rows = [(1, k, f"s{k}", words(n), n) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "page int, pos long, key string, text string, wc long")
    return [(r["key"], r["wc"]) for r in chunks.packed(df, "page").orderBy("n").collect()]


@pytest.mark.parametrize(
    "sizes, expected",
    [
        ([9], []), ([10], []), ([14], []), ([15], [("s0", 15)]), ([49], [("s0", 49)]), ([50], [("s0", 50)]), ([700], [("s0", 700)]),
        ([701], [("s0", 701)]), ([20, 60], [("s0", 20), ("s1", 60)]), ([30, 30, 12], [("s1", 60)]), ([30, 30, 15], [("s1", 60), ("s2", 15)]), ([12, 701, 14], [("s0", 12), ("s1", 701)]),
    ],
)
def test_packing_sizes(spark, sizes, expected):
    assert pack(spark, sizes) == expected


def test_long_section_is_cut_at_sentences(spark):
    text = ". ".join([words(300)] * 3) + "."
    df = spark.createDataFrame([(1, 0, "k", text, 900)], "page int, pos long, key string, text string, wc long")
    assert [r["wc"] for r in chunks.packed(df, "page").orderBy("n").collect()] == [600, 300]


def test_unique_keys_skip_used_suffixes(spark):
    names = ["A", "a", "a 2", "a", ""]
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate(names)], "page int, pos int, name string")
    assert [r["key"] for r in sections.unique_keys(df, "page").orderBy("pos").collect()] == ["a", "a_2", "a_2_2", "a_3", "section"]


def test_faq_chunks_number_all_pairs(spark):
    df = spark.createDataFrame([(1, [("q1", ""), ("q2", "a2")])], "page int, faq array<struct<question:string,answer:string>>")
    assert values(chunks.faq_chunks(df, "page"), "chunk_id", "text") == [("1_faq_002", "Q: q2\nA: a2")]


def test_page_type_of_short_paths(spark):
    for url, kind in (("https://h.org", "home"), ("https://h.org/x", "home"), ("https://h.org/x/", "general"), ("https://h.org/a/b", "general"), ("https://h.org/blog", "blog")):
        assert column(spark, url, T.page_type) == kind
    assert column(spark, "https://h.org/x", lambda u: T.page_type(u, lexicon.PAGE_TYPES_V1)) == "home"


def test_lines_description_and_contact_links(spark):
    page = """<head><meta name="description" content="What &amp; why"><title>T</title></head><body><nav>n</nav><h1>Big <b>title</b></h1><p>One<br>two &lt;3</p>
    <ul><li>a</li><li>b</li></ul><a href="/Contact-us">c</a><a href="mailto:contact@h.org">m</a></body>"""
    df = spark.createDataFrame([(page, "https://h.org/x/")], "html string, url string")
    r = df.select(H.visible_lines(F.col("html")).alias("t"), H.description(F.col("html")).alias("d"), H.contact_links(F.col("html"), F.col("url")).alias("c")).first()
    assert r["t"] == "Big title\n\nOne\ntwo <3\n\na\nb\n\ncm" and r["d"] == "What & why"
    assert r["c"] == ["https://h.org/Contact-us", "mailto:contact@h.org"]


SITE = """<html><head><title>{0}</title><meta name="description" content="{1}">{3}</head><body><nav>Home</nav><h1>{0}</h1>{2}</body></html>"""
FAQ_JSON = """<script type="application/ld+json">{"@type": "FAQPage", "mainEntity": [{"name": "What are the filing fees?", "acceptedAnswer": {"text": "Two hundred."}}, {"name": "Nothing?"}]}</script>"""


@pytest.fixture(scope="module")
def site(spark):
    para = lambda w, n: "<p>" + " ".join(f"{w} word{k} and more" for k in range(n)) + ".</p>"
    rows = [
        (1, "https://h.org/trademark", SITE.format("Trademark registration", "How to register", para("trademarks registering", 20), "")),
        (2, "https://h.org/faq/fees", SITE.format("Fees", "", "<p>1. Fees to pay now</p>" + para("filing costs", 20) + "<p>2. Steps to take now</p>" + para("process step", 20), FAQ_JSON)),
        (3, "https://h.org/empty", ""), (4, "https://h.org/null", None),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_page_chunks(spark, site):
    from siftline.plans import build

    got = {r["chunk_id"]: r for r in build.page_chunks(site).collect()}
    assert set(got) == {"1_title", "1_chunk_001", "2_title", "2_chunk_001", "2_chunk_002", "2_faq_001"}
    assert got["1_title"]["text"] == "Trademark registration. How to register" and got["2_title"]["text"] == "Fees."
    assert got["2_chunk_002"]["section"].lower().startswith("2 steps") and got["2_chunk_002"]["section_type"] == "process"
    assert got["2_faq_001"]["keywords"][:2] == ["what", "filing"] and got["2_faq_001"]["section_type"] == "faq" and got["1_title"]["page_title"] == "Trademark registration"
    assert set(build.CHUNK) == set(got["1_title"].asDict())


def test_retrieval_from_pages_with_stems(spark, site):
    from siftline.plans import build

    asked = spark.createDataFrame([("q1", "trademarked registration word3"), ("q2", "What are the filing fees?")], "query_id string, text string")
    queries = query.processed(query.valid(asked))
    plain, stems = (retrieve.retrieved(queries, build.page_indexes(site, stem=s)).collect() for s in (False, True))
    assert [r["chunk_id"] for r in stems if r["query_id"] == "q2" and r["rank"] == 1] == ["2_faq_001"]
    assert {r["chunk_id"] for r in stems if r["query_id"] == "q1"} >= {"1_title", "1_chunk_001"}
    score = lambda rows: max(r["score"] for r in rows if r["chunk_id"] == "1_chunk_001" and r["query_id"] == "q1")
    assert score(stems) >= score(plain)  # registering counts for registration


def test_sizes_and_noise_of_a_site(spark, site):
    from siftline.plans import build

    of = lambda **own: {r["chunk_id"]: r["text"] for r in build.page_chunks(site, **own).collect()}
    plain, large = of(), of(sizes=chunks.Sizes(least=150))  # two sections of 100 words in one chunk
    assert set(plain) - set(large) == {"2_chunk_002"} and large["2_chunk_001"] == plain["2_chunk_001"] + " " + plain["2_chunk_002"]
    page = spark.createDataFrame([(1, "Our own firm\nIntroduction\n" + "word " * 20 + "\nour OWN firm\nSummary\n" + "more " * 20, "t")], "page long, text string, title string")
    texts = lambda **own: " ".join(r["text"] for r in sections.visible_sections(page, "page", "text", "title", **own).collect()).lower()
    assert "own firm" in texts() and "own firm" not in texts(noise=["Our own firm "])


def test_boosts_and_threshold_are_options(spark):
    found = spark.createDataFrame([("q", "c", 1.0, 1)], "query_id string, chunk_id string, score double, tier long")
    asked = spark.createDataFrame([("q", ["a"])], "query_id string, keywords array<string>")
    kept = spark.createDataFrame([("c", "Title", "faq", ["b"], 0.5)], "chunk_id string, section string, section_type string, keywords array<string>, priority_score double")
    score = lambda *limits: retrieve.reranked(found, asked, kept, *limits).first()["final_score"]
    assert score() == 5.0 and score(retrieve.Limits(boost_faq=1.0, boost_title=3.0)) == 3.0


def test_answered_requests(spark, site):
    from dataclasses import replace

    from siftline.plans import build

    rows = [("q1", "What are the filing fees?", "s1", "now"), ("q2", "Hello!", None, "now"), ("q3", "zzz qqq", "s1", None), ("q4", "  ", "s2", "now"), ("q5", "x" * 2001, "s2", "now"), ("q6", None, "s2", "now")]
    asked = spark.createDataFrame(rows, "query_id string, text string, session_id string, at string").select("query_id", "text", "session_id", F.when(F.col("at") == "now", F.lit(F.current_timestamp())).alias("asked_at"))
    own = build.page_indexes(site)
    got = {r["query_id"]: r for r in answer.answered(asked, own).collect()}
    assert set(got) == {"q1", "q2", "q3"}
    assert got["q1"]["session_id"] == "s1" and not got["q1"]["fallback"] and "Two hundred." in got["q1"]["answer"] and got["q1"]["latency_ms"] > 0
    assert got["q2"]["answer"] == answer.GREETING and got["q2"]["session_id"] is None and got["q2"]["n_chunks"] == 0
    assert got["q3"]["fallback"] and got["q3"]["latency_ms"] is None
    own.limits = replace(own.limits, threshold=1.1)
    assert all(r["fallback"] for r in answer.answered(asked.where("query_id = 'q1'"), own).collect())
    assert answer.answered(asked.where("false"), own).count() == 0


def test_faq_prefixes_lose_no_match(spark):
    import random

    r = random.Random(7)
    words = [f"w{chr(97 + k // 6)}{chr(97 + k % 6)}" for k in range(30)]
    said = [" ".join(r.choices(words[: r.choice([5, 12, 30])], k=r.randint(1, 9))) for _ in range(60)]
    asked = spark.createDataFrame([(f"q{k}", x) for k, x in enumerate(said[:30])], "query_id string, text string")
    kept = spark.createDataFrame([(f"c{k:02d}", x) for k, x in enumerate(said[30:])], "chunk_id string, question string")
    best = {}
    for k, x in enumerate(said[:30]):
        for j, y in enumerate(said[30:]):
            a, b = set(x.split()), set(y.split())
            if (v := len(a & b) / len(a | b)) >= 0.4:
                best[f"q{k}"] = min(best.get(f"q{k}", (0, "")), (-round(v, 6), f"c{j:02d}"))
    got = {x["query_id"]: (-x["likeness"], x["chunk_id"]) for x in retrieve.faq_matches(asked, kept).collect()}
    assert got == best and len(best) > 5


def test_like_search_by_pages(spark):
    chunks_ = spark.createDataFrame([("c1", "p1", "The Taxonomy of it"), ("c2", "p2", "a tax"), ("c3", "p1", "no")], "chunk_id string, page_id string, text string")
    queries = spark.createDataFrame([("q", ["tax"]), ("r", ["no", "zz"]), ("s", [])], "query_id string, keywords array<string>")
    found = lambda pages=None: sorted((x["query_id"], x["chunk_id"]) for x in retrieve.like_search(queries, chunks_, pages=pages).collect())
    assert found() == [("q", "c1"), ("q", "c2"), ("r", "c1"), ("r", "c3")]
    assert found(spark.createDataFrame([("q", "p2")], "query_id string, page_id string")) == [("q", "c2"), ("r", "c1"), ("r", "c3")]


@pytest.mark.parametrize(
    "link, expected",
    [
        ("a.html#x", "https://h.org/d/a.html"), ("/b", "https://h.org/b"), ("//o.org/c", "https://o.org/c"), ("?p=1", "https://h.org/d/e?p=1"),
        ("http://x.org/#f", "http://x.org/"), ("#top", "https://h.org/d/e"),
    ],
)
def test_joined_url(spark, link, expected):
    assert column(spark, link, lambda x: T.joined_url(F.lit("https://h.org/d/e"), x)) == expected


def test_urls(spark):
    assert column(spark, "https://h.org/A b/C_d/?q", T.slug) == "a-b-c-d"
    assert column(spark, "https://h.org", T.slug) == "home"
    assert column(spark, "https://h.org/x?utm_a=1#f", T.canonical) == "https://h.org/x"
    assert column(spark, "https://h.org/x?a=1#f", T.canonical) == "https://h.org/x?a=1"
    assert column(spark, "https://h.org/doc.PDF?x", T.crawlable) is False


def test_query_analysis(spark):
    rows = [("1", "How do I REGISTER, register a company?"), ("2", "hi"), ("3", " "), ("4", "für taxes")]
    df = query.processed(query.valid(spark.createDataFrame(rows, "query_id string, text string")))
    got = {r["query_id"]: r for r in df.collect()}
    assert set(got) == {"1", "2", "4"}
    assert got["1"]["keywords"] == ["registration", "company"] and got["1"]["faq_like"] and "company_incorporation" in got["1"]["intents"]
    assert got["2"]["keywords"] == [] and got["2"]["intents"] == ["general"]
    assert got["4"]["keywords"] == ["tax"]


def test_greeting(spark):
    assert column(spark, "Hello, there!", query.is_greeting) is True
    assert column(spark, "hello world", query.is_greeting) is False


def corpus(spark):
    texts = {1: "alpha beta gamma", 2: "alpha beta", 3: "alpha delta", 4: "epsilon zeta"}
    rows = [(k, f"p{k}", f"https://h/p{k}", "S", "general", t, t.split(), 0.5) for k, t in texts.items()]
    c = spark.createDataFrame(rows, "chunk_id long, page_id string, url string, section string, section_type string, text string, keywords array<string>, priority_score double")
    empty = spark.createDataFrame([], "slug string, page_id string")
    return retrieve.Indexes(chunks=c, keyword=index.keyword_index(c), url=empty, intent=spark.createDataFrame([], "intent string, page_id string"), faq=index.faq_index(c), postings=index.postings(c, ["text"]))


def test_tiers_and_supplement(spark):
    own = corpus(spark)
    asked = query.processed(spark.createDataFrame([("q", "alpha beta")], "query_id string, text string"))
    found = {r["chunk_id"]: r["tier"] for r in retrieve.gathered(asked, own).collect()}
    # alpha and beta: 1 and 2 on routed pages; too few, so any term; nothing is left for the keywords
    assert found == {1: 1, 2: 1, 3: 3}
    top = retrieve.retrieved(asked, own)
    assert {r["chunk_id"] for r in top.where("rank <= 2").collect()} == {1, 2}
    low = retrieve.confidence(top, asked).first()
    assert low["n_chunks"] == 3 and 0 <= low["confidence"] <= 1
    nothing = query.processed(spark.createDataFrame([("q", "unheard")], "query_id string, text string"))
    assert answer.answers(nothing, retrieve.retrieved(nothing, own), retrieve.confidence(retrieve.retrieved(nothing, own), nothing)).first()["answer"] == answer.FALLBACK


def test_prefix_dedup_keeps_the_best(spark):
    rows = [("q", 1, "Same start " + "x" * 90 + "1", 2), ("q", 2, "same START " + "x" * 90 + "2", 1), ("q", 3, "other", 3)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id int, text string, place int")
    once = retrieve.deduplicated(df)
    assert sorted(r["chunk_id"] for r in once.collect()) == [2, 3] == sorted(r["chunk_id"] for r in retrieve.deduplicated(once).collect())


def test_faq_threshold(spark):
    faq = spark.createDataFrame([("f1", "alpha beta gamma delta epsilon"), ("f2", "zeta eta")], "chunk_id string, question string")
    asked = spark.createDataFrame([("at", "alpha beta"), ("below", "alpha"), ("none", "theta")], "query_id string, text string")
    assert values(retrieve.faq_matches(asked, faq), "query_id", "chunk_id", "likeness") == [("at", "f1", 0.4)]


def test_depths_with_cycle(spark):
    u = lambda k: f"https://h.org/{k}"
    edges = spark.createDataFrame([(u("a"), u("b")), (u("b"), u("a")), (u("b"), u("c")), (u("c"), u("d.pdf")), (u("c"), u("e"))], "src string, dst string")
    seeds = spark.createDataFrame([(u("a"), 0)], "url string, depth long")
    assert dict(values(crawl.depths(seeds, edges, most=2), "url", "depth")) == {u("a"): 0, u("b"): 1, u("c"): 2}


def test_robots_and_sitemaps(spark):
    urls = spark.createDataFrame([("https://h/a/1",), ("https://h/a/b/2",), ("https://o/a",)], "url string")
    rules = spark.createDataFrame([("h", "/a", False), ("h", "/a/b", True)], "host string, path string, allow boolean")
    assert sorted(values(crawl.allowed(urls, rules), "url")) == [("https://h/a/b/2",), ("https://o/a",)]
    maps = spark.createDataFrame([("https://h/sitemap.xml", "<sitemapindex><loc>https://h/x.xml</loc><loc>https://o/y.xml</loc></sitemapindex>")], "url string, xml string")
    assert values(crawl.sitemap_urls(maps), "kind", "loc") == [("map", "https://h/x.xml")]


@pytest.mark.parametrize(
    "agent, expected",
    [
        ("*", [("/private", False), ("/private/open", True)]), ("SiftBot/1.0", [("/", False), ("/sift", True)]), ("sift", [("/s", False)]), ("other", [("/private", False), ("/private/open", True)]),
        ("deep", [("/one", False), ("/two", False)]),
    ],
)
def test_robots_files(spark, agent, expected):
    txt = """# comment
User-agent: *
Disallow: /private # not this
Allow: /private/open
Crawl-delay: 3

User-agent: siftbot
User-Agent: SIFTBOT-NEWS
Disallow: /
allow:/sift
Disallow:
user-agent: sift
Disallow: /s\r\nnonsense
USER-AGENT: deep
Disallow: /one
User-agent: none
Disallow: /x
User-agent: deep
Disallow: /two
"""
    files = spark.createDataFrame([("h", txt), ("empty", ""), ("null", None)], "host string, txt string")
    assert sorted(values(crawl.robots_rules(files, agent), "host", "path", "allow")) == [("h", *x) for x in expected]


def test_packs_and_keys_in_linear_time(spark):
    """A page of 100,000 sections whose names clash, packed and keyed in seconds; the same as section by section."""
    import time

    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "a 2").otherwise("a").alias("name"), F.lit("w " * 12).alias("text"), F.lit(12).cast("long").alias("wc"))
    start = time.time()
    keyed = sections.unique_keys(rows, "page").withColumn("key", F.col("key"))
    packs = chunks.packed(keyed.select("page", "pos", "key", "text", "wc"), "page")
    assert packs.count() == n // 5 and keyed.select("key").distinct().count() == n
    assert time.time() - start < 90
    assert sections._free_keys(["a", "a", "a_2", "a", "b", "a_2"]) == ["a", "a_2", "a_2_2", "a_3", "b", "a_2_3"]


@pytest.mark.parametrize("word, expected", [x.split(":") for x in "caresses:caress ponies:poni agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall filing:file happy:happi relational:relat triplicate:triplic formalize:formal revival:reviv adoption:adopt rate:rate cease:ceas controll:control roll:roll".split()])
def test_stem(word, expected):
    assert stem(word) == expected


def test_stream_equals_batch(spark, tmp_path):
    """Newer, late, repeated, emptied, vanished and returned pages, over several runs: what is stored is the newest version's postings."""
    import json

    from siftline.streaming import refresh

    folder = tmp_path / "in"
    folder.mkdir()
    runs = [
        [("a", "one two", 1, None), ("b", "two", 1, None), ("c", "three", 5, None), ("d", "four four", 2, False)],
        [("a", "three", 2, None), ("c", "late", 4, None), ("d", "four four", 2, None), ("e", "first seen late", 1, None)],
        [("b", "", 3, None), ("d", None, 3, None), ("a", "three", 3, True), ("c", "three", 5, None), ("f", None, 1, None)],
        [("a", "older than gone", 2, None), ("e", "again", 7, None), ("e", "between", 6, None), ("d", "back", 4, None)],
    ]
    seen = []
    for k, pages in enumerate(runs):
        lines = [{"page_id": p, "text": text, "last_crawled": f"2025-01-0{day}T00:00:00Z"} | ({} if gone is None else {"gone": gone}) for p, text, day, gone in pages]
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, lines)))
        refresh.start(refresh.page_stream(spark, str(folder)), "stream_postings", str(tmp_path / "ck")).awaitTermination()
        seen += pages
        newest = {}
        for p, text, day, gone in seen:
            if p not in newest or day >= newest[p][0]:
                newest[p] = (day, "" if gone else text or "")
        batch = sorted((w, p, text.split().count(w)) for p, (_, text) in newest.items() for w in set(text.split()))
        spark.catalog.refreshTable("stream_postings")
        assert sorted(values(spark.table("stream_postings"), "term", "page_id", "tf")) == batch
    refresh.replace_postings(spark.createDataFrame([("e", None, "again", None, None)], refresh.SCHEMA).withColumn("last_crawled", F.to_timestamp(F.lit("2025-01-07"))), "stream_postings")
    assert sorted(values(spark.table("stream_postings"), "term", "page_id", "tf")) == batch
