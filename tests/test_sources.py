"""Files in and out, snapshots of indexes, crawls over fetchers, progress of streams."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import answer, crawl, query, retrieve
from siftline.plans import build
from siftline.sources import tables
from siftline.streaming import refresh


def test_json_pages_and_chunks(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text(json.dumps({"page_id": "p1", "url": "https://h.org/a", "title": "A", "content": {"intro": "x"}}, indent=1))
    (tmp_path / "p/b.json").write_text(json.dumps({"page_id": "p2", "url": "https://h.org/b", "content_sections": {"s": "y"}, "more": 1}))
    got = {r["page_id"]: r for r in tables.read_pages(spark, str(tmp_path / "p")).collect()}
    assert got["p1"]["content_sections"] == {"intro": "x"} and got["p2"]["content_sections"] == {"s": "y"} and got["p2"]["title"] == ""
    tables.write_pages(spark.createDataFrame([("https://h.org/a",)], "url string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["file"].startswith("a_page_")
    (tmp_path / "c").mkdir()
    (tmp_path / "c/1.json").write_text(json.dumps({"chunk_id": "c1", "page_id": "p1", "text": "t", "keywords": ["k"]}, indent=1))
    r = tables.read_chunks(spark, str(tmp_path / "c")).first()
    assert r["keywords"] == ["k"] and r["important_entities"] == [] and r["priority_score"] == 0.5


@pytest.fixture(scope="module")
def pages(spark):
    page = lambda k, links: f"<title>Page {k} trademark</title><body><p>{' '.join(f'word{k} filing {j}.' for j in range(20))}</p>" + "".join(f'<a href="{x}">x</a>' for x in links) + "</body>"
    links = {0: ["/p1", "/p2#x", "https://o.org/z", "/f.pdf"], 1: ["/p3"], 2: ["/p0"], 3: ["/p4"], 4: []}
    return spark.createDataFrame([(k, f"https://h.org/p{k}", page(k, v)) for k, v in links.items()], "page_id long, url string, html string")


def test_snapshots_are_whole_and_swapped(spark, pages, tmp_path):
    folder = str(tmp_path / "indexes")
    assert tables.read_snapshot(spark, folder) is None
    built = []
    make = lambda: built.append(1) or build.page_indexes(pages)
    first = tables.snapshot_or_build(spark, folder, make)
    again = tables.snapshot_or_build(spark, folder, make)
    assert len(built) == 1 and first.postings.count() == again.postings.count() > 0
    asked = query.processed(query.valid(spark.createDataFrame([("q", "filing word3")], "query_id string, text string")))
    got, fresh = ([(r["rank"], r["chunk_id"], r["final_score"]) for r in retrieve.retrieved(asked, x).orderBy("rank").collect()] for x in (again, build.page_indexes(pages)))
    assert got == fresh and len(got) == 5
    assert tables.write_snapshot(spark, build.page_indexes(pages.where("page_id < 2"), stem=True), folder) == 2
    newest = tables.read_snapshot(spark, folder)
    assert newest.stemmed and {r["page_id"] for r in newest.chunks.collect()} == {0, 1}
    # a version without its number isn't seen
    newest.url.write.parquet(f"{folder}/3/url")
    assert tables.latest_version(spark, folder)["version"] == 2
    tables.compact(spark, f"{folder}/{tables.latest_version(spark, folder)['name']}/keyword", str(tmp_path / "small"), "keyword", 1)
    assert spark.read.parquet(str(tmp_path / "small")).count() == newest.keyword.count()


def test_crawl_follows_links_and_maps(spark, pages):
    seeds = spark.createDataFrame([("https://h.org/p0", 0), ("https://h.org/missing", 1)], "url string, depth long")
    got = {r["url"][-2:]: r["depth"] for r in crawl.crawled(seeds, crawl.TableFetcher(pages), 10).collect()}
    assert got == {"p0": 0, "p1": 1, "p2": 1, "p3": 2, "p4": 3}
    assert {r["url"][-2:] for r in crawl.crawled(seeds, crawl.TableFetcher(pages), 1).collect()} == {"p0", "p1", "p2"}
    maps = spark.createDataFrame(
        [("https://h.org/s.xml", "<sitemapindex><sitemap><loc>https://h.org/s1.xml</loc></sitemap><sitemap><loc>https://o.org/s2.xml</loc></sitemap></sitemapindex>"),
         ("https://h.org/s1.xml", "<urlset><url><loc> https://h.org/p1?a=1&amp;b </loc></url><url><loc>https://h.org/p2</loc></url></urlset>")], "url string, xml string")
    found = crawl.sitemap_pages(maps.where("url like '%s.xml'"), lambda urls: maps.join(urls, "url", "left_semi"))
    assert sorted(r["loc"] for r in found.collect()) == ["https://h.org/p1?a=1&b", "https://h.org/p2"]


class Failing:
    def generate(self, prompt, first_text):
        return F.when(prompt.contains("QUERY [Detected topic: general]:\nfiling word1"), None).otherwise(F.concat(F.lit("said: "), F.substring(first_text, 1, 5)))


def test_responses(spark, pages):
    asked = query.processed(query.valid(spark.createDataFrame([("q1", "filing word1"), ("q2", "filing word2"), ("q3", "Hello there!"), ("q4", "zzz qqq")], "query_id string, text string")))
    results = retrieve.retrieved(asked, build.page_indexes(pages))
    got = {r["query_id"]: r for r in answer.responses(asked, results, retrieve.confidence(results, asked), Failing()).collect()}
    assert (got["q1"]["answer"], got["q1"]["confidence"], got["q1"]["sources"], got["q1"]["fallback"]) == (answer.FALLBACK, 0.0, "", True)
    assert got["q2"]["answer"].startswith("said: ") and got["q2"]["confidence"] >= 0.25 and got["q2"]["sources"].startswith("https://h.org/p")
    assert (got["q3"]["answer"], got["q3"]["confidence"], got["q3"]["intents"]) == (answer.GREETING, 1.0, ["greeting"])
    assert got["q4"]["answer"] == answer.FALLBACK and got["q4"]["intents"] == ["general"]


def test_progress_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"page_id": f"p{k}", "url": "u", "text": "some text", "last_crawled": "2024-01-01T00:00:00Z"}) for k in range(7)))
    progress = refresh.Progress()
    spark.streams.addListener(progress)
    try:
        run = refresh.start(refresh.page_stream(spark, str(tmp_path / "in")), "postings_progress", str(tmp_path / "state"))
        key = str(run.id)
        run.awaitTermination(120)
        import time

        for _ in range(100):
            if key in progress.ended and progress.rows.get(key):
                break
            time.sleep(0.1)
        assert progress.rows[key] == 7 and progress.batches[key] >= 1 and progress.ended[key] is None
    finally:
        spark.streams.removeListener(progress)
        spark.sql("DROP TABLE IF EXISTS postings_progress")
