"""Raw pages to page records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import lexicon
from ..functions.text import joined_url, host, page_key, page_type, slug, word_count
from ..operators import markup
from ..operators.chunks import keywords


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url and what columns tell of each page (page_id, url, html), with no Python."""
    html, url = F.col("html"), F.col("url")
    own = pages.select("page_id", "url", "html", page_key(url).alias("page_key"), slug(url).alias("slug"), H.title(html).alias("title"), H.h1(html).alias("h1"), page_type(url).alias("page_type"), H.visible(html).alias("text"))
    return own.withColumn("n_words", word_count(F.col("text"))).withColumn("content_hash", F.sha2("text", 256))


def records(pages: DataFrame) -> DataFrame:
    """Whole page records: parsed() with headings, links, contacts, keywords, meta, FAQ, tables, breadcrumbs and sections. Links are capped at 60."""
    own = parsed(pages).withColumn("headings", H.headings(F.col("html"))).withColumn("contact_info", H.contacts(F.col("text")))
    links = F.array_distinct(F.filter(F.transform(H.links(F.col("html")), lambda h: joined_url(F.col("url"), h)), lambda u: (host(u) == host(F.col("url"))) & (u != F.col("url"))))
    own = own.withColumn("internal_links", F.slice(links, 1, 60)).withColumn("faq_jsonld", H.faq_jsonld(F.col("html")))
    word = keywords(own.select("page_id", F.concat_ws(" ", "title", "text").alias("t")), ["page_id"], F.col("t"), lexicon.PAGE_STOP_WORDS, 40)
    made = own.join(markup.parts(pages), "page_id").withColumn("contact_links", H.contact_links(F.col("html"), F.col("url"))).withColumn("last_crawled", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")).drop("html")
    return made.withColumn("section_count", F.size("sections")).join(word, "page_id")


def headed_sections(lines: DataFrame, page: str, heading: Column) -> DataFrame:
    """page, key, sid, text of lines (page, pos, line) under the heading before them. A repeated key keeps its first place and takes the last text."""
    ahead = Window.partitionBy(page).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("heading", heading).withColumn("sid", F.sum(F.col("heading").cast("long")).over(ahead))
    name = F.substring(F.regexp_replace(F.lower("line"), r"\s+", "_"), 1, 40)
    listed = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("pos", "line"))))
    own = marked.groupBy(page, "sid").agg(F.max(F.when(F.col("heading"), name)).alias("name"), F.array_join(F.transform(listed, lambda x: x["line"]), " ").alias("text")).where("text <> ''")
    return own.groupBy(page, F.coalesce("name", F.lit("introduction")).alias("key")).agg(F.min("sid").alias("sid"), F.max_by("text", "sid").alias("text"))
