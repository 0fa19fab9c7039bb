"""From raw pages to chunks and the indexes over them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import lexicon
from ..functions.text import slug, word_count
from ..operators import chunks as packing
from ..operators import index, sections
from ..operators.retrieve import Indexes, Limits
from ..operators.search import bags_index
from .session import checkpointed

CHUNK = ["chunk_id", "page_id", "page_title", "url", "section", "section_type", "text", "word_count", "keywords", "entities", "priority_score", "content_hash"]


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, slug, title, h1, description and text (in lines) of raw pages (page_id, url, html). Null html is empty."""
    html: Column = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", slug(F.col("url")).alias("slug"), H.title(html).alias("title"), H.h1(html).alias("h1"), H.description(html).alias("description"), H.visible_lines(html).alias("text"), H.faq_jsonld(html).alias("faq"))


def page_chunks(pages: DataFrame, sizes: packing.Sizes = packing.Sizes(), noise: Iterable[str] = ()) -> DataFrame:
    """The chunks (CHUNK) of raw pages: title, packed sections and FAQ pairs of each, all with keywords; a title's also from the page's keywords.

    noise: lines that are no content on these pages, beside the known ones.
    """
    own = checkpointed(page_texts(pages))  # read many times below
    cut = sections.visible_sections(own, "page_id", "text", "title", noise).withColumn("wc", word_count(F.col("text")))
    packed = packing.described(packing.packed(cut, "page_id", sizes), "page_id")
    of_page = packing.keywords(own.select("page_id", F.concat_ws(" ", "title", "text").alias("t")), ["page_id"], F.col("t"), lexicon.PAGE_STOP_WORDS, 40).withColumnRenamed("keywords", "page_keywords")
    titles = packing.with_keywords(packing.title_chunks(own, "page_id").join(of_page, "page_id"), "page_keywords")
    rest = packing.with_keywords(packed.unionByName(packing.faq_chunks(own, "page_id")))
    every = titles.unionByName(rest).join(own.select("page_id", F.col("title").alias("page_title"), "url"), "page_id")
    return every.select(*CHUNK)


def page_indexes(pages: DataFrame, intents: list = lexicon.INTENTS, stem: bool = False, limits: Limits = Limits(), sizes: packing.Sizes = packing.Sizes(), noise: Iterable[str] = ()) -> Indexes:
    """All indexes over the chunks of raw pages. Chunks are cut once and kept, as all other indexes are made of them."""
    return indexes(checkpointed(page_chunks(pages, sizes, noise)), page_texts(pages).select("page_id", "url", "slug", "title", "text"), ["section", "page_title", "text", "keywords"], intents, stem, limits)


def indexes(chunks: DataFrame, pages: DataFrame, columns: list[str], intents: list, stem: bool = False, limits: Limits = Limits(), texts: DataFrame | None = None) -> Indexes:
    """The indexes over chunks (chunk_id, page_id, url, section, section_type, text, keywords, priority_score) and pages (page_id, url, slug, title, text).

    Each is made when it is first asked for. The search's postings come from the texts, a row a chunk; those by term are a table of their own, for who asks for it.
    texts: chunk_id, page_id and the columns of the chunks, if there is a cheaper way to them.
    """
    return Indexes(
        chunks=chunks, keyword=lambda: index.keyword_index(chunks), url=lambda: index.url_index(pages), intent=lambda: index.intent_index(pages, intents),
        faq=lambda: index.faq_index(chunks), postings=lambda: checkpointed(index.postings(chunks, columns, stem)), stemmed=stem, limits=limits,
        search=lambda: bags_index(index.bags(chunks if texts is None else texts, columns, stem), chunks.count(), limits.k1, limits.b),
    )
