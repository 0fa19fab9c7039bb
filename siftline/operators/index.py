"""Lookup tables over chunks and pages. Each is a plain DataFrame; keep it as a table, sorted or bucketed by its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counts
from ..functions.stem import stem as stem_of
from ..functions.stem import stemmed
from ..functions.text import host, path, slug, tokens, whole_word, without
from ..functions.lexicon import STOP_WORDS


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by `order` (insert or replace: newest first; insert or ignore: oldest first)."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def keyword_index(chunks: DataFrame) -> DataFrame:
    """keyword, chunk_id, page_id, weight of chunks (chunk_id, page_id, keywords, priority_score)."""
    own = F.array_distinct(F.transform("keywords", F.lower))
    return chunks.select(F.explode(own).alias("keyword"), "chunk_id", "page_id", F.col("priority_score").alias("weight"))


def url_index_sql(pages: DataFrame) -> DataFrame:
    """slug, page_id: the parts of each URL but its host, and its slug."""
    parts = F.array_union(F.split(F.lower(F.regexp_replace("url", "^https?://", "")), "/"), F.array(slug(F.col("url"))))
    return pages.select("page_id", F.explode(parts).alias("slug"), F.lower(host(F.col("url"))).alias("_host")).where("slug <> '' and slug <> _host").select("slug", "page_id").distinct()


def url_index(pages: DataFrame) -> DataFrame:
    """slug, page_id: each URL's slug, the parts of the slug, and the segments of the path."""
    own = slug(F.col("url"))
    parts = F.concat(F.array(own), F.split(own, "[-/]"), F.split(F.lower(path(F.col("url"))), "/"))
    return pages.select("page_id", F.explode(parts).alias("slug")).withColumn("slug", F.trim("slug")).where("slug <> ''").distinct().select("slug", "page_id")


def faq_index(chunks: DataFrame) -> DataFrame:
    """question_hash, question, chunk_id, page_id of the chunks of type faq: the first line; of equal questions the least chunk_id."""
    question = F.trim(F.replace(F.split("text", "\n")[0], F.lit("Q:"), F.lit("")))
    asked = chunks.where("section_type = 'faq'").select(question.alias("question"), "chunk_id", "page_id").where("question <> ''")
    return latest(asked.withColumn("question_hash", F.md5(F.lower("question"))), ["question_hash"], [F.col("chunk_id")]).select("question_hash", "question", "chunk_id", "page_id")


def faq_router(chunks: DataFrame) -> DataFrame:
    """question (lower case), chunk_id of the chunks of type faq: of equal questions the last chunk_id."""
    question = F.lower(F.trim(F.replace(F.split("text", "\n")[0], F.lit("Q:"), F.lit(""))))
    return chunks.where("section_type = 'faq'").select(question.alias("question"), "chunk_id").where("question <> ''").groupBy("question").agg(F.max("chunk_id").alias("chunk_id"))


def heading_index(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.lower("section").alias("heading"), "chunk_id").where("heading <> ''").distinct()


def intent_index(pages: DataFrame, intents: list[tuple[str, list[str]]]) -> DataFrame:
    """intent, page_id of pages (page_id, slug, title, text): a term of the intent as whole words in slug, title or the first 500 characters.

    The topics are a short fixed list, so they are a column of each page and no join.
    """
    seen = F.lower(F.concat_ws(" ", "slug", "title", F.substring("text", 1, 500)))
    matched = F.array(*[F.when(_any(seen, ts), F.lit(name)) for name, ts in intents])
    return pages.select("page_id", F.explode(F.array_compact(matched)).alias("intent")).select("intent", "page_id").distinct()


def _any(text: Column, ts: list[str]) -> Column:
    out = F.lit(False)
    for t in ts:
        out = out | whole_word(text, t)
    return out


def lookup(index: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of an index for the keys of `wanted`; keys without a row stay, with nulls."""
    return wanted.join(index, key, "left")


def postings(chunks: DataFrame, columns: list[str], stem: bool = False) -> DataFrame:
    """term, chunk_id, tf over the text of the columns (arrays count as their items). Chunks have ids of their own. Stems are made for distinct terms only."""
    counted = counts.term_counts(chunks, "chunk_id", _said(chunks, columns))
    if not stem:
        return counted
    stems = counted.select("term").distinct().withColumn("stem", stemmed("term"))
    return counted.join(stems, "term").groupBy(F.col("stem").alias("term"), "chunk_id").agg(F.sum("tf").alias("tf"))


def _said(chunks: DataFrame, columns: list[str]) -> Column:
    kinds = dict(chunks.dtypes)
    return F.concat_ws(" ", *[F.array_join(c, " ") if kinds[c].startswith("array") else F.coalesce(c, F.lit("")) for c in columns])


def bags(chunks: DataFrame, columns: list[str], stem: bool = False) -> DataFrame:
    """chunk_id, page_id, terms, tfs: the postings of each chunk in one row."""
    return counts.bags(chunks, ["chunk_id", "page_id"], _said(chunks, columns), stem_of if stem else None)


def lengths(posting: DataFrame) -> DataFrame:
    return posting.groupBy("chunk_id").agg(F.sum("tf").alias("len"))


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("term").agg(F.count("*").alias("df"))


def corpus(length: DataFrame) -> DataFrame:
    """One row: n chunks and their average length."""
    return length.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def question_words(column: Column) -> Column:
    return F.array_distinct(without(tokens(column), STOP_WORDS))
