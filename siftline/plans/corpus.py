"""The text tables as the library's inputs: documents as chunks of the pages that their sources are, questions as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import priority, section_type, slug, word_count
from ..operators import chunks as packing
from ..operators import query
from ..operators.retrieve import Indexes
from .build import indexes
from .session import checkpointed, spread

SECTIONS = {"en": "Title / Overview", "fr": "Process steps", "de": "FAQ questions"}
OTHER_SECTION = "Contact"
#: What postings are made of.
INDEXED = ["section", "page_id", "text", "keywords"]
SLUGS = ["les", "der", "los", "thread", "notes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def section_of(lang: Column) -> Column:
    out = F.lit(OTHER_SECTION)
    for k, name in SECTIONS.items():
        out = F.when(lang == k, name).otherwise(out)
    return out


def page_url(source: Column) -> Column:
    return F.concat(F.lit("https://corpus.example/"), source, F.lit("-"), F.element_at(lexicon.words(SLUGS), F.pmod(F.coalesce(F.substring(source, 4, 9).try_cast("int"), F.lit(0)), F.lit(len(SLUGS))) + 1))


def document_chunks(documents: DataFrame) -> DataFrame:
    """Each document as a chunk of the page that its source is. Keywords and priority are worked out once and kept; texts come from the documents."""
    section = section_of(F.col("lang"))
    own = documents.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("page_id"), page_url(F.col("source")).alias("url"), section.alias("section"),
        section_type(section).alias("section_type"), "text",
    )
    own = own.withColumn("prefix", F.lower(F.substring("text", 1, 80)))
    weighed = own.withColumn("priority_score", priority(F.col("section_type"), word_count(F.col("text"))))
    # Joined by id, so what of the text retrieval looks at for all candidates is a column of its own.
    return own.join(checkpointed(packing.keywords(weighed, ["chunk_id", "priority_score"], F.col("text"))), "chunk_id")


def indexed_texts(documents: DataFrame) -> DataFrame:
    """chunk_id and INDEXED of each document, row by row: keywords are made where the text is, and no text is dealt out to join them."""
    own = documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("page_id"), section_of(F.col("lang")).alias("section"), "text")
    return packing.keywords(own, own.columns, F.col("text"))


def document_pages(documents: DataFrame) -> DataFrame:
    own = documents.groupBy("source").agg(F.min_by("text", "doc_id").alias("text"))
    made = own.select(F.col("source").alias("page_id"), page_url(F.col("source")).alias("url"), F.col("source").alias("title"), "text")
    return made.withColumn("slug", slug(F.col("url")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text: the benchmark's items and the users' turns."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), "text")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("query_id"), "text")
    return items.unionByName(turns)


def processed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.processed(query.valid(questions(spark, sf_dir)), lexicon.SAMPLE_INTENTS)


def asked_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """processed_questions, worked out once and by all cores: retrieval reads them many times."""
    return checkpointed(query.processed(spread(query.valid(questions(spark, sf_dir))), lexicon.SAMPLE_INTENTS))


def document_indexes(spark: SparkSession, sf_dir: str, stem: bool = False) -> Indexes:
    documents = table(spark, sf_dir, "documents")
    return indexes(document_chunks(documents), document_pages(documents), INDEXED, lexicon.SAMPLE_INTENTS, stem, texts=indexed_texts(documents))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, question, answer: a user's turn and the assistant's next one."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"])
