"""Answers from retrieved chunks. Writing the text is left to a Generator."""

from __future__ import annotations

import time
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import rounded
from ..plans.session import checkpointed
from .query import is_greeting, processed, valid
from .retrieve import Indexes, Limits, confidence, retrieved

FALLBACK = "No reliable information was found for this question. Please contact us directly."
GREETING = "Hello! How can I help you today?"


class Generator(Protocol):
    def generate(self, prompt: Column, first_text: Column) -> Column:
        """An answer column from the prompt and the best chunk's text."""


class Extractive:
    """Stands in for a language model: the best chunk's text."""

    def generate(self, prompt: Column, first_text: Column) -> Column:
        return first_text


def context(results: DataFrame) -> DataFrame:
    """query_id, context, urls of the results: numbered sources with page, section and text, in rank order."""
    said = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit("]"), F.when(F.col("url") != "", F.concat(F.lit(" | Page: "), "url")).otherwise(""),
        F.when(F.col("section") != "", F.concat(F.lit(" | Section: "), "section")).otherwise(""), F.lit("\n"), F.trim("text"), F.lit("\n"),
    )
    listed = F.array_sort(F.collect_list(F.struct("rank", said.alias("said"), "url", "text")))
    own = results.groupBy("query_id").agg(listed.alias("s"))
    return own.select("query_id", F.array_join(F.transform("s", lambda x: x["said"]), "\n---\n").alias("context"), F.array_distinct(F.filter(F.transform("s", lambda x: x["url"]), lambda u: u != "")).alias("urls"), F.col("s")[0]["text"].alias("first_text"))


def prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """query_id, prompt, sources: context, up to 5 source pages, topics and question."""
    own = queries.select("query_id", F.col("text").alias("question"), "intents").join(contexts, "query_id", "left")
    pages = F.slice("urls", 1, 5)
    block = F.when(F.size(pages) > 0, F.concat(F.lit("\nSOURCE PAGES:\n"), F.array_join(F.transform(pages, lambda u: F.concat(F.lit("  - "), u)), "\n"), F.lit("\n"))).otherwise("")
    prompt = F.concat(F.lit("RETRIEVED CONTEXT:\n"), F.coalesce("context", F.lit("No relevant content found.")), F.lit("\n"), block, F.lit("\nUSER QUERY [Detected topic: "), F.array_join("intents", ", "), F.lit("]:\n"), F.col("question"), F.lit("\n\nANSWER (only from context above):"))
    return own.select("query_id", prompt.alias("prompt"), F.coalesce(F.array_join(pages, "|"), F.lit("")).alias("sources"), "urls", "first_text")


def answers(queries: DataFrame, results: DataFrame, confidences: DataFrame, generator: Generator | None = None, threshold: float = Limits.threshold) -> DataFrame:
    """query_id, answer, confidence, sources (up to 3), n_chunks, fallback, intents.

    Below the threshold, or without chunks, the fallback text. Where the generator fails (null), the fallback text with confidence 0.
    """
    made = prompts(queries, context(results)).join(confidences, "query_id").join(queries.select("query_id", "intents"), "query_id")
    low = (F.col("confidence") < threshold) | (F.col("n_chunks") == 0)
    text = (generator or Extractive()).generate(F.col("prompt"), F.col("first_text"))
    told = made.withColumn("text", F.when(~low, text)).withColumn("low", low).withColumn("failed", ~F.col("low") & F.col("text").isNull())
    none = F.col("low") | F.col("failed")
    return told.select(
        "query_id", F.when(none, F.lit(FALLBACK)).otherwise(F.col("text")).alias("answer"), F.when(F.col("failed"), 0.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(none, F.lit("")).otherwise(F.array_join(F.slice("urls", 1, 3), "|")).alias("sources"), "n_chunks", none.alias("fallback"), "intents",
    )


def responses(queries: DataFrame, results: DataFrame, confidences: DataFrame, generator: Generator | None = None, threshold: float = Limits.threshold) -> DataFrame:
    """Rows of answers() for all queries (query_id, text and what is made of them); greetings get their fixed answer with confidence 1."""
    greeted = queries.where(is_greeting(F.col("text"))).select(
        "query_id", F.lit(GREETING).alias("answer"), F.lit(1.0).alias("confidence"), F.lit("").alias("sources"), F.lit(0).cast("long").alias("n_chunks"), F.lit(False).alias("fallback"), F.array(F.lit("greeting")).alias("intents")
    )
    asked = queries.where(~is_greeting(F.col("text")))
    return greeted.unionByName(answers(asked, results.join(asked.select("query_id"), "query_id", "left_semi"), confidences, generator, threshold))


def answered(requests: DataFrame, own: Indexes, topics: list[tuple[str, list[str]]] = lexicon.INTENTS, generator: Generator | None = None) -> DataFrame:
    """The response to every valid request (query_id, text, asked_at, session_id): what responses() gives, session_id and latency_ms.

    asked_at is a timestamp; the latency goes from there to when the batch's answers are written, to a tenth of a millisecond. Null where
    asked_at is null. Requests without text, or of over 2000 characters, get no response, requests of no words the fallback. query_id is unique.
    """
    told = checkpointed(requests.select("query_id", "session_id", "asked_at"))  # before all else, as asked_at may be worked out when it is read
    asked = checkpointed(processed(valid(requests.select("query_id", "text")), topics))
    results = retrieved(asked, own)
    made = checkpointed(responses(asked, results, confidence(results, asked, own.limits.top_k), generator, own.limits.threshold))
    written = F.lit(int(time.time() * 1_000_000))
    return made.join(told.select("query_id", "session_id", rounded((written - F.unix_micros("asked_at")) / 1000, 1).alias("latency_ms")), "query_id")


def preview(results: DataFrame, most: int = 5) -> DataFrame:
    """query_id, rank, chunk_id, section, score (4 decimals), preview (200 characters) of the first results."""
    return results.where(F.col("rank") <= most).select("query_id", "rank", "chunk_id", "section", rounded(F.col("final_score"), 4).alias("score"), F.concat(F.substring("text", 1, 200), F.lit("...")).alias("preview"))
