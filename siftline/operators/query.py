"""What is made of a query's text, as columns of a DataFrame of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import cleaned, faq_like, synonyms, tokens, whole_word, without


def intents(text: Column, words: Column, topics: list[tuple[str, list[str]]]) -> Column:
    """Names of the topics with a term as whole words in the text, or equal to a word; general if there is none."""
    lower = F.lower(text)
    hits = []
    for name, ts in topics:
        test = F.lit(False)
        for t in ts:
            test = test | whole_word(lower, t) | F.array_contains(words, t)
        hits.append(F.when(test, F.lit(name)))
    matched = F.array_compact(F.array(*hits))
    return F.when(F.size(matched) > 0, matched).otherwise(F.array(F.lit("general")))


def routing(keywords: Column, matched: Column, topics: list[tuple[str, list[str]]]) -> Column:
    """Keywords, and the first two terms of each topic matched."""
    first = F.create_map(*[x for name, ts in topics for x in (F.lit(name), lexicon.words(ts[:2]))])
    return F.array_union(keywords, F.flatten(F.transform(matched, lambda m: F.coalesce(first[m], F.array().cast("array<string>")))))


def processed(queries: DataFrame, topics: list[tuple[str, list[str]]] = lexicon.INTENTS) -> DataFrame:
    """queries (query_id, text) with clean, tokens, keywords, intents, routing_keywords, faq_like, phrase and match_terms."""
    made = queries.withColumn("clean", cleaned(F.col("text"))).withColumn("original", tokens(F.col("clean")))
    made = made.withColumn("tokens", synonyms(without(F.col("original"), lexicon.STOP_WORDS))).withColumn("keywords", F.array_distinct("tokens"))
    made = made.withColumn("intents", intents(F.col("text"), F.col("tokens"), topics)).withColumn("routing_keywords", routing(F.col("keywords"), F.col("intents"), topics))
    long = lambda values, most: F.filter(F.slice(values, 1, most), lambda t: F.length(t) > 2)
    first = long(F.col("keywords"), 8)
    made = made.withColumn("match_terms", F.when(F.size(first) > 0, first).otherwise(long(F.col("original"), 5)))
    phrase = F.array_join(F.transform(F.slice("keywords", 1, 6), lambda k: F.concat(F.lit('"'), k, F.lit('"'))), " OR ")
    return made.withColumn("faq_like", faq_like(F.col("text"))).withColumn("phrase", F.when(F.size("keywords") > 0, phrase).otherwise(F.col("clean")))


def valid(queries: DataFrame) -> DataFrame:
    return queries.where((F.length("text") >= 1) & (F.length("text") <= 2000) & (F.trim("text") != ""))


def is_greeting(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")).isin(lexicon.GREETINGS)
