"""Batches of queries answered from the indexes: routing, tiers of BM25 matches, supplements, ranking, confidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.counts import holding
from ..functions.text import jaccard, rounded, rounded_exactly
from ..functions.stem import stemmed
from ..plans.session import checkpointed
from . import index
from .search import SearchIndex, found, search_index

KEYWORD_SCORE, FAQ_SCORE, LIKE_SCORE = 0.2, 1.0, 0.3


@dataclass(frozen=True)
class Limits:
    """How much is looked at: few (fewer results widen the search), first and broad (results of a search), supplement (chunks by keyword), pages, FAQ likeness, top k.

    k1 and b are BM25's, for an index that is yet to be built. boost_faq, boost_title and boost_heading raise a chunk's score by its kind; below
    `threshold` of confidence no answer is given.
    """

    few: int = 3
    first: int = 25
    broad: int = 20
    supplement: int = 50
    pages: int = 800
    faq_likeness: float = 0.4
    top_k: int = 5
    k1: float = 1.2
    b: float = 0.75
    boost_faq: float = 2.0
    boost_title: float = 2.5
    boost_heading: float = 1.5
    threshold: float = 0.25


class Indexes:
    """What retrieval reads. chunks: chunk_id, page_id, url, section, section_type, text, keywords, priority_score.

    Each is a DataFrame or a function that makes it when it is first asked for. stemmed: the postings' terms are stems, and so are queries' terms to be.
    search: the block-max postings, or a function that makes them; made of postings and chunks if it isn't given.
    """

    #: The key that each is sorted by as a table.
    KEYS = {"chunks": "chunk_id", "keyword": "keyword", "url": "slug", "intent": "intent", "faq": "question_hash", "postings": "term"}

    def __init__(self, stemmed: bool = False, limits: Limits = Limits(), search: SearchIndex | Callable[[], SearchIndex] | None = None, **own: DataFrame | Callable[[], DataFrame]) -> None:
        if set(own) != set(self.KEYS):
            raise ValueError(f"indexes are {', '.join(self.KEYS)}")
        made = search or (lambda: search_index(self.postings, self.chunks, limits.k1, limits.b))
        self.stemmed, self.limits, self._own = stemmed, limits, own | {"search": made}

    def __getattr__(self, name: str) -> DataFrame | SearchIndex:
        if name.startswith("_") or name not in self._own:
            raise AttributeError(name)
        if callable(value := self._own[name]) and not isinstance(value, (DataFrame, SearchIndex)):
            self._own[name] = value = value()
        return value


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_items(queries: DataFrame, column: str, most: int, name: str) -> DataFrame:
    return queries.select("query_id", F.posexplode(F.slice(column, 1, most)).alias("at", name))


def first_chunks(own: Indexes) -> DataFrame:
    """The first chunks of each keyword, by chunk_id. No query looks at more of one keyword, so this is cut before queries are joined."""
    return ranked(own.keyword, ["keyword"], [F.col("chunk_id")]).where(F.col("rank") <= own.limits.supplement).drop("rank")


def routed(queries: DataFrame, own: Indexes) -> DataFrame:
    """query_id, page_id: pages of the query's intents, of its first 5 routing keywords' slugs, and of its first 8 keywords' chunks."""
    by_intent = queries.select("query_id", F.explode("intents").alias("intent")).where("intent <> 'general'").join(own.intent, "intent").select("query_id", "page_id")
    by_slug = first_items(queries, "routing_keywords", 5, "slug").join(own.url, "slug").select("query_id", "page_id")
    by_keyword = first_items(queries, "keywords", 8, "keyword").join(first_chunks(own), "keyword").select("query_id", "page_id")
    every = by_intent.unionByName(by_slug).unionByName(by_keyword).distinct()
    return ranked(every, ["query_id"], [F.col("page_id")]).where(F.col("rank") <= own.limits.pages).select("query_id", "page_id")


def wanted_terms(queries: DataFrame, stem: bool = False) -> DataFrame:
    """query_id, term, n_terms: a query's terms. Two terms with one stem count twice."""
    own = queries.select("query_id", F.explode("match_terms").alias("term"), F.size("match_terms").alias("n_terms"))
    if not stem:
        return own
    stems = own.select("term").distinct().withColumn("stem", stemmed("term"))
    return own.join(stems, "term").select("query_id", F.col("stem").alias("term"), "n_terms")


def searched(queries: DataFrame, own: Indexes, kind: str, most: int, routes: DataFrame | None = None, few: int | None = None) -> DataFrame:
    """The best chunks of each shard for the queries' terms; kind, few and columns as in search.found."""
    return found(wanted_terms(queries, own.stemmed), own.search, kind, most, routes, few=few)


def matched(queries: DataFrame, own: Indexes, every: bool, most: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, n_match, rank: the best `most` chunks with every or any term of the query."""
    most = most or own.limits.first
    best = ranked(searched(queries, own, "all" if every else "any", most), ["query_id"], best_first())
    return checkpointed(best.where(F.col("rank") <= most).select("query_id", "chunk_id", "score", "n_match", "rank"))


def routed_matches(queries: DataFrame, own: Indexes, most: int | None = None) -> DataFrame:
    """query_id, chunk_id, score: the best `most` chunks with any term of the query on the pages that it is routed to."""
    most = most or own.limits.first
    best = ranked(searched(queries, own, "routed", most, routed(queries, own)), ["query_id"], best_first())
    return checkpointed(best.where(F.col("rank") <= most).select("query_id", "chunk_id", "score"))


def candidates(queries: DataFrame, own: Indexes) -> DataFrame:
    """For tiered(): no tier takes more than `most` chunks of one kind, and counts only matter up to `few`, so the best `most` of each kind that is asked for are enough."""
    most = max(own.limits.few, own.limits.first, own.limits.broad)
    best = ranked(searched(queries, own, "tiers", most, routed(queries, own), own.limits.few), ["query_id", "whole", "inside"], best_first(), "kind_rank")
    return checkpointed(best.where(F.col("kind_rank") <= most).drop("kind_rank", "read"))


def best_first() -> list[Column]:
    return [F.desc("score"), F.col("chunk_id")]


def tiered(kinds: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """query_id, chunk_id, score, tier of candidates (query_id, chunk_id, score, n_terms, whole, inside, has_route). Tiers give way to the next while a query has fewer than 3 chunks.

    1: all terms, on routed pages (anywhere, if the query has none); 2: all terms anywhere; 3: any term, where tier 1 looked;
    the three together end at 25. 4: if there still are fewer than 3, all terms and then any anywhere, up to 20.
    """
    count = lambda test: F.sum(test.cast("int")).over(Window.partitionBy("query_id"))
    counted = kinds.withColumn("n1", count(F.col("whole") & F.col("inside"))).withColumn("n_whole", count(F.col("whole"))).withColumn("n_inside", count(F.col("inside")))
    second = F.col("has_route") & (F.col("n1") < limits.few)
    after = F.when(second, F.col("n_whole")).otherwise(F.col("n1"))
    third = (after < limits.few) & (F.col("n_terms") > 1)
    # in tier 3: what is inside and in no tier before
    total = F.when(third, after + F.col("n_inside") - F.col("n1")).otherwise(after)
    tier = (
        F.when(F.col("whole") & F.col("inside"), 1).when(F.col("whole") & second, 2).when(F.col("inside") & third, 3)
        .when(F.col("has_route") & (total < limits.few) & (F.col("whole") | (F.col("n_whole") < limits.few) & (F.col("n_terms") > 1)), 4)
    )
    given = counted.withColumn("tier", tier).where("tier is not null").withColumn("late", F.col("tier") == 4)
    # the broad search ranks what has all terms, then all others, wherever they were found before
    places = ranked(ranked(given, ["query_id", "late"], [F.col("tier"), *best_first()], "narrow"), ["query_id"], [F.desc("whole"), *best_first()], "broad")
    kept = places.where(F.when(F.col("late"), F.col("broad") <= limits.broad).otherwise(F.col("narrow") <= limits.first))
    return kept.select("query_id", "chunk_id", "score", F.col("tier").cast("long").alias("tier"))


def keyword_chunks(queries: DataFrame, own: Indexes) -> DataFrame:
    """query_id, chunk_id: the first 50 chunks of a query's first 10 keywords, by keyword and chunk_id."""
    # What an earlier keyword has given leaves enough of a later one's first chunks to fill the list.
    hits = first_items(queries, "keywords", 10, "keyword").join(first_chunks(own), "keyword").groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
    return ranked(hits, ["query_id"], [F.col("at"), F.col("chunk_id")]).where(F.col("rank") <= own.limits.supplement).select("query_id", "chunk_id")


def faq_matches(queries: DataFrame, faq: DataFrame, least: float = Limits.faq_likeness) -> DataFrame:
    """query_id, chunk_id, likeness: the FAQ whose question's words are most like those of a query (query_id, text), from `least` on.

    Two sets of n and m words that are alike to that degree share one of the rarest n - ceil(least * n) + 1 of the one and of the rarest
    m - ceil(least * m) + 1 of the other, in one order of all words. They share least / (1 + least) * (n + m) words, all from the first one on, so a shared word
    with fewer words after it in either set isn't that one. Only pairs that share a word that passes both tests are compared, where they meet: what is dealt out
    are the sets with their rarest words, never pairs that aren't alike.
    """
    asked = checkpointed(queries.select("query_id", index.question_words(F.col("text")).alias("q")))
    kept = checkpointed(faq.select("chunk_id", index.question_words(F.col("question")).alias("f")))
    common = kept.select(F.explode("f").alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, key: str, words: str) -> DataFrame:
        each = rows.select(key, F.size(words).alias("size"), F.explode(words).alias("w")).join(common, "w", "left")
        place = ranked(each, [key], [F.coalesce("n", F.lit(0)), F.col("w")])
        first = place.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
        return first.join(rows, key).select(key, "w", words, F.col("size").alias(f"{words}_size"), (F.col("size") - F.col("rank") + 1).alias(f"{words}_left"))

    both = rarest(asked, "query_id", "q").join(rarest(kept, "chunk_id", "f"), "w")
    enough = F.least("q_left", "f_left") * (1 + least) >= least * (F.col("q_size") + F.col("f_size")) - 1e-5
    likeness = F.round(jaccard(F.col("q"), F.col("f")), 6)
    pairs = both.where(enough).select("query_id", "chunk_id", likeness.alias("likeness")).where(F.col("likeness") >= least)
    return ranked(pairs, ["query_id"], [F.desc("likeness"), F.col("chunk_id")]).where("rank = 1").drop("rank")


def like_search(queries: DataFrame, chunks: DataFrame, most: int = Limits.first, pages: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score of the chunks that hold one of a query's first 3 keywords anywhere, by chunk_id; for engines without an index.

    The batch's different keywords are looked for, not each query's, all in one pass over the texts. pages (query_id, page_id) restricts queries that have any there.
    """
    first = checkpointed(queries.select("query_id", F.explode(F.slice("keywords", 1, 3)).alias("k")))
    words = [r["k"] for r in first.select("k").distinct().collect()]  # a few of each query
    # A keyword's first chunks are enough for every query that has it, unless pages choose among them.
    held = holding(chunks.select("chunk_id", F.lower("text").alias("t")), words, most if pages is None else None)
    if pages is None:
        held = held.groupBy("k").agg(F.slice(F.array_sort(F.flatten(F.collect_list("chunk_ids"))), 1, most).alias("chunk_ids"))
    each = first.join(held, "k").select("query_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    if pages is not None:
        placed = each.join(chunks.select("chunk_id", "page_id"), "chunk_id")
        some = pages.select("query_id").distinct()
        each = placed.join(pages, ["query_id", "page_id"], "left_semi").unionByName(placed.join(some, "query_id", "left_anti")).select("query_id", "chunk_id")
    return ranked(each, ["query_id"], [F.col("chunk_id")]).where(F.col("rank") <= most).select("query_id", "chunk_id", F.lit(LIKE_SCORE).alias("score"))


def gathered(queries: DataFrame, own: Indexes) -> DataFrame:
    """query_id, chunk_id, score, tier (5: keyword, 6: FAQ) of all candidates of valid queries, some dozens a query; a chunk counts in its first tier."""
    given = lambda rows, score, tier: rows.select("query_id", "chunk_id", F.lit(score).alias("score"), F.lit(tier).cast("long").alias("tier"))
    faq = given(faq_matches(queries.where("faq_like"), own.faq, own.limits.faq_likeness), FAQ_SCORE, 6)
    every = tiered(candidates(queries, own), own.limits).unionByName(given(keyword_chunks(queries, own), KEYWORD_SCORE, 5)).unionByName(faq)
    return ranked(every, ["query_id", "chunk_id"], [F.col("tier")]).where("rank = 1").drop("rank")


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.lit(1))


def reranked(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """candidates with chunk columns, final_score, overlap and place (from 1): section boosts, keyword overlap and priority on the base score."""
    own = candidates.join(chunks, "chunk_id").join(queries.select("query_id", F.col("keywords").alias("query_keywords")), "query_id")
    name = F.lower("section")
    boost = F.when(F.col("section_type") == "faq", limits.boost_faq).otherwise(1.0) * F.when(name.contains("title") | name.contains("overview"), limits.boost_title).otherwise(1.0)
    boost = boost * F.when(F.col("section_type").isin("requirements", "process", "pricing"), limits.boost_heading).otherwise(1.0)
    weight = F.when(F.coalesce("priority_score", F.lit(0.0)) == 0, 0.5).otherwise(F.col("priority_score"))
    share = overlap(F.col("query_keywords"), F.col("keywords"))
    made = own.withColumn("overlap", share).withColumn("final_score", rounded(F.col("score") * (boost + share * 0.5) * (0.5 + weight), 6))
    return ranked(made, ["query_id"], [F.desc("final_score"), F.col("tier"), F.col("chunk_id")], "place")


def deduplicated(rows: DataFrame) -> DataFrame:
    """The first of a query's chunks with equal first 80 characters."""
    prefix = F.lower(F.substring("text", 1, 80))
    return rows.withColumn("_p", prefix if "text" in rows.columns else F.col("prefix")).withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_p").orderBy("place"))).where("_r = 1").drop("_p", "_r")


def top(rows: DataFrame, most: int = Limits.top_k) -> DataFrame:
    return ranked(rows, ["query_id"], [F.col("place")]).where(F.col("rank") <= most)


def confidence(results: DataFrame, queries: DataFrame, top_k: int = Limits.top_k) -> DataFrame:
    """query_id, n_chunks, confidence of all queries: how many chunks, and overlap and priority of the best."""
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    found = results.groupBy("query_id").agg(F.count("*").alias("n_chunks"), first("overlap").alias("o"), first("priority_score").alias("p"))
    value = rounded_exactly(F.least(F.col("n_chunks") / top_k, F.lit(1.0)) * 0.3 + F.least("o", F.lit(1.0)) * 0.4 + F.col("p") * 0.3, 2)
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce(value, F.lit(0.0)).alias("confidence"))


def retrieved(queries: DataFrame, own: Indexes) -> DataFrame:
    """The best chunks of every query, with rank, final_score, tier and all chunk columns. Written once, as answers use it several times.

    Candidates are ranked without their texts; only the best ones fetch them.
    """
    light = own.chunks.select("chunk_id", "section", "section_type", "keywords", "priority_score", F.col("prefix") if "prefix" in own.chunks.columns else F.lower(F.substring("text", 1, 80)).alias("prefix"))
    best = top(deduplicated(reranked(gathered(queries, own), queries, light, own.limits)), own.limits.top_k).select("query_id", "chunk_id", "score", "tier", "overlap", "final_score", "place", "rank")
    return checkpointed(checkpointed(best).join(own.chunks.drop("prefix"), "chunk_id"))
