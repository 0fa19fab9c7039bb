"""Sections packed into chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.counts import frequent_words, numbered_by
from ..functions.text import display_name, entities, priority, section_type, word_count


@dataclass(frozen=True)
class Sizes:
    """Words: a section that counts, a chunk that takes no more sections, a chunk at the most, and the rest of a page that stays."""

    section: int = 10
    least: int = 50
    most: int = 700
    last: int = 15


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def _groups(counts: Column, most: int) -> Column:
    """For word counts of pieces in order, the group of each: a piece that would take a group beyond `most` begins the next."""

    def groups(counts: Iterable[int]) -> list[int]:
        held, group, out = 0, 0, []
        for n in counts:
            if held > 0 and held + n > most:
                held, group = 0, group + 1
            held += n
            out.append(group)
        return out

    return numbered_by(groups)(counts)


def _packs(sizes: Column, least: int) -> Column:
    """The pack of each section, for (wc) in order: small sections join until they have `least` words; all others stand alone."""

    def packs(sizes: Iterable[int]) -> list[int]:
        held, pack, out = 0, 0, []
        for n in sizes:
            if n >= least:
                held, pack = 0, pack + 1
            else:
                pack += held <= 0
                held += n
                held = 0 if held >= least else held  # a full pack takes no more
            out.append(pack)
        return out

    return numbered_by(packs)(sizes)


def packed(sections: DataFrame, page: str, limits: Sizes = Sizes()) -> DataFrame:
    """page, n (from 1), key, text, wc: chunks of sections (page, pos, key, text, wc), in order.

    Sections under ten words don't count. Smaller ones join the next until there are 50 words; a larger one ends what is held, of whatever
    size; one of over 700 words is cut at sentences. What is held at the end stays if it has 15 words. `limits` sets these numbers.
    """
    own = sections.where(F.col("wc") >= limits.section).groupBy(page).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "text", "wc"))).alias("s"))
    numbered = own.select(page, "s", _packs(F.transform("s", lambda x: x["wc"]), limits.least).alias("packs"))
    each = numbered.select(page, F.element_at("packs", -1).alias("last"), F.explode(F.arrays_zip("s", "packs")).alias("x")).select(page, "last", F.col("x.packs").alias("pack"), "x.s.pos", "x.s.key", "x.s.text", "x.s.wc")
    large = each.where(F.col("wc") > limits.most)
    listed = F.array_sort(F.collect_list(F.struct("pos", "key", "text")))
    packs = each.where(F.col("wc") <= limits.most).groupBy(page, "pack", "last").agg(listed.alias("s"), F.sum("wc").alias("wc")).where((F.col("pack") < F.col("last")) | (F.col("wc") >= limits.last))
    whole = packs.select(page, F.col("s")[0]["pos"].alias("pos"), F.lit(0).alias("part"), F.element_at("s", -1)["key"].alias("key"), F.trim(F.array_join(F.transform("s", lambda x: x["text"]), " ")).alias("text"), "wc")
    cut = large.withColumn("ss", sentences(F.col("text"))).withColumn("g", _groups(F.transform("ss", word_count), limits.most))
    pieces = cut.select(page, "pos", "key", F.posexplode(F.arrays_zip("ss", "g")).alias("i", "x")).groupBy(page, "pos", "key", F.col("x.g").alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", F.col("x.ss").alias("line")))).alias("s"))
    parts = pieces.withColumn("text", F.trim(F.array_join(F.transform("s", lambda x: x["line"]), " "))).select(page, "pos", "part", "key", "text", word_count(F.col("text")).alias("wc")).where("text <> ''")
    order = F.row_number().over(Window.partitionBy(page).orderBy("pos", "part"))
    return whole.unionByName(parts).withColumn("n", order).select(page, "n", "key", "text", "wc")


def keywords(rows: DataFrame, keys: list[str], text: Column, stop: list[str] = lexicon.CHUNK_STOP_WORDS, most: int = 15) -> DataFrame:
    """keys and keywords: words of three letters or more, by count and then first place. keys tell rows apart."""
    return frequent_words(rows, keys, F.lower(text), stop, most)


def described(chunks: DataFrame, page: str) -> DataFrame:
    """Chunks of packed() with id, display name, type, priority, entities and hash."""
    kind = section_type(F.col("key"))
    return chunks.select(
        F.concat(F.col(page).cast("string"), F.lit("_chunk_"), F.format_string("%03d", "n")).alias("chunk_id"), page,
        display_name(F.col("key")).alias("section"), kind.alias("section_type"), "text", F.col("wc").cast("long").alias("word_count"),
        entities(F.col("text")).alias("entities"), priority(kind, F.col("wc")).alias("priority_score"), F.sha2("text", 256).alias("content_hash"),
    )


def with_keywords(chunks: DataFrame, extra: str | None = None) -> DataFrame:
    """chunks (chunk_id, text) with keywords of the text, and of the array column `extra`, which goes."""
    said = F.concat_ws(" ", "text", F.array_join(extra, " ")) if extra else F.col("text")
    own = keywords(chunks.select("chunk_id", said.alias("_said")), ["chunk_id"], F.col("_said"))
    return (chunks.drop(extra) if extra else chunks).join(own, "chunk_id")


def title_chunks(pages: DataFrame, page: str) -> DataFrame:
    """One chunk of h1 or title, and description, for each page (page, title, h1, description) that has a title or description."""
    text = F.trim(F.concat(F.coalesce(F.nullif("h1", F.lit("")), F.col("title")), F.lit(". "), F.col("description")))
    some = pages.where("title <> '' or description <> ''").withColumn("text", text)
    return some.select(
        F.concat(F.col(page).cast("string"), F.lit("_title")).alias("chunk_id"), page, F.lit("Title / Overview").alias("section"), F.lit("intro").alias("section_type"),
        "text", word_count(F.col("text")).alias("word_count"), entities(F.col("text")).alias("entities"), F.lit(0.8).alias("priority_score"), F.sha2("text", 256).alias("content_hash"),
    )


def faq_chunks(pages: DataFrame, page: str, faq: str = "faq") -> DataFrame:
    """One chunk for each question with an answer, of an array of (question, answer); numbers count all pairs."""
    pairs = pages.select(page, F.posexplode(faq).alias("i", "x")).where("x.question <> '' and x.answer <> ''")
    text = F.concat(F.lit("Q: "), F.col("x.question"), F.lit("\nA: "), F.col("x.answer"))
    return pairs.withColumn("text", text).select(
        F.concat(F.col(page).cast("string"), F.lit("_faq_"), F.format_string("%03d", F.col("i") + 1)).alias("chunk_id"), page, F.lit("FAQ").alias("section"), F.lit("faq").alias("section_type"),
        "text", word_count(F.col("text")).alias("word_count"), entities(F.col("text")).alias("entities"), F.lit(0.95).alias("priority_score"), F.sha2("text", 256).alias("content_hash"),
    )
